"""Texts whose sets of word shingles are alike, linked by min-hash bands and the true Jaccard.

Each distinct text has ``BANDS`` keys of ``ROWS`` minimum hashes. Texts that share a key meet
in one task, which compares their whole shingle sets; only a Jaccard similarity of at least the
threshold links. Two texts at 0.8 share no key with chance 2e-6 (``(1 - 0.8**4) ** 25``), more
alike ones with less. Buckets of equal members are looked at once, and a text is not compared
with what it is linked to already.

Words are runs of non-white-space, A-Z lower-cased; a text of fewer words than a shingle is one
shingle, and so are null, empty and blank texts, all the same.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from logkeep.llm.components import components
from logkeep.llm.texts import as_bytes, hash64, lower_words
from logkeep.session import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4


def shingle_set(text, size=SHINGLE):
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = lower_words(text)
    found = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.unique(hash64(found))


def band_keys(hashes):
    """One 64-bit key for each band of minimum hashes."""
    draw = np.random.Generator(np.random.PCG64(7))
    flips, factors = draw.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
    least = np.array([((hashes ^ f) * (a * np.uint64(2) + np.uint64(1))).min() for f, a in zip(flips, factors)])
    return [h for h in hash64([r.tobytes() for r in least.reshape(BANDS, ROWS)]).view(np.int64)]


def linked(sets, similarity):
    """Pairs of places that join all sets at least that similar to one another."""
    root, pairs = list(range(len(sets))), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if find(i) == find(j) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both):
                root[find(i)] = find(j)
                pairs.append((i, j))
    return pairs


def similar_roots(texts, size=SHINGLE, similarity=SIMILARITY):
    """(node, root) of the hashes of ``texts`` (hash, text) that are similar to others."""
    def keys(batches):
        for batch in batches:
            found = [band_keys(shingle_set(t, size)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("hash").to_numpy(), BANDS)),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(found))),
                pa.array(np.array(found, np.int64).reshape(-1))], ["hash", "band", "key"])

    bands = stored(texts.mapInArrow(keys, "hash long, band int, key long").distinct(), "bands")
    buckets = bands.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.bit_xor("hash").alias("x"),
        F.bit_xor(F.xxhash64("hash")).alias("y")).where("n > 1")
    once = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("k")).select("k.*")
    members = stored(bands.join(once, ["band", "key"]), "members")
    rows = texts.join(members, "hash").dropDuplicates(["hash", "band", "key"])

    def edges(group):
        values = group["hash"].to_numpy()
        found = linked([shingle_set((t or "").encode(), size) for t in group["text"]], similarity)
        ends = values[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return components(rows.groupBy("band", "key").applyInPandas(edges, "a long, b long"))
