"""Document fingerprints: weighted SimHash and permuted block tables.

Every distinct word of a text votes with its hash on 64 signed bits, with a weight that
grows with the logarithm of its count and with its length; a bit is set if its sum is
positive. To find all fingerprints within a Hamming radius, the bits are permuted so that
each block in turn comes first and is the key of one table: near fingerprints share the
key of at least one. A pair is taken in the first such table only. Crowded keys are cut
by blocks of their remaining bits.

Words are runs of non-white-space, A-Z lower-cased; null, empty and blank texts have
fingerprint zero. Documents are ordered by id, null ids first, then by text. Repeated rows
are documents of their own: the next document of the first is the second. The document
after the last is the first; a lone document follows itself. Other columns are not read.
"""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from logkeep.llm.bitnodes import NODE_ROWS, cut_width, deal, earlier_masks, grouped
from logkeep.llm.texts import bit_sums, hash64, pack_rows
from logkeep.session import stored

RADIUS = 3
#: Text bytes that one range of ids aims at.
RANGE_BYTES = 24 << 20
_ROWS = 256


def weighted_simhash(text):
    """Fingerprint of a text (str) as an int."""
    counts = Counter(text.encode().lower().split())
    if not counts:
        return 0
    words, n = list(counts), len(counts)
    sizes = np.minimum(np.fromiter(map(len, words), np.float64, n), 16)
    weights = np.rint(8 * sizes * (1 + np.log(np.fromiter(counts.values(), np.float64, n))))
    votes = 2 * bit_sums(hash64(words), weights) - weights.sum()
    return int(pack_rows((votes > 0)[None, :])[0])


def likeness(a, b):
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


def edited(text, following):
    """``text`` with its second half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _signed(code):
    return code - (1 << 64) if code >> 63 else code


def neighbours(docs, doc_id="doc_id", text="text", range_bytes=RANGE_BYTES):
    """Facts of every document, its edited text and the next document.

    Ids are cut into ranges at known ids. A range is one bucket, sorted; the first document
    of a range also goes to the bucket before, so every document meets the next one while
    texts are shuffled once. A bucket is streamed row by row. Only the borders, eight bytes
    for each ``range_bytes`` of text, are known to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("size"),
                     F.min(F.struct("doc_id", "hash")).alias("first")).first()
    ranges = max(1, -(-(facts["size"] or 0) // range_bytes))
    borders = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        borders = docs.agg(F.percentile_approx(F.col(doc_id), shares, 100 * ranges)).first()[0]
        borders = sorted(set(borders or []))
    first, last = facts["first"], len(borders)

    @F.arrow_udf("array<int>")
    def buckets(doc_id: pa.Array) -> pa.Array:
        cuts, out = np.array(borders, np.int64), []
        for i in doc_id.to_pylist():
            place = 0 if i is None else int(np.searchsorted(cuts, i, "right"))
            also = place and cuts[place - 1] == i
            out.append([place, place - 1] if also else [place])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", "hash", F.posexplode(buckets("doc_id")).alias("tail", "bucket"))
    if first is not None:
        wrap = rows.where(F.col("doc_id").eqNullSafe(F.lit(first["doc_id"]))
                          & (F.col("hash") == first["hash"]))
        dealt = dealt.unionAll(wrap.select(
            "doc_id", "text", "hash", F.lit(1).alias("tail"), F.lit(last).alias("bucket")))
    order = ["bucket", "tail", F.asc_nulls_first("doc_id"), "hash", "text"]
    dealt = dealt.repartitionByRange(last + 1, "bucket").sortWithinPartitions(*order)

    def walk(batches):
        held = done = None
        out = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")]
            for bucket, tail, one_id, one_text in zip(*columns):
                if tail and done == bucket:
                    continue
                fresh = (bucket, one_id, one_text, weighted_simhash(one_text))
                if held and held[0] == bucket:
                    out.append(_facts(held, fresh))
                held = None if tail else fresh
                done = bucket if tail else done
            if out:
                yield _table(out)
                out = []

    schema = ("doc_id long, n_chars long, edited_sha256 string, code long, edited_code long, "
              "near_edited double, near_next double")
    return dealt.mapInArrow(walk, schema)


def _facts(held, fresh):
    _, one_id, text, code = held
    changed = edited(text, fresh[2])
    other = weighted_simhash(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (one_id, len(text), digest, _signed(code), _signed(other),
            likeness(code, other), likeness(code, fresh[3]))


def _table(rows):
    names = "doc_id n_chars edited_sha256 code edited_code near_edited near_next".split()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def bucket_counts(codes, masks, radius=RADIUS):
    """Codes within the radius of each code, over pairs that agree on none of the masks."""
    counts = np.zeros(len(codes), np.int64)
    masks = [np.uint64(m) for m in masks]
    for at in range(0, len(codes), _ROWS):
        differ = codes[at : at + _ROWS, None] ^ codes[None, :]
        i, j = np.nonzero(np.bitwise_count(differ) <= radius)
        differ, fresh = differ[i, j], i + at != j
        for m in masks:
            fresh &= (differ & m) != 0
        counts[at : at + _ROWS] += np.bincount(i[fresh], minlength=len(counts[at : at + _ROWS]))
    return counts


def near_counts(codes, radius=RADIUS, node_rows=NODE_ROWS):
    """(code, n_near) for each of the distinct codes that has others within the radius."""
    width = cut_width(codes.count())

    def count(batches):
        for node, held in grouped(batches):
            if len(held) > 1:
                found = bucket_counts(held.view(np.uint64), earlier_masks(node, radius, width), radius)
                some = found > 0
                yield pd.DataFrame({"code": held[some], "n_near": found[some]})

    nodes = deal(codes, radius, width, node_rows)
    parts = nodes.repartition("node").sortWithinPartitions("node").mapInPandas(
        count, "code long, n_near long")
    return parts.groupBy("code").agg(F.sum("n_near").alias("n_near"))


def op7_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = stored(neighbours(docs), "neighbours")
    near = near_counts(stored(found.select("code").distinct(), "codes"))
    hexed = {n: F.lpad(F.lower(F.hex(c)), 16, "0").alias(n)
             for n, c in (("fingerprint", "code"), ("edited_fingerprint", "edited_code"))}
    return found.join(near, "code", "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed["fingerprint"], hexed["edited_fingerprint"],
        "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
