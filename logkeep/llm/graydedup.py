"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has a bit set if more than half the shingle hashes have it. Equal
fingerprints fold into one first. Two fingerprints at most three bits apart agree on one
of four 16-bit patterns, so the upper nodes of the index are those masked patterns: they
deal the fingerprints to Spark's tasks, four entries each. A node that holds too many is
cut again by four parts of its remaining bits, until it is small or no bits are left.
Within a node the fingerprints are sorted by Gray rank and every eight form a tree node
that holds the bits they all share and have not been factored out above. A search adds up
the differences on the way down and drops whole groups once more than three are gathered.

What a node finds is joined there into a forest, so at most one edge per entry leaves it.
Edges join into components across nodes, and documents take the smallest id of theirs.

Words are runs of non-white-space, A-Z lower-cased; a text of fewer than three words is
one shingle; null, empty or blank texts have fingerprint zero and are linked like others.
Repeated rows are copies of each other. Null ids take no part in the smallest id (null if
the component has none else). Other columns are not read by ``near_groups``.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logkeep.llm.bitnodes import NODE_ROWS, cut_width, deal, grouped
from logkeep.llm.components import components
from logkeep.llm.similar import similar_roots
from logkeep.llm.texts import as_bytes, bit_sums, hash64, lower_words, pack_rows
from logkeep.session import stored

RADIUS = 3
SHINGLE = 3
FANOUT = 8
_BATCH = 4_096


def shingles(words, size=SHINGLE):
    """Space-joined word n-grams, cut from one joined text."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= size:
        return [text] if words else []
    starts = [0, *ends]
    return [text[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]


def simhash(hashes):
    """Bits set in more than half the hashes; zero for none."""
    votes = np.zeros(64)
    for at in range(0, len(hashes), 1 << 16):
        votes += bit_sums(hashes[at : at + (1 << 16)])
    return pack_rows((2 * votes > len(hashes))[None, :])[0]


@F.arrow_udf(LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Fingerprint of each text, as the signed long of its 64 bits."""
    found = [simhash(hash64(shingles(lower_words(t)))) for t in as_bytes(text)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def gray_rank(codes):
    """Position of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Levels of nodes over codes in Gray order; each node keeps its own shared bits."""

    def __init__(self, codes):
        self.codes = codes
        ones, zeros = codes, ~codes
        levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), FANOUT)
            ones = np.bitwise_and.reduceat(ones, cuts)
            zeros = np.bitwise_and.reduceat(zeros, cuts)
            levels.append((ones, ones | zeros))
        self.levels = []
        for k, (pattern, shared) in enumerate(levels):
            above = levels[k + 1][1].repeat(FANOUT)[: len(shared)] if k + 1 < len(levels) else 0
            self.levels.append((pattern, shared & ~np.uint64(0) & ~np.asarray(above, np.uint64)))

    def near(self, first, last, radius=RADIUS):
        """Pairs (query, code) at most ``radius`` apart, queries ``first`` to ``last``."""
        query = np.arange(first, last)
        node, gathered = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
        for level, (pattern, own) in reversed(list(enumerate(self.levels))):
            differ = (self.codes[query] ^ pattern[node]) & own[node]
            gathered = gathered + np.bitwise_count(differ)
            # a pair is found from its larger member: later groups hold nothing new
            live = (gathered <= radius) & (node * FANOUT**level < query)
            query, node, gathered = query[live], node[live], gathered[live]
            if level:
                below = len(self.levels[level - 1][0])
                query, gathered = query.repeat(FANOUT), gathered.repeat(FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                query, node, gathered = (x[node < below] for x in (query, node, gathered))
        return query, node


def forest(size, pairs):
    """Smallest index reachable from each of ``size`` entries."""
    root = np.arange(size)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def node_edges(codes, radius=RADIUS):
    """Edges of a forest that joins the codes (distinct, uint64) within the radius."""
    codes = codes[np.argsort(gray_rank(codes))]
    tree = GrayTree(codes)
    batches = (tree.near(i, min(i + _BATCH, len(codes)), radius)
               for i in range(0, len(codes), _BATCH))
    root = forest(len(codes), batches)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[moved], codes[root[moved]]


def near_edges(codes, radius=RADIUS, node_rows=NODE_ROWS):
    """(a, b) edges that join all codes within the radius, one per node entry at most."""
    def edges(batches):
        for _, held in grouped(batches):
            if len(held) > 1:
                a, b = node_edges(held.view(np.uint64), radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    nodes = deal(codes, radius, cut_width(codes.count()), node_rows)
    return nodes.repartition("node").sortWithinPartitions("node").mapInPandas(
        edges, "a long, b long")


def rooted(docs, doc_id="doc_id", text="text", radius=RADIUS, node_rows=NODE_ROWS):
    """(doc_id, hash, code, root) of every row; ``hash`` is that of the text, null as empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    codes = stored(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"),
                               fingerprint(text).alias("code")), "fingerprints")
    edges = near_edges(stored(codes.select("code").distinct(), "codes"), radius, node_rows)
    roots = stored(components(edges), "roots")
    return codes.join(roots, codes["code"] == roots["node"], "left").select(
        "doc_id", "hash", "code", F.coalesce("root", "code").alias("root"))


def near_groups(docs, doc_id="doc_id", text="text", radius=RADIUS, node_rows=NODE_ROWS):
    """(doc_id, code, component_id) of every row."""
    rows = rooted(docs, doc_id, text, radius, node_rows)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "code", "component_id")


def similar_rooted(docs, doc_id, text, size, similarity):
    """(doc_id, hash, root) of every row, joined by the Jaccard of their shingle sets."""
    text = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    roots = stored(similar_roots(rows.select("hash", "text"), size, similarity), "roots")
    return rows.join(roots, rows["hash"] == roots["node"], "left").select(
        "doc_id", "hash", F.coalesce("root", "hash").alias("root"))


def keep_one(docs, doc_id="doc_id", text="text", radius=RADIUS, node_rows=NODE_ROWS,
             size=SHINGLE, similarity=None):
    """One row of ``docs`` for each group: that of the smallest id, then text hash.

    Groups are those of ``near_groups``, or with ``similarity``, those of texts whose sets of
    ``size`` words have at least that Jaccard similarity. Null ids come after all others. Rows
    alike in id and text count as one.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    rows = (rooted(docs, doc_id, text, radius, node_rows) if similarity is None
            else similar_rooted(docs, doc_id, text, size, similarity))
    kept = rows.groupBy("root").agg(F.min(first).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.hash").alias("kept_hash"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs[doc_id].alias("doc_id"),
                       F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    found = rows.join(kept, same).dropDuplicates(["doc_id", "hash"])
    return found.select("row.*")


def op2_simhash_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"),
                        "component_id")
