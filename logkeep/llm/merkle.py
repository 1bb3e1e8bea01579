"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels by slot arrays.

A row's leaf is the hash of its fields. In every group (language) the leaves ascend by id, and
runs of eight become a node, level by level, until one is left: the group's subroot. Subroots,
ordered by group, make the root alike. A proof is a node's siblings on the way up.

Where a leaf lies is found without sorting. Each group's ids make a compressed bitmap: its
non-zero words of 64 bits, one row each, which partial aggregation merges by ``bit_or``. A
directory of popcounts sums the words in four levels of at most 2^15 children, so the count of
ids before a word takes windows of bounded length only; the rank of an id is that count and the
popcount of the lower bits of its word. Words in which an id repeats are ranked row by row.

A leaf's place gives the key of its block and its slot there. A block has 512 slots, three
levels of the tree, and is folded in one task; the blocks' nodes are the next round's leaves.
Proofs go the other way: a block gets the siblings above it once, for all its leaves.

Rows of one id in one group follow each other by leaf; equal rows are interchangeable. A null
id comes before all others; a null group comes first, apart from the empty one; null fields
hash as a dash; empty and very long texts hash like any other. An empty table gives no rows.
Columns that are not fields are not read. Groups are expected to be few: the driver holds one
hash for each, at most ``GROUPS``; more raise a ValueError.
"""

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from logkeep.operators.ordering import number_within
from logkeep.session import sized_shuffles, stored

FANOUT = 8
#: Levels of the tree in one block, and slots of a block.
LEVELS = 3
SLOTS = FANOUT**LEVELS
#: Bits of a directory level's fan-out, and shifts from words to its three upper levels.
_FAN_BITS = 15
_SHIFTS = tuple(_FAN_BITS * i for i in (1, 2, 3))
#: The word of null ids, below those of all 64-bit ids.
_NULL_WORD = -(1 << 57) - 1
GROUPS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:binary,right:binary>>"
_GROUP = "_group"


def digest(data):
    """Hash of bytes as hex text."""
    return hashlib.sha256(data).hexdigest().encode()


def leaf_hash(fields):
    """Column of the binary hash of string columns, each with its length in bytes."""
    parts = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f))
             for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs, changed_text=None, when=None, fields=FIELDS, doc_id="doc_id", group="lang", text="text"):
    """Stored (_group, doc_id, leaf, other, row), one for each row of ``docs``.

    ``other`` is the leaf with ``changed_text`` in place of the text where ``when`` holds, else
    null. Only hashes are kept, so the texts are read once.
    """
    values = [F.col(f).cast("string") for f in fields]
    changed = [changed_text if f == text else v for f, v in zip(fields, values)]
    other = F.when(when, leaf_hash(changed)) if when is not None else F.lit(None).cast("binary")
    name = F.col(group).cast("string")
    return stored(docs.select(
        # null first: the empty text is below every marked name
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias(_GROUP),
        F.col(doc_id).cast("long").alias("doc_id"), leaf_hash(values).alias("leaf"), other.alias("other"),
        F.monotonically_increasing_id().alias("row")), "leaves")


def _total_before(keys, order):
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(rows), F.lit(0))


def bitmaps(rows):
    """Stored (_group, word, bits, n, before): words of each group's bitmap and its directory.

    ``n`` counts the rows of a word and ``before`` those of all words before it.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("low"))
    words = stored(rows.groupBy(_GROUP, "word").agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")), "words")
    levels = [words]
    for i, _ in enumerate(_SHIFTS):
        below = "word" if i == 0 else f"_up{i - 1}"
        up = F.shiftright(below, _FAN_BITS).alias(f"_up{i}")
        levels[i] = levels[i].withColumn(f"_up{i}", up)
        levels.append(levels[i].groupBy(_GROUP, f"_up{i}").agg(F.sum("n").alias("n")))
    top = levels[-1].withColumn("_base", _total_before([_GROUP], f"_up{len(_SHIFTS) - 1}")).drop("n")
    for i in reversed(range(len(_SHIFTS))):
        own = "word" if i == 0 else f"_up{i - 1}"
        keys = [_GROUP, f"_up{i}"]
        found = levels[i].withColumn("_in", _total_before(keys, own)).join(top, keys)
        found = found.withColumn("_base", F.col("_base") + F.col("_in"))
        top = found.select(_GROUP, own, "_base", *(["bits", "n"] if i == 0 else []))
    return stored(top.withColumnRenamed("_base", "before"), "bitmaps")


def placed(rows):
    """Rows with ``pos``, their place among their group's leaves, from 0."""
    id64 = F.col("doc_id")
    rows = rows.withColumn("word", F.coalesce(F.shiftright(id64, 6), F.lit(_NULL_WORD))).withColumn(
        "low", F.coalesce(id64.bitwiseAND(F.lit(63).cast("long")), F.lit(0)).cast("int"))
    maps, keys = bitmaps(rows), [_GROUP, "word"]
    once = F.bit_count("bits") == F.col("n")
    lower = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("low"))))
    kept = [_GROUP, "doc_id", "leaf", "other", "pos"]
    found = rows.join(maps.where(once), keys).withColumn("pos", F.col("before") + F.bit_count(lower)).select(*kept)
    crowded = maps.where(~once).select(*keys, "before")
    if crowded.isEmpty():
        return found
    again = rows.join(crowded, keys).withColumn("_slice", F.shiftright("row", 33))
    again = number_within(again, keys, ["low", "leaf", "row"], "_place", buckets=["low", "leaf", "_slice"])
    return found.unionByName(again.withColumn("pos", F.col("before") + F.col("_place")).select(*kept))


def depth_of(n):
    """Levels above ``n`` leaves: the octal digits of the last place."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 8)))


def in_blocks(nodes, fields):
    """(_group, block, depth, nodes): slots of each block with their ``fields``."""
    slot = F.col("pos").bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int").alias("slot")
    block = F.call_function("div", F.col("pos"), F.lit(SLOTS)).alias("block")
    return nodes.groupBy(_GROUP, block).agg(
        F.max("depth").alias("depth"), F.collect_list(F.struct(slot, *fields)).alias("nodes"))


def tree(hashes, levels):
    """Levels of nodes above a list of hashes, itself the first."""
    rows = [hashes]
    for _ in range(levels):
        last = rows[-1]
        rows.append([digest(b"".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return rows


def steps(rows, slot):
    """(left, right) siblings of a slot at each level but the last."""
    out = []
    for level in rows[:-1]:
        first = slot // FANOUT * FANOUT
        out.append((b"".join(level[first:slot]), b"".join(level[slot + 1 : first + FANOUT])))
        slot //= FANOUT
    return out


def fold(own, path):
    """Root from a hash and its siblings."""
    return reduce(lambda h, step: digest(step[0] + h + step[1]), path, own)


def _slots(nodes, i):
    """Fields of block ``i`` of an Arrow list array, in slot order, as lists."""
    a, b = nodes.offsets[i].as_py(), nodes.offsets[i + 1].as_py()
    own = nodes.values.slice(a, b - a)
    order = pa.array(np.argsort(own.field("slot").to_numpy()))
    return {f.name: own.field(f.name).take(order).to_pylist() for f in own.type}


def _hexed(values):
    return [v.hex().encode() for v in values]


@F.arrow_udf(BinaryType())
def _top(nodes: pa.Array, depth: pa.Array) -> pa.Array:
    """Node above each block of nodes."""
    tops = []
    for i, levels in enumerate(depth.to_pylist()):
        rows = tree(_hexed(_slots(nodes, i)["leaf"]), min(levels, LEVELS))
        tops.append(bytes.fromhex(rows[-1][0].decode()))
    return pa.array(tops, pa.binary())


@dataclass(frozen=True)
class Manifest:
    """Blocks of each round, from the leaves up, with what lies above each group's top block."""

    rounds: tuple[DataFrame, ...]
    groups: tuple  # (group, leaves, depth, subroot, steps to the root), in order
    root: str | None

    def subroots(self):
        """(lang, n, subroot) rows."""
        return [(None if g == "" else g[1:], n, top.decode()) for g, n, _, top, _ in self.groups]


def build(rows, groups=GROUPS):
    """Manifest of stored leaves."""
    sizes = rows.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", depth_of(F.col("n")))
    known = sizes.limit(groups + 1).collect()
    if len(known) > groups:
        raise ValueError(f"more than {groups} groups")
    if not known:
        return Manifest((), (), None)
    spark = rows.sparkSession
    sizes = spark.createDataFrame([(r[_GROUP], r["depth"]) for r in known], f"{_GROUP} string, depth int")
    nodes = placed(rows).join(F.broadcast(sizes), _GROUP)  # at most GROUPS rows
    rounds, tops, fields = [], {}, ["doc_id", "leaf", "other"]
    for _ in range(1 + (max(0, max(r["depth"] for r in known) - 1)) // LEVELS):
        rounds.append(stored(in_blocks(nodes, fields), f"blocks{len(rounds)}"))
        above = stored(rounds[-1].select(
            _GROUP, F.col("block").alias("pos"), (F.col("depth") - LEVELS).alias("depth"),
            _top("nodes", "depth").alias("leaf")), f"nodes{len(rounds)}")
        # one node is left of these groups
        tops.update({r[_GROUP]: r["leaf"].hex().encode() for r in above.where("depth <= 0").collect()})
        nodes, fields = above.where("depth > 0"), ["leaf"]
    return _joined(rounds, sorted(known, key=lambda r: r[_GROUP].encode()), tops)


def _joined(rounds, known, tops):
    hashes, levels = [tops[r[_GROUP]] for r in known], 0
    while FANOUT**levels < len(hashes):
        levels += 1
    above = tree(hashes, levels)
    groups = tuple((r[_GROUP], r["n"], r["depth"], tops[r[_GROUP]], steps(above, i)) for i, r in enumerate(known))
    return Manifest(tuple(rounds), groups, above[-1][0].decode())


def _with_paths(blocks, paths):
    return blocks.join(paths, [_GROUP, "block"])


def _spread(batches):
    """Path of every node of blocks that come with the path above them."""
    for batch in batches:
        nodes, above = batch.column("nodes"), batch.column("above")
        for i, (group, block, depth) in enumerate(zip(*(batch.column(c).to_pylist() for c in (_GROUP, "block", "depth")))):
            rows = tree(_hexed(_slots(nodes, i)["leaf"]), min(depth, LEVELS))
            upper = [(s["left"], s["right"]) for s in above[i].as_py()]
            paths = [[*steps(rows, s), *upper] for s in range(len(rows[0]))]
            kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
            yield pa.RecordBatch.from_arrays([
                pa.array([group] * len(paths)), pa.array(np.arange(len(paths)) + block * SLOTS),
                pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind)], [_GROUP, "block", "above"])


PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def _prover(subroots, root):
    def prove(batches):
        for batch in batches:
            nodes, above = batch.column("nodes"), batch.column("above")
            for i, (group, depth) in enumerate(zip(*(batch.column(c).to_pylist() for c in (_GROUP, "depth")))):
                own = _slots(nodes, i)
                rows = tree(_hexed(own["leaf"]), min(depth, LEVELS))
                upper = [(s["left"], s["right"]) for s in above[i].as_py()]
                tail, proof, folded = b"".join(a + b for a, b in upper), [], []
                for slot, (leaf, other) in enumerate(zip(rows[0], own["other"])):
                    path = steps(rows, slot)
                    proof.append(digest(b"".join(a + b for a, b in path) + tail).decode())
                    start = leaf if other is None else other.hex().encode()
                    folded.append(fold(fold(start, path), upper).decode())
                n = len(proof)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own["doc_id"], pa.int64()), pa.array([h.decode() for h in rows[0]]),
                    pa.array([subroots[group]] * n), pa.array([root] * n), pa.array(proof), pa.array(folded),
                    pa.array([f == root for f in folded])], [c.split()[0] for c in PROOFS.split(", ")])

    return prove


def proofs(manifest, spark):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``folded_root`` starts from the leaf's other hash where it has one.
    """
    if not manifest.rounds:
        return spark.createDataFrame([], PROOFS)
    paths = None
    for i in reversed(range(len(manifest.rounds))):
        # groups whose topmost block is in this round
        tops = [(g, 0, [dict(zip(("left", "right"), s)) for s in path]) for g, _, depth, _, path in manifest.groups
                if max(0, depth - 1) // LEVELS == i]
        own = spark.createDataFrame(tops, f"{_GROUP} string, block long, above {_STEPS}")
        paths = own if paths is None else paths.unionByName(own)
        found = _with_paths(manifest.rounds[i], paths)
        if i:
            paths = stored(found.mapInArrow(_spread, f"{_GROUP} string, block long, above {_STEPS}"), f"paths{i}")
    subroots = {g: top.decode() for g, _, _, top, _ in manifest.groups}
    return found.mapInArrow(_prover(subroots, manifest.root), PROOFS)


def op13_merkle_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    with sized_shuffles(docs):
        rows = leaves(docs, F.translate("text", UPPER, LOWER), third)
        return proofs(build(rows), spark)


#: The same in SQL: crc32 bit by bit, levels by recursion.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), leaf AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM leaf
), up AS (
  SELECT 0 AS level, g, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM up WHERE n > 1 GROUP BY level, g, pos // 8, n
), sub AS (
  SELECT g, h AS subroot FROM up WHERE n = 1
), up2 AS (
  SELECT 0 AS level, g AS pos, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM up2 WHERE n > 1 GROUP BY level, pos // 8, n
), top AS (
  SELECT h AS root FROM up2 WHERE n = 1
), steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY stage, level) - 1 AS k, left_of, right_of FROM (
    SELECT p.r, 0 AS stage, u.level,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < p.pos >> (3 * u.level)), '') AS left_of,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > p.pos >> (3 * u.level)), '') AS right_of
    FROM placed p JOIN up u ON u.g = p.g AND u.n > 1 AND u.pos >> 3 = p.pos >> (3 * u.level + 3)
    GROUP BY p.r, u.level
    UNION ALL
    SELECT p.r, 1, u.level,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < p.g >> (3 * u.level)), ''),
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > p.g >> (3 * u.level)), '')
    FROM placed p JOIN up2 u ON u.n > 1 AND u.pos >> 3 = p.g >> (3 * u.level + 3)
    GROUP BY p.r, u.level)
), proof AS (
  SELECT r, count(*) AS k, string_agg(left_of || right_of, '' ORDER BY k) AS proof FROM steps GROUP BY r
), fold AS (
  SELECT r, CAST(0 AS BIGINT) AS k, other AS h FROM placed
  UNION ALL
  SELECT f.r, f.k + 1, sha256(left_of || h || right_of) FROM fold f JOIN steps s ON s.r = f.r AND s.k = f.k
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, fold.h AS folded_root,
  fold.h = root AS verified
FROM placed LEFT JOIN proof USING (r) JOIN sub USING (g) JOIN fold ON fold.r = placed.r AND fold.k = coalesce(proof.k, 0), top
"""
