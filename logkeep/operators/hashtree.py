"""Comparing two logs by a tree of hashes over their offset ranges.

A leaf stands for a range of offsets of a topic-partition: how many messages it has and two
order-free sums of their hashes. Nodes above add up ``FANOUT`` ranges each, then partitions,
then topics. Two trees are compared from the top; only below nodes that differ the next level
is looked at, and rows are compared in ranges that differ alone. Leaves need a hash for each
row, which an archive has stored, so comparing two archives reads no keys and values.
"""

from pyspark.sql import functions as F

from logkeep.functions.messages import row_hash
from logkeep.operators.joins import join_small
from logkeep.operators.ordering import bucket_of
from logkeep.session import stored

WIDTH, FANOUT, LEVELS = 1 << 12, 64, 3
PLACE = ["topic", "partition"]
SUMS = ["messages", "folded", "added"]


def hashed(rows):
    """Place and hash of each row; a stored hash is used, so that payloads are not read."""
    value = F.col("row_hash") if "row_hash" in rows.columns else row_hash()
    return rows.select(*PLACE, "offset", value.alias("row_hash"))


def leaves(rows, width=WIDTH):
    """Stored (topic, partition, range) sums of hashed rows.

    The xor of a message's two copies is nothing, hence the count and a second, plain sum.
    """
    low = F.col("row_hash").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return stored(hashed(rows).groupBy(*PLACE, bucket_of("offset", width).alias("range")).agg(
        F.count(F.lit(1)).alias("messages"), F.bit_xor("row_hash").alias("folded"),
        F.sum(low).alias("added")), "leaves")


def _above(nodes, keys):
    return nodes.groupBy(*keys).agg(
        F.sum("messages").alias("messages"), F.bit_xor("folded").alias("folded"), F.sum("added").alias("added"))


def tree(nodes):
    """Levels from the topics down to the leaves, each with the keys of its nodes."""
    levels = [([*PLACE, "range"], nodes)]
    for up in range(1, LEVELS + 1):
        node = bucket_of("range", FANOUT**up).alias(f"node{up}")
        levels.append(([*PLACE, f"node{up}"], _above(nodes.withColumn(f"node{up}", node), [*PLACE, f"node{up}"])))
    for keys in (PLACE, PLACE[:1]):
        levels.append((keys, _above(levels[-1][1], keys)))
    return levels[::-1]


def differing_ranges(left, right):
    """Ranges of two sets of leaves that differ, found from the top.

    Each level keeps only children of nodes that differ; equal trees are left after the topics.
    """
    found = None
    for (keys, ours), (_, theirs) in zip(tree(left), tree(right)):
        if found is not None:
            ours, theirs = (_below(side, keys, *found) for side in (ours, theirs))
        both = ours.select(*keys, F.struct(*SUMS).alias("_l")).join(
            theirs.select(*keys, F.struct(*SUMS).alias("_r")), keys, "full_outer")
        found = keys, stored(both.where(~F.col("_l").eqNullSafe(F.col("_r"))).select(*keys), "differ")
        if found[1].isEmpty():
            break
    keys, nodes = found
    if "range" not in keys:  # equal higher up
        return left.select(*PLACE, "range").where("false")
    return nodes


def _below(nodes, keys, above, differing):
    """Nodes whose parent is among the differing ones."""
    if above[-1].startswith("node"):
        up = int(above[-1][4:])
        width = FANOUT if keys[-1] != "range" else FANOUT**up
        nodes = nodes.withColumn(above[-1], bucket_of(keys[-1], width))
    spread = keys[-1] if keys[-1] not in above else keys[0]
    return join_small(nodes, differing, above, spread, how="left_semi").select(*keys, *SUMS)


def compare(left, right, width=WIDTH):
    """(topic, partition, offset, finding) of messages that differ between two logs.

    ``lost`` is on the left only, ``added`` on the right only; ``doubled`` and ``fewer`` have
    other numbers of copies on the right; ``changed`` has other content. Rows of ranges that
    agree are not looked at again.
    """
    ranges = differing_ranges(leaves(left, width), leaves(right, width))
    keys = [*PLACE, "range"]

    def suspects(rows, name):
        placed = hashed(rows).withColumn("range", bucket_of("offset", width))
        return join_small(placed, ranges, keys, "offset", how="left_semi").groupBy(*PLACE, "offset").agg(
            F.struct(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("row_hash")).alias("h")).alias(name))

    both = suspects(left, "_l").join(suspects(right, "_r"), [*PLACE, "offset"], "full_outer")
    n = F.col("_r.n") - F.col("_l.n")
    finding = (
        F.when(F.col("_r").isNull(), "lost").when(F.col("_l").isNull(), "added")
        .when(F.col("_l.h") != F.col("_r.h"), "changed").when(n > 0, "doubled").when(n < 0, "fewer"))
    return both.select(*PLACE, "offset", finding.alias("finding")).where(F.col("finding").isNotNull())
