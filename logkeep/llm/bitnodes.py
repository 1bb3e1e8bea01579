"""Deal 64-bit codes to nodes of bounded size so that near codes meet in one of them."""

from pyspark.sql import functions as F

from logkeep.session import stored

#: Codes that the first cut aims at for a node, and may leave in one before it is cut again.
NODE_AIM = 1_000
NODE_ROWS = 20_000


def parts_of(bits, pieces):
    """Bit places in exactly ``pieces`` lists whose lengths differ by one at most."""
    cuts = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def cut_width(count):
    """Bits of each part that the first cut uses for ``count`` codes."""
    return max(0, (count // NODE_AIM).bit_length())


def _value(bits):
    """Column expression for the chosen bits of ``code``, as one number."""
    value = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        one = F.shiftrightunsigned("code", bit).bitwiseAND(F.lit(1).cast("long"))
        value = value.bitwiseOR(F.shiftleft(one, place))
    return value


def deal(codes, radius, width, node_rows=NODE_ROWS):
    """(code, node): codes at most ``radius`` bits apart share at least one node.

    ``codes`` holds distinct longs, stored. Bits fall into ``radius + 1`` parts, so two
    near codes agree on one of them; a node is a part (its first ``width`` bits) and its
    value. Nodes of more than ``node_rows`` codes are cut again by as many parts of the
    bits not used yet, while more than half the bits are left. A node's name is the path
    of ``:part:value`` steps.
    """
    done, level = [], [(codes.select("code", F.lit("").alias("node")), list(range(64)))]
    while level:
        following = []
        for frame, bits in level:
            parts = [p[:width] for p in parts_of(bits, radius + 1)]
            dealt = frame.select("code", F.explode(F.array(*[
                F.concat_ws(":", "node", F.lit(str(i)), _value(p).cast("string"))
                for i, p in enumerate(parts)])).alias("node"))
            if len(bits) <= 32:
                done.append(dealt)
                continue
            sizes = dealt.groupBy("node").count().where(F.col("count") > node_rows)
            large = stored(sizes.select("node"), "large")
            if not large.take(1):
                done.append(dealt)
                continue
            done.append(dealt.join(large, "node", "left_anti").select("code", "node"))
            hot = stored(dealt.join(large, "node").select("code", "node"), "hot")
            for i, part in enumerate(parts):
                mine = F.element_at(F.split("node", ":"), -2) == str(i)
                following.append((hot.where(mine), [b for b in bits if b not in part]))
        width, level = 64, [(f, b) for f, b in following if f.take(1)]
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def earlier_masks(node, radius, width):
    """Masks of the parts before those on a node's path.

    A pair that also agrees on one of them meets in an earlier node; looking for it in the
    first one only counts every pair once.
    """
    masks, bits = [], list(range(64))
    for step in [int(x) for x in node.split(":")[1::2]]:
        parts = [p[:width] for p in parts_of(bits, radius + 1)]
        masks += [sum(1 << b for b in p) for p in parts[:step]]
        bits, width = [b for b in bits if b not in parts[step]], 64
    return masks


def grouped(batches):
    """(node, codes) of consecutive equal nodes in sorted pandas batches."""
    import numpy as np

    held, key = [], None
    for batch in batches:
        node, code = batch["node"].to_numpy(), batch["code"].to_numpy()
        if not len(node):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        for at, piece in zip(cuts, np.split(code, cuts[1:])):
            if node[at] != key and held:
                yield key, np.concatenate(held)
                held = []
            key = node[at]
            held.append(piece)
    if held:
        yield key, np.concatenate(held)
