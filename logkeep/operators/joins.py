"""Joins against a side that is expected, but not known, to be small."""

from pyspark.sql import functions as F

SMALL_ROWS = 500_000
SMALL_BYTES = 64 << 20
#: Rows of one key that a piece of a salted join aims at.
PIECE_ROWS = 1_000_000


def text_bytes(df):
    """Bytes of all values of ``df``, as the length of their JSON text."""
    return F.sum(F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns]))))


def local_if_small(df, max_rows=SMALL_ROWS, max_bytes=SMALL_BYTES):
    """``df`` as a local relation if it fits the bounds, else None.

    Rows and bytes are counted where they are; only a side within both bounds is fetched.
    """
    rows, size = df.agg(F.count(F.lit(1)), text_bytes(df)).first()
    if rows > max_rows or (size or 0) > max_bytes:
        return None
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def join_small(big, small, on, spread, how="inner", salts=None,
               max_rows=SMALL_ROWS, max_bytes=SMALL_BYTES):
    """Broadcast ``small`` when its measured size allows, else a salted join.

    ``spread`` is a column of ``big`` that varies inside one join key, so that a
    key holding much of ``big`` is cut into ``salts`` pieces, by default as many as
    its largest key needs.
    """
    local = local_if_small(small, max_rows, max_bytes)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    if salts is None:
        largest = big.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        salts = max(1, -(-largest // PIECE_ROWS))
    if salts == 1:
        return big.join(small, on, how)
    pieces = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = small.withColumn("_salt", F.explode(pieces))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
