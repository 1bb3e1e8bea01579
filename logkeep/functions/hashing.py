"""FNV-1a hashes and hash buckets as column expressions."""

from pyspark.sql import functions as F

# Fixed values of FNV-1a.
FNV32_OFFSET = 2166136261
FNV32_PRIME = 16777619
FNV64_OFFSET_HIGH = 3421674724
FNV64_OFFSET_LOW = 2216829733
FNV64_PRIME_LOW = 435  # the 64-bit prime is 2**40 + 435
MASK32 = 4294967295


def _bytes_of(text):
    """UTF-8 bytes of a string column as array<bigint>."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(data)
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"),
        )
    )


def fnv32(text):
    """FNV-1a 32 of a string column, 0 .. 2^32-1 as bigint."""
    return F.aggregate(
        _bytes_of(text),
        F.lit(FNV32_OFFSET).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(MASK32)),
    )


def fnv64(text):
    """FNV-1a 64 of a string column as decimal(20,0).

    The state is kept in two 32-bit halves because a 64-bit product overflows
    bigint: with prime 2**40 + 435 the low half adds ``low * 256`` to the high one.
    """

    def step(h, b):
        low = h["low"].bitwiseXOR(b)
        product = low * F.lit(FNV64_PRIME_LOW)
        high = (
            h["high"] * F.lit(FNV64_PRIME_LOW)
            + low.bitwiseAND(F.lit(0xFFFFFF)) * F.lit(256)
            + F.shiftright(product, 32)
        )
        return F.struct(
            high.bitwiseAND(F.lit(MASK32)).alias("high"),
            product.bitwiseAND(F.lit(MASK32)).alias("low"),
        )

    start = F.struct(
        F.lit(FNV64_OFFSET_HIGH).cast("bigint").alias("high"),
        F.lit(FNV64_OFFSET_LOW).cast("bigint").alias("low"),
    )
    return F.aggregate(
        _bytes_of(text),
        start,
        step,
        lambda h: (
            h["high"].cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)")
            + h["low"].cast("decimal(20,0)")
        ).cast("decimal(20,0)"),
    )


def seeded_bucket(text, seed, buckets):
    """``fnv32("<seed>:<text>") mod buckets``; hash-mod, not a ring."""
    return (fnv32(F.concat(F.lit(f"{seed}:"), text)) % F.lit(buckets)).cast("int")
