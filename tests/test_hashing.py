from pyspark.sql import functions as F

from logkeep.functions.hashing import fnv32, fnv64, seeded_bucket

# Published test vectors.
VECTORS = {
    "": (0x811C9DC5, 0xCBF29CE484222325),
    "a": (0xE40C292C, 0xAF63DC4C8601EC8C),
    "foobar": (0xBF9CF968, 0x85944171F73967E8),
}


def test_vectors(spark):
    df = spark.createDataFrame([(k,) for k in VECTORS], "x string")
    rows = df.select("x", fnv32(F.col("x")).alias("h"), fnv64(F.col("x")).alias("g")).collect()
    assert {r.x: (r.h, int(r.g)) for r in rows} == VECTORS


def test_long_and_multibyte_text(spark):
    text = "тема-" * 500
    want32, want64 = 0x811C9DC5, 0xCBF29CE484222325
    for b in text.encode():
        want32 = ((want32 ^ b) * 16777619) % 2**32
        want64 = ((want64 ^ b) * 1099511628211) % 2**64
    row = spark.createDataFrame([(text,)], "x string").select(
        fnv32(F.col("x")).alias("h"), fnv64(F.col("x")).alias("g")
    ).first()
    assert (row.h, int(row.g)) == (want32, want64)


def test_bucket(spark):
    h = 0x811C9DC5
    for b in b"42:orders":
        h = ((h ^ b) * 16777619) % 2**32
    row = spark.createDataFrame([("orders",)], "x string").select(
        seeded_bucket(F.col("x"), 42, 3).alias("w")
    ).first()
    assert row.w == h % 3
