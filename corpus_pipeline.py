"""From raw documents to token ids: five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
``run`` writes each stage's rows as Parquet in the shared folder and reads them back for
the next, so a lost executor never costs more than one stage.
"""

from pyspark.sql import functions as F

from logkeep.llm import bpe, decontamination, graydedup, pii, quality
from logkeep.llm.texts import small_batches
from logkeep.session import stored

#: No SQL expresses the classifier; the tests run the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return graydedup.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents in which passages of the benchmark make up less than a twentieth."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.mask_pii(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark, docs, sf_dir):
    """All documents with their token ids and what these decode to."""
    small_batches(spark)
    both = bpe.round_trip(F.col("text"), bpe.read_definition()).alias("both")
    found = docs.select("doc_id", "lang", "source", "text", both)
    return found.select("doc_id", "lang", "source", "text", "both.ids",
                        F.size("both.ids").alias("n_tokens"), "both.decoded")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode_tokens),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
