"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic scorer that minimises
the non-negative unbiased risk: the prior times the positives' loss, plus the negatives'
risk, which is the unlabelled texts' loss as negatives less the prior's share of the
positives', never below zero. Where that part turns negative its gradient is followed
upwards, as the estimator's authors do. Labelled negatives serve one purpose: the share of
positives among the labels estimates the class prior.

Scores read the text only. The fit takes at most ``FIT_ROWS`` positives and as many
unlabelled texts, those of the smallest id hashes; every text is scored. Rows whose
crc32(id) mod 5 is 0 are held out of both. Null and empty texts have zero features and a
score like any other text; null ids are held in; labels without quality or with a null id
are ignored; without positives, or with no unlabelled text, every score is one half.
Repeated rows score alike. Other columns are not read, or kept as they are by ``keep_good``.
"""

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logkeep.llm.texts import as_bytes

#: Most positives, and most unlabelled texts, that the fit reads.
FIT_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_STEPS, _RATE, _DECAY = 800, 0.05, 1e-3


def features(text):
    """Style of a text: marks, case, repetition, lengths (float vector)."""
    words = text.lower().split()
    out = np.zeros(len(_MARKS) + 14)
    if not words:
        return out
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    lines = text.split(b"\n")
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    out[: len(_MARKS)] = np.sqrt(hist[_MARKS] / n)
    out[len(_MARKS) :] = (
        1, np.log1p(n), np.sqrt(upper / (upper + lower + 1)), len(text) / n,
        np.sqrt(sum(map(operator.eq, words, words[1:])) / n), len(set(words)) / n,
        len(set(words)) / n * np.log1p(n), marked / n,
        np.sqrt(hist[48:58].sum() / n), np.sqrt(hist[128:].sum() / n),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(map(len, words)) / n, np.sqrt(words.count(words[n // 2]) / n))
    return out


def _table(column):
    texts = as_bytes(column)
    return np.array([features(t) for t in texts]).reshape(len(texts), len(_MARKS) + 14)


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, table):
        if self.weights is None:
            return np.full(len(table), 0.5)
        z = np.clip((table - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z))


def fit(positive, unlabelled, prior):
    """Minimise the non-negative risk by Adam over all rows given."""
    if not len(positive) or not len(unlabelled):
        return Scorer(None, None, None, 0.0)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))] for x in (positive, unlabelled))
    w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
    for step in range(1, _STEPS + 1):
        fp, fu = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        negative = -np.log(1 - fu + 1e-12).mean() + prior * np.log(1 - fp + 1e-12).mean()
        slope = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
        slope = prior * (p.T @ (fp - 1)) / len(p) + slope if negative >= 0 else -slope
        slope[:-1] += _DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= _RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def held_out(doc_id):
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def _smallest(ids, rows):
    """``ids`` (distinct) of the smallest hashes, at most ``rows``."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _features_of(docs, ids, rows):
    texts = docs.join(F.broadcast(ids), "doc_id").select("text").limit(rows)

    def tables(batches):
        for batch in batches:
            table = _table(batch.column("text"))
            data = pa.array(table.reshape(-1))
            cuts = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, data)], ["x"])

    found = texts.mapInArrow(tables, "x array<double>").toArrow().column("x").to_pylist()
    return np.array(found).reshape(len(found), len(_MARKS) + 14)


def train(docs, labels, doc_id="doc_id", text="text", rows=FIT_ROWS):
    """Scorer from the labels and texts that are not held out."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
        ~held_out("doc_id") & F.col("doc_id").isNotNull())
    known = labels.select("doc_id", "quality").where(
        ~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    facts = known.agg(F.count("*").alias("n"), F.sum(F.expr("int(quality = 1)")).alias("p")).first()
    prior = min(0.99, max(0.01, (facts["p"] or 0) / facts["n"])) if facts["n"] else 0.5
    trusted = _smallest(known.where("quality = 1").select("doc_id"), rows)
    others = _smallest(own.select("doc_id"), rows)
    return fit(_features_of(own, trusted, rows), _features_of(own, others, rows), prior)


def score(text, scorer):
    """Column of scores of a text column."""
    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        return pa.array(scorer(_table(text)))

    return scores(text)


def keep_good(docs, labels, doc_id="doc_id", text="text", threshold=THRESHOLD):
    """Rows of ``docs`` that score at least the threshold."""
    return docs.where(score(docs[text], train(docs, labels, doc_id, text)) >= threshold)


def op10_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"),
                        score(F.col("text"), scorer).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
