"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams, most frequent first. A document's own
list is compared with each profile by the out-of-place distance: for every n-gram of the
document, how far its rank there lies from its rank in the profile, or the profile's length
where the profile lacks it. The nearest language wins. The score is one less the distance's
share of the largest possible one, which every n-gram out of place would give.

N-grams have one to three symbols. Letters and combining marks are lower-cased symbols;
everything else parts words, and runs of it are one blank, so an n-gram may begin or end with
a blank but has none inside. Of equally frequent n-grams the shorter ranks first, then the one
of lower code points.

Counts cover the whole texts of all documents that are not held out and have a language;
each task adds up its own before they are shuffled, and only the best ranks of each language
leave the partitions. Profiles are the sole thing that the driver holds: ``RANKS`` entries for
at most ``LANGUAGES`` languages; more raise a ValueError.

A null or empty text, or one without a letter, is ``und`` with score 0; so is every text when
nothing was learned. Ties go to the language that comes first by its bytes. Null ids are not
held out; null languages teach nothing; repeated rows count as often as they occur and are
predicted alike; very long texts are read in pieces. An empty table gives no rows. Other
columns are not read by the query and kept as they are by ``with_language``.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from logkeep.llm.texts import as_bytes, per_process, struct_array

RANKS = 400
#: Most languages whose profiles are shipped to the tasks (about 60 MB).
LANGUAGES = 10_000
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Code points handled at once, and entries that a task's counts may reach before they leave.
PIECE, HELD = 1 << 20, 1 << 20
_BLANK, _WIDTH = 32, 21
#: Beyond the first four planes there are no letters; the last code point below stands for them.
_PLANES = 0x40000
_LAST, _LAST_TWO = (1 << _WIDTH) - 1, (1 << 2 * _WIDTH) - 1


def _classes():
    """Of each code point: whether it is a symbol (letter or mark), and whether a letter."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(_PLANES)], np.uint8)
    return (kinds == ord("L")) | (kinds == ord("M")), kinds == ord("L")


def places(text):
    """Distinct places of a text and their counts; none if it has no letter.

    A place is a symbol or blank with the two before it, 21 bits each, the last one lowest,
    0 before the beginning. Every n-gram is the end of one place, so one sort counts all.
    """
    symbol, letter = per_process("letters and marks", _classes)
    tail, found, seen = np.array([_BLANK]), [], False
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le"), "<u4")
        codes = np.minimum(codes, _PLANES - 1)
        seen = seen or bool(letter[codes].any())
        piece = np.where(symbol[codes], codes, _BLANK).astype(np.int64)
        if start + PIECE >= len(text):
            piece = np.append(piece, _BLANK)
        row = np.concatenate([tail, piece])
        kept = np.ones(len(row), bool)
        kept[1:] = (row[1:] != _BLANK) | (row[:-1] != _BLANK)
        new, row = np.count_nonzero(kept[len(tail) :]), row[kept]
        before = np.concatenate([[0, 0], row])
        found.append((row | before[1:-1] << _WIDTH | before[:-2] << 2 * _WIDTH)[len(row) - new :])
        tail = row[-2:]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(found), return_counts=True)


def added(parts):
    """Sum of several (keys, counts)."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)


def grams(keys, counts):
    """All n-grams of the given places and their counts."""
    one = keys & _LAST != _BLANK
    three = (keys >> 2 * _WIDTH != 0) & (keys >> _WIDTH & _LAST != _BLANK)
    return added([(keys[one] & _LAST, counts[one]), (keys & _LAST_TWO, counts), (keys[three], counts[three])])


def top(keys, counts, ranks):
    """The most frequent keys, most frequent first."""
    return keys[np.lexsort((keys, -counts))[:ranks]]


def gram_text(key):
    """The symbols of an n-gram."""
    codes = (key >> 2 * _WIDTH, key >> _WIDTH & _LAST, key & _LAST)
    return "".join(chr(c) for c in codes if c)


def _texts(column):
    return (t.decode("utf-8", "replace") for t in as_bytes(column))


def gram_counts(docs):
    """(lang, gram, n) of a table of texts with a language, added up within each task first."""
    def count(batches):
        held, size = {}, 0

        def leave():
            parts = [(lang, *grams(*added(own))) for lang, own in held.items()]
            names = pa.array([p[0] for p in parts], pa.string())
            for lang, keys, counts in zip(names, (p[1] for p in parts), (p[2] for p in parts)):
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text"))):
                found = places(text)
                if len(found[0]):
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                if size > HELD:
                    held = {name: [added(own)] for name, own in held.items()}
                    size = sum(len(own[0][0]) for own in held.values())
                    if size > HELD // 2:
                        yield from leave()
                        held, size = {}, 0
        yield from leave()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs, lang="lang", text="text", ranks=RANKS):
    """(lang, rank, gram, n): the most frequent n-grams of each language, ranks from 0."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(known).withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < ranks)


class Profiles:
    """Profiles as arrays: the entries of every n-gram lie together."""

    def __init__(self, rows, ranks=RANKS):
        self.names = sorted({r["lang"] for r in rows}, key=str.encode)
        number = {name: i for i, name in enumerate(self.names)}
        entries = np.array([(r["gram"], number[r["lang"]], r["rank"]) for r in rows], np.int64).reshape(-1, 3)
        entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
        self.grams, first = np.unique(entries[:, 0], return_index=True)
        self.first = np.append(first, len(entries))
        self.lang, self.rank, self.ranks = entries[:, 1], entries[:, 2], ranks

    def distances(self, own):
        """Out-of-place distance of a ranked list to each profile."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == own)
        counts = self.first[at[hit] + 1] - self.first[at[hit]]
        entry = np.repeat(self.first[at[hit]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        off = np.minimum(np.abs(self.rank[entry] - np.repeat(hit, counts)), self.ranks)
        near = np.bincount(self.lang[entry], self.ranks - off, len(self.names))
        return len(own) * self.ranks - near.astype(np.int64)

    def predict(self, text):
        """(language, score) of a text."""
        keys, counts = places(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = top(*grams(keys, counts), self.ranks)
        distances = self.distances(own)
        best = int(np.argmin(distances))
        return self.names[best], 1 - float(distances[best]) / (len(own) * self.ranks)


def train(docs, lang="lang", text="text", ranks=RANKS, languages=LANGUAGES):
    """Profiles of all rows of ``docs`` that have a language and a text."""
    rows = profiles(docs, lang, text, ranks).limit(languages * ranks + 1).collect()
    if len(rows) > languages * ranks or len({r["lang"] for r in rows}) > languages:
        raise ValueError(f"more than {languages} languages")
    return Profiles(rows, ranks)


def predicted(text, trained):
    """Column struct<lang_pred, score> of a text column."""
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def best(text: pa.Array) -> pa.Array:
        found = [trained.predict(t) for t in _texts(text)]
        return struct_array({"lang_pred": pa.array([n for n, _ in found], pa.string()),
                             "score": pa.array([s for _, s in found], pa.float64())})

    return best(text)


def with_language(docs, trained, text="text", out="lang_pred"):
    """``docs`` with the predicted language as a column."""
    return docs.withColumn(out, predicted(docs[text], trained)["lang_pred"])


def held_out(doc_id):
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def op11_language_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trained = train(docs.where(~held_out("doc_id")))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"),
                        predicted(F.col("text"), trained).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
