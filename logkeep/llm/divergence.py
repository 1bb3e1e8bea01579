"""Divergence of a language's sources, with terms as digests until the result.

Every task numbers the terms of its documents and writes one row for each language and term:
a 64-bit digest, the text, the number of documents, and the occurrences in each source.
That table stays where it is written. What is shuffled from it is keyed by digests: document
counts with the least and the greatest text of each digest, which give the kept digests of each
language and tell whether several terms share one, and occurrences by source, without texts.
A shared digest is split: its
terms are counted again, told apart by their rank among the digest's texts, and those that are
too rare on their own are dropped. A term that is kept always has a kept digest, so no other
digest needs the check. The result's terms get their text at the very end.

Shares of a term: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers. The distance
of two sources is the sum of |p - q| over all V kept terms. Absent terms all have the same
share z of a source, so the sum is V |z - z'|, corrected for the terms that either has, by
counts of equal shares, and for the terms that both have: nothing is computed for a term that
neither has. The pairs of a language's sources are the result itself.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Null text, language
and source count as empty. Every language and source pair that occurs is a group, without
terms too; a language without kept terms gives pairs of distance 0 and no terms. Repeated rows
and null ids count like any row; equal values rank by the item's bytes; long texts are read in
pieces; an empty table gives no rows. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from logkeep.llm.texts import as_bytes
from logkeep.operators.joins import join_small
from logkeep.session import sized_shuffles, stored

MIN_DOCS, TOP, PRIOR, SCALE = 30, 50, 5, 10**9
#: Bytes of a text split at once; words and distinct terms after which a task's rows leave.
PIECE, BLOCK_WORDS, BLOCK_TERMS = 1 << 20, 1 << 22, 1 << 19
TERM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PARTS = ("lang string, digest long, term string, docs long, "
         "spread array<struct<source:string,n:long>>")
_ID = ["lang", "digest", "ord"]


class _Block:
    """Terms, documents and groups of a run of documents, as numbers."""

    def __init__(self):
        self.terms, self.groups, self.words, self.owners = {}, {}, [], []
        self.group_of, self.held = [], 0

    def add(self, lang, source, text):
        doc = len(self.group_of)
        self.group_of.append(self.groups.setdefault((lang, source), len(self.groups)))
        data, at, terms = text.translate(TERM_TABLE), 0, self.terms
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            for word in set(words).difference(terms):
                terms[word] = len(terms)
            self.words.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
            self.owners.append((doc, len(words)))
            self.held += len(words)
            at = end

    def full(self):
        return self.held >= BLOCK_WORDS or len(self.terms) >= BLOCK_TERMS

    def rows(self, bits):
        """Record batch of PARTS."""
        groups = sorted(self.groups)
        place = {self.groups[g]: i for i, g in enumerate(groups)}
        langs = sorted({lang for lang, _ in groups})
        lang_of = np.array([langs.index(lang) for lang, _ in groups])
        group_of = np.array([place[g] for g in self.group_of])
        size, words = len(self.terms), np.concatenate(self.words)
        owner = np.repeat([d for d, _ in self.owners], [n for _, n in self.owners])
        pairs, n = np.unique(owner * size + words, return_counts=True)
        # by term, language and source, so that a language's sources lie together
        group = group_of[pairs // size]
        keys, where, docs = np.unique(pairs % size * len(groups) + group, return_inverse=True,
                                      return_counts=True)
        n = np.bincount(where, n).astype(np.int64)
        term, group = keys // len(groups), keys % len(groups)
        new = np.flatnonzero(np.diff(term * len(langs) + lang_of[group], prepend=-1))
        spread = pa.StructArray.from_arrays(
            [pa.array([s for _, s in groups], pa.string()).take(pa.array(group)), pa.array(n)], ["source", "n"])
        texts = list(self.terms)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, size).view(np.int64)
        if bits < 64:
            digests &= (1 << bits) - 1
        first = pa.array(term[new])
        return pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()).take(pa.array(lang_of[group[new]])),
            pa.array(digests).take(first), _as_text(texts).take(first),
            pa.array(np.add.reduceat(docs, new)),
            pa.ListArray.from_arrays(np.append(new, len(keys)).astype(np.int32), spread),
        ], ["lang", "digest", "term", "docs", "spread"])


def _as_text(values):
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # a text that is no UTF-8
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def term_parts(docs, bits=64):
    """Stored rows of PARTS, added up within each task; nothing is shuffled."""
    def count(batches):
        block = _Block()
        for batch in batches:
            names = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(*names, as_bytes(batch.column("text"))):
                block.add(lang, source, text)
                if block.full():
                    yield block.rows(bits)
                    block = _Block()
        if block.held:
            yield block.rows(bits)

    return stored(docs.select("lang", "source", "text").mapInArrow(count, PARTS), "terms")


def kept_terms(parts, min_docs=MIN_DOCS):
    """Stored (lang, digest, ord, term): terms in at least ``min_docs`` of their language's
    documents. ``ord`` tells the terms of one digest apart; it is 0 where the digest has one term.
    """
    span = stored(parts.groupBy("lang", "digest").agg(
        F.sum("docs").alias("docs"), F.min("term").alias("least"), F.max("term").alias("term")).where(
        F.col("docs") >= min_docs), "spans")
    single = span.where("least = term").select("lang", "digest", F.lit(0).alias("ord"), "term")
    shared = span.where("least <> term").select("lang", "digest")
    if shared.isEmpty():
        return single
    # digests of several terms: exact counts of each
    own = join_small(parts.select("lang", "digest", "term", "docs"), shared, ["lang", "digest"], "term")
    own = own.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs"))
    rank = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))
    split = own.withColumn("ord", rank).where(F.col("docs") >= min_docs)
    return stored(single.unionByName(split.select("lang", "digest", "ord", "term")), "kept")


def kept_counts(parts, kept):
    """Stored (lang, digest, ord, source, n) of the kept terms' occurrences.

    Digests are counted before the kept ones are picked: most rows of the tasks belong to kept
    terms, so picking first would move as much and join many times the rows.
    """
    def added(rows, *more):
        each = rows.select("lang", "digest", *more, F.explode("spread").alias("s"))
        return each.select("lang", "digest", *more, "s.source", "s.n").groupBy(
            "lang", "digest", *more, "source").agg(F.sum("n").alias("n"))

    columns = [*_ID, "source", "n"]
    plain = kept.where("ord = 0").select(*_ID)
    found = join_small(added(parts), plain, ["lang", "digest"], "source").select(*columns)
    split = kept.where("ord > 0")
    if not split.isEmpty():
        own = join_small(parts.select("lang", "digest", "term", "spread"), split.select("lang", "digest", "term", "ord"),
                         ["lang", "digest", "term"], "spread")
        found = found.unionByName(added(own, "ord").select(*columns))
    return stored(found, "counts")


def share(count, total):
    """1 + floor(SCALE (count + PRIOR) / total), exactly: three digits a step, in whole numbers."""
    quotient, rest = F.lit(0).cast("long"), count + F.lit(PRIOR)
    for _ in range(3):
        rest = rest * F.lit(1000)
        quotient = quotient * F.lit(1000) + F.call_function("div", rest, total)
        rest = rest % total
    return quotient + F.lit(1)


def source_divergence(docs, min_docs=MIN_DOCS, top=TOP, bits=64):
    """(lang, source, part, item, value, rank) of all groups of ``docs``.

    A term is kept in a language if at least ``min_docs`` of its documents have it; ``top``
    terms are listed for each group. ``bits`` narrows the digests.
    """
    with sized_shuffles(docs):
        return _divergence(docs, min_docs, top, bits)


def _divergence(docs, min_docs, top, bits):
    names = ["lang", "source"]
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names], "text")
    parts = term_parts(read, bits)
    kept = kept_terms(parts, min_docs)
    counts = kept_counts(parts, kept)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy(*names).agg(F.sum("n").alias("total"))
    groups = read.select(*names).groupBy(*names).agg(F.lit(1).alias("_one")).drop("_one")
    facts = groups.join(vocabulary, "lang", "left").join(totals, names, "left").select(
        *names, F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    full = F.col("total") + PRIOR * F.col("v")
    # without kept terms nothing is shared out: distance 0
    facts = stored(facts.withColumn("full", full).withColumn(
        "z", F.when(full > 0, share(F.lit(0).cast("long"), full)).otherwise(F.lit(0))), "groups")
    shares = join_small(counts, facts.select(*names, "full", "z"), names, "digest").withColumn(
        "p", share(F.col("n"), F.col("full"))).select(*_ID, "source", "p", "z")
    shares = stored(shares, "shares")
    pairs = _pairs(facts, shares)
    terms = _terms(facts, counts, shares, kept, top)
    return pairs.unionByName(terms)


def _pairs(facts, shares):
    one = facts.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "v")
    two = facts.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    apart = F.abs(F.col("za") - F.col("zb"))
    # every pair of a language's sources is a row of the result
    bases = one.join(two, "lang").where("a <> b").select("lang", "a", "b", (F.col("v") * apart).alias("f"))
    # terms of one source, as if the other lacked them: equal shares count once
    equal = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("z").alias("za")).agg(
        F.count(F.lit(1)).alias("m"))
    alone = equal.join(two, "lang").where("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("m") * (F.abs(F.col("p") - F.col("zb")) - apart)).alias("f"))
    # terms of both
    left = shares.select(*_ID, F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = shares.select(*_ID, F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    gain = (F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb"))
            - F.abs(F.col("pb") - F.col("za")) + apart)
    both = left.join(right, _ID).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gain).alias("f"))

    def turned(df):
        return df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f")

    total = bases.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    value = total.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    return value.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"),
                        F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))


def _terms(facts, counts, shares, kept, top):
    of_lang = counts.groupBy(*_ID).agg(F.sum("n").alias("n"))
    size = facts.groupBy("lang").agg((F.sum("total") + PRIOR * F.max("v")).alias("full"))
    common = join_small(of_lang, size, ["lang"], "digest").select(*_ID, share(F.col("n"), F.col("full")).alias("q"))
    more = shares.join(common, _ID).where("p > q").withColumn("value", F.col("p") - F.col("q"))
    group = Window.partitionBy("lang", "source")
    # ties at the last rank stay until the texts decide
    best = more.withColumn("_r", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("_r") <= top)
    named = kept.join(best.select(*_ID, "source", "value"), _ID)
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(
        F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         "value", "rank")


def op12_source_divergence(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL, over all groups and all kept terms.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (
  SELECT r, lang, source, unnest(ws) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
    LEFT JOIN t USING (lang, source)
), q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
    JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
