"""Benchmark decontamination: an FM-index per training shard, searched backwards.

A shard is one batch of documents. Words that no phrase uses become a separator, and
stretches too short to hold a phrase are left out. What remains is indexed: suffix
order, its last column in a wavelet tree with rank directories, and every eighth
suffix position. All phrases are searched at once by backward steps, occurrences are
located by walking to the next sampled position, and their spans are merged.

Words are runs of ASCII letters and digits or other non-ASCII characters, A-Z
lower-cased. A phrase is a window of 13 consecutive words of an item; an item of
fewer words is one phrase. A document is contaminated if at least one word in twenty
lies inside an occurrence.

Null or empty texts have no words and are clean; null item texts give no phrase; a null
item id counts as the empty text; items that share an id count once; repeated documents
are judged each on its own; an empty benchmark hits nothing. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logkeep.llm.texts import as_bytes, struct_array
from logkeep.session import stored

WINDOW = 13
SAMPLE = 8
#: Benchmark bytes whose phrases go to the tasks at once; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20

_KEPT = bytes(range(48, 58)) + bytes(range(97, 123))
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _KEPT or b > 127 else 32 for b in range(256)
)
HITS = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "spans:array<struct<start:int,end:int>>>"
)


def words_of(text):
    return text.translate(WORD_TABLE).split()


class Phrases:
    """Distinct windows of the items, as word numbers, and the items each belongs to."""

    def __init__(self, items, window=WINDOW):
        self.words, windows = {}, {}
        for item_id, text in items:
            words = words_of((text or "").encode())
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                windows.setdefault(tuple(ids[i : i + size]), set()).add(item_id)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        # last word first, as backward search reads them
        self.backward = np.zeros((len(windows), window), np.int64)
        for row, w in enumerate(windows):
            self.backward[row, : len(w)] = w[::-1]
        self.items = [sorted(v) for v in windows.values()]


class Ranks:
    """Rank directory over one bit plane: set bits before a position."""

    def __init__(self, bits):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.zeros = len(bits) - int(counts.sum())

    def __call__(self, i):
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def bit(self, i):
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Counts and locates symbol sequences in an integer text (symbols from 1 up)."""

    def __init__(self, text, sample=SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(text)
        last = text[order - 1]
        size = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.planes, column = [], last
        for level in reversed(range(max(1, (size - 1).bit_length()))):
            bits = (column >> level) & 1
            self.planes.append((level, Ranks(bits)))
            column = np.concatenate([column[bits == 0], column[bits == 1]])
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))
        marked = order % sample == 0
        self.marks, self.places = Ranks(marked), order[marked]

    def _walk(self, symbols, i):
        for level, ranks in self.planes:
            ones = ranks(i)
            i = np.where((symbols >> level) & 1, ranks.zeros + ones, i - ones)
        return i

    def step(self, symbols, i):
        """Backward step: where the rows before ``i`` that follow ``symbols`` end up."""
        return self.starts[symbols] + self._walk(symbols, i) - self.first[symbols]

    def search(self, backward, lengths):
        """Row range of each sequence, given last symbol first."""
        size = len(self.starts) - 1
        low = np.zeros(len(lengths), np.int64)
        high = np.full(len(lengths), int(self.starts[-1]))
        live = np.arange(len(lengths))
        for k in range(backward.shape[1]):
            live = live[lengths[live] > k]
            symbols = backward[live, k]
            known = symbols < size
            high[live[~known]] = low[live[~known]]
            live, symbols = live[known], symbols[known]
            low[live], high[live] = self.step(symbols, low[live]), self.step(symbols, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def symbol(self, rows):
        value, i = np.zeros(len(rows), np.int64), rows
        for level, ranks in self.planes:
            bit, ones = ranks.bit(i).astype(np.int64), ranks(i)
            value |= bit << level
            i = np.where(bit, ranks.zeros + ones, i - ones)
        return value, i

    def locate(self, rows):
        """Text position of each row, walking back to the next sampled one."""
        found = np.full(len(rows), -1, np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.marks.bit(rows) == 1
            found[todo[done]] = self.places[self.marks(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            symbols, walked = self.symbol(rows)
            rows = self.starts[symbols] + walked - self.first[symbols]
            steps += 1
        return found


def suffix_order(text):
    """Suffix array by doubling the compared prefix until no two suffixes tie."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        following = np.zeros(len(rank), np.int64)
        following[: -width or None] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (len(rank) + 1) + following
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(order), np.int64)
        rank[order] = fresh
        if fresh[-1] == len(order) - 1:
            return order
        width *= 2


def find_phrases(texts, phrases):
    """Words of each text, and for the whole shard the occurrences of the phrases.

    Returns word counts, where each text's words start, and for every occurrence its
    first word (counted over the shard) and its phrase.
    """
    known, pieces, counts = phrases.words.get, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        counts[i] = len(words)
        pieces.append(np.fromiter((known(w, 1) for w in words), np.int64, len(words)))
        pieces.append(np.ones(1, np.int64))
    starts = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
    none = np.zeros(0, np.int64)
    if not len(texts) or not len(phrases.lengths):
        return counts, starts, none, none
    symbols = np.concatenate(pieces)
    ends = np.flatnonzero(symbols == 1)
    runs = np.diff(np.concatenate([[-1], ends])) - 1
    long = runs >= phrases.shortest
    edge = np.zeros(len(symbols) + 1, np.int8)
    edge[ends[long] - runs[long]] = 1
    edge[ends[long] + 1] -= 1
    places = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(places):
        return counts, starts, none, none
    index = FMIndex(symbols[places])
    low, high = index.search(phrases.backward, phrases.lengths)
    sizes = high - low
    which = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
    return counts, starts, places[index.locate(rows)], which


def shard_hits(texts, earlier, phrases):
    """One HITS value per text; ``earlier`` holds those of other passes, or None."""
    counts, starts, first, which = find_phrases(texts, phrases)
    total = int(counts.sum()) + len(texts)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + phrases.lengths[which], -1)
    items = [set() for _ in texts]
    owner = np.searchsorted(starts, first, "right") - 1
    for d, w in np.unique(np.stack([owner, which], 1), axis=0).tolist() if len(first) else ():
        items[d].update(phrases.items[w])
    for d, hit in enumerate(earlier or ()):
        items[d].update(hit["items"])
        for span in hit["spans"]:
            edge[starts[d] + span["start"]] += 1
            edge[starts[d] + span["end"]] -= 1
    inside = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    owner = np.searchsorted(starts, opens, "right") - 1
    spans = [[] for _ in texts]
    hit = np.zeros(len(texts), np.int64)
    for d, a, b in zip(owner.tolist(), opens.tolist(), closes.tolist()):
        spans[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
        hit[d] += b - a
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return struct_array({
        "n_words": pa.array(counts),
        "n_hit": pa.array(hit),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "spans": pa.array(spans, span),
    })


def benchmark_passes(benchmark, item_id="item_id", text="text", pass_bytes=PASS_BYTES):
    """The benchmark's phrases, in groups of bounded size."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"),
        F.col(text).alias("text"),
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for k in range(passes):
        yield Phrases(items.where(place == k).collect())


def _hits_udf(phrases, again):
    if again:
        @F.arrow_udf(HITS)
        def hits(text: pa.Array, earlier: pa.Array) -> pa.Array:
            return shard_hits(as_bytes(text), earlier.to_pylist(), phrases)
    else:
        @F.arrow_udf(HITS)
        def hits(text: pa.Array) -> pa.Array:
            return shard_hits(as_bytes(text), None, phrases)
    return hits


def with_hits(docs, benchmark, text="text", into="hits"):
    """``docs`` with a column of word count, hit words, items and merged word spans.

    The column ``into`` must be new to ``docs``.
    """
    for k, phrases in enumerate(benchmark_passes(benchmark)):
        if k:
            docs = stored(docs, "decontaminate")
            docs = docs.withColumn(into, _hits_udf(phrases, True)(F.col(text), F.col(into)))
        else:
            docs = docs.withColumn(into, _hits_udf(phrases, False)(F.col(text)))
    return docs


def contaminated(hits):
    n_hit, n_words = F.col(hits)["n_hit"], F.col(hits)["n_words"]
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs, benchmark, text="text"):
    """Rows of ``docs`` that are not contaminated, with their own columns only."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                      docs[text].alias("text"))
    kept = with_hits(own, benchmark).where(~contaminated("hits"))
    return kept.select("row.*")


def op8_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    @F.arrow_udf("string")
    def digest(items: pa.Array) -> pa.Array:
        texts = [",".join(sorted(x)).encode() for x in items.to_pylist()]
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())

    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        digest("hits.items").alias("items_sha256"),
        contaminated("hits").alias("contaminated"),
    )


#: The same in SQL, over every window length that the items have.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (
    SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i
    FROM b WHERE len(ws) > 0)
), placed AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), found AS (
  SELECT DISTINCT doc_id, n, i, item_id FROM placed JOIN windows USING (n, gram)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS w FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
