"""Removal of repeated passages by recompression.

Every document is parsed into a hierarchy of symbols with names that all documents share.
First each word's place in a run of equal words (last or not) joins its name. Then rounds
put every symbol on one of two sides by a bit of its name, and name each adjacent pair of a
left and a right symbol as one, up to three words. Whether two symbols join depends on the
two alone, so equal word sequences get equal symbols except near their borders: of 13 equal
words, the fourth to the ninth are parsed alike wherever they stand, and hold at least one
whole symbol.

The smallest such symbol name stands for the window, with the three words before it and the
four after, all of them inside the window. Names that occur in two documents reveal where
repeats can be; only windows there are verified by a name of all 13 words, for which every
block learns whether a document with a smaller id has it. Words covered by such windows go.

Names are 64-bit hashes (equal for unequal sequences with chance 2^-64 a pair). Words stand
between ASCII white space and are compared unchanged. Null, empty and short texts have no
window. A null id counts as larger than all ids and as no reason for removal; rows with
the same id do not remove each other's words. Repeated rows are judged each on its own.
Other columns are not read.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logkeep.llm.exchange import (
    NO_ID, PIECES, Block, answers, bucket_count, make_blocks, pieces, with_answers)
from logkeep.llm.texts import hash64, mix
from logkeep.session import stored

WINDOW = 13
ROUNDS = 2
LONGEST = 3
#: Words of a window before and after the part that is parsed alike in all its occurrences.
BEFORE, AFTER = 3, 4


def _fold(name, word):
    return mix(name * np.uint64(0x9E3779B97F4A7C15) + word, 1)


def parse(words, owner):
    """Symbols of all documents of a block: first word, words and name of each."""
    n = len(words)
    same = np.zeros(n, bool)
    same[:-1] = (words[:-1] == words[1:]) & (owner[:-1] == owner[1:])
    first, length = np.arange(n), np.ones(n, np.int64)
    name = mix(words + same.astype(np.uint64), 2)
    for turn in range(ROUNDS):
        right = mix(name, 3 + turn) >> np.uint64(63) == 1
        joins = ~right[:-1] & right[1:] & (owner[first[:-1]] == owner[first[1:]])
        joins &= length[:-1] + length[1:] <= LONGEST
        at = np.flatnonzero(joins)
        name[at] = _fold(name[at], name[at + 1])
        length[at] += length[at + 1]
        stay = np.ones(len(first), bool)
        stay[at + 1] = False
        first, length, name = first[stay], length[stay], name[stay]
    return first, length, name


class Windows:
    """Windows of a block and the symbol that stands for each."""

    def __init__(self, block):
        self.block = block
        self.words = hash64(block.distinct)[block.number] if len(block.number) else np.zeros(0, np.uint64)
        starts = np.cumsum(block.counts) - block.counts
        many = np.maximum(block.counts - WINDOW + 1, 0)
        self.first = np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many)
        if not len(self.first):
            self.symbol, self.keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.number = np.zeros(0, np.int64)
            return
        first, length, name = parse(self.words, block.owner)
        rank = mix(name, 9)
        low = np.searchsorted(first, self.first + BEFORE)
        ends = first + length
        high = np.searchsorted(ends, self.first + WINDOW - AFTER, "right")
        best = low.copy()
        for k in range(1, WINDOW - BEFORE - AFTER):
            other = np.minimum(low + k, len(first) - 1)
            best = np.where((low + k < high) & (rank[other] < rank[best]), other, best)
        chosen, which = np.unique(best, return_inverse=True)
        keys = np.full(len(chosen), 7, np.uint64)
        for k in range(BEFORE + LONGEST + AFTER):
            at = first[chosen] - BEFORE + k
            inside = at < ends[chosen] + AFTER
            folded = _fold(keys, self.words[np.where(inside, at, 0)])
            keys = np.where(inside, folded, keys)
        # chosen symbols of equal context share a key
        self.keys, number = np.unique(keys, return_inverse=True)
        self.symbol, self.number = chosen, number[which]

    def owners(self):
        return self.block.owner[self.first]

    def names(self, at):
        """Name of all words of the windows ``at``."""
        name = np.full(len(at), 11, np.uint64)
        for k in range(WINDOW):
            name = _fold(name, self.words[self.first[at] + k])
        return name


def _open(row):
    return Windows(Block(row["ids"], row["counts"], row["words"]))


def _several(which, values, size):
    """Whether each key is in two documents; an entry counts two if its own block has two."""
    return (np.bincount(which, values, size) >= 2).astype(np.uint8)[which]


def _earliest(which, values, size):
    """Whether another block holds a smaller id than the entry's own."""
    least = np.full(size, NO_ID, np.int64)
    np.minimum.at(least, which, values)
    return (least[which] < values).astype(np.uint8)


def _symbol_rows(blocks, buckets):
    def send(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                w = _open(row)
                owner, size = w.owners(), len(w.keys)
                low, high = np.full(size, len(w.block.ids)), np.full(size, -1)
                np.minimum.at(low, w.number, owner)
                np.maximum.at(high, w.number, owner)
                yield pieces(row["block"], w.keys, 1 + (low < high).astype(np.uint8), buckets)

    return blocks.mapInPandas(send, PIECES)


def _shared(w, answer):
    return np.flatnonzero(np.frombuffer(answer, np.uint8)[w.number] == 1)


def _named(w, at):
    """Distinct names of the windows ``at``, their numbers, and the least id of each."""
    names, which = np.unique(w.names(at), return_inverse=True)
    ids = w.block.ids[w.owners()[at]]
    least = np.full(len(names), NO_ID, np.int64)
    np.minimum.at(least, which, ids)
    return names, which, least


def _window_rows(blocks, shared, buckets):
    def send(number, row, answer):
        if number is None:
            return pd.DataFrame(columns=["bucket", "block", "keys", "values"])
        w = _open(row)
        names, _, least = _named(w, _shared(w, answer))
        return pieces(number, names, least, buckets)

    return with_answers(blocks, shared, send, PIECES)


def _judged(row, symbols, windows):
    """Rows of a block's documents, repeated words removed."""
    w = _open(row)
    block, at = w.block, _shared(w, symbols)
    _, which, least = _named(w, at)
    earlier = np.frombuffer(windows, np.uint8)[which] == 1
    repeated = at[earlier | (block.ids[w.owners()[at]] > least[which])]
    edge = np.zeros(len(w.words) + 1, np.int64)
    np.add.at(edge, w.first[repeated], 1)
    np.add.at(edge, w.first[repeated] + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed = np.bincount(block.owner[gone], minlength=len(block.ids))
    starts, texts = np.cumsum(block.counts) - block.counts, []
    for k, line in enumerate(block.lines):
        if removed[k]:
            stay = ~gone[starts[k] : starts[k] + block.counts[k]]
            line = b" ".join(word for word, s in zip(line.split(b" "), stay.tolist()) if s)
        texts.append(line.decode())
    ids = pd.array(block.ids, "Int64")
    ids[block.ids == NO_ID] = pd.NA
    return pd.DataFrame({"doc_id": ids, "n_words": block.counts, "n_removed": removed, "kept": texts})


def remove_repeats(docs, doc_id="doc_id", text="text", block_words=None, bucket_words=None):
    """(doc_id, n_words, n_removed, kept): each text without what smaller ids hold already."""
    sizes = {} if block_words is None else {"block_words": block_words}
    blocks = make_blocks(docs, doc_id, text, **sizes)
    buckets = bucket_count(blocks, *([] if bucket_words is None else [bucket_words]))
    shared = stored(answers(_symbol_rows(blocks, buckets), _several, np.uint8), "symbols")
    judged = answers(_window_rows(blocks, shared, buckets), _earliest, np.int64)
    # both answers of a block travel as one table, told apart by the sign of the bucket
    both = shared.unionAll(judged.select("block", (-1 - F.col("bucket")).alias("bucket"), "answer"))

    def finish(row, found):
        if not len(row):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept": []})
        first = found[found["bucket"] >= 0].sort_values("bucket")
        second = found[found["bucket"] < 0].sort_values("bucket", ascending=False)
        return _judged(row.iloc[0], b"".join(first["answer"]), b"".join(second["answer"]))

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
        finish, "doc_id long, n_words long, n_removed long, kept string")


def op6_repeated_passages(spark, sf_dir):
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL: every window's least document, and the words under later copies.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), least AS (
  SELECT gram, min(doc_id) AS least FROM g GROUP BY gram
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM g JOIN least USING (gram) WHERE least < doc_id
), removed AS (
  SELECT doc_id, list(i) AS removed FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(
    [ws[k] for k in range(1, len(ws) + 1) if NOT list_contains(coalesce(removed, []), k)], ' ')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id)
"""
