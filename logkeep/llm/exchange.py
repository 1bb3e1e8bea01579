"""Blocks of documents that ask key tables for what all other blocks know.

A block is a bounded run of documents as one row. Each block sends its distinct 64-bit keys,
sorted, with a value for each, cut by key range into buckets; a bucket merges the keys of
all blocks and answers every block in the order of its keys. So rows of the shuffle are
packed arrays, combined within blocks before they move, and no key, however frequent, has
more than one entry for each block.
"""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from logkeep.session import stored

#: Words of a block, beyond which it takes no further document, and words for each key bucket.
BLOCK_WORDS = 1 << 20
BUCKET_WORDS = 1 << 21
#: Stands for a null id: larger than all others.
NO_ID = (1 << 63) - 1


def make_blocks(docs, doc_id="doc_id", text="text", lower=False, block_words=BLOCK_WORDS, keep=stored):
    """Stored table of blocks: (block, ids, counts, n_words, words).

    ``ids`` and ``counts`` are the documents' ids (NO_ID for null) and numbers of words,
    ``words`` the compressed words, one space between words and one line per document.
    Words stand between ASCII white space. ``keep`` stores the rows.
    """
    def blocks(batches):
        place, number = TaskContext.get().partitionId() << 32, itertools.count()
        ids, lines, counts, held = [], [], [], 0

        def full():
            data = zstandard.compress(b"\n".join(lines), 3)
            return pa.RecordBatch.from_arrays([
                pa.array([place + next(number)], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]),
                pa.array([np.array(counts, "<i8").tobytes()]), pa.array([held], pa.int64()),
                pa.array([data])], ["block", "ids", "counts", "n_words", "words"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for one, value in zip(batch.column("doc_id").to_pylist(), texts):
                value = value.as_py() or b""
                words = (value.lower() if lower else value).split()
                if ids and held + len(words) > block_words:
                    yield full()
                    ids, lines, counts, held = [], [], [], 0
                ids.append(NO_ID if one is None else one)
                lines.append(b" ".join(words))
                counts.append(len(words))
                held += len(words)
        if ids:
            yield full()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return keep(rows.mapInArrow(
        blocks, "block long, ids binary, counts binary, n_words long, words binary"), "blocks")


class Block:
    """Opened block: ids, counts, lines (words of a document joined) and word numbers."""

    def __init__(self, ids, counts, words):
        self.ids, self.counts = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8")
        self.lines = zstandard.decompress(words).split(b"\n")
        numbers = {}
        split = b" ".join(line for line in self.lines if line).split(b" ") if self.counts.sum() else []
        self.number = np.fromiter((numbers.setdefault(w, len(numbers)) for w in split), np.int64, len(split))
        self.distinct = list(numbers)
        self.owner = np.repeat(np.arange(len(self.ids)), self.counts)


def bucket_count(blocks, bucket_words=BUCKET_WORDS):
    """Buckets, a power of two, for keys in proportion to the words of all blocks."""
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    return 1 << max(0, (words // bucket_words).bit_length())


def pieces(block, keys, values, buckets):
    """Rows (bucket, block, keys, values) of one block's sorted distinct keys."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    place = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pd.DataFrame({
        "bucket": some, "block": block,
        "keys": [keys[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1])],
        "values": [values[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1])],
    })


PIECES = "bucket long, block long, keys binary, values binary"


def answers(sent, merge, kind, tally=None):
    """(block, bucket, answer): ``merge`` of each bucket's keys, given back to its blocks.

    ``merge(which, values, distinct)`` sees the values of all blocks' entries (of dtype
    ``kind``) and for each entry the number of its key among ``distinct``; it returns one
    answer for each entry. With ``tally``, a column of that name repeats, for every row of a
    bucket, its count of keys whose values do not sum to zero.
    """
    def meet(group):
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        values = np.concatenate([np.frombuffer(v, kind) for v in group["values"]])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        found = merge(which, values, len(distinct))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = {"block": group["block"], "bucket": group["bucket"],
               "answer": [a.tobytes() for a in np.split(found, cuts)]}
        if tally:
            out[tally] = np.count_nonzero(np.bincount(which, values, len(distinct)))
        return pd.DataFrame(out)

    schema = "block long, bucket long, answer binary" + (f", {tally} long" if tally else "")
    return sent.groupBy("bucket").applyInPandas(meet, schema)


def with_answers(blocks, replies, function, schema):
    """``function(block number, row, answer bytes in key order)`` for every block."""
    def join(row, found):
        if not len(row):
            return function(None, None, b"")
        found = found.sort_values("bucket")
        return function(int(row["block"].iloc[0]), row.iloc[0], b"".join(found["answer"]))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(join, schema)
