"""Token ids in word-aligned Simple-8b files.

A file holds blocks of 1,024 ids. Each 64-bit word has a selector in its upper four bits
and as many ids as fit in equal widths below: 60 of one bit down to one of 60 bits. An id of
more bits is an escape: a word with the last selector and the id in the word after it. The
header keeps the place of every block's first word, so any block decodes alone and whole
files decode by array operations.

Layout (little endian): magic ``S8B1``, block size (u4), number of ids (u8), word offset of
each block and of the end (u8 each), words (u8 each).

Documents are written in ascending id order (null ids first, then by text): a range sort,
then one file for at most ``FILE_IDS`` ids or one longer document. A file is a row of a
table in the shared folder (its bytes beside its documents and their lengths), so a lost
executor's files are written again and never twice. Null and empty texts hold the end id
only; repeated rows are documents of their own; an empty table gives no files.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from logkeep.llm.bpe import MARKS, STABLE, WordEncoder, read_definition
from logkeep.llm.texts import per_process, small_batches, text_runs
from logkeep.llm.wordtokens import WordTokens
from logkeep.session import stored

END_ID = 2
BLOCK = 1024
#: Blocks that are packed or decoded at once.
PASS = 256
FILE_IDS = 1 << 20
#: Text bytes that one range of the sort aims at.
RANGE_BYTES = 32 << 20
#: Text bytes that are split and looked up at once.
TEXT_BYTES = 1 << 20
#: Distinct words whose ids a task keeps: about those of one range, whose words would be learned twice.
KEPT_WORDS = 500_000
#: Pieces whose ids a task keeps for words that add a mark to them; beyond it starts anew.
KEPT_PIECES = 50_000
#: Ids of a word and their width, by selector; the selector after them is the escape.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
          (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.array([c for c, _ in WIDTHS] + [0, 1], np.int64)
_BITS = np.array([b for _, b in WIDTHS] + [0, 0], np.uint64)
_HEAD = "<4sIQ"


def _selectors(ids, ends):
    """Best selector for a word that starts at each place of (blocks x BLOCK) ids."""
    places, block = np.arange(BLOCK, dtype=np.int16), np.int16(BLOCK)
    # past 53 bits the length may come out one too large, which costs room but no value
    length = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    ends = ends.astype(np.int16)[:, None]
    best = np.full(ids.shape, ESCAPE, np.int8)
    # of the widths that hold all ids only the narrowest can be best
    fitting = sum(bits >= int(length.max()) for _, bits in WIDTHS)
    for selector in reversed(range(min(len(WIDTHS), len(WIDTHS) - fitting + 1))):
        count, bits = WIDTHS[selector]
        wide = np.where(length > bits, places, block)
        following = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1]
        np.copyto(best, np.int8(selector), where=following >= np.minimum(places + np.int16(count), ends))
    return best


def _pack_blocks(ids):
    """(words of ids below 2^64, place of each block's first word)."""
    blocks = -(-len(ids) // BLOCK)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(ids) - (blocks - 1) * BLOCK
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    table = padded.reshape(blocks, BLOCK)
    best = _selectors(table, ends)
    starts, at, live = [], np.zeros(blocks, np.int64), np.arange(blocks)
    while len(live):
        starts.append(live * BLOCK + at[live])
        at[live] += _COUNTS[best[live, at[live]]]
        live = live[at[live] < ends[live]]
    starts = np.sort(np.concatenate(starts))
    chosen = best.reshape(-1)[starts].astype(np.int64)
    escaped = chosen == ESCAPE
    # an escaped id takes the word after its own
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    words[place[escaped] + 1] = padded[starts[escaped]]
    padded = np.concatenate([padded, np.zeros(60, np.uint64)])
    limit = (starts // BLOCK) * BLOCK + ends[starts // BLOCK]
    for selector, (count, bits) in enumerate(WIDTHS):
        mine = np.flatnonzero(chosen == selector)
        value = np.zeros(len(mine), np.uint64)
        for k in range(count if len(mine) else 0):
            inside = starts[mine] + k < limit[mine]
            value |= np.where(inside, padded[starts[mine] + k], 0) << np.uint64(k * bits)
        words[place[mine]] = value
    words[place] |= chosen.astype(np.uint64) << np.uint64(60)
    return words, place[np.searchsorted(starts, np.arange(blocks) * BLOCK)]


def pack(ids):
    """File bytes of a sequence of ids below 2^64."""
    ids = np.asarray(ids, np.uint64)
    words, offsets, held = [], [], 0
    for at in range(0, len(ids), PASS * BLOCK):
        some, firsts = _pack_blocks(ids[at : at + PASS * BLOCK])
        words.append(some.astype("<u8"))
        offsets.append(held + firsts)
        held += len(some)
    offsets = np.concatenate([*offsets, [held]]).astype("<u8")
    return b"".join([struct.pack(_HEAD, b"S8B1", BLOCK, len(ids)), offsets, *words])


def _words(data):
    magic, block, count = struct.unpack_from(_HEAD, data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b file")
    blocks = -(-count // block)
    offsets = np.frombuffer(data, "<u8", blocks + 1, struct.calcsize(_HEAD)).astype(np.int64)
    return block, count, offsets, np.frombuffer(data, "<u8", -1, struct.calcsize(_HEAD) + 8 * (blocks + 1))


def _decode(words, owner, sizes):
    """Ids of words; ``owner`` is the block of each word, ``sizes`` the ids of each block."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a word after an escape is plain: of a run that looks like escapes every second one is
    marked = selector == ESCAPE
    run = np.arange(len(words)) - np.maximum.accumulate(np.where(marked, -1, np.arange(len(words))))
    begin = np.maximum.accumulate(np.where(marked & ~np.concatenate([[False], marked[:-1]]),
                                           np.arange(len(words)), -1))
    escape = marked & ((np.arange(len(words)) - begin) % 2 == 0) & (run > 0)
    plain = np.concatenate([[False], escape[:-1]])
    counts = np.where(plain, 1, np.where(escape, 0, _COUNTS[selector]))
    bits = np.where(plain, 0, _BITS[selector])
    ends = np.cumsum(counts)
    place = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    word = np.repeat(words, counts)
    bits, whole = np.repeat(bits, counts).astype(np.uint64), np.repeat(plain, counts)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    values = np.where(whole, word, (word >> (place.astype(np.uint64) * bits)) & mask)
    # the last word of a block may have room to spare
    block = np.repeat(owner, counts)
    rank = np.arange(len(block)) - np.searchsorted(block, block)
    return values[rank < sizes[block]]


def unpack(data):
    """All ids of a file."""
    block, count, offsets, words = _words(data)
    ids = np.empty(count, np.uint64)
    for at in range(0, len(offsets) - 1, PASS):
        some = offsets[at : at + PASS + 1]
        first, last = at * block, min((at + PASS) * block, count)
        sizes = np.diff(np.minimum(np.arange(first, last + block, block), last))
        owner = np.repeat(np.arange(len(some) - 1), np.diff(some))
        ids[first:last] = _decode(words[some[0] : some[-1]], owner, sizes)
    return ids


def unpack_block(data, k):
    """Ids of block ``k`` alone."""
    block, count, offsets, words = _words(data)
    mine = words[offsets[k] : offsets[k + 1]]
    return _decode(mine, np.zeros(len(mine), np.int64), np.array([min(block, count - k * block)]))


class LibraryWords(WordEncoder):
    """Words split beforehand, their pieces merged by the tokenizers library."""

    def __init__(self, definition):
        super().__init__(definition)
        self.marks = {}

    def encode_piece(self, piece):
        return [t.id for t in self.library.model.tokenize(piece)]

    def encode_words(self, words):
        """Stable words of letters are one piece, with a mark behind them two; others are split."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        tokenize, symbols, known, marks, out = self.library.model.tokenize, self.symbols, self.known, self.marks, []
        for word in words:
            letters, mark = word.decode(), ""
            if not letters.isalpha():
                letters, mark = letters[:-1], letters[-1:]
                if mark not in MARKS or not letters.isalpha():
                    out.append(self.encode_word(word))
                    continue
            if not (letters.isascii() or STABLE(letters)):
                out.append(self.encode_word(word))
                continue
            piece = letters.lower()
            ids = known.get(piece) if mark else None
            if ids is None:
                mapped = piece if piece.isascii() else "".join(map(symbols.__getitem__, piece.encode()))
                ids = [t.id for t in tokenize(mapped)]
            if mark:
                known[piece] = ids
                if mark not in marks:
                    marks[mark] = self.encode_piece(mark)
                ids = ids + marks[mark]
            out.append(ids)
        return out


def _coder(definition):
    return WordTokens(LibraryWords(definition).encode_words, KEPT_WORDS)


def write_token_files(docs, definition, doc_id="doc_id", text="text", end_id=END_ID,
                      range_bytes=RANGE_BYTES, file_ids=FILE_IDS):
    """Table of files, by ascending document id.

    A row has the range of the sort, the file's number in it, its documents and their
    lengths, the ids of the range before the file, its own number of ids and its bytes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(max(1, -(-size // range_bytes)), *order[:2]).sortWithinPartitions(*order)

    def write(batches):
        place, file = TaskContext.get().partitionId(), 0
        coder = per_process(("files", hash(definition)), lambda: _coder(definition))
        end = np.array([end_id])
        ids, doc_ids, counts, held, before = [], [], [], 0, 0

        def full():
            flat = np.concatenate(ids)
            one = {"range": [place], "file": [file], "doc_ids": [doc_ids], "counts": [counts],
                   "before": [before], "n_ids": [len(flat)], "data": [pack(flat)]}
            return pa.RecordBatch.from_arrays(
                [pa.array(one[f.name], f.type) for f in kinds], names=[f.name for f in kinds])

        kinds = pa.schema([("range", pa.int32()), ("file", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                           ("counts", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()),
                           ("data", pa.binary())])
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, texts in text_runs(batch.column("text"), TEXT_BYTES):
                flat, sizes = coder.batch(texts)
                for name, piece in zip(names[at:], np.split(flat, np.cumsum(sizes)[:-1])):
                    if held and held + len(piece) + 1 > file_ids:
                        yield full()
                        before, file = before + held, file + 1
                        ids, doc_ids, counts, held = [], [], [], 0
                    ids += [piece, end]
                    doc_ids.append(name)
                    counts.append(len(piece) + 1)
                    held += len(piece) + 1
        if held:
            yield full()

    return stored(dealt.mapInArrow(
        write, "range int, file int, doc_ids array<long>, counts array<long>, before long, "
        "n_ids long, data binary"), "tokens")


def read_token_files(files):
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' bytes.

    The driver keeps one number per range of the sort; files know the ids before them in theirs.
    """
    totals = {r[0]: r[1] for r in files.groupBy("range").agg(F.sum("n_ids")).collect()}
    firsts, total = [], 0
    for r in range(max(totals, default=-1) + 1):
        firsts.append(total)
        total += totals.get(r, 0)
    def read(batches):
        for batch in batches:
            for at in range(len(batch)):
                # a batch holds many files: one at a time is made Python's
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack(row["data"]).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["counts"])]).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([firsts[row["range"]] + row["before"] + c for c in cuts[:-1]], pa.int64()),
                    pa.array(row["counts"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, read_definition()))
