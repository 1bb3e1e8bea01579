import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logkeep.llm import simple8b as S
from logkeep.llm.queries import QUERIES
from logkeep.llm.texts import text_runs
from tests.llm.conftest import save_tables
from tests.llm.test_bpe import library_ids
from tests.llm.test_graydedup import rows


@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 16, 1 << 40, 1 << 60, 1 << 63])
def test_round_trip(top):
    rng = np.random.default_rng(1)
    for size in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, top, size, dtype=np.uint64)
        if top == 1 << 63:
            ids = np.where(rng.random(size) < 0.3, 3, ids * np.uint64(2) + np.uint64(1)).astype(np.uint64)
        data = S.pack(ids)
        assert (S.unpack(data) == ids).all() and len(S.unpack(data)) == size
        for k in range(-(-size // S.BLOCK)):
            assert (S.unpack_block(data, k) == ids[k * S.BLOCK : (k + 1) * S.BLOCK]).all()


def test_all_ones_and_foreign_bytes():
    ids = np.full(3000, (1 << 64) - 1, np.uint64)
    assert (S.unpack(S.pack(ids)) == ids).all()
    with pytest.raises(ValueError):
        S.unpack(b"x" * 40)


@pytest.mark.parametrize("top, passes", [(1 << 16, 2.5), (3, 1), (1 << 63, 0.1)])
@pytest.mark.parametrize("more", [-1, 0, 1])
def test_blocks_of_several_passes(top, passes, more):
    size = int(passes * S.PASS * S.BLOCK) + more
    ids = np.random.default_rng(2).integers(0, top, size, dtype=np.uint64)
    data = S.pack(ids)
    assert (S.unpack(data) == ids).all() and len(S.unpack(data)) == size
    for k in {0, S.PASS - 1, S.PASS, -(-size // S.BLOCK) - 1} & set(range(-(-size // S.BLOCK))):
        assert (S.unpack_block(data, k) == ids[k * S.BLOCK : (k + 1) * S.BLOCK]).all()


def test_memory_of_a_file_is_that_of_a_pass():
    ids = np.random.default_rng(3).integers(0, 49_152, S.FILE_IDS)
    tracemalloc.start()
    try:
        data = S.pack(ids)
        packing = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        assert (S.unpack(data) == ids).all()
        unpacking = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert packing < 48 << 20 and unpacking < 48 << 20


def test_pieces_kept_for_marks_are_bounded():
    coder = S._coder(S.read_definition())
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d + "," for a in alphabet for b in alphabet for c in alphabet for d in alphabet[:4]]
    text = " ".join(words)
    ids = coder.batch([text.encode()])[0]
    assert len(words) > S.KEPT_PIECES + 10_000 > len(coder.encode_words.__self__.known)
    assert ids.tolist() == library_ids(text)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_runs_of_texts(kind):
    texts = ["ab", None, "", "\u00e9\u00e9", "x" * 9, "c", "d", "e" * 4, "fg"]
    column = pa.array(["cut", *texts], kind).slice(1)
    found = list(text_runs(column, 5))
    assert [at for at, _ in found] == [0, 3, 4, 5, 7, 8]
    assert [t for _, run in found for t in run] == [(t or "").encode() for t in texts]
    assert all(len(run) == 1 or sum(map(len, run)) <= 5 for _, run in found)
    assert not list(text_runs(column.slice(0, 0), 5)) and list(text_runs(column.slice(1, 2), 5)) == [(0, [b"", b""])]


def test_words_of_a_range_are_learned_once():
    coder = S._coder(S.read_definition())
    encode, learned = coder.encode_words, []

    def count(words):
        learned.append(len(words))
        return encode(words)

    coder.encode_words = count
    # rare words, each twice, more than 300,000 different ones
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in alphabet for b in alphabet for c in alphabet for d in alphabet[:20]]
    texts = [" ".join(words[k::400]).encode() for k in range(400)]
    first = [coder.batch(texts[k : k + 100])[0] for k in range(0, 400, 100)]
    again = [coder.batch(texts[k : k + 100])[0] for k in range(0, 400, 100)]
    assert sum(learned) == len(words) and all((a == b).all() for a, b in zip(first, again))


@pytest.mark.parametrize("word", ["Straße", "ABC", "abc.", "ABC,", "x...", "\u00a0a", "<|endoftext|>", "a\x1cb", "", " ",
                                  "\u00c9t\u00c9", "\u00c9t\u00e9!", "\u00aa", "\u00b5\u00b5.", "\u0130x", "\u0130x,", "a<", "7.", "."])
def test_short_path_of_words(word):
    text = f" {word}\t{word}x {word} "
    assert S._coder(S.read_definition()).batch([text.encode()])[0].tolist() == library_ids(text)


def brute(docs):
    def key(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
        return row[0] is not None, row[0] or 0, h - (1 << 64) * (h >> 63)

    out, start = [], 0
    for doc_id, text in sorted(docs, key=key):
        ids = np.array([*library_ids(text), 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes, file_ids", [(S.RANGE_BYTES, S.FILE_IDS), (40_000, 3_000)])
def test_whole_table(spark, sf_dir, all_docs, monkeypatch, range_bytes, file_ids):
    monkeypatch.setattr(S.write_token_files, "__defaults__", ("doc_id", "text", 2, range_bytes, file_ids))
    want = brute([(r.doc_id, r.text) for r in all_docs.collect()])
    assert rows(QUERIES["op4_token_files"](spark, sf_dir)) == want


@pytest.mark.parametrize("range_bytes, file_ids", [(S.RANGE_BYTES, S.FILE_IDS), (40, 3)])
def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs, monkeypatch, range_bytes, file_ids):
    monkeypatch.setattr(S.write_token_files, "__defaults__", ("doc_id", "text", 2, range_bytes, file_ids))
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    assert rows(QUERIES["op4_token_files"](spark, folder)) == brute(
        [(r.doc_id, r.text) for r in odd_docs.collect()])
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op4_token_files"](spark, folder).count() == 0
