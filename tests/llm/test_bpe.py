import hashlib
import random

import pytest
from tokenizers import Tokenizer

from logkeep.llm import bpe
from logkeep.llm.queries import QUERIES
from logkeep.llm.wordtokens import WordTokens
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows

DEFINITION = bpe.read_definition()
LIBRARY = Tokenizer.from_str(DEFINITION)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(DEFINITION)


def random_texts():
    rng = random.Random(6)
    pieces = ["th", "er", "in", "a", "aa", "s", "'s", "'LL", "don't", "ing", "1", "é", "é", " ", "!!"]
    for _ in range(1500):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        yield "".join(rng.choice("abcdefghinorstulem") for _ in range(rng.randrange(1, 25)))
        yield "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x20000)]))
                      for _ in range(rng.randrange(1, 9)))
    yield from ("<|endoftext|>a<|startoftext|>B <|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ", "İx",
                "x\x1cy\x85z q", "ΩK", "a" * 500, "!" * 500, "ab" * 300, "\x00", "", " \n")


def test_same_ids_and_text_as_the_library(coder):
    decoder = bpe.Decoder(DEFINITION)
    words = WordTokens(coder.encode_words, kept=200)
    for text in random_texts():
        ids, counts = words.batch([text.encode()])
        assert ids.tolist() == library_ids(text), repr(text)
        assert counts.tolist() == [len(ids)]
        assert decoder.decode(ids).decode() == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_batches_keep_texts_apart(coder):
    texts = list(random_texts())[:200]
    ids, counts = WordTokens(coder.encode_words).batch([t.encode() for t in texts])
    assert counts.tolist() == [len(library_ids(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library_ids(t)]


def digest(doc_id, text):
    ids = library_ids(text)
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def test_whole_table(spark, sf_dir, all_docs):
    want = sorted((digest(r.doc_id, r.text) for r in all_docs.collect()), key=str)
    assert rows(QUERIES["op9_bpe"](spark, sf_dir)) == want


def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    want = sorted((digest(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    assert rows(QUERIES["op9_bpe"](spark, folder)) == want
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op9_bpe"](spark, folder).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Bpe(bpe.read_definition(bpe.public_tokenizers.path("byte_bpe_50k.json")))
