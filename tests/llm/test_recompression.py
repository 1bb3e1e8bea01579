import hashlib
import random

import numpy as np
import pytest

from logkeep.llm import recompression as R
from logkeep.llm.exchange import NO_ID
from logkeep.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows
from workload.compare import differences, duck


def brute(docs):
    words = [(NO_ID if d is None else d, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, ws in words:
        for i in range(len(ws) - 12):
            key = tuple(ws[i : i + 13])
            least[key] = min(d, least.get(key, NO_ID))
    out = []
    for d, ws in words:
        gone = {j for i in range(len(ws) - 12) if least[tuple(ws[i : i + 13])] < d for j in range(i, i + 13)}
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((None if d == NO_ID else d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_symbols_inside_equal_windows_are_alike():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        kinds = int(rng.integers(2, 12))
        middle = rng.integers(0, kinds, 13).astype(np.uint64)
        seen = []
        for _ in range(2):
            left, right = (rng.integers(0, kinds, 8).astype(np.uint64) for _ in range(2))
            text = np.concatenate([left, middle, right])
            first, length, name = R.parse(text, np.zeros(len(text), np.int64))
            assert length.max() <= R.LONGEST
            inside = (first >= 8 + 3) & (first + length <= 8 + 9)
            seen.append(list(zip(first[inside], length[inside], name[inside])))
        assert seen[0] == seen[1] and seen[0]


@pytest.mark.parametrize("block_words, bucket_words", [(200, 100), (None, None)])
def test_random_repeats(spark, block_words, bucket_words):
    rng = random.Random(8)
    passages = [" ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(10, 40)))
                for _ in range(8)]
    docs = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(
            rng.choice("abcdefghij") for _ in range(rng.randrange(1, 20))) for _ in range(4)]
        text = " ".join(parts)
        docs.append((rng.choice([i, i, i, 5, None]), text[rng.randrange(30) :] if rng.random() < 0.5 else text))
    docs += [(500 + i, "x " * n) for i, n in enumerate((12, 13, 14, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = R.remove_repeats(df, block_words=block_words, bucket_words=bucket_words)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
           for r in found.collect()]
    assert sorted(got, key=str) == brute(docs) and any(g[2] for g in got)


def test_whole_table(spark, sf_dir, all_docs):
    want = brute([(r.doc_id, r.text) for r in all_docs.collect()])
    assert rows(QUERIES["op6_repeated_passages"](spark, sf_dir)) == want
    sql = ORACLES["op6_repeated_passages"]
    found, _ = differences(spark, sf_dir, QUERIES["op6_repeated_passages"], sql, duck(sf_dir))
    assert found == ""


def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    assert rows(QUERIES["op6_repeated_passages"](spark, folder)) == brute(
        [(r.doc_id, r.text) for r in odd_docs.collect()])
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op6_repeated_passages"](spark, folder).count() == 0
