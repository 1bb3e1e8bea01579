import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from logkeep.llm import fingerprints as P
from logkeep.llm.bitnodes import cut_width
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import near_codes, rows


def brute_code(text):
    votes = [0] * 64
    for word, n in Counter(text.encode().lower().split()).items():
        h, w = xxhash.xxh64_intdigest(word, seed=42), round(8 * min(len(word), 16) * (1 + math.log(n)))
        votes = [v + (w if h >> b & 1 else -w) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def brute(docs):
    docs = [(d, t or "", xxhash.xxh64_intdigest((t or "").encode(), seed=42)) for d, t in docs]
    docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2] - (1 << 64) * (r[2] >> 63)))
    codes = [brute_code(t) for _, t, _ in docs]
    out = []
    for i, (doc_id, text, _) in enumerate(docs):
        j = (i + 1) % len(docs)
        half = len(text) // 2
        changed = text[: len(text) - half] + docs[j][1][:half]
        other = brute_code(changed)
        like = [1 - (codes[i] ^ c).bit_count() / 64 for c in (other, codes[j])]
        near = sum(1 for c in set(codes) if c != codes[i] and (c ^ codes[i]).bit_count() <= 3)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(),
                    f"{codes[i]:016x}", f"{other:016x}", *like, near))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [P.RANGE_BYTES, 20_000])
def test_whole_table(spark, sf_dir, all_docs, monkeypatch, range_bytes):
    monkeypatch.setattr(P.neighbours, "__defaults__", ("doc_id", "text", range_bytes))
    want = brute([(r.doc_id, r.text) for r in all_docs.collect()])
    assert rows(QUERIES["op7_fingerprints"](spark, sf_dir)) == want


@pytest.mark.parametrize("range_bytes", [P.RANGE_BYTES, 30])
def test_odd_rows(spark, tmp_path, odd_docs, no_docs, monkeypatch, range_bytes):
    monkeypatch.setattr(P.neighbours, "__defaults__", ("doc_id", "text", range_bytes))
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    assert rows(QUERIES["op7_fingerprints"](spark, folder)) == brute(
        [(r.doc_id, r.text) for r in odd_docs.collect()])
    lone = odd_docs.where("doc_id = 7")
    folder = save_tables(tmp_path / "b", documents=lone)
    assert rows(QUERIES["op7_fingerprints"](spark, folder)) == brute([(7, lone.first().text)])
    folder = save_tables(tmp_path / "c", documents=no_docs)
    assert QUERIES["op7_fingerprints"](spark, folder).count() == 0


@pytest.mark.parametrize("node_rows", [6, 10**6])
def test_block_tables_count_every_pair_once(spark, node_rows):
    codes = np.array(near_codes(11, 25), np.uint64)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3).sum(1) - 1
    want = {int(c): int(n) for c, n in zip(codes.view(np.int64), near) if n}
    assert {r.code: r.n_near for r in P.near_counts(df, node_rows=node_rows).collect()} == want
    assert cut_width(0) == 0
