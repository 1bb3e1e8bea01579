import hashlib
import random
import re

import numpy as np

from logkeep.llm import decontamination as D
from logkeep.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import save_tables
from workload.compare import differences, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        words = WORD.findall(lower(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(
                "" if item_id is None else str(item_id))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(words)
        out.append((doc_id, len(words), len(hit), len(found), digest, bad))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fm_index_finds_and_locates():
    rng = np.random.default_rng(3)
    for size in (1, 7, 63, 64, 65, 300):
        text = rng.integers(1, 5, size)
        index = D.FMIndex(text)
        sequences = [rng.integers(1, 7, n) for n in (1, 2, 3, 4) for _ in range(6)]
        lengths = np.array([len(s) for s in sequences])
        backward = np.zeros((len(sequences), 4), np.int64)
        for row, s in enumerate(sequences):
            backward[row, : len(s)] = s[::-1]
        low, high = index.search(backward, lengths)
        for row, s in enumerate(sequences):
            want = [i for i in range(size - len(s) + 1) if (text[i : i + len(s)] == s).all()]
            assert sorted(index.locate(np.arange(low[row], high[row])).tolist()) == want


def test_whole_tables(spark, sf_dir, all_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in all_docs.collect()], items)
    assert sum(r[5] for r in want)
    assert rows(QUERIES["op8_decontamination"](spark, sf_dir)) == sorted(want, key=str)
    found, _ = differences(spark, sf_dir, QUERIES["op8_decontamination"], ORACLES["op8_decontamination"], duck(sf_dir))
    assert found == ""


def test_odd_rows_short_items_and_several_passes(spark, tmp_path, odd_docs, monkeypatch):
    rng = random.Random(2)
    items = [(None, "one TWO"), (1, "a"), (1, "brown fox"), (2, None), (3, ""), (4, "café-isn"),
             (5, "word " * 14), (6, "dog again and again"), (6, "dog again and again")]
    random_docs = [(100 + i, " ".join(rng.choice("ab cd dog".split()) for _ in range(40)), *"xxxxxxx", 1, "x")
                   for i in range(20)]
    docs = odd_docs.unionAll(spark.createDataFrame(random_docs, odd_docs.schema))
    bench = spark.createDataFrame(items + [(7, "ab ab cd"), (8, "cd dog ab dog")], "item_id long, text string")
    folder = save_tables(tmp_path, documents=docs, benchmark=bench)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()],
                        [tuple(r) for r in bench.collect()]), key=str)
    assert rows(QUERIES["op8_decontamination"](spark, folder)) == want
    monkeypatch.setattr(D.benchmark_passes, "__defaults__", ("item_id", "text", 40))
    assert rows(QUERIES["op8_decontamination"](spark, folder)) == want


def test_empty_tables(spark, tmp_path, odd_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    folder = save_tables(tmp_path, documents=no_docs, benchmark=bench)
    assert QUERIES["op8_decontamination"](spark, folder).count() == 0
    kept = D.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_pipeline_keeps_clean_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string")
    kept = D.decontaminate(odd_docs, bench)
    assert rows(kept) == rows(odd_docs.where("text is null or text not like 'The quick%'"))
