import re
from collections import Counter

import pytest

from logkeep.llm import divergence as D
from logkeep.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows
from workload.compare import differences, duck

NAME = "op12_source_divergence"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, min_docs=D.MIN_DOCS, top=D.TOP):
    seen, counts = {}, {}
    for text, lang, source in docs:
        words = Counter(TERM.findall((text or "").translate(UPPER)))
        seen.setdefault(lang or "", Counter()).update(words.keys())
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def shares(own):
            full = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // full for t in kept}

        q, p = shares(sum(sources.values(), Counter())), {s: shares(own) for s, own in sources.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found[:most], 1)]
    return sorted(out, key=str)


def facts(docs):
    return [(r.text, r.lang, r.source) for r in docs.collect()]


def test_whole_table(spark, sf_dir, all_docs):
    got = QUERIES[NAME](spark, sf_dir)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(facts(all_docs))
    assert rows(got) == want and {r[2] for r in want} == {"pair", "term"}


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_sql_twin(spark, folder):
    folder = f"/root/testdata/{folder}"
    found, _ = differences(spark, folder, QUERIES[NAME], ORACLES[NAME], duck(folder))
    assert found == ""


@pytest.mark.parametrize(("bits", "min_docs", "top"), [(0, 2, 3), (3, 3, 50), (64, 1, 1)])
def test_digests_that_terms_share_are_split(spark, all_docs, bits, min_docs, top):
    docs = all_docs.where("n_chars < 1500").limit(60).cache()
    got = D.source_divergence(docs, min_docs, top, bits)
    assert rows(got) == brute(facts(docs), min_docs, top)


ODD = [
    (None, "Ab ab aB c9d é É", "x", "s"), (1, None, "x", "s"), (1, None, "x", "s"), (2, "", None, None),
    (3, " \t 12 !", "y", "only"), (4, "ab ab c d", "x", "t"), (4, "ab ab c d", "x", "t"),
    (5, "word " * 30_000, "x", "u"), (6, "z", "", ""), (7, "z z y", None, "long source " * 50),
    (8, "tie a\U0001f600b tie2", "x", "t"), (9, "ünï", "x", None),
]


@pytest.mark.parametrize(("piece", "words", "terms"), [(1 << 20, 1 << 22, 1 << 19), (1, 1, 1), (3, 5, 2)])
def test_odd_rows_and_blocks(spark, tmp_path, monkeypatch, piece, words, terms):
    docs = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in ODD], "doc_id long, text string, lang string, "
                                 "source string, term string, n long, digest string, ord long")
    if piece < 1 << 20:
        docs = docs.where("length(text) < 1000 or text is null")
    for name, value in (("PIECE", piece), ("BLOCK_WORDS", words), ("BLOCK_TERMS", terms)):
        monkeypatch.setattr(D, name, value)
    for bits, least in ((64, 1), (1, 2), (64, 30)):
        assert rows(D.source_divergence(docs, least, 2, bits)) == brute(facts(docs), least, 2)


def test_empty_table(spark, tmp_path, all_docs):
    folder = save_tables(tmp_path, documents=all_docs.where("false"))
    assert QUERIES[NAME](spark, folder).count() == 0
