import re
import unicodedata
import zlib
from collections import Counter

import pytest

from logkeep.llm import langprofiles as L
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows

NAME = "op11_language_profiles"


def brute_counts(text):
    chars = [c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()]
    if not any(unicodedata.category(c)[0] == "L" for c in chars):
        return Counter()
    row = " " + re.sub(" +", " ", "".join(chars) + " ").lstrip(" ")
    found = (row[i : i + n] for n in (1, 2, 3) for i in range(len(row) - n + 1))
    return Counter(g for g in found if g != " " and " " not in g[1:-1])


def brute_ranks(counts):
    order = sorted(counts, key=lambda g: (-counts[g], len(g), g))[: L.RANKS]
    return {g: i for i, g in enumerate(order)}


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def brute(docs):
    learned = {}
    for doc_id, text, lang in docs:
        if lang is not None and not held(doc_id):
            learned.setdefault(lang, Counter()).update(brute_counts(text))
    profiles = {lang: brute_ranks(c) for lang, c in sorted(learned.items()) if c}
    out = []
    for doc_id, text, _ in docs:
        own, best = brute_ranks(brute_counts(text)), ("und", 0.0)
        if own and profiles:
            far = {lang: sum(min(L.RANKS, abs(i - p[g])) if g in p else L.RANKS for g, i in own.items())
                   for lang, p in profiles.items()}
            lang = min(far, key=far.get)
            best = (lang, 1 - far[lang] / (len(own) * L.RANKS))
        out.append((doc_id, held(doc_id), *best))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir, all_docs):
    got = QUERIES[NAME](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert rows(got) == brute([(r.doc_id, r.text, r.lang) for r in all_docs.collect()])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[NAME](spark, folder).where("held_out")
    both = got.join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    assert len(both) > 150 and (both.lang_pred == both.lang).mean() >= 0.99
    assert both.score.between(0, 1).all()


def test_languages_of_held_out_rows_do_not_matter(spark, tmp_path, sf_dir, all_docs):
    changed = all_docs.withColumn("lang", L.F.when(L.held_out("doc_id"), "xx").otherwise(L.F.col("lang")))
    folder = save_tables(tmp_path, documents=changed)
    assert rows(QUERIES[NAME](spark, folder)) == rows(QUERIES[NAME](spark, sf_dir))


ODD = [
    (None, "le chat et le chien", "fr"), (1, None, "fr"), (2, "", None), (3, "12 34 !", "en"),
    (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (6, "the cat", None),
    (7, "Ünïcode ǅ é naïve İstanbul हिन्दी 漢字 \U0001f600", ""), (8, "wort " * 30_000, "de"),
    (9, "a\U000e0100b \U0010ffff", "de"), (-3, " \t\n ", "de"), (11, "le", "fr"), (12, "the dog", "en"),
]


@pytest.mark.parametrize("piece", [1 << 20, 1, 3, 7])
def test_odd_rows_and_pieces(spark, tmp_path, monkeypatch, piece):
    docs = spark.createDataFrame([(i, t, g, 1, "x", "x") for i, t, g in ODD],
                                 "doc_id long, text string, lang string, gram long, rank string, n string")
    if piece < 1 << 20:
        docs = docs.where("length(text) < 1000 or text is null")
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "HELD", 40)
    folder = save_tables(tmp_path, documents=docs)
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert rows(QUERIES[NAME](spark, folder)) == want
    trained = L.train(docs)
    named = L.with_language(docs, trained)
    assert named.columns == [*docs.columns, "lang_pred"] and named.count() == docs.count()


def test_empty_table_and_nothing_learned(spark, tmp_path, no_docs):
    empty = no_docs.withColumn("lang", L.F.lit("x"))
    folder = save_tables(tmp_path / "a", documents=empty)
    assert QUERIES[NAME](spark, folder).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    folder = save_tables(tmp_path / "b", documents=docs)
    assert rows(QUERIES[NAME](spark, folder)) == brute([(1, "some text", None)])


def test_number_of_languages_is_checked(spark):
    docs = spark.createDataFrame([("abc", f"l{i}") for i in range(5)], "text string, lang string")
    assert len(L.train(docs, languages=5).names) == 5
    with pytest.raises(ValueError):
        L.train(docs, languages=4)


def test_profile_rows_are_ranked_texts(spark):
    docs = spark.createDataFrame([("aab ab", "x")], "text string, lang string")
    got = [(r["rank"], L.gram_text(r["gram"]), r["n"]) for r in L.profiles(docs).orderBy("rank").collect()]
    assert got[:4] == [(0, "a", 3), (1, "b", 2), (2, " a", 2), (3, "ab", 2)]
    assert ("b ", 2) in [(g, n) for _, g, n in got] and (" ab", 1) in [(g, n) for _, g, n in got]
