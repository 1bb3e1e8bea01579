import math
import zlib
from collections import Counter

import numpy as np
import pytest

from logkeep.llm import suffixtree as S
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables

END = None


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_model(docs):
    """Conditional probability by the definition, with dictionaries of tuples."""
    train = [tokens(t) for d, t in docs if not is_held_out(d)]
    total = sum(map(len, train))
    words = Counter(w for t in train for w in t)
    base = total + len(words) + 1
    grams = Counter(tuple(t[i : i + n]) for t in train for n in range(1, S.DEPTH + 2)
                    for i in range(len(t) - n + 1))
    grams = {g: c for g, c in grams.items() if c >= max(2, S.P_MIN * total)}
    following, states = {}, {}
    for g, c in grams.items():
        following.setdefault(g[:-1], {})[g[-1]] = c

    def state(context):
        return next((context[i:] for i in range(len(context)) if context[i:] in states), ())

    def probability(context, word):
        s = state(context)
        if not s:
            return (words[word] + 1) / base
        shares, rest = states[s]
        return shares[word] if word in shares else rest * probability(s[1:], word)

    for s in sorted((s for s in following if s), key=len):
        c = grams[s]
        own = {w: n / c for w, n in following[s].items()}
        given = {w: probability(s[1:], w) for w in own}
        rest, other = max(0.0, 1 - sum(own.values())), max(1e-12, 1 - sum(given.values()))
        gain = sum(p * math.log(p / given[w]) for w, p in own.items())
        gain += rest * math.log(rest / other) if rest else 0
        if gain >= S.DIVERGENCE and gain * c >= 2 * len(own) + 5:
            kept = {w: p - S.DISCOUNT / c for w, p in own.items()}
            states[s] = kept, (1 - sum(kept.values())) / other
    return words, total, base, states, probability


def brute(docs):
    words, total, base, _, probability = brute_model(docs)
    out = []
    for d, text in docs:
        t = tokens(text)
        low = sum(math.log10((words[w] + 1) / base) for w in t)
        high = sum(math.log10(probability(tuple(t[max(0, i - S.DEPTH) : i]), w)) for i, w in enumerate(t))
        out.append((d, is_held_out(d), len(t), sum(words[w] > 0 for w in t), total, low, high))
    return sorted(out, key=str)


def same(got, want):
    got = sorted(map(tuple, got.collect()), key=lambda r: str(r[:1]))
    want = sorted(want, key=lambda r: str(r[:1]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_whole_table(spark, sf_dir, all_docs):
    want = brute([(r.doc_id, r.text) for r in all_docs.collect()])
    same(QUERIES["op1_suffix_tree"](spark, sf_dir), want)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize("run_tokens", [S.RUN_TOKENS, 3_000])
def test_other_runs_and_thresholds(spark, sf_dir, all_docs, monkeypatch, run_tokens):
    monkeypatch.setattr(S, "RUN_TOKENS", run_tokens)
    monkeypatch.setattr(S, "P_MIN", 2e-4)
    monkeypatch.setattr(S, "SLACK", 5e-5)
    docs = all_docs.repartition(5)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    same(S.score_texts(docs), want)


def test_distributions_sum_to_one():
    docs = [(i, "a b c a b d a b c e " * 5 + "x y z") for i in range(6)]
    words, _, base, states, probability = brute_model(docs)
    assert len({len(s) for s in states}) > 1
    for s in [*states, ()]:
        unseen = _leftover(s, states) / base
        assert math.isclose(sum(probability(s, w) for w in words) + unseen, 1, rel_tol=1e-6)


def _leftover(state, states):
    """Share of the root's mass for unseen words that reaches a state."""
    share = 1.0
    while state:
        if state in states:
            share *= states[state][1]
        state = state[1:]
    return share


def test_odd_rows_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    same(QUERIES["op1_suffix_tree"](spark, folder), brute([(r.doc_id, r.text) for r in odd_docs.collect()]))
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op1_suffix_tree"](spark, folder).count() == 0
    only = odd_docs.where("doc_id is not null").selectExpr("12 doc_id", "text").limit(2)
    number = next(i for i in range(100) if is_held_out(i))
    only = only.selectExpr(f"{number} doc_id", "text")
    folder = save_tables(tmp_path / "c", documents=only)
    same(QUERIES["op1_suffix_tree"](spark, folder), brute([(r.doc_id, r.text) for r in only.collect()]))


def test_a_phrase_counts_the_same_in_a_larger_corpus(spark):
    phrase = "quartz vellum ostrich"
    filler = [(i, " ".join(f"w{i}x{k}" for k in range(3_000))) for i in range(20, 120)]
    docs = [(i, f"{phrase} n{i}") for i in range(12)] + filler
    want = brute(docs)
    assert want[0][4] * 2e-5 > 5
    same(S.score_texts(spark.createDataFrame(docs[:5] + filler, "doc_id long, text string").repartition(4)),
         brute(docs[:5] + filler))
    low, high = next(r[5:] for r in brute(docs[:5] + filler) if r[0] == 1)
    assert high > low + 5


@pytest.mark.parametrize("heavy", [5, 40, 1 << 19])
def test_words_dealt_to_several_tasks(spark, sf_dir, all_docs, odd_docs, monkeypatch, heavy):
    monkeypatch.setattr(S, "RUN_TOKENS", 3_000)
    monkeypatch.setattr(S, "BUCKET_TOKENS", 10_000)
    monkeypatch.setattr(S, "HEAVY", heavy)
    docs = all_docs.select("doc_id", "text").where("doc_id % 4 = 0").unionAll(odd_docs.select("doc_id", "text"))
    docs = docs.where("length(coalesce(text, '')) < 20000").repartition(3)
    same(S.score_texts(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))
