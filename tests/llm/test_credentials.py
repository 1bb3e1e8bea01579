import hashlib
import random
import re

from logkeep.llm import credentials as C
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows

KEY = "(?:password|passwd|secret|token|api_?key)"
SLOW = re.compile(rf"""(?ai)({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in SLOW.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{C.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def base_row(doc_id, text):
    base = brute(text or "")
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return (doc_id, *(sum(k == n for _, k, _ in base) for n in range(3)), digest)


def test_base_patterns():
    rng = random.Random(9)
    pieces = ["PassWord", "passwd", "secret", "token", "apikey", "API_KEY", "AKIA", "AKIA" + "A1" * 9, "ab12" * 7,
              "=", ":", " ", "'", '"', "x", "abcdef", "é", "ſecret", "toKen", "deadbeef"]
    for _ in range(8000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert [(s, k, e) for s, k, e, _ in C.base_spans(text)] == brute(text), text


def test_automaton_learns_formats():
    rng = random.Random(2)
    samples = ["sk_" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(200)]
    a = C.Automaton(samples)
    assert len(a.visits) > 24 and sum(a.flows[0].values()) + a.ends[0] == a.visits[0]
    fresh = ["sk_" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(200)]
    assert sum(a.score(f) >= a.threshold for f in fresh) > 180
    for other in ("mail7.example.com1", "ABCDEFGHIJKL1234567", "sk-0123456789abcdef0123", "ordinary_words_in_1_line"):
        assert a.score(other) < a.threshold


def test_compatible_states_merge():
    a = C.Automaton(["ab" * n for n in (1, 1, 1, 1, 2, 2, 3) for _ in range(40)])
    reached, todo = {0}, [0]
    while todo:
        for t in a.moves[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    assert len(reached) < 7


def test_added_spans_and_overlaps():
    rng = random.Random(3)
    samples = ["".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(20)) for _ in range(100)]
    automata = [C.Automaton(samples)]
    text = f"see {samples[0]} and token={samples[1]} or plain"
    base, added = C.find_spans(text, automata)
    assert [k for _, k, _ in base] == ["assign"] and added == [(4, "format", 24)]
    assert C.find_spans(text, []) == (base, [])


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "token" * 60_000, "token" + " " * 300_000, "AKIA" * 80_000, "A1" * 150_000,
                 "abc1" * 5 * 20_000, "token=abcdef " * 30_000):
        C.find_spans(text, [C.Automaton(["abcdef12" * 4] * 20)])


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows(QUERIES["op5_secrets"](spark, sf_dir))
    want = sorted((base_row(r.doc_id, r.text) for r in all_docs.collect()), key=str)
    assert [r[:5] for r in got] == want and any(r[1] for r in want)
    texts = {r.doc_id: r.text for r in all_docs.collect()}
    for r in got:
        base = listed(brute(texts[r[0]]))
        assert {*filter(None, base.split(","))} <= {*r[5].split(",")}


def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    got = rows(QUERIES["op5_secrets"](spark, folder))
    assert [r[:5] for r in got] == sorted((base_row(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op5_secrets"](spark, folder).count() == 0
