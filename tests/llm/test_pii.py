import hashlib
import random
import re

import pytest

from logkeep.llm import pii
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text)
              if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest_row(doc_id, text):
    base = brute(text or "")
    _, added = pii.find_spans(text or "")
    counts = [sum(k == n for _, k, _ in base) for n in range(4)]
    return (doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(),
            listed(sorted(base + added)))


def test_scans_agree_with_plain_patterns():
    rng = random.Random(4)
    for alphabet in ("a1.@-+ é%", "1232.. ", "0123456789 -", "+12()-. 3"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.find_spans(text)[0] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000,
                 "a@" * 150_000, "+1" + "(" * 300_000, "A" * 300_000, "1 " * 150_000):
        pii.find_spans(text)


def test_added_kinds():
    cases = {
        "iban GB82 WEST 1234 5698 7654 32 now": "iban",
        "GB82WEST12345698765432": "iban",
        "GB82WEST12345698765431": None,
        "invoice GB82WEST12345698765432": None,
        "my ssn 123-45-6789": "ssn",
        "number 123-45-6789": None,
        "ssn 666-45-6789": None,
        "call (212) 555-0199 today": "localphone",
        "part (212) 555-0199 today": None,
    }
    for text, kind in cases.items():
        base, added = pii.find_spans(text)
        assert [pii.KINDS[k] for _, k, _ in added] == ([kind] if kind else []), text


def test_mask():
    text = "x 1@a.b +1 (234) 555-1234y 4111 1111 1111 1111."
    spans = sorted(sum(pii.find_spans(text), []))
    assert pii.mask(text, spans) == "x [EMAIL] [PHONE]y [CARD]."
    assert pii.mask("abcdef", [(1, 0, 3), (2, 1, 5)]) == "a[EMAIL]f"
    assert pii.mask("abcdef", [(0, 2, 6)]) == "[CARD]"


def test_whole_table(spark, sf_dir, all_docs):
    got = rows(QUERIES["op3_pii"](spark, sf_dir))
    want = sorted((digest_row(r.doc_id, r.text) for r in all_docs.collect()), key=str)
    assert got == want and any(r[6] for r in want)


def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    want = sorted((digest_row(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    assert rows(QUERIES["op3_pii"](spark, folder)) == want
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op3_pii"](spark, folder).count() == 0
    same = pii.mask_pii(odd_docs)
    assert same.columns == odd_docs.columns and rows(same) == rows(odd_docs)


@pytest.mark.parametrize("text", ["mail 1@a.b", None, ""])
def test_masking_keeps_nulls(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.mask_pii(df).first().text == (text and "mail [EMAIL]")
