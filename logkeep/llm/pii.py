"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Every kind has a pattern, a validator and a prior score. A validated span of a base kind
(email, ip, card, phone) always counts. The other kinds need a score of one half: their
checksum or shape gives a part of it, words nearby that name the kind add to it, and words
that name something else (order, version, ...) take from it. Spans of those kinds that
overlap a base span are left out.

Kinds beside the base ones: iban (mod 97), ssn (number ranges), localphone (national form).
Offsets are code points, ends exclusive. Matches of a kind are leftmost and do not overlap;
one that fails its validator is dropped without a retry. All scans take time in proportion
to the text. Null and empty texts have no spans; masking leaves null texts null. Repeated
rows and null ids are treated like any other row; other columns are passed through or not
read.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logkeep.llm.texts import struct_array

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "localphone")
ACCEPT = 0.5
#: Code points on either side of a span that are searched for context words.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCALPHONE = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Prior score of a validated span, words nearby that raise it, words that lower it.
_PRIORS = {"iban": 0.6, "ssn": 0.3, "localphone": 0.3}
_FOR = {
    "iban": re.compile(r"\b(iban|account|bank|konto|compte|cuenta|bic|swift)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social|security|taxpayer)\b", re.I),
    "localphone": re.compile(r"\b(phone|tel|telephone|call|fax|mobile|cell|telefon|contact)\b", re.I),
}
_AGAINST = re.compile(r"\b(order|invoice|version|isbn|part|serial|ticket|item|model)\b", re.I)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text):
    """Whether an IBAN's check digits hold."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text):
    """Spans of local part, at sign and dotted domain, found from the at sign outwards."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            spans.append((start, end))
        at = text.find("@", max(at + 1, end))
    return spans


def _small(part):
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text):
    return [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]


def _cards(text):
    spans = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(m.span())
    return spans


def _phones(text):
    return [m.span() for m in _PHONE.finditer(text)
            if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def _ssn_valid(text):
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


_EXTRA = (
    ("iban", _IBAN, lambda t: 15 <= len(t.replace(" ", "")) <= 34 and mod97(t.replace(" ", ""))),
    ("ssn", _SSN, _ssn_valid),
    ("localphone", _LOCALPHONE, lambda t: True),
)


def context_score(text, kind, start, end):
    """Prior of the kind, moved by the words around the span."""
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return _PRIORS[kind] + 0.4 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))


def find_spans(text):
    """(base, added): lists of (start, kind number, end)."""
    base = [(s, 0, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return base, []
    for number, found in ((1, _ips), (2, _cards), (3, _phones)):
        base += [(s, number, e) for s, e in found(text)]
    base.sort()
    added = []
    for kind, pattern, valid in _EXTRA:
        for m in pattern.finditer(text):
            start, end = m.span()
            if valid(m[0]) and context_score(text, kind, start, end) >= ACCEPT and not any(
                    s < end and start < e for s, _, e in base):
                added.append((start, KINDS.index(kind), end))
    return base, added


def mask(text, spans):
    """``text`` with overlapping spans merged, each replaced by the name of its first kind."""
    out, at, end, tag = [], 0, 0, None
    for start, kind, stop in [*sorted(spans), (len(text) + 1, 0, 0)]:
        if tag is not None and start >= end:
            out.append(tag)
            at, tag = end, None
        if tag is None:
            out.append(text[at:start])
            end, tag = stop, f"[{KINDS[kind].upper()}]"
        end = max(end, stop)
    return "".join(out)


def pii_spans(text):
    """Column of base and added spans: ``array<struct<start, kind, end>>`` each."""
    span = "array<struct<start:int,kind:string,end:int>>"

    @F.arrow_udf(f"struct<base:{span},added:{span}>")
    def spans(text: pa.Array) -> pa.Array:
        found = [find_spans(t or "") for t in text.to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

        def column(k):
            return pa.array([[{"start": s, "kind": KINDS[n], "end": e} for s, n, e in f[k]]
                             for f in found], kind)

        return struct_array({"base": column(0), "added": column(1)})

    return spans(text)


@F.arrow_udf(StringType())
def masked(text: pa.Array) -> pa.Array:
    """Each text with its spans replaced by the names of their kinds."""
    out = []
    for t in text.to_pylist():
        spans = [s for found in find_spans(t or "") for s in found]
        out.append(mask(t, spans) if spans else t)
    return pa.array(out, pa.string())


def mask_pii(docs, text="text"):
    """``docs`` with its text masked; all columns stay as they are named."""
    return docs.withColumn(text, masked(docs[text]))


@F.arrow_udf(StringType())
def _joined(spans: pa.Array) -> pa.Array:
    texts = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row)
             for row in spans.to_pylist()]
    return pa.array(texts, pa.string())


def op3_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", pii_spans(F.col("text")).alias("s"))
    both = F.concat("s.base", "s.added")
    listed = F.array_sort(F.transform(both, lambda s: F.struct(
        s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["kind"], s["end"])))

    def count(kind):
        own = F.filter("s.base", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined("s.base"), 256).alias("base_sha256"),
                        _joined(listed).alias("spans"))
