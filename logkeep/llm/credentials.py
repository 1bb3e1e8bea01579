"""Secrets: base patterns, and formats learned by grammar inference.

Matches of the base patterns are labelled credentials. For each of their kinds a prefix
tree of symbol classes is built and its states are merged where they are statistically
compatible: their next-symbol and end frequencies, and those of all states below, stay
within a Hoeffding bound. The result is a probabilistic automaton of the format. Every other
word that could be a credential (16 characters or more of the credential alphabet, with a
letter and a digit) is scored by each automaton, as mean log probability a symbol; at or
above what nearly all of the kind's own credentials reach, it is reported as kind ``format``.

The automata are fitted to at most ``FIT_ROWS`` distinct credentials of each kind, those of
the smallest hashes; all candidates of all texts are scored. Base spans always stay; added
ones never overlap them. Offsets are code points. Null and empty texts have no spans; without
labelled credentials nothing is added. Repeated rows and null ids are treated like any other
row; other columns are not read. Scans take time in proportion to the text.
"""

import bisect
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from logkeep.llm.texts import struct_array
from logkeep.session import stored

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Distinct credentials of a kind that its automaton is fitted to.
FIT_ROWS = 400
#: Confidence of the merge test, and states with fewer visits than this are not told apart.
ALPHA, LEAST_VISITS = 0.05, 8
#: Share of a kind's own credentials that may fall below its threshold.
MISSES = 0.02
_FLOOR = math.log(1e-4)


def _either_case(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Symbol classes of the automata: digit, a-f, other lower, upper, and marks as they are.
CLASSES = {ord(c): k for k, cs in (("d", "0123456789"), ("x", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"),
                                   ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in cs}


def base_spans(text):
    """(start, kind number, end, secret) of the base patterns, by start, then kind."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


class Automaton:
    """Probabilistic automaton merged from the prefix tree of class sequences.

    ``moves`` has each state's next states by symbol, ``flows`` how often each move was made,
    ``visits`` and ``ends`` how often a sample was in a state and ended there.
    """

    def __init__(self, samples):
        self.moves, self.flows, self.visits, self.ends = [], [], [], []
        self._state()
        for sample in samples:
            state = 0
            self.visits[0] += 1
            for symbol in sample.translate(CLASSES):
                if symbol not in self.moves[state]:
                    self.moves[state][symbol] = self._state()
                self.flows[state][symbol] = self.flows[state].get(symbol, 0) + 1
                state = self.moves[state][symbol]
                self.visits[state] += 1
            self.ends[state] += 1
        self._merge()
        scores = sorted(map(self.score, samples))
        self.threshold = scores[int(MISSES * len(scores))] if scores else 0.0

    def _state(self):
        for rows, new in ((self.moves, {}), (self.flows, {}), (self.visits, 0), (self.ends, 0)):
            rows.append(new)
        return len(self.moves) - 1

    def _compatible(self, a, b):
        """Whether two states, and all below the second, have compatible frequencies."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if n >= LEAST_VISITS and m >= LEAST_VISITS:
                bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                shares = [(self.ends[a], self.ends[b])]
                shares += [(self.flows[a].get(s, 0), self.flows[b].get(s, 0))
                           for s in self.flows[a].keys() | self.flows[b].keys()]
                if any(abs(x / n - y / m) > bound for x, y in shares):
                    return False
            todo += [(self.moves[a][s], d) for s, d in self.moves[b].items() if s in self.moves[a]]
        return True

    def _fold(self, a, b):
        """Add state ``b`` and the tree below it to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for symbol, state in self.moves[b].items():
                self.flows[a][symbol] = self.flows[a].get(symbol, 0) + self.flows[b][symbol]
                if symbol in self.moves[a]:
                    todo.append((self.moves[a][symbol], state))
                else:
                    self.moves[a][symbol] = state

    def _merge(self):
        """Every state next to the settled ones joins one of them, or becomes settled."""
        settled = [0]
        while True:
            edge = next(((r, s, t) for r in settled for s, t in sorted(self.moves[r].items())
                         if t not in settled), None)
            if edge is None:
                return
            parent, symbol, state = edge
            match = next((r for r in settled if self._compatible(r, state)), None)
            if match is None:
                settled.append(state)
            else:
                self.moves[parent][symbol] = match
                self._fold(match, state)

    def score(self, text):
        """Mean log probability of a symbol, the end included."""
        total, state = 0.0, 0
        for symbol in text.translate(CLASSES):
            flow = self.flows[state].get(symbol)
            if not flow:
                return _FLOOR
            total += math.log(flow / self.visits[state])
            state = self.moves[state][symbol]
        if not self.ends[state]:
            return _FLOOR
        return (total + math.log(self.ends[state] / self.visits[state])) / (len(text) + 1)


def find_spans(text, automata):
    """(base, added) spans as (start, kind, end)."""
    base = base_spans(text)
    starts = [b[0] for b in base]
    furthest = list(itertools.accumulate((b[2] for b in base), max))
    added = []
    for m in CANDIDATE.finditer(text) if automata else ():
        word = m[0]
        if not _DIGIT.search(word) or not _LETTER.search(word):
            continue
        before = bisect.bisect_left(starts, m.end())
        if before and furthest[before - 1] > m.start():
            continue
        if any(a.score(word) >= a.threshold for a in automata):
            added.append((m.start(), ADDED, m.end()))
    return [(s, KINDS[k], e) for s, k, e, _ in base], added


_LABELLED = ArrayType(StructType([StructField("kind", StringType()), StructField("secret", StringType())]))


@F.arrow_udf(_LABELLED)
def labelled(text: pa.Array) -> pa.Array:
    """Credentials that the base patterns find, with their kinds."""
    out = [[{"kind": KINDS[k], "secret": v} for _, k, _, v in base_spans(t or "")] for t in text.to_pylist()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("secret", pa.string())]))
    return pa.array(out, kind)


def learn(docs, text="text", rows=FIT_ROWS):
    """Automata of the formats that the labelled credentials of each kind follow."""
    found = docs.select(F.explode(labelled(docs[text])).alias("c")).select("c.*").distinct()
    found = stored(found, "credentials")
    automata = []
    for kind in KINDS:
        own = found.where(F.col("kind") == kind).orderBy(F.xxhash64("secret"), "secret").limit(rows)
        samples = [r.secret for r in own.collect()]
        if len(samples) >= LEAST_VISITS:
            automata.append(Automaton(samples))
    return automata


def secret_spans(text, automata):
    """Column of base and added spans: ``array<struct<start, kind, end>>`` each."""
    span = "array<struct<start:int,kind:string,end:int>>"

    @F.arrow_udf(f"struct<base:{span},added:{span}>")
    def spans(text: pa.Array) -> pa.Array:
        found = [find_spans(t or "", automata) for t in text.to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        names = ("start", "kind", "end")
        return struct_array({name: pa.array([[dict(zip(names, s)) for s in f[k]] for f in found], kind)
                             for k, name in enumerate(("base", "added"))})

    return spans(text)


@F.arrow_udf(StringType())
def _joined(spans: pa.Array) -> pa.Array:
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    rows = [sorted(((s["start"], order[s["kind"]], s["kind"], s["end"]) for s in row)) for row in spans.to_pylist()]
    return pa.array([",".join(f"{k}:{s}:{e}" for s, _, k, e in row) for row in rows], pa.string())


def op5_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", secret_spans(F.col("text"), learn(docs)).alias("s"))

    def count(kind):
        own = F.filter("s.base", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("s.base"), 256).alias("base_sha256"),
                        _joined(F.concat("s.base", "s.added")).alias("spans"))
