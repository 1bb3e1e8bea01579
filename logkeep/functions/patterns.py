"""Topic selectors as column predicates, and checks of patterns."""

import functools
import operator
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named character classes of RE2 and their Java spelling. Fixed values.
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank",
    "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
    "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}

# Constructs Java accepts and RE2 refuses: look-around, atomic groups,
# back-references, possessive quantifiers and class intersection.
NOT_IN_RE2 = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+|&&")


@dataclass(frozen=True)
class TopicSelector:
    type: str  # exact, glob or regex
    pattern: str

    def __post_init__(self):
        if self.type not in ("exact", "glob", "regex"):
            raise ValueError(f"unknown selector type: {self.type}")
        if self.type == "regex":
            java_regex(self.pattern)

    def matches(self, topic):
        """Predicate on a topic name column."""
        if self.type == "exact":
            return topic == F.lit(self.pattern)
        if self.type == "glob":
            return _glob_predicate(topic, self.pattern)
        return topic.rlike(java_regex(self.pattern))


def selectors_from_matcher(name=None, glob=None, regex=None):
    """A matcher may set several fields; each set field is one selector."""
    found = []
    if name:
        kind = "glob" if re.search(r"[*?\[]", name) else "exact"
        found.append(TopicSelector(kind, name))
    if glob:
        found.append(TopicSelector("glob", glob))
    if regex:
        found.append(TopicSelector("regex", regex))
    return found


def matches_any(topic, selectors, when_empty):
    """OR of all selectors; ``when_empty`` is the answer for an empty list."""
    if not selectors:
        return F.lit(when_empty)
    return functools.reduce(operator.or_, [s.matches(topic) for s in selectors])


def java_regex(pattern):
    """RE2 pattern in Java spelling; raises where the two differ."""
    if NOT_IN_RE2.search(pattern):
        raise ValueError(f"not supported in topic patterns: {pattern}")
    spelled = re.sub(r"\[:(\^?)(\w+):\]", _java_class, pattern.replace("(?P<", "(?<"))
    # Java nests classes: a bracket or && inside a class is text in RE2
    return re.sub(r"(\\.)|\[(\^?\]?)((?:\\.|[^\]\\])*)\]", _java_brackets, spelled, flags=re.S)


def _java_brackets(match):
    escaped, head, body = match.groups()
    if escaped:
        return escaped
    body = re.sub(r"(\\.)|([\[&])", lambda m: m[1] or "\\" + m[2], body, flags=re.S)
    return "[" + head.replace("]", "\\]") + body + "]"


def _java_class(match):
    negated, name = match.groups()
    if name == "word":
        return "\\W" if negated else "\\w"
    if name not in POSIX_CLASSES:
        raise ValueError(f"unknown character class: {name}")
    return ("\\P{" if negated else "\\p{") + POSIX_CLASSES[name] + "}"


def glob_regex(pattern):
    """Anchored regex for a glob with ``*``, ``?`` and ``[...]``."""
    pieces = re.findall(r"\[[!^]?\]?[^\]]*\]|.", pattern, flags=re.S)
    out = []
    for piece in pieces:
        if piece == "*":
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif len(piece) > 1:
            negated = piece[1] in "!^"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", piece[2 if negated else 1 : -1])
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.sub(r"([^0-9A-Za-z_])", r"\\\1", piece))
    return "(?s)^" + "".join(out) + "\\z"


def _glob_predicate(topic, pattern):
    # Plain comparisons reach partition pruning and Parquet statistics.
    if not re.search(r"[*?\[]", pattern):
        return topic == F.lit(pattern)
    if pattern == "*":
        return topic.isNotNull()
    if not re.search(r"[*?\[]", pattern[:-1]) and pattern.endswith("*"):
        return topic.startswith(pattern[:-1])
    return topic.rlike(glob_regex(pattern))


def regex_compiles(pattern):
    """Whether an RE2 engine would accept the pattern."""
    names = re.findall(r"\[:\^?(\w+):\]", pattern)
    if NOT_IN_RE2.search(pattern) or any(n not in POSIX_CLASSES and n != "word" for n in names):
        return False
    plain = re.sub(r"\(\?[imsU-]+\)", "", re.sub(r"\[:\^?\w+:\]", "a", pattern))
    try:
        re.compile(plain)
    except (re.error, OverflowError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    known = {p: regex_compiles(p) for p in patterns.dropna().unique()}
    return patterns.map(known.get).astype(object)


def pattern_reason(pattern):
    """Why a pattern is refused, null if it is fine."""
    bad_chars = [("/", "/"), ("\\", "\\"), ("\0", "NUL")]
    reason = F.when(pattern.isNull() | (pattern == ""), F.lit("empty"))
    for char, shown in bad_chars:
        reason = reason.when(
            F.instr(pattern, char) > 0, F.lit(f"invalid character: {shown}")
        )
    is_regex = pattern.startswith("^") | pattern.endswith("$")
    clean = ~pattern.rlike("[/\\\\\\x00]")
    compiles = _compiles(F.when(is_regex & clean, pattern))
    return reason.when(is_regex & ~compiles, F.lit("invalid regex"))


def check_patterns(selectors, column="pattern"):
    """Rows of patterns with ``ok`` and ``reason``."""
    return selectors.withColumn("reason", pattern_reason(F.col(column))).withColumn(
        "ok", F.col("reason").isNull()
    )
