"""Topic selectors by the thousand: names and selectors meet through keys, never all with all.

A selector is looked up by what it says literally. Exact names join by name. Globs and anchored
regexes begin or end with fixed text: each topic is cut to the lengths that occur among these
texts, and the pieces join by equality. Selectors without fixed ends are tried in alternations
of ``GROUP`` patterns, one constant expression each; only topics that match an alternation meet
its members. Every candidate is then held against its whole pattern.

The list of selectors is a job's configuration and lies in the driver; topics may be many. Null
topics match nothing; a topic or selector that comes twice counts twice.
"""

import re

from pyspark.sql import functions as F

from logkeep.functions.patterns import glob_regex, java_regex
from logkeep.operators.joins import join_small

#: Patterns of one alternation.
GROUP = 64
#: Selectors beyond which rows are selected through their distinct topics.
MANY = 64

_GLOB_META, _REGEX_META = "*?[", "\\.+*?()|[]{}^$"


def _before_meta(pattern):
    return re.match(r"[^*?\[]*", pattern)[0]


def _after_meta(pattern):
    """Fixed text that a glob ends with; a closing bracket may belong to a class."""
    return re.search(r"[^*?\[\]]*\Z", pattern)[0]


def regex_prefix(pattern):
    """Fixed text that every match of an anchored regex begins with; empty if that is not plain."""
    if not pattern.startswith("^") or "|" in pattern or "(?" in pattern or "\\Q" in pattern:
        return ""
    found, at = [], 1
    while at < len(pattern):
        escaped = re.match(r"\\([^\w\s])", pattern[at:], flags=re.A) or re.match(r"\[([^\]\[^\\:])\]", pattern[at:])
        if escaped:
            found.append(escaped[1])
            at += escaped.end()
        elif pattern[at] in _REGEX_META:
            break
        else:
            found.append(pattern[at])
            at += 1
    # a quantifier belongs to the text's last sign, which may then be missing
    if at < len(pattern) and pattern[at] in "*?{":
        found = found[:-1]
    return "".join(found)


def placed(selector):
    """(how, key, regex) of a selector: ``exact``, ``prefix``, ``suffix`` or ``loose``.

    The regex is None where the key alone decides.
    """
    kind, pattern = selector.type, selector.pattern
    if kind == "exact" or (kind == "glob" and not any(c in pattern for c in _GLOB_META)):
        return "exact", pattern, None
    if kind == "regex":
        prefix, regex = regex_prefix(pattern), java_regex(pattern)
        return ("prefix", prefix, regex) if prefix else ("loose", "", regex)
    prefix, suffix, regex = _before_meta(pattern), _after_meta(pattern), glob_regex(pattern)
    if prefix and len(prefix) >= len(suffix):
        return "prefix", prefix, None if pattern == prefix + "*" else regex
    if suffix:
        return "suffix", suffix, None if pattern == "*" + suffix else regex
    return "loose", "", regex


def alternations(regexes, group=GROUP):
    """Java regexes joined by groups; names of groups go, since two members may share one."""
    named = r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\])|\(\?<[A-Za-z]\w*>"
    plain = [re.sub(named, lambda m: m[1] or "(?:", r, flags=re.S) for r in regexes]
    # quoted text may be open at the end of a pattern
    plain = [r + "\\E" if r.rfind("\\Q") > r.rfind("\\E") else r for r in plain]
    return ["|".join(f"(?:{r})" for r in plain[at : at + group]) for at in range(0, len(plain), group)]


def matched(topics, selectors, topic="topic", group=GROUP):
    """(topic, number) of every topic and every selector, by its place in the list, that matches it."""
    spark, names = topics.sparkSession, topics.select(F.col(topic).alias("topic")).where(F.col(topic).isNotNull())
    parts = {"exact": [], "prefix": [], "suffix": [], "loose": []}
    for number, selector in enumerate(selectors):
        how, key, regex = placed(selector)
        parts[how].append((key, number, regex))
    found = [spark.createDataFrame([], "topic string, number int")]
    for how in ("exact", "prefix", "suffix"):
        if parts[how]:
            keys = spark.createDataFrame(parts[how], "_key string, number int, _regex string")
            found.append(_verified(join_small(_pieces(names, how, parts[how]), keys, ["_key"], spread="topic")))
    if parts["loose"]:
        tests = [F.when(F.col("topic").rlike(a), F.lit(i)) for i, a in enumerate(
            alternations([regex for _, _, regex in parts["loose"]], group))]
        members = spark.createDataFrame(
            [(i // group, number, regex) for i, (_, number, regex) in enumerate(parts["loose"])],
            "_key int, number int, _regex string")
        tried = names.select("topic", F.explode(F.array_compact(F.array(*tests))).alias("_key"))
        found.append(_verified(join_small(tried, members, ["_key"], spread="topic")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _pieces(names, how, rows):
    """Topics with each of their ends that may be a key."""
    if how == "exact":
        return names.withColumn("_key", F.col("topic"))
    # topic names are short, so few lengths occur
    lengths = F.array(*[F.lit(n) for n in sorted({len(key) for key, _, _ in rows})])
    held = F.filter(lengths, lambda n: n <= F.char_length("topic"))
    cut = F.left if how == "prefix" else F.right
    return names.select("topic", F.explode(held).alias("_n")).select("topic", cut("topic", F.col("_n")).alias("_key"))


def _verified(candidates):
    fits = F.col("_regex").isNull() | F.regexp_like("topic", F.col("_regex"))
    return candidates.where(fits).select("topic", "number")


def coverage(topics, selectors, topic="topic"):
    """One row for each selector with the number of topics that it matches."""
    listed = topics.sparkSession.createDataFrame(
        [(i, s.type, s.pattern) for i, s in enumerate(selectors)], "number int, type string, pattern string")
    counts = matched(topics, selectors, topic).groupBy("number").agg(F.count(F.lit(1)).alias("_n"))
    return listed.join(counts, "number", "left").select(
        "type", "pattern", F.coalesce("_n", F.lit(0)).cast("bigint").alias("topics_matched"))


def any_of(topic, selectors, group=GROUP):
    """One predicate for a long list: a set of names, and alternations of all patterns."""
    kept = [placed(s) for s in selectors]
    exact = [key for how, key, _ in kept if how == "exact"]
    regexes = []
    for how, key, regex in kept:
        if how != "exact":
            quoted = re.sub(r"([^0-9A-Za-z_])", r"\\\1", key)
            regexes.append(regex or (f"(?s)^{quoted}" if how == "prefix" else f"{quoted}\\z"))
    test = topic.isin(exact) if exact else F.lit(False)
    for one in alternations(regexes, group):
        test = test | topic.rlike(one)
    return test


def select(df, selectors):
    """Rows of ``df`` whose topic matches a selector of a long list.

    Bounded rows: their distinct topics are matched and joined back. Streams take one predicate.
    """
    if df.isStreaming:
        return df.where(any_of(F.col("topic"), selectors))
    names = df.select("topic").distinct()
    chosen = matched(names, selectors).select("topic").distinct()
    spread = next((c for c in ("offset", "segment", "partition") if c in df.columns), "topic")
    return join_small(df, chosen, ["topic"], spread=spread, how="left_semi").select(*df.columns)
