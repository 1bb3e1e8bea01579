import re

import pytest
from pyspark.sql import functions as F

from logkeep.functions.patterns import (
    TopicSelector,
    check_patterns,
    glob_regex,
    java_regex,
    matches_any,
    regex_compiles,
    selectors_from_matcher,
)

TOPICS = ["orders", "orders.f", "orders-v2", "ordersXf", "a[b", "x.y.z", "Orders.f", "événement"]


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame([(t,) for t in TOPICS], "topic string")


def chosen(topics, *selectors, when_empty=False):
    rows = topics.where(matches_any(F.col("topic"), list(selectors), when_empty)).collect()
    return {r.topic for r in rows}


@pytest.mark.parametrize("pattern, expected", [
    ("orders", {"orders"}),
    ("orders.*", {"orders.f"}),
    ("orders?f", {"orders.f", "ordersXf"}),
    ("[oO]rders.f", {"orders.f", "Orders.f"}),
    ("[!o]rders.f", {"Orders.f"}),
    ("[^o]rders.f", {"Orders.f"}),
    ("*", set(TOPICS)),
    ("*.*.z", {"x.y.z"}),
    ("a[[]b", {"a[b"}),
    ("?v?nement", {"événement"}),
])
def test_glob(topics, pattern, expected):
    assert chosen(topics, TopicSelector("glob", pattern)) == expected


def test_exact_takes_wildcards_literally(topics):
    assert chosen(topics, TopicSelector("exact", "orders*")) == set()
    assert chosen(topics, TopicSelector("exact", "orders")) == {"orders"}


def test_regex_is_unanchored(topics):
    assert chosen(topics, TopicSelector("regex", "rders[.]")) == {"orders.f", "Orders.f"}
    assert chosen(topics, TopicSelector("regex", "^[[:upper:]]")) == {"Orders.f"}


def test_character_classes(topics):
    assert chosen(topics, TopicSelector("regex", "^[[:word:]]+$")) == {"orders", "ordersXf"}
    assert chosen(topics, TopicSelector("regex", "^[[:^lower:]]r")) == {"Orders.f"}
    with pytest.raises(ValueError):
        TopicSelector("regex", "[[:letter:]]")
    assert not regex_compiles("^[[:letter:]]")


def test_any_and_empty(topics):
    both = [TopicSelector("exact", "orders"), TopicSelector("glob", "x.*")]
    assert chosen(topics, *both) == {"orders", "x.y.z"}
    assert chosen(topics, when_empty=False) == set()
    assert chosen(topics, when_empty=True) == set(TOPICS)


def test_matcher_fields():
    assert selectors_from_matcher(name="a") == [TopicSelector("exact", "a")]
    assert selectors_from_matcher(name="a*") == [TopicSelector("glob", "a*")]
    assert len(selectors_from_matcher("a", "b*", "^c")) == 3


@pytest.mark.parametrize("pattern", ["a(?=b)", "(?<!a)b", "(a)\\1", "a++", "[a&&b]", "(?>a)"])
def test_what_re2_lacks_is_refused(pattern):
    with pytest.raises(ValueError):
        java_regex(pattern)
    assert not regex_compiles(pattern)


def test_glob_regex_agrees_with_python():
    for glob, text in [("a.b*", "a.bcd"), ("a.b", "axb"), ("[a-c]?", "bz")]:
        ours = re.match(glob_regex(glob).replace("\\z", "\\Z"), text) is not None
        import fnmatch

        assert ours == fnmatch.fnmatchcase(text, glob)


def test_pattern_reasons(spark):
    rows = [("",), ("a/b",), ("a\\b",), ("a\0b",), ("^[",), ("(x$",), ("^ok$",), ("plain[",),
            ("^a(?i)b",), (None,)]
    found = {
        r.pattern: r.reason
        for r in check_patterns(spark.createDataFrame(rows, "pattern string")).collect()
    }
    assert found == {
        "": "empty", None: "empty", "a/b": "invalid character: /",
        "a\\b": "invalid character: \\", "a\0b": "invalid character: NUL",
        "^[": "invalid regex", "(x$": "invalid regex", "^ok$": None, "plain[": None,
        "^a(?i)b": None,
    }


def test_brackets_inside_classes(spark):
    names = spark.createDataFrame([("a[b",), ("a]b",), ("axb",)], "topic string")
    for pattern, want in (("a[[]b", ["a[b"]), ("a[]]b", ["a]b"]), ("a[^[]b", ["a]b", "axb"]), ("a[x[]b", ["a[b", "axb"])):
        rows = names.where(TopicSelector("regex", pattern).matches(F.col("topic")))
        assert sorted(r.topic for r in rows.collect()) == sorted(want)
