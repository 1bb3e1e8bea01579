"""Long lists of selectors against one predicate for each."""

import pytest
from pyspark.sql import functions as F

from helpers import same_rows
from logkeep.functions.patterns import TopicSelector, matches_any
from logkeep.operators import selectors as long_lists
from logkeep.operators import topics as topic_ops

NAMES = ["orders.a", "orders.b", "orders", "ord", "o", "", "x.orders", "a]b", "a[b", "a.b", "é.ü", "line\nend", "ORDERS.A",
         "payments-1", "payments-12", "pay*ments", "a|b", "b+c", "(x)", "tab\t", "orders.a"]
PATTERNS = {
    "exact": ["orders.a", "missing", "", "pay*ments", "é.ü", "orders.a"],
    "glob": ["*", "orders.*", "*.orders", "o?", "*a", "[ox]*", "a[]]b", "a[[]b", "*[ab]", "pay*1", "?", "é*", "line*end", "orders",
             "[!o]*", "*]b", "a[b", "*\t", "**", "*|b", "(*)"],
    "regex": ["^orders", "orders$", "^orders[.]a$", "^orders\\.?", "^ord(ers)?$", "a|b", "^a|b$", "^payments-1*$", "^o?", "^pa{2}",
              "(?i)^orders", "(?P<n>a)", "x(?P<n>.)o", "[[:upper:]]", "^a[|]b", "^b\\+", "\\Q(x", "^\\(x", "^x.o", "end$", ".", "^$", "^é"],
}
EVERY = [TopicSelector(kind, p) for kind, found in PATTERNS.items() for p in found]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "topic string").cache()


@pytest.fixture(scope="module")
def expected(names):
    row = names.agg(*[F.collect_list(F.when(s.matches(F.col("topic")), F.col("topic"))).alias(f"n{i}")
                      for i, s in enumerate(EVERY)]).first()
    return {i: sorted(row[i]) for i in range(len(EVERY))}


@pytest.mark.parametrize("group", [1, 4, 64])
def test_matches_equal_those_of_single_predicates(names, expected, group):
    found = {i: [] for i in range(len(EVERY))}
    for row in long_lists.matched(names, EVERY, group=group).collect():
        found[row.number].append(row.topic)
    assert {i: sorted(t) for i, t in found.items()} == expected


def test_one_predicate_equals_the_or_of_all(spark, names):
    for chosen in (EVERY[:6], EVERY[7:12], EVERY[30:40], EVERY[-4:-2], EVERY[3:60:9]):
        want = names.where(matches_any(F.col("topic"), chosen, when_empty=False))
        assert same_rows(names.where(long_lists.any_of(F.col("topic"), chosen, group=2)), want)


def test_long_lists_take_the_keyed_way(spark, names):
    rows = names.withColumn("offset", F.monotonically_increasing_id()).select("offset", "topic")
    narrow = [s for s in EVERY if s.pattern in ("orders.a", "^payments-1*$", "o?", "(?i)^orders")]
    filler = [TopicSelector("glob", f"none-{i}*") for i in range(long_lists.MANY)]
    want = topic_ops.select_for_backup(rows, narrow)
    for pick in (topic_ops.select_for_backup, topic_ops.select_for_restore):
        got = pick(rows, [*narrow, *filler])
        assert got.columns == rows.columns and same_rows(got, want)
    assert topic_ops.select_for_restore(names, [*narrow, *filler]).count() == want.count()
    counts = topic_ops.selector_coverage(names, [*narrow, *filler])
    assert same_rows(counts.where("topics_matched > 0"),
                     topic_ops.selector_coverage(names, narrow).where("topics_matched > 0"))
    assert counts.count() == len(narrow) + len(filler)


def test_no_topics(spark):
    none = spark.createDataFrame([], "topic string")
    assert long_lists.matched(none, EVERY).count() == 0
    assert long_lists.coverage(none, EVERY).agg(F.sum("topics_matched")).first()[0] == 0


def test_plan_pairs_through_keys_only(names):
    plan = long_lists.matched(names, EVERY)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(("pattern", "prefix"), [
    ("^orders[.]a", "orders.a"), ("^ab*", "a"), ("^ab+", "ab"), ("^ab{0,2}", "a"), ("^a\\.b?c", "a."), ("^a\\d", "a"),
    ("^a|b", ""), ("ab", ""), ("^(?i)ab", ""), ("^[ab]c", ""), ("^[^]a", ""), ("^a.b", "a"), ("^", ""), ("^a$", "a"), ("^a[.]*", "a")])
def test_prefix_of_a_regex(pattern, prefix):
    assert long_lists.regex_prefix(pattern) == prefix
