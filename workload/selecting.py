"""Queries on selectors, hashes, topics and workers."""

from pyspark.sql import functions as F

from logkeep.functions.hashing import fnv32, fnv64
from logkeep.functions.patterns import TopicSelector, check_patterns, selectors_from_matcher
from logkeep.operators import topics
from logkeep.sources.filelog import between_offsets
from workload import logs
from workload import sqlparts as sql
from workload.registry import query

PLACE = ["topic", "partition", "offset"]
PLACE_SQL = 'topic, "partition", "offset"'


@query("select_exact", f"""WITH {sql.EVENTS}
SELECT {PLACE_SQL}, "timestamp" FROM events_log WHERE topic = 'events.click' OR topic = 'events.purchase'""")
def select_exact(spark, sf_dir):
    chosen = [TopicSelector("exact", "events.click"), TopicSelector("exact", "events.purchase")]
    rows = topics.select_for_backup(logs.log(spark, sf_dir, "events"), chosen)
    return rows.select(*PLACE, F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("select_glob", f"""WITH {sql.ALL}
SELECT {PLACE_SQL} FROM all_logs WHERE topic GLOB 'orders.*' OR topic GLOB 'lineitem.[an]' OR topic GLOB 'events.?i*'""")
def select_glob(spark, sf_dir):
    chosen = [TopicSelector("glob", p) for p in ("orders.*", "lineitem.[an]", "events.?i*")]
    return topics.select_for_backup(logs.all_logs(spark, sf_dir), chosen).select(*PLACE)


@query("select_regex", f"""WITH {sql.ALL}
SELECT {PLACE_SQL} FROM all_logs
WHERE regexp_matches(topic, '^(events|orders)[.](click|f|p.*)$') OR regexp_matches(topic, 'item[.][[:lower:]]$')""")
def select_regex(spark, sf_dir):
    chosen = [
        TopicSelector("regex", "^(events|orders)[.](click|f|p.*)$"),
        TopicSelector("regex", "item[.][[:lower:]]$"),
    ]
    return topics.select_for_backup(logs.all_logs(spark, sf_dir), chosen).select(*PLACE)


@query("select_any", f"""WITH {sql.ALL}
SELECT {PLACE_SQL} FROM all_logs
WHERE topic = 'orders.o' OR topic GLOB 'events.*' OR regexp_matches(topic, '^lineitem[.]r$')""")
def select_any(spark, sf_dir):
    chosen = selectors_from_matcher(name="orders.o", glob="events.*", regex="^lineitem[.]r$")
    return topics.select_for_backup(logs.all_logs(spark, sf_dir), chosen).select(*PLACE)


@query("select_empty_restore", f"""WITH {sql.ALL}
SELECT topic, "partition", count(*) AS restored FROM all_logs GROUP BY topic, "partition" """)
def select_empty_restore(spark, sf_dir):
    rows = topics.select_for_restore(logs.all_logs(spark, sf_dir), [])
    return rows.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("restored"))


@query("pattern_check", """WITH hosts AS (SELECT page_id, url, split_part(url, '/', 3) AS host FROM pages),
patterns AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '^' || host || '$'
  WHEN 2 THEN '^[' || host WHEN 3 THEN '' WHEN 4 THEN 'a\\' || host WHEN 5 THEN host
  WHEN 6 THEN '^(' || host || '$' ELSE host || '[0-9]+$' END AS pattern FROM hosts),
reasons AS (SELECT page_id, pattern, CASE WHEN pattern = '' THEN 'empty'
  WHEN contains(pattern, '/') THEN 'invalid character: /'
  WHEN contains(pattern, '\\') THEN 'invalid character: \\'
  WHEN (starts_with(pattern, '^') OR ends_with(pattern, '$'))
    AND try(regexp_matches('', pattern)) IS NULL THEN 'invalid regex' END AS reason FROM patterns)
SELECT page_id, pattern, reason IS NULL AS ok, reason FROM reasons""".replace("\\\\", "\\"))
def pattern_check(spark, sf_dir):
    host = F.split_part(F.col("url"), F.lit("/"), F.lit(3))
    kind = F.col("page_id") % 8
    pattern = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("^"), host, F.lit("$")))
        .when(kind == 2, F.concat(F.lit("^["), host))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.concat(F.lit("a\\"), host))
        .when(kind == 5, host)
        .when(kind == 6, F.concat(F.lit("^("), host, F.lit("$")))
        .otherwise(F.concat(host, F.lit("[0-9]+$")))
    )
    rows = logs.table(spark, sf_dir, "pages").select("page_id", pattern.alias("pattern"))
    return check_patterns(rows).select("page_id", "pattern", "ok", "reason")


COVERAGE = [
    TopicSelector("glob", "cust.1*"),
    TopicSelector("glob", "payments.*"),
    TopicSelector("exact", "cust.7"),
    TopicSelector("exact", "cust.none"),
    TopicSelector("regex", "[.][0-9]5$"),
    TopicSelector("regex", "^orders"),
]


@query("selector_coverage", f"""WITH {sql.CUSTOMER_TOPICS}
SELECT 'glob' AS type, 'cust.1*' AS pattern, count_if(topic GLOB 'cust.1*')::BIGINT AS topics_matched FROM customer_topics
UNION ALL SELECT 'glob', 'payments.*', count_if(topic GLOB 'payments.*')::BIGINT FROM customer_topics
UNION ALL SELECT 'exact', 'cust.7', count_if(topic = 'cust.7')::BIGINT FROM customer_topics
UNION ALL SELECT 'exact', 'cust.none', count_if(topic = 'cust.none')::BIGINT FROM customer_topics
UNION ALL SELECT 'regex', '[.][0-9]5$', count_if(regexp_matches(topic, '[.][0-9]5$'))::BIGINT FROM customer_topics
UNION ALL SELECT 'regex', '^orders', count_if(regexp_matches(topic, '^orders'))::BIGINT FROM customer_topics""")
def selector_coverage(spark, sf_dir):
    return topics.selector_coverage(logs.customer_topics(spark, sf_dir), COVERAGE)


#: (type, text before a number, text after it, how many numbers): the selectors of a long list.
LONG_LIST = (
    ("exact", "cust.", "1", 1000), ("exact", "none.", "", 100), ("glob", "cust.", "*", 500), ("glob", "*.", "?", 100),
    ("glob", "*", "5", 200), ("glob", "cust.[!1]", "", 200), ("regex", "^cust[.]", "[0-9]$", 500),
    ("regex", "", "[13]$", 200), ("regex", "^(cust|none)[.]", "$", 100),
)
LONG_LIST_SQL = "selectors AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS type, '{before}' || i || '{after}' AS pattern FROM range({n}) t(i)"
    for kind, before, after, n in LONG_LIST) + """),
hits AS (SELECT s.type, s.pattern, t.topic FROM selectors s JOIN customer_topics t ON CASE s.type
  WHEN 'exact' THEN t.topic = s.pattern WHEN 'glob' THEN t.topic GLOB s.pattern
  ELSE regexp_matches(t.topic, s.pattern) END)"""


def long_list():
    return [TopicSelector(kind, f"{before}{i}{after}") for kind, before, after, n in LONG_LIST for i in range(n)]


@query("selector_coverage_long", f"""WITH {sql.CUSTOMER_TOPICS}, {LONG_LIST_SQL}
SELECT s.type, s.pattern, count(h.topic) AS topics_matched FROM selectors s
LEFT JOIN hits h ON s.type = h.type AND s.pattern = h.pattern GROUP BY s.type, s.pattern""")
def selector_coverage_long(spark, sf_dir):
    """2,900 selectors against one topic per customer."""
    return topics.selector_coverage(logs.customer_topics(spark, sf_dir), long_list())


@query("select_long", f"""WITH {sql.CUSTOMER_TOPICS}, {LONG_LIST_SQL}
SELECT topic, partitions FROM customer_topics WHERE topic IN (SELECT topic FROM hits WHERE pattern NOT IN ('[13]$', '0[13]$'))""")
def select_long(spark, sf_dir):
    """Topics that a long list of selectors takes into a backup."""
    chosen = [s for s in long_list() if s.pattern != "0[13]$"]
    return topics.select_for_backup(logs.customer_topics(spark, sf_dir), chosen).select("topic", "partitions")


FNV32_SQL = (
    "list_reduce(list_transform(range(1, octet_length(encode({x})) + 1), "
    "lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::UBIGINT), "
    "lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::UBIGINT)"
)
FNV64_SQL = (
    "list_reduce(list_transform(range(1, octet_length(encode({x})) + 1), "
    "lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::HUGEINT), "
    "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, "
    "14695981039346656037::HUGEINT)"
)


@query("fnv32", f"SELECT c_custkey, c_name, CAST({FNV32_SQL.format(x='c_name')} AS BIGINT) AS hash FROM customer")
def hash32(spark, sf_dir):
    c = logs.table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", fnv32(F.col("c_name")).alias("hash"))


@query("fnv64", f"SELECT page_id, url, CAST({FNV64_SQL.format(x='url')} AS VARCHAR) AS hash FROM pages")
def hash64(spark, sf_dir):
    p = logs.table(spark, sf_dir, "pages")
    return p.select("page_id", "url", fnv64(F.col("url")).cast("string").alias("hash"))


BUCKET_SQL = "CAST(" + FNV32_SQL.format(x="('42:' || topic)") + " % 3 AS INTEGER)"


@query("topic_buckets", f"""WITH {sql.CUSTOMER_TOPICS}
SELECT topic, {BUCKET_SQL} AS worker_id FROM customer_topics""")
def topic_buckets(spark, sf_dir):
    names = logs.customer_topics(spark, sf_dir).select("topic")
    return topics.assign_workers(names, workers=3, seed=42)


@query("worker_topics", f"""WITH {sql.CUSTOMER_TOPICS}, placed AS (SELECT topic, {BUCKET_SQL} AS worker_id FROM customer_topics)
SELECT worker_id, count(*) AS topics, min(topic) AS first_topic, max(topic) AS last_topic FROM placed GROUP BY worker_id""")
def worker_topics(spark, sf_dir):
    return topics.topics_by_worker(logs.customer_topics(spark, sf_dir), workers=3, seed=42)


@query("worker_rows", f"""WITH {sql.ALL}
SELECT {PLACE_SQL}, {BUCKET_SQL} AS worker_id FROM all_logs WHERE {BUCKET_SQL} = 1""")
def worker_rows(spark, sf_dir):
    rows = logs.all_logs(spark, sf_dir).select(*PLACE)
    return topics.rows_of_worker(rows, worker=1, workers=3, seed=42)


@query("partition_watermarks", f"""WITH {sql.ALL}
SELECT topic, "partition", min("offset") AS low, max("offset") + 1 AS high, count(*) AS messages
FROM all_logs GROUP BY topic, "partition" """)
def partition_watermarks(spark, sf_dir):
    return topics.watermarks(logs.all_logs(spark, sf_dir))


@query("topic_discovery", f"""WITH {sql.ALL}
SELECT topic, CAST(count(DISTINCT "partition") AS INTEGER) AS partitions FROM all_logs GROUP BY topic""")
def topic_discovery(spark, sf_dir):
    return topics.discover(logs.all_logs(spark, sf_dir))


@query("topic_describe", f"""WITH {sql.ALL}
SELECT topic, CAST(count(DISTINCT "partition") AS INTEGER) AS partitions,
  string_agg(DISTINCT CAST("partition" AS VARCHAR), ',' ORDER BY lpad(CAST("partition" AS VARCHAR), 5, '0')) AS partition_ids,
  CAST(length(topic) % 3 + 1 AS SMALLINT) AS replication_factor, 'cleanup=' || substr(topic, 1, 6) AS config
FROM (SELECT DISTINCT topic, "partition" FROM all_logs) GROUP BY topic""".replace("string_agg(DISTINCT ", "string_agg("))
def topic_describe(spark, sf_dir):
    rows = logs.all_logs(spark, sf_dir)
    facts = rows.select(F.col("topic").alias("name")).distinct().select(
        "name",
        (F.length("name") % 3 + 1).cast("smallint").alias("replication_factor"),
        F.create_map(F.lit("cleanup"), F.substring("name", 1, 6)).alias("config"),
    )
    ids = F.array_join(F.col("partition_ids").cast("array<string>"), ",")
    config = F.concat(F.lit("cleanup="), F.col("config")["cleanup"])
    return topics.describe(rows, facts).select(
        "topic", "partitions", ids.alias("partition_ids"), "replication_factor",
        config.alias("config"),
    )


@query("offset_range_scan", f"""WITH {sql.LINEITEM}
SELECT {PLACE_SQL} FROM lineitem_log WHERE "offset" >= 50 AND "offset" < 900""")
def offset_range_scan(spark, sf_dir):
    return between_offsets(logs.log(spark, sf_dir, "lineitem"), 50, 900).select(*PLACE)
