"""Registered queries: each operator over the driver's tables, beside the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.layout import spread
from lodestar.functions.text import tokens
from lodestar.operators import aggregates as A
from lodestar.operators import filters as P
from lodestar.operators import graph as G
from lodestar.operators import lint as L
from lodestar.operators import retrieval as R
from lodestar.operators.profile import totals_profile
from lodestar.sources.index import snapshot_diff
from lodestar.sources.ledger import malformed_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def between(column: str, first: str, after: str):
    return (F.col(column) >= F.lit(first).cast("timestamp_ntz")) & (F.col(column) < F.lit(after).cast("timestamp_ntz"))


# ---- filters and projections


@registered("""SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
    WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal >= 1000 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13)""")
def filter_eq_gte_in(spark, sf_dir):
    rows = P.query(table(spark, sf_dir, "customer"), equals={"c_mktsegment": "HOUSEHOLD"}, field_gte={"c_acctbal": 1000}, field_in={"c_nationkey": [1, 3, 5, 7, 9, 11, 13]}, key="c_custkey")
    return rows.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@registered("SELECT p_partkey, p_name, p_brand FROM part WHERE starts_with(p_name, 'small') ORDER BY p_partkey LIMIT 100")
def filter_prefix_project_limit(spark, sf_dir):
    return P.query(table(spark, sf_dir, "part"), folder="small", path_column="p_name", key="p_partkey", fields=["p_name", "p_brand"], limit=100)


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def filter_nested_path(spark, sf_dir):
    return P.query(table(spark, sf_dir, "events").withColumn("extra", F.parse_json("props")), field_gte={"k": 50}, key="event_id", fields=["k"])


@registered("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3') AND json_exists(props, '$.k')")
def filter_nested_in(spark, sf_dir):
    rows = P.query(table(spark, sf_dir, "events").withColumn("extra", F.parse_json("props")), has_field="k", field_in={"k": [1, 2, 3]}, key="event_id")
    return rows.select("event_id", "event_type")


def daily_tags(spark, sf_dir):
    """Event types by user and day, as a tag list: the types are few, so a list is short."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("tags"))


_TAGS = "SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS tags FROM events GROUP BY ALL"


@registered(f"SELECT user_id, day, len(tags) AS n_tags FROM ({_TAGS}) WHERE list_has_all(tags, ['purchase', 'error'])")
def tags_all(spark, sf_dir):
    return P.query(daily_tags(spark, sf_dir), tags=["purchase", "error"], key="user_id").select("user_id", "day", F.size("tags").cast("long").alias("n_tags"))


@registered(f"SELECT user_id, day, len(tags) AS n_tags FROM ({_TAGS}) WHERE list_has_any(tags, ['purchase', 'error'])")
def tags_any(spark, sf_dir):
    return P.query(daily_tags(spark, sf_dir), tags_any=["purchase", "error"], key="user_id").select("user_id", "day", F.size("tags").cast("long").alias("n_tags"))


@registered(f"SELECT user_id, day, len(tags) AS n FROM ({_TAGS}) WHERE len(tags) > 3")
def tag_count_over(spark, sf_dir):
    rows = daily_tags(spark, sf_dir).withColumn("key", F.struct("user_id", "day"))
    return A.tag_counts(rows, 3, name="key").select("key.user_id", "key.day", F.col("n").cast("long").alias("n"))


@registered("SELECT d.doc_id, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def field_presence(spark, sf_dir):
    found = G.resolve(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")
    return found.select("doc_id", F.col("resolved").alias("present"))


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND starts_with(o_orderpriority, '1')")
def ledger_eligible(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"pristine": F.col("o_orderstatus") == "F", "judge_model": F.col("o_orderpriority")})
    return P.eligible(rows, "1").select("o_orderkey", "o_custkey", "o_totalprice")


# ---- references


@registered("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def backlinks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return G.backlinks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, target="l_partkey")


@registered("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
    AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01')""")
def broken_refs(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where(between("o_orderdate", "1995-01-01", "1996-01-01"))
    return G.broken(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), known, "l_orderkey", "o_orderkey")


@registered("""SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
    AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')""")
def orphans(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where(between("o_orderdate", "1996-01-01", "1997-01-01"))
    return G.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), edges, "c_custkey", "o_custkey")


@registered("SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_refs(spark, sf_dir):
    return G.duplicates(table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")), ["user_id", "event_type", "day"])


def transitions(spark, sf_dir):
    """Consecutive event types of a user, as edges."""
    return A.followers(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"))


_EDGES = "SELECT DISTINCT user_id, event_type AS source, target FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL AND target <> event_type"
_ONE_WAY = f"WITH e AS ({_EDGES}) SELECT user_id, source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.source = e.target AND b.target = e.source)"


@registered(_ONE_WAY)
def asymmetric_refs(spark, sf_dir):
    return G.one_way(transitions(spark, sf_dir), carry=["user_id"])


_PAIRS = [("click", "purchase"), ("view", "error"), ("error", "view"), ("signup", "click")]


@registered(f"SELECT source, target, count(*) AS n FROM ({_ONE_WAY}) WHERE (source, target) IN (('click', 'purchase'), ('view', 'error'), ('error', 'view'), ('signup', 'click')) GROUP BY ALL")
def asymmetric_scoped(spark, sf_dir):
    scope = spark.createDataFrame(_PAIRS, "source string, target string")
    return G.one_way(transitions(spark, sf_dir), carry=["user_id"]).join(F.broadcast(scope), ["source", "target"], "left_semi").groupBy("source", "target").agg(F.count("*").alias("n"))


_TRADE = """SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.09 AND c_nationkey <> s_nationkey"""


@registered(f"""WITH e AS ({_TRADE}), o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.source = e.target AND b.target = e.source))
    SELECT source, target, s.n_regionkey AS source_kind, t.n_regionkey AS target_kind, target AS missing_reverse_from, 'WARN' AS severity
    FROM o JOIN nation s ON s.n_nationkey = source JOIN nation t ON t.n_nationkey = target WHERE s.n_regionkey = t.n_regionkey OR s.n_regionkey = 0""")
def asymmetric_by_kind(spark, sf_dir):
    """Trade between nations that has no reverse, for pairs of regions in scope."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    sold = lines.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source")), "c_custkey")
    edges = sold.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey").select("source", "target")
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("kind"))
    scope = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a in (0, b)], "source_kind int, target_kind int")
    return G.asymmetric(edges, kinds, scope)


_SIDES = "a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.02)"


@registered(f"WITH {_SIDES} SELECT *, 'right' AS missing_on FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def mirror_gap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return G.mirror_gaps(lines.where("l_quantity > 10"), lines.where("l_discount > 0.02"), ["l_orderkey", "l_partkey"])


@registered("SELECT l_orderkey, l_linenumber, l_partkey, EXISTS (SELECT 1 FROM part p WHERE p_size > 10 AND p_partkey = l_partkey) AS resolved FROM lineitem")
def fk_resolution(spark, sf_dir):
    return G.resolve(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part").where("p_size > 10"), "l_partkey", "p_partkey")


@registered("""SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
    AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_partkey = lineitem.l_partkey AND k.l_returnflag <> 'R')""")
def required_links(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edges = lambda rows: rows.select(F.col("l_orderkey").alias("source"), F.lit("part").alias("field"), F.col("l_partkey").alias("target"))
    found = G.required_links(edges(lines), table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("name")), edges(lines.where("l_returnflag <> 'R'")))
    return found.select("source", "target")


@registered("SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY p_name HAVING count(*) > 1")
def shared_names(spark, sf_dir):
    return G.shared_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path"))).withColumnRenamed("first_path", "first_key")


@registered("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS n_targets FROM pages")
def extract_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_targets"))


_HREFS = "SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)"


@registered(f"SELECT href, arg_min(page_id, (page_id, position)) AS page_id, arg_min(position, (page_id, position)) AS position FROM ({_HREFS}) GROUP BY href")
def first_occurrence(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("position", "href"))
    # the least (page, position) of each link is a pre-aggregated minimum: a link on every page is never gathered
    first = hrefs.groupBy("href").agg(F.min(F.struct("page_id", "position")).alias("at"))
    return first.select("href", "at.page_id", F.col("at.position").cast("long").alias("position"))


@registered(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
    SELECT doc_id, term FROM t JOIN w USING (term) WHERE length(term) >= 9""")
def text_mentions(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("term")).where("length(term) >= 9").distinct().withColumn("target", F.col("term"))
    return G.text_mentions(texts(spark, sf_dir), terms, keys=["doc_id"]).select("doc_id", "term")


# ---- aggregates


@registered("""SELECT 'total' AS axis, NULL AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def stats_by_axis(spark, sf_dir):
    return A.stats(table(spark, sf_dir, "documents"), ["lang", "source"])


@registered(f"""SELECT 'n_tags' AS axis, CAST(len(tags) AS VARCHAR) AS value, count(*) AS n FROM ({_TAGS}) GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM ({_TAGS})
    UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest(tags) AS t FROM ({_TAGS})) GROUP BY t""")
def stats_with_tags(spark, sf_dir):
    return A.stats(daily_tags(spark, sf_dir).withColumn("n_tags", F.size("tags")), ["n_tags", "tags"], "tags")


@registered("""WITH u AS (SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1), c(tag) AS (VALUES ('click'), ('view'), ('purchase'), ('refund'))
    SELECT tag, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'ghost' WHEN c.tag IS NULL THEN 'noncanon' WHEN n = 1 THEN 'singleton' ELSE 'ok' END AS status FROM u FULL JOIN c USING (tag)""")
def ghost_noncanon_singleton(spark, sf_dir):
    canon = spark.createDataFrame([("click",), ("view",), ("purchase",), ("refund",)], "tag string")
    return A.tag_health(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag")), canon)


@registered("""WITH m AS (SELECT DISTINCT user_id % 10 AS facet, user_id AS member FROM events), t AS (SELECT DISTINCT user_id AS member, event_type AS tag FROM events WHERE ts < TIMESTAMP '2024-01-04'),
    s AS (SELECT facet, count(*) AS size FROM m GROUP BY 1), h AS (SELECT facet, tag, count(*) AS present FROM m JOIN t USING (member) GROUP BY ALL)
    SELECT facet, tag, present, size - present AS missing, round(present / size, 6) AS confidence FROM h JOIN s USING (facet) WHERE round(present / size, 6) >= 0.6 AND size - present BETWEEN 1 AND 2""")
def under_tag_majority(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    members = events.select((F.col("user_id") % 10).alias("facet"), F.col("user_id").alias("member")).distinct()
    tags = events.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).select(F.col("user_id").alias("member"), F.col("event_type").alias("tag")).distinct()
    return A.under_tagged(members, tags)


@registered("SELECT o_custkey AS source, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 15")
def out_degree_band(spark, sf_dir):
    return A.out_degrees(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))).where("n > 15")


_CELLS = "SELECT lang, source, count(quality) AS n, round(avg(CAST(quality AS DOUBLE)), 1) AS mean, greatest(0, 5 - count(quality)) AS runway FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


def cells(spark, sf_dir):
    # labels join by doc_id to two short columns: texts are never read
    return A.cell_means(table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "source"], "quality")


@registered(_CELLS)
def cell_mean_runway(spark, sf_dir):
    return cells(spark, sf_dir)


@registered(f"SELECT count(*) AS cells, count(*) FILTER (n >= 5) AS stable, CAST(coalesce(sum(runway), 0) AS BIGINT) AS needed FROM ({_CELLS})")
def runway_summary(spark, sf_dir):
    return A.runway_summary(cells(spark, sf_dir))


@registered("SELECT count(DISTINCT o_orderpriority) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS judges FROM orders WHERE o_orderstatus = 'F'")
def distinct_judges(spark, sf_dir):
    return A.distinct_values(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderpriority").select("n", F.array_join("values", ",").alias("judges"))


def order_ledger(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "structural").when(F.col("o_orderstatus") == "O", "content").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), kind.alias("audit_type"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("file_pos"))


_LEDGER = "SELECT o_custkey AS note, CASE o_orderstatus WHEN 'F' THEN 'structural' WHEN 'O' THEN 'content' ELSE 'other' END AS audit_type, o_totalprice AS score, o_orderdate AS ts, o_orderkey AS file_pos FROM orders"


@registered(f"""SELECT (SELECT count(*) FROM customer) AS cards, count(DISTINCT note) AS audited, count(DISTINCT CASE WHEN audit_type = 'structural' THEN note END) AS structural,
    count(DISTINCT CASE WHEN audit_type = 'content' THEN note END) AS content, count(*) AS rows FROM ({_LEDGER})""")
def coverage_totals(spark, sf_dir):
    return A.coverage_totals(table(spark, sf_dir, "customer"), order_ledger(spark, sf_dir))


@registered("""SELECT c_mktsegment AS kind, 'balance' AS requirement, count(*) FILTER (NOT coalesce(made < TIMESTAMP '1995-07-01', false)) AS defects, count(*) FILTER (made < TIMESTAMP '1995-07-01') AS drift
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS made FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1""")
def spec_drift(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"))
    records = table(spark, sf_dir, "customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left").withColumnRenamed("c_mktsegment", "kind")
    wanted = spark.createDataFrame([(k, "balance", "1995-07-01") for k in ("BUILDING", "MACHINERY", "HOUSEHOLD")], "kind string, requirement string, introduced string").withColumn("introduced", F.to_timestamp_ntz("introduced"))
    return A.requirement_gaps(records, wanted, F.col("c_acctbal") >= 0)


# ---- windows and orders


@registered("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    return A.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", ["event_id"])


_LATEST = "SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1"


@registered(f"""SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'error') AS error FROM ({_LATEST}) GROUP BY 1""")
def pivot_latest(spark, sf_dir):
    newest = A.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["event_id"])
    return A.pivoted(newest, "user_id", "event_type", ["click", "purchase", "error"], "value")


@registered("SELECT user_id, greatest(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type = 'error')) AS last FROM events GROUP BY 1")
def last_of_axes(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["purchase", "error"]).agg(F.max("ts"))
    return A.last_of(wide, ["purchase", "error"]).select("user_id", "last")


@registered(f"""WITH l AS (SELECT * FROM ({_LEDGER}) WHERE audit_type <> 'other' QUALIFY row_number() OVER (PARTITION BY note, audit_type ORDER BY ts DESC, file_pos) = 1)
    SELECT c_custkey AS path, s.score AS structural_score, c.score AS content_score, greatest(s.ts, c.ts) AS last FROM customer
    LEFT JOIN (SELECT * FROM l WHERE audit_type = 'structural') s ON s.note = c_custkey LEFT JOIN (SELECT * FROM l WHERE audit_type = 'content') c ON c.note = c_custkey""")
def coverage_join(spark, sf_dir):
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("created"))
    return A.coverage(cards, order_ledger(spark, sf_dir)).select("path", "structural_score", "content_score", "last")


@registered("""SELECT c_custkey AS path, last, CASE WHEN last IS NULL THEN 1 ELSE 0 END AS tier FROM customer
    LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) ON o_custkey = c_custkey""")
def tiered_order(spark, sf_dir):
    last = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("created")).join(last, F.col("path") == F.col("o_custkey"), "left")
    return cards.orderBy(*A.card_order(cards)).select("path", "last", A.card_tier("last").alias("tier"))


@registered("SELECT event_id, NOT coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS pristine FROM events")
def pristine_flag(spark, sf_dir):
    return A.pristine(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "pristine")


@registered("SELECT md5(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_by_hash(spark, sf_dir):
    # the first of each hash by a pre-aggregated minimum: texts go no further than the scan
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@registered("SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def suppress_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.suppress_repeats(rows, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("user_id", "event_type", "day", "event_id")


@registered("SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 3")
def top_per_axis(spark, sf_dir):
    return A.top_per_axis(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 3)


@registered("SELECT o_custkey, o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_orderpriority = '1-URGENT'")
def chronological_list(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return A.chronological(rows, "year", "o_orderkey")


# ---- sets


@registered("SELECT l_orderkey AS source, l_partkey AS target, 'link' AS kind FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_suppkey, 'embed' FROM lineitem WHERE l_returnflag = 'A'")
def union_of_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edge = lambda flag, target, kind: lines.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"))
    return edge("R", "l_partkey", "link").unionByName(edge("A", "l_suppkey", "embed"))


@registered(f"WITH {_SIDES} SELECT l_orderkey, l_partkey FROM a EXCEPT SELECT l_orderkey, l_partkey FROM b")
def set_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return G.only_left(lines.where("l_quantity > 10"), lines.where("l_discount > 0.02"), ["l_orderkey", "l_partkey"])


@registered("SELECT count(*) AS outside FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def superset_invariant(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return G.only_left(used, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), ["key"]).agg(F.count("*").alias("outside"))


# ---- text and lint


@registered(r"SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: trim(x) <> '')) AS n_solid, list_max(list_transform(l, lambda x: length(x))) AS longest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def line_split_stats(spark, sf_dir):
    lines = F.split("text", "\n")
    longest = F.array_max(F.transform(lines, F.char_length)).cast("long")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_solid"), longest.alias("longest"))


@registered("SELECT lang, count(*) FILTER (regexp_matches(text, '[À-ÿ]')) AS mixed, count(*) AS n FROM documents GROUP BY 1")
def mixed_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("[À-ÿ]")).alias("mixed"), F.count("*").alias("n"))


@registered(r"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    t AS (SELECT doc_id, n, len(string_split(line, '|')) AS cells FROM l WHERE contains(line, '|')), h AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id ORDER BY n) AS header_cells FROM t)
    SELECT doc_id, CAST(n AS BIGINT) AS n, cells, header_cells FROM h WHERE cells <> header_cells""")
def broken_table_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").contains("|"))
    rows = lines.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.size(F.split("line", r"\|")).cast("long").alias("cells"))
    return L.cell_mismatches(rows, ["doc_id"], "n", "cells")


_RULES = """SELECT 'missing-balance' AS rule, 'ERROR' AS severity, 'structural' AS stream, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
    UNION ALL SELECT 'enum', 'ERROR', 'structural', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0
    UNION ALL SELECT 'broken-link', 'ERROR', 'structural', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) HAVING count(*) > 0
    UNION ALL SELECT 'name-shape', 'WARN', 'heuristic', count(*) FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') HAVING count(*) > 0"""


@registered(_RULES)
def lint_summary(spark, sf_dir):
    """Rules over records in two streams: each is a filter or an anti-join, and all are one union."""
    rows = table(spark, sf_dir, "customer").withColumn("path", F.col("c_custkey").cast("string"))
    allowed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").withColumnRenamed("n_nationkey", "name")
    found = [
        L.issue(rows.where("c_acctbal < 0"), "missing-balance", "ERROR"),
        L.issue(rows.join(allowed, "c_mktsegment", "left_anti"), "enum", "ERROR"),
        L.issue(G.broken(rows, nations, "c_nationkey"), "broken-link", "ERROR"),
        L.issue(rows.where(~F.col("c_name").rlike("[02468]$")), "name-shape", "WARN", stream=L.HEURISTIC),
    ]
    return L.summary(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


@registered("""WITH e AS (SELECT c_custkey, (c_acctbal < 0)::BIGINT + (c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))::BIGINT AS errors FROM customer)
    SELECT CAST(c_custkey AS VARCHAR) AS path, errors, errors = 0 AS structural_green FROM e""")
def structural_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("path", F.col("c_custkey").cast("string"))
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").withColumnRenamed("n_nationkey", "name")
    return L.structural_green(rows, L.issue(rows.where("c_acctbal < 0"), "balance", "ERROR").unionByName(L.issue(G.broken(rows, nations, "c_nationkey"), "broken-link", "ERROR")))


_CUT = "CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END"


@registered(f"SELECT count(*) FILTER (TRY_CAST(p AS JSON) IS NULL) AS malformed, count(*) FILTER (TRY_CAST(p AS JSON) IS NOT NULL) AS valid FROM (SELECT {_CUT} AS p FROM events)")
def malformed_json_count(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return malformed_count(table(spark, sf_dir, "events").select(F.when(F.try_parse_json(text).isNull(), text).alias("_corrupt")))


@registered("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05')
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def snapshot_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return snapshot_diff(events.where(between("ts", "2024-01-01", "2024-01-03")), events.where(between("ts", "2024-01-03", "2024-01-05")), ["user_id", "event_type"], [])


@registered("""SELECT c_custkey, c_name, coalesce(n_children, 0) AS n_children, round(total, 2) AS total, newest FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_children, sum(o_totalprice) AS total, max(o_orderdate) AS newest FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def record_profile(spark, sf_dir):
    found = totals_profile(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", {"total": "sum(o_totalprice)", "newest": "max(o_orderdate)"})
    return found.select("c_custkey", "c_name", "n_children", F.round("total", 2).alias("total"), "newest")


# ---- retrieval

_BM25 = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, bytes, len(w) AS length, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'oner')) AS b FROM t),
    s AS (SELECT count(*) AS n, avg(length) AS average, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
    bm25 AS (SELECT doc_id, bytes, CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END
      + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END AS score FROM c, s WHERE a > 0 OR b > 0)"""
TERMS = ["the", "oner"]


def texts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text is not null")


@registered(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 12")
def bm25_topk(spark, sf_dir):
    return R.top_k(R.bm25(texts(spark, sf_dir), TERMS)).select("doc_id", F.round("score", 6).alias("score"))


_DENSE = "q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0), dense AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.e) AS score FROM embeddings, q)"


def query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@registered(f"WITH {_DENSE} SELECT vec_id, round(score, 5) AS score FROM dense ORDER BY dense.score DESC, vec_id LIMIT 12")
def dense_topk(spark, sf_dir):
    return R.top_k(R.dense(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)), key="vec_id").select("vec_id", F.round("score", 5).alias("score"))


@registered(f"""WITH {_BM25}, {_DENSE}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 40), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM dense QUALIFY rank <= 40)
    SELECT doc_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 8) AS score, CAST(a.rank AS INTEGER) AS bm25_rank, CAST(b.rank AS INTEGER) AS dense_rank FROM a FULL JOIN b USING (doc_id)""")
def hybrid_rrf(spark, sf_dir):
    lexical = R.ranked(R.top_k(R.bm25(texts(spark, sf_dir), TERMS), 40))
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = R.ranked(R.top_k(R.dense(vectors, query_vector(spark, sf_dir), "doc_id"), 40))
    return R.fuse({"bm25": lexical, "dense": near}).select("doc_id", F.round("score", 8).alias("score"), "bm25_rank", "dense_rank")


@registered(f"""WITH {_BM25}, k AS (SELECT doc_id, bytes, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 40), u AS (SELECT *, sum(bytes) OVER (ORDER BY rank) AS used FROM k)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(bytes AS INTEGER) AS n_bytes, CAST(used AS BIGINT) AS used, rank = 1 OR used <= 40000 AS is_full FROM u""")
def payload_budget(spark, sf_dir):
    best = R.top_k(R.bm25(texts(spark, sf_dir), TERMS), 40)
    # the list has 40 rows at most, so it may be broadcast
    rows = texts(spark, sf_dir).join(F.broadcast(best), "doc_id").withColumn("minus", -F.col("score"))
    return R.within_budget(rows, ["minus", "doc_id"]).select("doc_id", "rank", "n_bytes", "used", "is_full")
