"""Further registered queries: sections, mirrors with roles, lint rules, retrieval modes, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import byte_length, iso_date
from lodestar.operators import aggregates as A
from lodestar.operators import filters as P
from lodestar.operators import graph as G
from lodestar.operators import lint as L
from lodestar.operators import profile as X
from lodestar.operators import retrieval as R
from lodestar.plans.catalog import _BM25, TERMS, registered, table, texts
from lodestar.sources.notes import nearest_above

# ---- lines and sections

_LINES = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


def lines(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


@registered(f"""WITH l AS ({_LINES}), h AS (SELECT *, last_value(CASE WHEN length(line) < 16 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
    SELECT doc_id, CAST(coalesce(section, 0) AS BIGINT) AS section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM h GROUP BY ALL""")
def section_chunks(spark, sf_dir):
    """Lines under the nearest short line above them, as chunks."""
    headed = nearest_above(lines(spark, sf_dir), ["doc_id"], "n", F.when(F.char_length("line") < 16, F.col("n")), "section")
    return headed.groupBy("doc_id", F.coalesce("section", F.lit(0)).alias("section")).agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


@registered("SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_code_points FROM documents WHERE octet_length(encode(text)) > length(text)")
def byte_vs_char(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", byte_length("text").cast("long").alias("n_bytes"), F.char_length("text").cast("long").alias("n_code_points"))
    return rows.where("n_bytes > n_code_points")


@registered(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, len(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')) - 3 AS depth FROM pages")
def external_urls(spark, sf_dir):
    path = F.split(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), (F.size(path) - 3).cast("long").alias("depth"))


# ---- mirrors and relations


@registered("""WITH c AS (SELECT DISTINCT l_orderkey AS title, l_partkey AS person, l_returnflag AS role FROM lineitem WHERE l_quantity > 40), w AS (SELECT l_orderkey AS title, l_partkey AS person, l_linestatus AS role FROM lineitem WHERE l_discount > 0.03),
    m(role, other) AS (VALUES ('R', 'F'), ('A', 'F'), ('N', 'O'))
    SELECT title, person, role, 'works' AS missing_on FROM c WHERE NOT EXISTS (SELECT 1 FROM m JOIN w ON w.role = m.other WHERE m.role = c.role AND w.title = c.title AND w.person = c.person)
    UNION ALL SELECT title, person, role, 'credits' FROM (SELECT DISTINCT * FROM w WHERE role IN (SELECT other FROM m)) v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.title = v.title AND c.person = v.person)""")
def role_mirror(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    side = lambda where, role: rows.where(where).select(F.col("l_orderkey").alias("title"), F.col("l_partkey").alias("person"), F.col(role).alias("role"))
    return G.role_mirror(side("l_discount > 0.03", "l_linestatus"), side("l_quantity > 40", "l_returnflag"), {"R": ["F"], "A": ["F"], "N": ["O"]})


@registered("SELECT DISTINCT o_custkey AS source, CAST(o_custkey % 97 + 1 AS BIGINT) AS target FROM orders o WHERE o_custkey <> o_custkey % 97 + 1 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = o.o_custkey % 97 + 1 AND b.o_custkey % 97 + 1 = o.o_custkey)")
def symmetric_relation(spark, sf_dir):
    """A lists B must mean that B lists A: each customer lists one other."""
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") % 97 + 1).cast("long").alias("target"))
    return G.one_way(listed)


@registered("SELECT l_orderkey AS source, l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE starts_with(p_name, 'small') AND p_size = 10")
def backlinks_by_prefix(spark, sf_dir):
    """Edges to targets of one kind whose name has a prefix."""
    wanted = P.query(table(spark, sf_dir, "part"), equals={"p_size": 10}, folder="small", path_column="p_name", key="p_partkey").select(F.col("p_partkey").alias("target"))
    return G.backlinks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")), wanted)


@registered("""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, l_partkey AS target, p_brand AS cover, CAST(l_quantity AS INTEGER) AS width, CASE WHEN p_size > 25 THEN 40 ELSE 10 END AS wanted
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate < TIMESTAMP '1996-01-01' AND CAST(l_quantity AS INTEGER) <> CASE WHEN p_size > 25 THEN 40 ELSE 10 END""")
def thumbnail_widths(spark, sf_dir):
    """Gallery bullets with another width than the target's kind asks for."""
    gallery = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target"), F.col("l_quantity").cast("int").alias("width"))
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("note_kind"), "p_brand")
    files = notes.select(F.col("name").alias("target"), F.col("p_brand").alias("file"))
    return G.missing_thumbnails(gallery.join(files, "target"), notes, F.col("p_brand"), {"large": 40}, 10)


@registered("""SELECT o_orderkey AS path, o_orderkey AS line, 'C' || o_custkey AS before, 'C0' AS after FROM orders WHERE o_custkey = 1 UNION ALL SELECT o_orderkey, o_orderkey, 'C' || o_custkey, 'C0' FROM orders WHERE o_custkey = 2""")
def rename_plan(spark, sf_dir):
    """What renaming two records would edit, found by an equality lookup."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderkey").alias("line"), F.concat(F.lit("C"), F.col("o_custkey")).alias("target"))
    return G.backlinks(edges, ["C1", "C2"]).select("path", "line", F.col("target").alias("before"), F.lit("C0").alias("after"))


# ---- lint rules over records


@registered("""SELECT CAST(c_custkey AS VARCHAR) AS path, 'score-range' AS rule, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS has_detail FROM customer WHERE NOT (c_acctbal BETWEEN 0 AND 9000)
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'required-field', true FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey = 0""")
def field_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("path", F.col("c_custkey").cast("string"))
    wanted = spark.createDataFrame([("BUILDING",), ("HOUSEHOLD",)], "c_mktsegment string")
    found = L.issue(rows.where(~F.col("c_acctbal").between(0, 9000)), "score-range", "ERROR", F.col("c_acctbal"))
    missing = rows.join(wanted, "c_mktsegment", "left_semi").where("c_nationkey = 0")
    return found.unionByName(L.issue(missing, "required-field", "ERROR", "c_nationkey")).select("path", "rule", F.col("detail").isNotNull().alias("has_detail"))


@registered("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM documents WHERE text IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) < 3")
def thin_records(spark, sf_dir):
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return texts(spark, sf_dir).select("doc_id", n.alias("n_lines")).where("n_lines < 3")


@registered(f"""WITH l AS ({_LINES}) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(n AS VARCHAR) AS line FROM l WHERE list_has_any(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+'), ['idiot', 'trash', 'clown'])""")
def vocabulary_hits(spark, sf_dir):
    """Lines with words of a short list, as the heuristic stream's rule finds them."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("n").alias("line"), F.col("line").alias("text"), F.lit(False).alias("in_frontmatter"), F.lit(False).alias("in_fence"))
    return L.vocabulary(rows, ["idiot", "trash", "clown"]).select("path", F.split("detail", ":")[0].alias("line"))


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_format(spark, sf_dir):
    """Dates that aren't written YYYY-MM-DD are null: every fifth is written another way."""
    written = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-M-d'T'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_date(written).alias("day"))


@registered("""SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')""")
def dependent_fields(spark, sf_dir):
    """A value that is only allowed beside another one."""
    bad = ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)) | ((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"))
    return table(spark, sf_dir, "orders").where(F.coalesce(bad, F.lit(False))).select("o_orderkey", "o_orderstatus")


_CLOSED = """WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_acctbal >= 0 AS structural_green FROM customer), e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source, CAST(o_custkey % 50 + 1 AS VARCHAR) AS target FROM orders),
    o AS (SELECT source, count(*) AS n FROM e WHERE source <> target AND target IN (SELECT path FROM r) AND NOT EXISTS (SELECT 1 FROM e b WHERE b.source = e.target AND b.target = e.source) GROUP BY 1)
    SELECT path, structural_green, coalesce(n, 0) AS one_way_links, structural_green AND coalesce(n, 0) = 0 AS closed FROM r LEFT JOIN o ON o.source = path"""


@registered(_CLOSED)
def card_closed(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey").cast("string").alias("name"), "c_acctbal")
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), (F.col("o_custkey") % 50 + 1).cast("string").alias("target"))
    return X.card_closed(notes, L.structural_green(notes, L.issue(notes.where("c_acctbal < 0"), "balance", "ERROR")), links)


# ---- retrieval and ledgers


@registered(f"WITH {_BM25}, d AS (SELECT doc_id, lang FROM documents) SELECT doc_id, round(score, 6) AS score, lang FROM bm25 JOIN d USING (doc_id) WHERE score >= 0.5 AND lang = 'en'")
def retrieval_filter(spark, sf_dir):
    """All scored rows above a score, with a filter on their metadata."""
    scored = R.bm25(texts(spark, sf_dir), TERMS).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return P.retrieval_filter(scored, min_score=0.5, equals={"lang": "en"}).select("doc_id", F.round("score", 6).alias("score"), "lang")


@registered("SELECT count(*) AS chunks, max(ts) AS last_refresh FROM events")
def index_stats(spark, sf_dir):
    return A.index_stats(table(spark, sf_dir, "events"), "ts")


@registered("SELECT o_custkey AS note, o_orderstatus AS audit_type, o_orderdate AS ts FROM orders WHERE o_totalprice > 200000")
def ledger_history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return A.history(rows.select(F.col("o_custkey").alias("note"), F.col("o_orderstatus").alias("audit_type"), F.col("o_orderdate").alias("ts")))


@registered("""SELECT o_orderpriority AS authored_model, o_orderstatus AS audit_type, count(*) AS n, round(avg(o_totalprice), 1) AS mean, greatest(0, 5 - count(*)) AS runway
    FROM orders WHERE o_orderstatus <> 'P' AND starts_with(o_orderpriority, '1') GROUP BY ALL""")
def model_ranking(spark, sf_dir):
    """The ranking of the dashboard: eligible rows only, mean by model and axis."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("authored_model"), F.col("o_orderpriority").alias("judge_model"), F.col("o_orderstatus").alias("audit_type"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") != "P").alias("pristine"))
    return A.ranked_models(rows, "1")[0]


@registered("""WITH m AS (SELECT DISTINCT user_id % 10 AS facet, user_id AS member FROM events), t AS (SELECT DISTINCT user_id AS member, event_type AS tag FROM events WHERE ts < TIMESTAMP '2024-01-04'),
    s AS (SELECT facet, count(*) AS size FROM m GROUP BY 1), h AS (SELECT facet, tag, count(*) AS present FROM m JOIN t USING (member) GROUP BY ALL), c AS (SELECT facet, tag FROM h JOIN s USING (facet) WHERE size > present)
    SELECT c.facet, c.tag, m.member FROM c JOIN m ON m.facet = c.facet WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.member = m.member AND t.tag = c.tag)""")
def under_tag_any_members(spark, sf_dir):
    """The looser mode, and who lacks each tag."""
    events = table(spark, sf_dir, "events")
    members = events.select((F.col("user_id") % 10).alias("facet"), F.col("user_id").alias("member")).distinct()
    tags = events.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).select(F.col("user_id").alias("member"), F.col("event_type").alias("tag")).distinct()
    return A.under_tagged_members(members, tags, A.under_tagged(members, tags, mode="any"))


@registered("SELECT user_id, day, has_purchase, n FROM (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS has_purchase, count(*) AS n FROM events GROUP BY ALL) WHERE has_purchase AND n BETWEEN 2 AND 4")
def gated_records(spark, sf_dir):
    """Records behind a gate of two conditions, as a retrieval gate takes them."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("has_purchase"), F.count("*").alias("n"))
    return P.query(rows, equals={"has_purchase": True}, field_gte={"n": 2}, field_in={"n": [2, 3, 4]}, key="user_id")


# ---- orders, seen by each row's place


@registered("""SELECT o_orderpriority AS axis, mean, first_pos, row_number() OVER (ORDER BY mean DESC, first_pos) AS place FROM (SELECT o_orderpriority || o_orderstatus AS o_orderpriority, round(avg(o_totalprice), 0) AS mean, min(o_orderkey) AS first_pos FROM orders GROUP BY 1)""")
def ranking_places(spark, sf_dir):
    """Means in order, equal ones by first appearance."""
    cells = table(spark, sf_dir, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("axis")).agg(F.round(F.avg("o_totalprice"), 0).alias("mean"), F.min("o_orderkey").alias("first_pos"))
    return A.numbered(cells, A.ranking_order("first_pos"))


@registered("""WITH c AS (SELECT 'C' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(c_custkey % 40 AS INTEGER) END AS created, last FROM customer
      LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) ON o_custkey = c_custkey)
    SELECT path, row_number() OVER (ORDER BY last DESC NULLS LAST, CASE WHEN last IS NULL THEN coalesce(CAST(created AS VARCHAR), '') END DESC NULLS LAST, path) AS place FROM c""")
def card_places(spark, sf_dir):
    """Cards in three tiers: by last audit, by creation, by path."""
    last = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    created = F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int")))
    cards = table(spark, sf_dir, "customer").select("c_custkey", F.expr("'C' || c_custkey").alias("path"), created.alias("created")).join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return A.numbered(cards, A.card_order(cards)).select("path", "place")


@registered("SELECT note, audit_type, ts, row_number() OVER (ORDER BY ts DESC NULLS LAST, note, audit_type) AS place FROM (SELECT o_custkey AS note, o_orderstatus AS audit_type, CASE WHEN o_orderkey % 100 > 0 THEN o_orderdate END AS ts FROM orders)")
def history_places(spark, sf_dir):
    """The whole history, newest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), F.col("o_orderstatus").alias("audit_type"), F.when(F.col("o_orderkey") % 100 > 0, F.col("o_orderdate")).alias("ts"))
    return A.numbered(rows, A.history_order())


@registered("SELECT o_orderkey AS name, year, row_number() OVER (ORDER BY year NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders)")
def chronology_places(spark, sf_dir):
    """Titles by year, undated ones last."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 7 > 0, F.year("o_orderdate")).alias("year"))
    return A.numbered(rows, A.chronological_order())
