"""Registered queries over notes that Spark writes from the customer table: what the readers and rules find in their text is
compared with what the table says."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.layout import shared_folder, spread
from lodestar.operators import filters as P
from lodestar.operators import graph as G
from lodestar.operators import lint as L
from lodestar.operators import profile as X
from lodestar.operators import retrieval as R
from lodestar.plans.catalog import _BM25, TERMS, registered, table, texts
from lodestar.sources import index as I
from lodestar.sources import notes as N
from lodestar.sources.ledger import parse_ledger
from lodestar.sources.registries import Settings, render_taxonomy

#: A note's lines, as SQL that Spark runs.
LINES = [
    "'---'",
    "'type: card'",
    "'note_kind: ' || if(k % 3 = 0, 'person', 'work')",
    "'quality: ' || if(n % 2 = 0, 'verified', 'draft')",
    "'created: ' || if(k % 7 = 0, '2024/1/5', '2024-01-' || lpad(string(k % 28 + 1), 2, '0'))",
    "'tags: [' || if(k % 11 = 0, '', lower(seg) || ', t' || n % 5) || ']'",
    "'status: ' || if(k % 4 = 0, 'defunct', 'active')",
    "'successor: ' || if(k % 5 = 0, 'Cust_1', 'null')",
    "'score: ' || k % 13",
    "'images: {cover: img/Cust_' || k || '.png}'",
    "'parent: Cust_' || (k % 97 + 1)",
    "'---'",
    "'# Cust_' || k",
    "'See [[Cust_' || (k % 97 + 1) || ']] and [[Cust_' || (k % 50 + 1) || '|other]], `[[Not_A_Link]]`.'",
    "if(k % 6 = 0, '![[Other.png|100]]', '![[Cust_' || k || '.png|' || (400 + k % 300) || ']]')",
    "'## Part ' || n",
    "'[site](https://example.org/c/' || k || ')'",
    "'| who | what |'",
    "'| --- | --- |'",
    r"'| [[Gone_' || k || '\\|x]] | a |'",
    "if(k % 8 = 0, '| b |', '| b | c |')",
    "'The customer of segment ' || seg || ' number' || k || '.'",
]
_C = "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, 'CUSTOMERS/Cust_' || c_custkey || '.md' AS path FROM customer)"
_NAME = "'Cust_' || "


def files(spark, sf_dir):
    """Notes as scan() gives files, one for each customer."""
    rows = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg"))
    named = rows.select(F.expr("'CUSTOMERS/Cust_' || k || '.md'").alias("path"), F.expr("'Cust_' || k").alias("name"), F.lit("CUSTOMERS").alias("folder"), F.lit(None).cast("timestamp").alias("mtime"), F.expr(f"concat_ws(char(10), {', '.join(LINES)})").alias("text"))
    return named.select("path", "name", "folder", "mtime", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), "text")


def tables(spark, sf_dir):
    notes = N.parse(files(spark, sf_dir))
    return N.NoteTables(notes, N.note_lines(notes))


# ---- what the readers find


@registered(f"""WITH {_C} SELECT path, {_NAME}k AS name, CASE WHEN k % 3 = 0 THEN 'person' ELSE 'work' END AS note_kind, CASE WHEN n % 2 = 0 THEN 'verified' ELSE 'draft' END AS quality,
    CASE WHEN k % 7 = 0 THEN '2024/1/5' ELSE '2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') END AS created, CASE WHEN k % 11 = 0 THEN '' ELSE lower(seg) || ',t' || (n % 5) END AS tags,
    CASE WHEN k % 4 = 0 THEN 'defunct' ELSE 'active' END AS status, k % 5 = 0 AS has_successor, CAST(k % 13 AS DOUBLE) AS score, 'img/Cust_' || k || '.png' AS cover, 22 AS n_lines, 12 AS front_lines FROM c""")
def note_records(spark, sf_dir):
    """Front matter, typed and untyped, as records."""
    field = N.field_value
    return tables(spark, sf_dir).notes.where("error is null").select("path", "name", "note_kind", "quality", "created", F.array_join("tags", ",").alias("tags"), field("status").alias("status"), N.has_value("successor").alias("has_successor"), field("score", "double").alias("score"), field("images.cover").alias("cover"), "n_lines", "front_lines")


_LINKS = f"""SELECT path, 14 AS line, {_NAME}(k % 97 + 1) AS target, NULL AS display_text, false AS in_table, 0 AS position FROM c UNION ALL SELECT path, 14, {_NAME}(k % 50 + 1), 'other', false, 1 FROM c
    UNION ALL SELECT path, 20, 'Gone_' || k, 'x', true, 0 FROM c"""


@registered(f"WITH {_C} {_LINKS}")
def note_links(spark, sf_dir):
    """Wiki links outside of code, front matter and embeds."""
    return tables(spark, sf_dir).links.select("path", "line", "target", "display_text", "in_table", "position")


@registered(f"WITH {_C} SELECT path, 15 AS line, CASE WHEN k % 6 = 0 THEN 'Other.png' ELSE 'Cust_' || k || '.png' END AS file, CAST(CASE WHEN k % 6 = 0 THEN 100 ELSE 400 + k % 300 END AS INTEGER) AS width FROM c")
def note_embeds(spark, sf_dir):
    return tables(spark, sf_dir).embeds.select("path", "line", "file", "width")


@registered(f"WITH {_C} SELECT path AS source_path, 17 AS line, 'inline' AS origin, 'https://example.org/c/' || k AS url FROM c")
def note_urls(spark, sf_dir):
    made = tables(spark, sf_dir)
    return N.external_links(made.notes, made.lines)


@registered(f"""WITH {_C} SELECT path, 18 AS table_id, i AS line, CASE WHEN i = 21 AND k % 8 = 0 THEN 1 ELSE 2 END AS n_cells, 2 AS header_cells, false AS raw_pipe FROM c, unnest([18, 19, 20, 21]) t(i)""")
def note_tables(spark, sf_dir):
    """Rows of Markdown tables, their cells counted beside their header's."""
    return tables(spark, sf_dir).table_rows.select("path", "table_id", "line", "n_cells", "header_cells", "raw_pipe")


@registered(f"""WITH {_C}, s AS (SELECT path, 'Cust_' || k AS section_path, length('# Cust_' || k) + 1 + length('See [[Cust_' || (k % 97 + 1) || ']] and [[Cust_' || (k % 50 + 1) || '|other]], `[[Not_A_Link]]`.') + 1
      + length(CASE WHEN k % 6 = 0 THEN '![[Other.png|100]]' ELSE '![[Cust_' || k || '.png|' || (400 + k % 300) || ']]' END) AS n_bytes FROM c
    UNION ALL SELECT path, 'Cust_' || k || ' / Part ' || n, length('## Part ' || n) + 1 + length('[site](https://example.org/c/' || k || ')') + 1 + 14 + 1 + 13 + 1 + length('| [[Gone_' || k) + 12 + CASE WHEN k % 8 = 0 THEN 5 ELSE 9 END + 1
      + length('The customer of segment ' || seg || ' number' || k || '.') FROM c)
    SELECT path AS note_path, section_path, CAST(n_bytes AS INTEGER) AS n_bytes FROM s""")
def note_chunks(spark, sf_dir):
    """Sections as chunks, under their headings' path."""
    made = tables(spark, sf_dir)
    return N.chunks(made.notes, made.lines).select("note_path", "section_path", "n_bytes")


@registered(f"WITH {_C} SELECT {_NAME}k AS source, CASE WHEN k % 3 = 0 THEN 'person' ELSE 'work' END AS source_kind, 'parent' AS field, {_NAME}(k % 97 + 1) AS target FROM c")
def note_references(spark, sf_dir):
    """References by name in one untyped field."""
    return N.variant_edges(tables(spark, sf_dir).notes, "parent")


@registered(f"WITH {_C}, e AS (SELECT path AS source_path, line, target FROM ({_LINKS}) UNION ALL SELECT path, 15, CASE WHEN k % 6 = 0 THEN 'Other.png' ELSE 'Cust_' || k || '.png' END FROM c) SELECT target, count(*) AS n FROM e GROUP BY 1")
def note_edges(spark, sf_dir):
    """Links and embeds as one edge table, counted by target."""
    made = tables(spark, sf_dir)
    return G.both_kinds(made.links, made.embeds).groupBy("target").agg(F.count("*").alias("n"))


@registered(f"WITH {_C} SELECT target, path, line, position FROM ({_LINKS}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY path, line, position) = 1")
def first_links(spark, sf_dir):
    """The first link to each target."""
    return G.first_occurrences(tables(spark, sf_dir).links, ["target"], ["path", "line", "position"]).select("target", "path", "line", "position")


@registered(f"WITH {_C} SELECT path, 22 AS line, seg AS target FROM c WHERE seg IN ('BUILDING', 'MACHINERY')")
def phrase_mentions(spark, sf_dir):
    """Mentions of terms of several words in the notes' prose."""
    terms = spark.createDataFrame([("BUILDING", "the customer of segment building"), ("MACHINERY", "Segment Machinery"), ("none", "the customer of nothing")], "target string, term string")
    return G.text_mentions(tables(spark, sf_dir).lines.where("not in_frontmatter"), terms).select("path", "line", "target")


# ---- what is asked of records


@registered(f"WITH {_C} SELECT {_NAME}k AS name, CAST(k % 13 AS VARCHAR) AS score FROM c WHERE k % 4 <> 0 AND n % 2 = 0 AND k % 13 >= 5")
def note_query(spark, sf_dir):
    """Equal fields, a quality gate, a kind that must be set, and a range of an untyped field."""
    notes = tables(spark, sf_dir).notes
    return P.query(notes, field_equals={"status": "active"}, field_gte={"score": 5}, quality_gate="verified", note_kind_required=True, key="name", fields=["score"])


@registered("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def rating_axis(spark, sf_dir):
    """An axis to filter by on request; without a request nothing goes."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return P.by_rating(P.by_rating(rows), ["BUILDING", "FURNITURE"], "c_mktsegment")


# ---- all rules at once

_RULES = [
    ("k % 3 = 0 AND k % 5 <> 0", "required-field", "ERROR"), ("k % 3 <> 0", "recommended-field", "WARN"), ("k % 3 = 0", "always-present", "ERROR"),
    ("k % 3 <> 0 AND (k % 11 = 0 OR n % 5 <> 1)", "tag-required", "ERROR"), ("k % 11 = 0", "empty-tags", "ERROR"), ("k % 11 <> 0", "too-many-tags", "ERROR"),
    ("k % 97 <> k % 50", "too-many-links", "WARN"), ("true", "broken-link", "ERROR"), ("k % 97 = k % 50", "duplicate-link", "ERROR"), ("k % 8 = 0", "table-row", "ERROR"),
    ("k % 6 = 0", "cover-ref", "ERROR"), ("k % 6 <> 0 AND k % 300 > 100", "embed-width", "WARN"), ("k % 5 = 0 AND k % 4 <> 0", "dependent-field", "ERROR"),
    ("k % 3 = 0 AND k % 5 <> 0", "stub", "WARN"), ("k % 13 NOT BETWEEN 1 AND 10", "score-range", "ERROR"), ("k % 7 = 0", "date-format", "ERROR"), ("true", "thin-note", "WARN"),
    ("k % 3 = 0 AND k % 4 = 0", "enum", "ERROR"), ("k % 3 <> 0 AND n % 2 = 1", "enum", "ERROR"), ("k % 11 <> 0 AND seg NOT IN ('BUILDING', 'HOUSEHOLD')", "tag-canon", "WARN"),
    ("k % 3 = 0 AND k % 7 <> 0 AND k % 28 < 14", "schema-drift", "INFO"), ("k % 3 = 0 AND (k % 7 = 0 OR k % 28 >= 14)", "requirement", "ERROR"),
]
_LINT = " UNION ALL ".join(f"SELECT path, '{rule}' AS rule, '{severity}' AS severity, 'structural' AS stream, 1 AS n FROM c WHERE {where}" for where, rule, severity in _RULES)
_HEURISTIC = """SELECT path, 'tooling-vocabulary', 'WARN', 'heuristic', 1 FROM c UNION ALL SELECT path, 'user-only', 'WARN', 'heuristic', 6 FROM c WHERE n = 1
    UNION ALL SELECT path, 'prose-script', 'WARN', 'heuristic', 1 FROM c WHERE n = 3 UNION ALL SELECT path, 'spoiler-callout', 'WARN', 'structural', 6 FROM c WHERE n = 2"""
SETTINGS = Settings(
    max_tags=1, max_links=2, max_width=500, min_lines=11, required_tags_by_kind={"work": ["t1"]}, required_fields={"person": ["successor"]}, recommended_fields={"work": ["nothere"]},
    always_present={"person": ["successor", "motto"]}, score_fields=["score"], relation_fields={"person": ["successor"]}, tooling_vocab=["customer"], personal_heading="Part 1",
    spoiler_headings=["Part 2"], prose_pattern="Part 3$",
)


def all_issues(spark, sf_dir, made, **options):
    enums = spark.createDataFrame([("person", "status", "active"), ("work", "quality", "verified")], "kind string, field string, value string")
    canon = spark.createDataFrame([(x,) for x in ("t0", "t1", "t2", "t3", "t4", "building", "household")], "name string")
    changelog = spark.createDataFrame([("person", "motto", "2024-01-15", "field")], "kind string, requirement string, introduced string, kind_of string").withColumn("introduced", F.to_date("introduced"))
    return L.lint(made, SETTINGS, enums, canon, changelog, **options)


@registered(f"WITH {_C} SELECT path, rule, severity, stream, CAST(sum(n) AS BIGINT) AS n FROM ({_LINT} UNION ALL {_HEURISTIC}) GROUP BY ALL")
def lint_all(spark, sf_dir):
    """Every rule over every note, in both streams."""
    return all_issues(spark, sf_dir, tables(spark, sf_dir), show_all=True).groupBy("path", "rule", "severity", "stream").agg(F.count("*").alias("n"))


#: Lines of notes that break the rules which the others keep.
ODD_LINES = [
    "'---'", "'type: card'", "'note_kind: anime'", "'tags: [x]'", "if(k % 4 = 0, 'images: {}', 'images: {cover: a.png}')",
    "'works: [{title: T, roles: [voice-actor' || if(k % 6 = 0, ', director]', ']') || if(k % 6 = 1, '}]', ', character: C}]')",
    "'personal_status: ' || if(k % 3 = 0, 'completed', if(k % 3 = 1, 'plan-to-watch', 'watching'))", "'episodes: 12'",
    "'last_episode_watched: ' || if(k % 3 = 0, if(k % 2 = 0, '12', '5'), if(k % 2 = 0, 'null', '3'))", "'times_watched: ' || if(k % 3 = 0, 1, k % 2)", "'---'",
    "'# Head' || if(k % 7 = 0, ' [[Card_' || (k + 1) || ']]', '')", "if(k % 5 = 0, 'No link here.', 'See [[Card_' || (k + 1) || ']].')",
]
_ODD = [
    ("k % 5 = 0 AND k % 7 <> 0", "no-outgoing-link", "ERROR"), ("k % 7 = 0", "link-in-heading", "ERROR"), ("k % 11 = 0", "name-shape", "ERROR"), ("k % 6 < 2", "voice-record", "ERROR"), ("k % 4 = 0", "missing-cover", "INFO"),
    ("CASE WHEN k % 3 = 2 THEN k % 2 = 0 ELSE k % 2 = 1 END", "progress", "WARN"), ("(k % 5 <> 0 OR k % 7 = 0) AND (k + 1) % 11 <> 0 AND k < (SELECT max(c_custkey) FROM customer)", "asymmetric-link", "WARN"),
]


@registered(" UNION ALL ".join(f"SELECT 'CARDS/Card' || CASE WHEN k % 11 = 0 THEN ' ' ELSE '_' END || k || '.md' AS path, '{rule}' AS rule, '{severity}' AS severity FROM (SELECT c_custkey AS k FROM customer) WHERE {where}" for where, rule, severity in _ODD))
def lint_odd_notes(spark, sf_dir):
    """Notes without a link, with a link in a heading, an odd name, mixed voice records, no cover, wrong progress, and one-way links."""
    k = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("k"))
    rows = k.select(F.expr("'Card' || if(k % 11 = 0, ' ', '_') || k").alias("name"), F.expr(f"concat_ws(char(10), {', '.join(ODD_LINES)})").alias("text"))
    odd = rows.select(F.concat(F.lit("CARDS/"), "name", F.lit(".md")).alias("path"), "name", F.lit("CARDS").alias("folder"), F.lit(None).cast("timestamp").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), "text")
    notes = N.parse(odd)
    found = L.lint(N.NoteTables(notes, N.note_lines(notes)), Settings(reciprocity_pairs=[("anime", "anime")]))
    return found.where(F.col("rule").isin(*(rule for _, rule, _ in _ODD))).select("path", "rule", "severity")


@registered("SELECT 'img/' || p_brand || '/' || p_partkey || '.png' AS path, p_partkey || '.png' AS detail FROM part WHERE p_size % 3 > 0")
def attachments_misplaced(spark, sf_dir):
    """Files outside of the top folder for attachments."""
    top = F.when(F.col("p_size") % 3 == 0, "attachments").otherwise("img")
    return L.misplaced(table(spark, sf_dir, "part").select(F.concat_ws("/", top, "p_brand", F.concat("p_partkey", F.lit(".png"))).alias("path")), "attachments").select("path", "detail")


@registered(f"WITH {_C}, i AS (SELECT path, severity FROM ({_LINT})) SELECT path, count(*) FILTER (severity = 'ERROR') AS errors, false AS structural_green FROM i GROUP BY path")
def lint_gate(spark, sf_dir):
    """Structural errors by note: the gate."""
    made = tables(spark, sf_dir)
    return L.structural_green(made.notes, all_issues(spark, sf_dir, made))


# ---- views and plans of edits


@registered(f"""WITH {_C}, l AS ({_LINKS}), e AS (SELECT target FROM l UNION ALL SELECT 'Other.png' FROM c WHERE k % 6 = 0) SELECT path, {_NAME}k AS name, (SELECT count(*) FROM l WHERE l.path = c.path) AS n_outgoing, (SELECT count(*) FROM l WHERE l.target = 'Cust_7') AS n_backlinks,
    (SELECT CAST(sum(n) AS BIGINT) FROM ({_LINT}) i WHERE i.path = c.path) AS n_issues FROM c WHERE k = 7""")
def profile_of_note(spark, sf_dir):
    """One note with its links both ways and its issues."""
    made = tables(spark, sf_dir)
    row = X.note_profile(made.notes, made.links, made.embeds, all_issues(spark, sf_dir, made, target="Cust_7"), "Cust_7")
    n = lambda x: F.size(x).cast("long")
    return row.select("path", "name", n("outgoing").alias("n_outgoing"), n("backlinks").alias("n_backlinks"), n("lint").alias("n_issues"))


@registered(f"WITH {_C} SELECT path, line, '[[' || target AS before, '[[Cust_new' AS after FROM ({_LINKS}) WHERE target = 'Cust_7'")
def plan_of_rename(spark, sf_dir):
    made = tables(spark, sf_dir)
    return X.rename_plan(made.links, made.embeds, "Cust_7", "Cust_new")


_CARD = "'Card_' || substr(md5(CAST({0} AS VARCHAR(20))), 1, 12)"
_TYPO = f"CASE WHEN o_orderkey % 3 = 0 THEN upper({_CARD}) WHEN o_orderkey % 3 = 1 THEN substr({_CARD}, 1, 7) || substr({_CARD}, 9) ELSE substr({_CARD}, 1, 9) || 'xy' || substr({_CARD}, 12) END".replace("{0}", "o_custkey")


@registered(f"""WITH o AS (SELECT o_orderkey AS line, {_TYPO} AS target FROM orders), d AS (SELECT DISTINCT target FROM o), n AS (SELECT {_CARD.format("c_custkey")} AS name FROM customer),
    m AS (SELECT target, name, levenshtein(lower(target), lower(name)) AS distance FROM d JOIN n ON levenshtein(lower(target), lower(name)) <= 2),
    r AS (SELECT *, min(distance) OVER (PARTITION BY target) AS least FROM m), b AS (SELECT target, min(name) AS proposal, CAST(any_value(distance) AS INTEGER) AS distance, count(*) AS n_names FROM r WHERE distance = least GROUP BY target)
    SELECT 'P' AS path, line, target, proposal, distance, n_names FROM o JOIN b USING (target)""")
def plan_of_fixes(spark, sf_dir):
    """Links with planted typos (another case, one character less, two others), and the nearest names."""
    rows = spread(table(spark, sf_dir, "orders")).select(F.lit("P").alias("path"), F.col("o_orderkey").alias("line"), F.expr(_TYPO).alias("target"))
    names = spread(table(spark, sf_dir, "customer")).select(F.expr(_CARD.format("c_custkey")).alias("name"))
    return X.fix_plan(rows, names)


@registered(f"WITH {_C} SELECT path, {_NAME}k AS name, 15 AS line, 'Other.png' AS file FROM c WHERE k % 6 = 0")
def plan_of_image(spark, sf_dir):
    made = tables(spark, sf_dir)
    return X.image_plan(made.notes, made.embeds, "Other.png")


_LATER = f"{_C}, f AS (SELECT path, k, 0 AS more FROM c WHERE k % 17 <> 0 AND k % 10 <> 0 UNION ALL SELECT path, k, 1 FROM c WHERE k % 17 <> 0 AND k % 10 = 0 UNION ALL SELECT 'NEW/' || path, k, 0 FROM c WHERE k % 19 = 0)"


def refreshed_index(spark, sf_dir):
    """An index of the notes, and its refresh from a later listing: some have one more link, some are gone, some new, and some
    have another time but the same text. Gives its folder, and what the refresh counted."""
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    timed = lambda x, at: x.withColumn("mtime", F.timestamp_seconds(F.lit(at)))
    before = timed(files(spark, sf_dir), 0)
    later = before.where(k % 17 != 0)
    text = F.when(k % 10 == 0, F.concat("text", F.lit("\nMore: [[Cust_1]]"))).otherwise(F.col("text"))
    later = timed(later.withColumn("text", text), 0).withColumn("mtime", F.when((k % 10 == 0) | (k % 23 == 0), F.timestamp_seconds(F.lit(60))).otherwise(F.col("mtime")))
    later = later.unionByName(timed(before.where(k % 19 == 0), 60).withColumn("path", F.concat(F.lit("NEW/"), "path")))
    later = later.withColumns({"size": F.octet_length("text").cast("long"), "content_hash": F.sha2("text", 256)})
    folder = shared_folder(spark)
    reader = lambda rows: lambda paths: rows if paths is None else rows.join(paths, "path", "left_semi")
    I.refresh(spark, folder, before, reader(before))
    return folder, I.refresh(spark, folder, later, reader(later))


@registered("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT CASE WHEN k % 17 = 0 THEN 'removed' WHEN k % 10 = 0 THEN 'changed' WHEN k % 23 = 0 THEN 'touched' ELSE 'kept' END AS change, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM c WHERE k % 19 = 0""")
def index_refresh(spark, sf_dir):
    """What a refresh finds: it reads only files of another time or size, and parses only those of another content."""
    _, counts = refreshed_index(spark, sf_dir)
    return spark.createDataFrame(sorted(counts.items()), "change string, n long")


@registered(f"WITH {_LATER} SELECT path, 14 AS line, {_NAME}(k % 97 + 1) AS target FROM f UNION ALL SELECT path, 14, {_NAME}(k % 50 + 1) FROM f UNION ALL SELECT path, 20, 'Gone_' || k FROM f UNION ALL SELECT path, 23, 'Cust_1' FROM f WHERE more = 1")
def index_merged_links(spark, sf_dir):
    """Links as a reader merges them from a whole version and a delta."""
    folder, _ = refreshed_index(spark, sf_dir)
    return I.read_index(spark, folder)["links"].select("path", "line", "target")


@registered(f"WITH {_LATER} SELECT path, {_NAME}k AS name, k % 13 AS score, 22 + more AS n_lines FROM f")
def index_compacted(spark, sf_dir):
    """Records after the versions were merged into one."""
    folder, _ = refreshed_index(spark, sf_dir)
    I.compact(spark, folder)
    return I.read_index(spark, folder)["notes"].select("path", "name", N.field_value("score", "long").alias("score"), "n_lines")


# ---- ledgers, registries, search


@registered("""SELECT CAST(o_orderkey AS VARCHAR) AS note, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS score, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS pristine, o_orderkey % 9 = 0 AS corrupt FROM orders""")
def ledger_lines(spark, sf_dir):
    """JSON lines as ledger rows: cut ones are kept apart, a flag of another type is null."""
    flag = F.when(F.col("o_orderkey") % 4 == 0, F.lit('"yes"')).otherwise((F.col("o_orderstatus") == "F").cast("string"))
    line = F.concat(F.lit('{"audit_type": "x", "score": '), F.col("o_totalprice").cast("string"), F.lit(', "pristine": '), flag, F.lit("}"))
    cut = F.when(F.col("o_orderkey") % 9 == 0, F.substring(line, 1, 25)).otherwise(line)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), cut.alias("value"))
    return parse_ledger(rows).select(F.col("key").alias("note"), "score", "pristine", F.col("_corrupt").isNotNull().alias("corrupt"))


@registered("""SELECT p_type AS "group", '| tag | description |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_brand || ' | ' || n || ' |', chr(10) ORDER BY p_brand) AS markdown FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1""")
def taxonomy_markdown(spark, sf_dir):
    """A taxonomy rendered group by group."""
    tags = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").cast("string").alias("description"))
    return render_taxonomy(tags.select(F.col("p_brand").alias("name"), F.col("p_type").alias("group"), "description"))


@registered(f"""WITH {_BM25}, k AS (SELECT doc_id, bytes, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 JOIN documents USING (doc_id) WHERE starts_with(lang, 'e') QUALIFY rank <= 8), u AS (SELECT *, sum(bytes) OVER (ORDER BY rank) AS used FROM k)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(bytes AS INTEGER) AS n_bytes, CAST(used AS BIGINT) AS used, rank = 1 OR used <= 6000 AS is_full FROM u""")
def search_by_words(spark, sf_dir):
    """A search within one section, cut to a budget of bytes; scores count all chunks."""
    chunks = texts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section_path")), "doc_id")
    found = R.search(chunks, TERMS, mode="bm25", k=8, section_path_prefix="e", budget=6000, key="doc_id")
    return found.select("doc_id", "rank", "n_bytes", "used", "is_full")
