"""Lint: rules over notes, in two streams that never merge. Structural issues gate, heuristic ones only inform.

Every rule gives path, rule, severity, stream, detail. Rules are compiled: those that look at one line become one array of
issues in one pass over lines, those that look at one note, its links included, one array in one pass over notes. Only what
compares notes with each other (broken links, shared names, missing reverse links) is a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.layout import stored
from lodestar.functions.text import basename, is_set, iso_date, mixed_script, two_scripts_in_word
from lodestar.operators import graph as G
from lodestar.sources import notes as N
from lodestar.sources.notes import NoteTables, Vault, field_value
from lodestar.sources.registries import Settings

STRUCTURAL, HEURISTIC = "structural", "heuristic"
ISSUE = "struct<rule:string,severity:string,stream:string,detail:string>"
#: A registry (enum values, canonical tags, dated requirements) comes from one YAML file; it becomes part of the rules.
MOST_REGISTERED = 100_000


def issue(rows: DataFrame, rule: str, severity: str, detail: Column | str = "", stream: str = STRUCTURAL) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(stream).alias("stream"), detail.cast("string").alias("detail"))


# ---- how rules are written: each is an array of issues


def told(rule: str, severity: str, detail: Column | str = "", stream: str = STRUCTURAL) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(stream).alias("stream"), detail.cast("string").alias("detail"))


def none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def if_so(condition: Column, rule: str, severity: str, detail: Column | str = "", stream: str = STRUCTURAL) -> Column:
    """One issue where the condition holds; null is no."""
    return F.when(condition, F.array(told(rule, severity, detail, stream))).otherwise(none())


def for_each(items: Column, rule: str, severity: str, detail) -> Column:
    """An issue for each element; detail makes its text. A null array has none."""
    return F.coalesce(F.transform(items, lambda x: told(rule, severity, detail(x))), none())


def by_kind(values: dict[str, list[str]], rule) -> Column:
    """Of each kind's values those issues that rule(value) gives."""
    return F.concat(none(), *(F.when(F.col("note_kind") == kind, F.concat(none(), *map(rule, map(str, own)))).otherwise(none()) for kind, own in values.items()))


def registered(registry: DataFrame) -> list:
    rows = registry.limit(MOST_REGISTERED + 1).collect()
    if len(rows) > MOST_REGISTERED:
        raise ValueError(f"a registry of more than {MOST_REGISTERED} entries is none")
    return rows


# ---- rules about one line


def vocabulary_pattern(words: list[str]) -> str:
    """Words that belong to tooling, not to prose. A fixed short list: one pattern."""
    return r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(rf"\Q{x}\E" for x in words) + r")(?![\p{L}\p{N}_])"


def vocabulary(lines: DataFrame, words: list[str]) -> DataFrame:
    pattern = vocabulary_pattern(words)
    rows = lines.where(~F.col("in_frontmatter") & ~F.col("in_fence") & F.col("text").rlike(pattern))
    return issue(rows, "tooling-vocabulary", "WARN", F.concat_ws(":", "line", F.regexp_extract("text", pattern, 1)), HEURISTIC)


def line_rules(settings: Settings, show_all: bool) -> Column:
    """lines (with `found`, their links and embeds, and `row`, their place in a table): issues of each line."""
    body, prose, line = ~F.col("in_frontmatter"), ~F.col("in_frontmatter") & ~F.col("in_fence"), F.col("line")
    own = F.element_at(F.split("section_path", " / "), -1)
    written = ~F.col("is_heading") & (F.trim("text") != "")
    wide = F.filter("found", lambda x: x["is_embed"] & (N.width_of(x["display_text"]) > settings.max_width))
    rules = [
        F.when(F.col("is_heading"), for_each(F.filter("found", lambda x: ~x["is_embed"]), "link-in-heading", "ERROR", lambda x: line)).otherwise(none()),
        for_each(wide, "embed-width", "WARN", lambda x: F.concat_ws(":", x["target"], N.width_of(x["display_text"]).cast("string"))),
        if_so((F.col("row.n_cells") != F.col("row.header_cells")) | F.col("row.raw_pipe"), "table-row", "ERROR", F.concat_ws(":", line.cast("string"), F.when(F.col("row.raw_pipe"), "unescaped pipe").otherwise("cell count"))),
    ]
    if settings.spoiler_headings:
        rules.append(if_so(body & written & own.isin(*settings.spoiler_headings) & ~F.col("text").startswith(">"), "spoiler-callout", "WARN", line))
    if show_all:
        rules.append(if_so(prose & two_scripts_in_word("text"), "mixed-script", "WARN", line, HEURISTIC))
        if settings.prose_pattern:
            rules.append(if_so(prose & mixed_script("text", settings.prose_pattern), "prose-script", "WARN", line, HEURISTIC))
        if settings.personal_heading:
            # counts only in notes without a score of their own
            rules.append(if_so(prose & written & (own == settings.personal_heading), "user-only", "WARN", line, HEURISTIC))
        if settings.tooling_vocab:
            pattern = vocabulary_pattern(settings.tooling_vocab)
            rules.append(if_so(prose & F.col("text").rlike(pattern), "tooling-vocabulary", "WARN", F.concat_ws(":", line, F.regexp_extract("text", pattern, 1)), HEURISTIC))
    return F.concat(*rules)


def line_facts(lines: DataFrame, settings: Settings, show_all: bool) -> DataFrame:
    """path, issues, links (target, at: its lines), embeds (files): one row for each note with any of them.

    One exchange by path, which lines that were made from notes have already. A note's own links make one row, never those to it.
    """
    order = Window.partitionBy("path").orderBy("line")
    text, prose = F.col("text"), ~F.col("in_frontmatter") & ~F.col("in_fence")
    rows = lines.withColumn("found", F.when(prose, N.link_array(text)).otherwise(F.array().cast("array<struct<position:int,is_embed:boolean,target:string,display_text:string>>")))
    rows = rows.withColumn("cells", F.when(prose & N.in_table(text), F.size(N.table_cells(text))))
    above = F.last(F.when(F.col("cells").isNotNull() & F.col("before").isNull(), F.col("cells")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", F.lag("cells").over(order)).withColumn("header", above)
    rows = rows.withColumn("row", F.when(F.col("cells").isNotNull(), F.struct(F.col("cells").alias("n_cells"), F.col("header").alias("header_cells"), N.raw_pipe(text).alias("raw_pipe"))))
    facts = rows.select("path", "line", line_rules(settings, show_all).alias("issues"), "found").where("size(issues) > 0 or size(found) > 0")
    no_target = F.lit(None).cast("string")
    each = F.concat(
        F.transform("issues", lambda x: F.struct(F.lit("issue").alias("what"), no_target.alias("target"), x.alias("issue"))),
        F.transform("found", lambda x: F.struct(F.when(x["is_embed"], "embed").otherwise("link").alias("what"), x["target"].alias("target"), F.lit(None).cast(ISSUE).alias("issue"))),
    )
    single = facts.select("path", "line", F.explode(each).alias("x")).select("path", "line", "x.*")
    of_target = single.groupBy("path", "what", "target").agg(F.collect_list("line").alias("at"), F.collect_list("issue").alias("issues"))
    of = lambda what, value: F.collect_list(F.when(F.col("what") == what, value))
    return of_target.groupBy("path").agg(F.flatten(of("issue", F.col("issues"))).alias("issues"), of("link", F.struct("target", "at")).alias("links"), of("embed", F.col("target")).alias("embeds"))


# ---- rules about one note


def gathered(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """notes without their texts, with `fields` (all front matter as JSON texts), `n_written` lines of body, and their facts."""
    own = F.map_from_arrays(F.array(*map(F.lit, N.CORE_NAMES)), F.array(*(F.when(F.size(x) > 0, F.to_json(x)) if x in ("tags", "aliases") else F.col(x).cast("string") for x in N.CORE_NAMES)))
    fields = F.map_concat(own, F.coalesce(F.from_json(F.to_json("extra"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    n_written = F.size(F.filter(F.split("body", r"\r?\n"), lambda x: F.trim(x) != ""))
    rows = notes.select("path", "name", "folder", *N.CORE_NAMES, "extra", "error", fields.alias("fields"), n_written.alias("n_written")).join(facts, "path", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    return rows.select(*(x for x in rows.columns if x not in ("issues", "links", "embeds")), empty("issues", ISSUE), empty("links", "struct<target:string,at:array<int>>"), empty("embeds", "string"))


def missing(key: str) -> Column:
    """Absent, null, empty, or an empty list."""
    value = F.element_at("fields", F.lit(key))
    return value.isNull() | value.isin("", "[]")


def has_key(key: str) -> Column:
    """Whether the front matter beyond the core fields names the key, even with null."""
    return F.map_contains_key("fields", F.lit(key)) if key not in N.CORE_NAMES else F.lit(False)


def unlisted(found: Column, values: list[str], field: str) -> Column:
    return for_each(F.filter(found, lambda x: ~x.startswith("{") & ~x.isin(*values)), "enum", "ERROR", lambda x: F.concat_ws("=", F.lit(field), x))


def enum_values(enums: DataFrame) -> Column:
    """Values outside of their registry (kind, field, value), of fields that it has for the note's kind; lists by element."""
    allowed: dict[tuple[str, str], list[str]] = {}
    for x in registered(enums.select("kind", "field", "value")):
        allowed.setdefault((x.kind, x.field), []).append(x.value)
    rules: dict[str, list[Column]] = {}
    for (kind, field), values in allowed.items():
        value = F.element_at("fields", F.lit(field))
        listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value != "", F.array(value))
        rules.setdefault(kind, []).append(unlisted(listed, values, field))
    return F.concat(none(), *(F.when(F.col("note_kind") == kind, F.concat(none(), *own)).otherwise(none()) for kind, own in rules.items()))


def drift(changelog: DataFrame) -> Column:
    """Dated field requirements: an absent key in an older note is drift, in a newer one a defect. A null is no absence;
    requirements of another kind_of than `field` can't be seen in the front matter."""
    made = iso_date("created")
    rules = []
    for x in registered(changelog.where(F.coalesce("kind_of", F.lit("field")) == "field").select("kind", "requirement", "introduced")):
        gap, older = (F.col("note_kind") == x.kind) & ~has_key(x.requirement), F.coalesce(made < F.lit(x.introduced), F.lit(False))
        rules += [if_so(gap & older, "schema-drift", "INFO", x.requirement), if_so(gap & ~older, "requirement", "ERROR", x.requirement)]
    return F.concat(none(), *rules)


def progress(kinds: list[str]) -> Column:
    """A watched record's status against its counts, for notes of the given kinds."""
    status, episodes, seen, times = field_value("personal_status"), field_value("episodes", "int"), field_value("last_episode_watched", "int"), field_value("times_watched", "int")
    done = status.isin("completed", "favorite")
    bad = (done & is_set(episodes) & (episodes > 0) & ~seen.eqNullSafe(episodes)) | ((status == "plan-to-watch") & seen.isNotNull()) | (status.isin("completed", "favorite", "watching") & (F.coalesce(times, F.lit(0)) < 1))
    return if_so(F.col("note_kind").isin(*kinds) & bad, "progress", "WARN", status)


def dependent_fields() -> Column:
    """A successor only if defunct; a date of death only if deceased."""
    status = field_value("status")
    bad = (is_set(field_value("successor")) & ~status.eqNullSafe("defunct")) | (is_set(field_value("death_date")) & ~status.eqNullSafe("deceased"))
    return if_so(bad, "dependent-field", "ERROR", status)


def voice_records() -> Column:
    """In works, the voice role goes with a character and with no other role, and the other way round."""
    works = F.from_json(F.element_at("fields", F.lit("works")), "array<struct<title:string,roles:array<string>,character:string>>")
    voice = lambda w: F.coalesce(F.array_contains(w["roles"], "voice-actor"), F.lit(False))
    return if_so(F.exists(works, lambda w: (voice(w) != F.coalesce(w["character"] != "", F.lit(False))) | (voice(w) & (F.size(w["roles"]) > 1))), "voice-record", "ERROR")


def stubs(relations: dict[str, list[str]]) -> Column:
    """Notes of a kind whose relation fields are all empty and, where the list names `links`, whose body has no link."""
    rules = []
    for kind, fields in relations.items():
        empty = reduce(lambda a, b: a & b, [F.size("links") == 0 if x == "links" else missing(x) for x in fields], F.lit(True))
        rules.append(if_so((F.col("note_kind") == kind) & empty, "stub", "WARN", F.col("note_kind")))
    return F.concat(none(), *rules)


def note_rules(settings: Settings, enums: DataFrame | None, canon: DataFrame | None, changelog: DataFrame | None) -> Column:
    """Issues of one row of gathered()."""
    card, tags = F.col("note_kind").isNotNull(), F.col("tags")
    bad_date = lambda x: F.col(x).isNotNull() & iso_date(x).isNull()
    cover = F.element_at(F.split(field_value("images.cover"), "/"), -1)
    draft = ~F.coalesce(is_set(field_value("personal_score")), F.lit(False))
    exempt = F.col("folder").isin(*settings.link_exempt) if settings.link_exempt else F.lit(False)
    rules = [
        F.filter("issues", lambda x: (x["rule"] != "user-only") | draft),
        if_so(F.col("error").isNotNull(), "front-matter", "ERROR", F.col("error")),
        by_kind(settings.required_fields, lambda key: if_so(missing(key), "required-field", "ERROR", key)),
        by_kind(settings.recommended_fields, lambda key: if_so(missing(key), "recommended-field", "WARN", key)),
        by_kind(settings.always_present, lambda key: if_so(~has_key(key), "always-present", "ERROR", key)),
        by_kind(settings.required_tags_by_kind, lambda tag: if_so(~F.array_contains(tags, tag), "tag-required", "ERROR", tag)),
        if_so(card & (F.size(tags) == 0), "empty-tags", "ERROR"), if_so(F.size(tags) > settings.max_tags, "too-many-tags", "ERROR", F.size(tags)),
        if_so(F.size("links") > settings.max_links, "too-many-links", "WARN", F.size("links")), if_so(~exempt & (F.size("links") == 0), "no-outgoing-link", "ERROR"),
        for_each(F.filter("links", lambda x: F.size(x["at"]) > 1), "duplicate-link", "ERROR", lambda x: F.concat_ws(":", x["target"], F.size(x["at"]).cast("string"))),
        if_so((cover != "") & ~F.array_contains("embeds", cover), "cover-ref", "ERROR", cover), if_so(~F.col("name").rlike(settings.name_pattern), "name-shape", "ERROR", F.col("name")),
        voice_records(), progress(settings.progress_kinds), dependent_fields(), stubs(settings.relation_fields),
        *(if_so(~field_value(x, "double").between(1, 10), "score-range", "ERROR", x) for x in settings.score_fields),
        if_so(bad_date("created") | bad_date("updated"), "date-format", "ERROR", F.concat_ws(",", "created", "updated")), if_so(card & (F.col("n_written") < settings.min_lines), "thin-note", "WARN"),
        if_so(card & ~F.coalesce(is_set(field_value("images.cover")), F.lit(False)), "missing-cover", "INFO"),
    ]
    if canon is not None:
        known = [x.name for x in registered(canon.select("name"))]
        rules.append(for_each(F.filter(tags, lambda x: ~x.isin(*known)), "tag-canon", "WARN", lambda x: x))
    if enums is not None:
        rules.append(enum_values(enums))
    if changelog is not None:
        rules.append(drift(changelog))
    return F.concat(*rules)


# ---- rules that compare notes


def link_targets(own: DataFrame, names: DataFrame) -> DataFrame:
    """Links to no note, and those of them that would resolve in another case. own: gathered notes. names: name, of all notes."""
    # names that differ in case alone are few, whatever number of files shares each
    lower = names.groupBy("name").agg(F.lit(1)).groupBy(F.lower("name").alias("lower")).agg(F.collect_list("name").alias("known"))
    links = own.select("path", F.explode("links").alias("link")).select("path", "link.target", "link.at", F.lower("link.target").alias("lower"))
    broken = links.join(lower, "lower", "left").where("known is null or not array_contains(known, target)")
    each = F.array_compact(F.array(told("broken-link", "ERROR", F.concat_ws(":", F.col("line").cast("string"), "target")), F.when(F.col("known").isNotNull(), told("case-mismatch", "ERROR", F.col("target")))))
    return broken.withColumn("line", F.explode("at")).select("path", F.explode(each).alias("x")).select("path", "x.*")


def shared(names: DataFrame) -> DataFrame:
    return issue(G.shared_names(names).select(F.col("first_path").alias("path"), "n"), "shared-name", "ERROR", F.col("n"))


def misplaced(files: DataFrame, home: str) -> DataFrame:
    """files: path of each file that is no note. Those that lie outside of the top folder for attachments."""
    return issue(files.where(~F.col("path").startswith(f"{home}/")), "attachment-place", "WARN", F.element_at(F.split("path", "/"), -1))


def one_way_links(own: DataFrame, others: DataFrame, settings: Settings) -> DataFrame:
    """Links of `own` to notes of the wanted pairs of kinds that don't link back. others: gathered notes, those linked to at least."""
    edges = lambda rows: rows.select(F.col("name").alias("source"), F.col("note_kind").alias("source_kind"), "path", F.explode("links").alias("link")).select("source", "source_kind", "path", F.col("link.target").alias("target"))
    wanted = reduce(lambda a, b: a | b, [(F.col("source_kind") == a) & (F.col("target_kind") == b) for a, b in settings.reciprocity_pairs])
    met = edges(own).where("source != target").join(others.select(F.col("name").alias("target"), F.col("note_kind").alias("target_kind"), F.transform("links", lambda x: x["target"]).alias("back")), "target").where(wanted)
    # of files that share a name one link back is enough
    gaps = met.groupBy("path", "source", "target").agg(F.bool_or(F.array_contains("back", F.col("source"))).alias("answered")).where("not answered")
    return issue(gaps, "asymmetric-link", settings.asymmetry_severity, F.col("target"))


def lint(vault: Vault | NoteTables, settings: Settings, enums: DataFrame | None = None, canon: DataFrame | None = None, changelog: DataFrame | None = None, target: str | None = None, show_all: bool = False) -> DataFrame:
    """All issues: structural ones, and with show_all the heuristic stream beside them.

    Notes and what their lines say are gathered once, as a stored table of one row a note without texts. target: one note's
    name; then only notes of that name are linted, and of the others only names, and the links of those it links to, are read.
    """
    notes, lines = vault.notes, vault.lines
    gather = lambda rows, own: gathered(rows, line_facts(own, settings, show_all))
    if target is None:
        own = others = stored(gather(notes, lines))
        names = own.select("name", "path")
    else:
        # a note's name is its path's, which all tables of lines have
        named = lambda x: x.where(basename("path") == target)
        own = stored(gather(named(notes), named(lines)))
        names = notes.select("name", "path")
        linked = own.select(F.explode("links.target").alias("name")).distinct()
        if settings.reciprocity_pairs:
            wanted = notes.join(linked, "name", "left_semi")
            others = gather(wanted, lines.join(wanted.select("path"), "path", "left_semi"))
        sought = own.select(F.explode(F.transform("links", lambda x: F.lower(x["target"]))).alias("lower")).distinct()
        names = names.withColumn("lower", F.lower("name")).join(sought.unionByName(own.select(F.lower("name").alias("lower"))).distinct(), "lower", "left_semi").select("name", "path")
    found = [own.select("path", F.explode(note_rules(settings, enums, canon, changelog)).alias("x")).select("path", "x.*"), link_targets(own, names.select("name"))]
    found.append(shared(names) if target is None else shared(names.where(F.col("name") == target)))
    if isinstance(vault, Vault) and target is None:
        found.append(misplaced(vault.attachments, settings.attachment_folder))
    if settings.reciprocity_pairs:
        found.append(one_way_links(own, others, settings))
    return reduce(DataFrame.unionByName, found)


def summary(issues: DataFrame) -> DataFrame:
    """stream, rule, severity, n."""
    return issues.groupBy("stream", "rule", "severity").agg(F.count("*").alias("n"))


def structural_green(notes: DataFrame, issues: DataFrame) -> DataFrame:
    """path, errors, structural_green: heuristic issues never gate."""
    errors = issues.where((F.col("stream") == STRUCTURAL) & (F.col("severity") == "ERROR")).groupBy("path").agg(F.count("*").alias("errors"))
    return notes.select("path").join(errors, "path", "left").select("path", F.coalesce("errors", F.lit(0)).alias("errors"), F.col("errors").isNull().alias("structural_green"))


def cell_mismatches(rows: DataFrame, keys: list[str], position: str, cells: str) -> DataFrame:
    """Rows of any grouped table whose number of cells differs from that of their group's first row."""
    first = F.first(cells).over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("header_cells", first).where(F.col(cells) != F.col("header_cells"))
