"""Small registries in YAML: enum values, tag taxonomy, dated requirements, and the vault's own settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as Spark sees it, so that it may lie in any store."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""


def _load(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def enums(spark: SparkSession, text: str, key: str = "note_kinds") -> DataFrame:
    """kind, field, value; anchors and aliases are resolved by the YAML parser. Entries that aren't lists are skipped."""
    rows = [(kind, name, str(value)) for kind, fields in (_load(text).get(key) or {}).items() if isinstance(fields, dict) for name, values in fields.items() if isinstance(values, list) for value in values]
    return spark.createDataFrame(rows, "kind string, field string, value string")


def taxonomy(spark: SparkSession, text: str, key: str = "tags") -> DataFrame:
    """name, group, description, applies_to_kinds, adult_gated."""
    rows = [(x["name"], x.get("group"), x.get("description"), x.get("applies_to_kinds"), x.get("adult_gated") is True) for x in _load(text).get(key) or []]
    return spark.createDataFrame(rows, "name string, group string, description string, applies_to_kinds array<string>, adult_gated boolean")


def spec_changelog(spark: SparkSession, text: str) -> DataFrame:
    """kind, requirement, introduced, kind_of."""
    found = _load(text)
    lists = {k: v for k, v in (found.get("kinds") or found).items() if isinstance(v, list)}
    rows = [(kind, str(x["requirement"]), str(x["introduced"]), x.get("kind_of")) for kind, entries in lists.items() for x in entries]
    return spark.createDataFrame(rows, "kind string, requirement string, introduced string, kind_of string").withColumn("introduced", F.to_date("introduced"))


def render_taxonomy(tags: DataFrame) -> DataFrame:
    """group, markdown: a table of each group's tags, sorted by name."""
    row = F.concat(F.lit("| "), "name", F.lit(" | "), F.coalesce("description", F.lit("")), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))), lambda x: x["row"]), "\n")
    return tags.groupBy("group").agg(body.alias("rows")).select("group", F.concat(F.lit("| tag | description |\n| --- | --- |\n"), "rows").alias("markdown"))


@dataclass
class Settings:
    """What one collection of notes sets for the generic operators."""

    folders: dict[str, str] = field(default_factory=dict)
    reciprocity_pairs: list[tuple[str, str]] = field(default_factory=list)
    asymmetry_severity: str = "WARN"
    orphan_exempt: list[str] = field(default_factory=list)
    link_exempt: list[str] = field(default_factory=list)
    max_tags: int = 10
    max_links: int = 15
    max_width: int = 300
    min_lines: int = 30
    required_tags_by_kind: dict[str, list[str]] = field(default_factory=dict)
    required_fields: dict[str, list[str]] = field(default_factory=dict)
    recommended_fields: dict[str, list[str]] = field(default_factory=dict)
    always_present: dict[str, list[str]] = field(default_factory=dict)
    progress_kinds: list[str] = field(default_factory=lambda: ["anime"])
    score_fields: list[str] = field(default_factory=list)
    relation_fields: dict[str, list[str]] = field(default_factory=dict)
    tag_facet_fields: list[str] = field(default_factory=list)
    under_tag_mode: str = "majority"
    under_tag_present_fraction: float = 0.6
    under_tag_max_missing: int = 2
    under_tag_limit: int = 50
    tooling_vocab: list[str] = field(default_factory=list)
    personal_heading: str = ""
    spoiler_headings: list[str] = field(default_factory=list)
    prose_pattern: str | None = None
    name_pattern: str = r"^[A-Za-z0-9][A-Za-z0-9_.,'!()&-]*$"
    attachment_folder: str = "attachments"
    thumb_width: dict[str, int] = field(default_factory=dict)
    thumb_default: int = 60


def pairs(spark: SparkSession, values: dict[str, list[str]], names: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, str(x)) for k, own in values.items() for x in own], f"{names[0]} string, {names[1]} string")
