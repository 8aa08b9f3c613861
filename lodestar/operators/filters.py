"""Record queries: filters that conjoin, a projection of nested fields, and a limit in a fixed order."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def nested(path: str, kind: str, record: str, columns: list[str]) -> Column:
    """A typed column if there is one of that name, else a dot-path in the untyped record (VARIANT, or JSON text)."""
    if path in columns:
        return F.col(path).cast(kind) if kind != "variant" else F.col(path)
    return F.try_variant_get(F.col(record), f"$.{path}", kind)


def has_all(array: Column | str, wanted: list[str]) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), array)) == 0


def has_any(array: Column | str, wanted: list[str]) -> Column:
    return F.arrays_overlap(array, F.array(*map(F.lit, wanted)))


def query(
    records: DataFrame, *, equals: dict[str, Any] | None = None, tags: list[str] | None = None, tags_any: list[str] | None = None, folder: str | None = None, has_field: str | None = None,
    field_equals: dict[str, Any] | None = None, field_gte: dict[str, float] | None = None, field_in: dict[str, list] | None = None, fields: list[str] | None = None, limit: int | None = None,
    key: str = "path", tag_column: str = "tags", record: str = "extra", path_column: str = "path", quality_gate: str | None = None, note_kind_required: bool = False,
) -> DataFrame:
    """Rows that meet every condition given.

    equals: typed columns. tags: all of these; tags_any: one at least. folder: a prefix of the path, not a component.
    has_field: the key exists, even with null. field_*: dot-paths in the record; null or a failed cast never matches.
    fields: projects these next to the key. limit: the first rows in order of the key.
    """
    columns, where = records.columns, []
    where += [F.col(k) == v for k, v in (equals or {}).items()]
    if tags:
        where.append(has_all(tag_column, tags))
    if tags_any:
        where.append(has_any(tag_column, tags_any))
    if folder:
        where.append(F.col(path_column).startswith(folder))
    if has_field:
        where.append(nested(has_field, "variant", record, columns).isNotNull())
    # a typed column is compared as it is, so that the condition reaches the scan
    where += [F.col(k) == v if k in columns else nested(k, "string", record, columns) == str(v) for k, v in (field_equals or {}).items()]
    where += [F.col(k) >= v if k in columns else nested(k, "double", record, columns) >= float(v) for k, v in (field_gte or {}).items()]
    where += [F.col(k).isin(*v) if k in columns else nested(k, "string", record, columns).isin(*map(str, v)) for k, v in (field_in or {}).items()]
    if quality_gate:
        where.append(F.col("quality") == quality_gate)
    if note_kind_required:
        where.append(F.col("note_kind").isNotNull() & (F.col("note_kind") != ""))
    out = records.where(conjunction(where))
    if fields is not None:
        out = out.select(key, *(nested(x, "string", record, columns).alias(x.replace(".", "_")) for x in fields if x != key))
    return out.orderBy(key).limit(limit) if limit is not None else out


def retrieval_filter(chunks: DataFrame, *, section_path_prefix: str | None = None, min_score: float | None = None, equals: dict[str, Any] | None = None) -> DataFrame:
    where = [F.col(k) == v for k, v in (equals or {}).items()]
    if section_path_prefix:
        where.append(F.col("section_path").startswith(section_path_prefix))
    if min_score is not None:
        where.append(F.col("score") >= min_score)
    return chunks.where(conjunction(where))


def eligible(ledger: DataFrame, judge_prefix: str) -> DataFrame:
    """Measurements of untouched notes by judges of one family."""
    return ledger.where(F.col("pristine").eqNullSafe(True) & F.col("judge_model").startswith(judge_prefix))


def by_rating(records: DataFrame, allowed: list[str] | None = None, column: str = "content_rating") -> DataFrame:
    """An axis to filter by on request; nothing is left out by default."""
    return records if allowed is None else records.where(F.col(column).isin(*allowed))
