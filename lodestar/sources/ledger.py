"""An append-only ledger of measurements in JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "note string, audit_type string, score double, authored_model string, judge_model string, pristine boolean, ts string, reasons array<string>, fixes_applied boolean, content_hash string"


def parse_ledger(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines (with file_pos, the order of equal times) as ledger rows; _corrupt holds a line that isn't an object.

    Blank lines are no rows. A value of another type than the schema's makes its field null, not its line corrupt: `pristine`
    counts as true only where it is the boolean.
    """
    text = F.col(column)
    rows = lines.where(F.trim(text) != "")
    # a malformed line gives a null record under try_parse_json
    variant = F.try_parse_json(text)
    good = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    fields = []
    for item in LEDGER.split(", "):
        name, kind = item.split()
        got = F.try_variant_get(variant, f"$.{name}", kind)
        if kind == "boolean":
            got = F.when(F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")) == "BOOLEAN", got)
        fields.append(got.alias(name))
    return rows.select(*[c for c in lines.columns if c != column], *fields, F.when(~good, text).alias("_corrupt"))


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Ledger rows and a warning. A missing or empty source is one warning and an empty table, no failure."""
    try:
        lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("file_pos"))
        if lines.isEmpty():
            return parse_ledger(lines), f"{path} is empty"
        return parse_ledger(lines), None
    except AnalysisException as e:
        empty = spark.createDataFrame([], "value string, file_path string, file_pos long")
        return parse_ledger(empty), f"{path} can't be read: {e.getCondition() or 'missing'}"


def valid(ledger: DataFrame) -> DataFrame:
    return ledger.where("_corrupt is null")


def malformed_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("malformed"), F.count_if(F.col("_corrupt").isNull()).alias("valid"))
