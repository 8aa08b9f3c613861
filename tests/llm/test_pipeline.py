"""The pipeline, stage by stage, on small tables; and its registered queries' names."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
from lodestar.llm import queries
from lodestar.llm.quality_rules import measure
from lodestar.llm.secret_scan import secret_spans
from lodestar.llm.simhash_dedup import near_groups


def documents(spark):
    text = lambda k, n=60: " ".join(f"word{k}x{j}" for j in range(n))
    rows = [(k, text(k), "en", f"s{k % 4}", 1) for k in range(40)]
    rows += [(100, text(1), "en", "s1", 1), (101, text(1) + " one", "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None), (104, "token=abcdefgh12345 " + text(104), "en", None, 1), (104, "token=abcdefgh12345 " + text(104), "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = documents(spark)
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, "")
        rows = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect() if measure((r.text or "").encode())[0] >= 10)
        if name == "near_dedup":
            groups = {r.component_id for r in near_groups(before).collect()}
            assert Counter(r.doc_id for r in rows) == Counter(groups)
        if name == "secrets":
            assert len(rows) == before.count() and not any(secret_spans(r.text.encode())[1] for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "mixture":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()} and max(Counter(r.doc_id for r in rows).values()) <= 2
        if name == "tokens":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before.collect()) and all(r.spans_tile and r.n_tokens > 0 for r in rows)
        out = spark.createDataFrame(rows, out.schema)


def test_workers_get_a_few_megabytes(spark):
    """A stage's Python workers never get a whole split of a table at once."""
    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat('word ', 2000) text", "'en' lang", "'s' source", "10000L n_chars")
    corpus_pipeline.near_dedup(spark, docs.limit(0), "")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"]) for x in batches), "n long")
    found = [r.n for r in sizes.collect()]
    assert sum(found) > 40_000_000 and max(found) < 5_000_000


def test_empty_table(spark):
    out = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0


def test_run_over_a_folder(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and sorted(r.ids_sha256 for r in rows) == sorted(r.ids_sha256 for r in again)


def test_names():
    assert {n for n in range(1, 14)} == {int(x[2:].split("_")[0]) for x in queries.QUERIES if x != "pipeline"}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
