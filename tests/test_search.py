"""Search indexes against exhaustive scores."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.layout import shared_folder
from lodestar.operators import postings as PI
from lodestar.operators import retrieval as R


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    draw = lambda n: " ".join(words[min(199, int(x))] for x in rng.exponential(25, n))
    rows = [(k, draw(int(rng.integers(1, 60)))) for k in range(600)] + [(900 + k, "w0 w1 Rare") for k in range(20)] + [(990, ""), (991, None), (992, "only")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.mark.parametrize("k,share", [(1, 50), (5, 50), (12, 4096)])
def test_postings_equal_exhaustive_scores(spark, docs, monkeypatch, k, share):
    monkeypatch.setattr(PI, "SHARE", share)
    path, asked = shared_folder(spark), {1: ["w0", "w150"], 2: ["W3", "w3", "rare", "w90"], 3: ["nowhere"], 4: ["w0"], 5: ["only", "w1", "w2", "w5", "nowhere"], 6: []}
    PI.build(docs, path)
    got: dict[int, list] = {}
    for x in PI.search(spark, path, spark.createDataFrame(list(asked.items()), "query long, terms array<string>"), k).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append((x.key, x.score))
    for query, terms in asked.items():
        want = [(x.doc_id, x.score) for x in R.top_k(R.bm25(docs.where("text is not null"), terms), k).collect()] if terms else []
        found = got.get(query, [])
        assert [x for x, _ in found] == [x for x, _ in want] and [x for _, x in found] == pytest.approx([x for _, x in want]), query


def test_postings_open_little(spark, docs, monkeypatch, capsys):
    """Only the terms' folders are read, weak terms carry no candidates, and few blocks of a frequent term are opened."""
    monkeypatch.setattr(PI, "SHARE", 50)
    path = shared_folder(spark)
    PI.build(docs, path)
    asked = spark.createDataFrame([(1, 0, "rare"), (1, 1, "w0")], "query long, pos int, term string")
    blocks = PI.blocks_of(spark, path, asked)
    blocks.explain()
    folders = ",".join(str(x) for x in sorted(x[0] for x in asked.select(PI.folder_of(F.col("term"))).collect()))
    pruned = re.search(r"PartitionFilters: \[.*?IN \(([\d,]+)\)", capsys.readouterr().out)
    assert ",".join(sorted(pruned[1].split(","), key=int)) == folders
    plan = {x.term: x for x in PI.plan_of(asked, blocks, PI.statistics(spark, path), 3).collect()}
    assert plan["rare"].essential and not plan["w0"].essential
    one = {x.term: x for x in PI.plan_of(asked.where("pos = 1"), blocks, PI.statistics(spark, path), 3).collect()}["w0"]
    levels = blocks.where("term = 'w0'").groupBy("level").count().count()
    assert blocks.where((F.col("term") == "w0") & (F.col("top") * one.weight >= one.threshold)).groupBy("level").count().count() < levels


def test_empty_index(spark, docs):
    path = shared_folder(spark)
    PI.build(docs.limit(0), path)
    assert PI.search(spark, path, spark.createDataFrame([(1, ["w0"])], "query long, terms array<string>")).count() == 0


def test_postings_are_not_dealt_out(spark, docs, monkeypatch):
    """Building shuffles texts once, by share, and no postings; a search finds the same by candidates that are sent and dealt out."""
    path, asked = shared_folder(spark), spark.createDataFrame([(1, ["w0", "w1", "rare"]), (2, ["w5", "w90", "w3"])], "query long, terms array<string>")
    PI.build(docs, path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(runs.size())]
    plan = next(x for x in reversed(plans) if f"{path}/postings," in x and "InsertIntoHadoopFsRelationCommand" in x).split("Initial Plan")[0]
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) <= {"share"} and "ObjectHashAggregate" not in plan
    rows = lambda: [tuple(x) for x in PI.search(spark, path, asked, 5).orderBy("query", "rank").collect()]
    sent = rows()
    monkeypatch.setattr(PI, "MOST_SENT", 0)
    assert rows() == sent and len(sent) == 10
