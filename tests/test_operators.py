"""Operators on small literal tables: ties, nulls, empty inputs, ledgers, retrieval and streams."""

import json
import re

from pyspark.sql import functions as F

from lodestar.operators import aggregates as A
from lodestar.operators import graph as G
from lodestar.operators import profile as X
from lodestar.operators import retrieval as R
from lodestar.sources.ledger import malformed_count, parse_ledger, read_ledger, valid
from lodestar.streaming.refresh import distinct_measurements, ledger_stream, note_stream, run_batches


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target string")


def test_one_way_and_broken(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("a", "c"), ("a", "c"), ("d", "d"), ("a", None))
    # an edge without a target is no edge, one to itself is its own reverse
    assert [tuple(x) for x in G.one_way(e).collect()] == [("a", "c")]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(tuple(x) for x in G.broken(e, names).collect()) == [("a", "c"), ("a", "c"), ("d", "d")]
    assert G.one_way(edges(spark)).count() == 0 and G.broken(edges(spark), names).count() == 0


def test_join_form_equals_aggregate_form(spark):
    """Edges without reverse by anti-join, and by counting both directions of a pair."""
    e = spark.range(400).select((F.col("id") * 7 % 23).alias("source"), (F.col("id") * 11 % 19).alias("target"))
    joined = {tuple(x) for x in G.one_way(e).collect()}
    pair = e.where("source != target").distinct().withColumn("p", F.struct(F.least("source", "target"), F.greatest("source", "target")))
    counted = {(x.s, x.t) for x in pair.groupBy("p").agg(F.count("*").alias("n"), F.first("source").alias("s"), F.first("target").alias("t")).where("n = 1").collect()}
    assert joined == counted


def test_mirrors(spark):
    credits = spark.createDataFrame([("T", "P", "story"), ("T", "Q", "art")], "title string, person string, role string")
    works = spark.createDataFrame([("T", "P", "novelist"), ("U", "P", "mangaka"), ("T", "P", "voice")], "title string, person string, role string")
    gaps = {tuple(x) for x in G.role_mirror(works, credits, {"story": ["novelist", "mangaka"], "art": ["mangaka"]}).collect()}
    assert gaps == {("T", "Q", "art", "works"), ("U", "P", "mangaka", "credits")}


def test_ledger(spark, tmp_path):
    lines = [{"note": "a", "audit_type": "content", "score": 7, "ts": "2024-01-02", "pristine": True}, {"note": "a", "audit_type": "content", "score": 9, "ts": "2024-01-02", "pristine": "true"}]
    (tmp_path / "ledger.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "{bad", json.dumps(lines[1]), "3"]))
    rows, warning = read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert warning is None and tuple(malformed_count(rows).first()) == (2, 2)
    assert A.latest(valid(rows), ["note", "audit_type"], "ts", ["file_pos"]).first().score == 7
    assert sorted(str(x.pristine) for x in valid(rows).collect()) == ["None", "True"]
    rows, warning = read_ledger(spark, str(tmp_path / "missing.jsonl"))
    assert warning and rows.count() == 0


def test_coverage_order(spark):
    cards = spark.createDataFrame([("c", "2024-01-01"), ("b", None), ("a", "2024-02-01"), ("d", "2024-01-01")], "path string, created string")
    text = [json.dumps({"note": "d", "audit_type": t, "score": 5, "ts": ts}) for t, ts in (("structural", "2024-03-01"), ("content", "2024-03-02"))]
    ledger = valid(parse_ledger(spark.createDataFrame([(x, k) for k, x in enumerate(text)], "value string, file_pos long")))
    # a card with one audit only has a last audit too
    assert [x.path for x in A.coverage(cards, ledger).collect()] == ["d", "a", "c", "b"]
    assert tuple(A.coverage_totals(cards, ledger).first()) == (4, 1, 1, 1, 2)


def test_pristine_and_runway(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "note string, ts int, fixed boolean")
    assert {(x.note, x.ts): x.pristine for x in A.pristine(rows, "note", ["ts"], F.col("fixed")).collect()} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True}
    assert tuple(A.runway_summary(A.cell_means(rows, ["note"], "ts")).first()) == (2, 0, 6)


def test_followers(spark):
    rows = spark.createDataFrame([("u", k, "abcab"[k % 5]) for k in range(23)] + [("v", 1, "x"), (None, 1, "y"), (None, 9, "z")], "who string, at int, kind string")
    got = sorted((x.who or "", x.source, x.target) for x in A.followers(rows, "who", ["at"], "kind", F.floor(F.col("at") / 4)).collect())
    assert got == sorted([("u", "abcab"[k % 5], "abcab"[(k + 1) % 5]) for k in range(22)] + [("", "y", "z")])


def test_hot_keys_are_limited_before_the_shuffle(spark):
    plan = A.latest(spark.range(10).selectExpr("id % 2 as k", "id as ts"), ["k"], "ts", ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cast_mirror_and_thumbnails(spark):
    featured = edges(spark, ("C1", "T"), ("C2", "T"))
    links = spark.createDataFrame([("T.md", "T / Cast", "C1"), ("T.md", "T / Cast", "C3"), ("T.md", "T", "C2")], "path string, section_path string, target string")
    names = spark.createDataFrame([("T.md", "T")], "path string, name string")
    assert {tuple(x) for x in G.cast_mirror(featured, links, names, "Cast").collect()} == {("T", "C2", "cast section"), ("T", "C3", "featured list")}
    gallery = spark.createDataFrame([("g.md", 1, "A", "a.png", 80), ("g.md", 2, "A", "other.png", 80), ("g.md", 3, "B", "b.png", None), ("g.md", 4, "B", "b.png", 60)], "path string, line int, target string, file string, width int")
    notes = spark.createDataFrame([("A", "work", "attachments/a.png"), ("B", "person", "b.png"), ("N", "work", None)], "name string, note_kind string, cover_path string")
    assert {x.line for x in G.missing_thumbnails(gallery, notes, F.col("cover_path"), {"work": 80}, 60).collect()} == {2, 3}


def test_under_tag_modes(spark):
    members = spark.createDataFrame([("f", x) for x in "abcde"], "facet string, member string")
    tags = spark.createDataFrame([(x, "t") for x in "abcd"] + [("a", "u")], "member string, tag string")
    assert [x.tag for x in A.under_tagged(members, tags).collect()] == ["t"]
    assert A.under_tagged(members, tags, mode="any").count() == 2 and A.under_tagged(members, tags, mode="off").count() == 0
    assert A.under_tagged_members(members, tags, A.under_tagged(members, tags)).first().member == "e"


def test_budget(spark):
    rows = spark.createDataFrame([(1, "x" * 50), (2, "Ю" * 10), (3, "x" * 90), (4, "x")], "id int, text string")
    got = [(x.rank, x.n_bytes, x.is_full) for x in R.within_budget(rows, ["id"], budget=40).orderBy("rank").collect()]
    assert got == [(1, 50, True), (2, 20, False), (3, 90, False), (4, 1, False)]
    assert [x.is_full for x in R.within_budget(rows, ["id"], budget=70).orderBy("rank").collect()] == [True, True, False, False]


def test_search_modes(spark):
    vector = "array<float>"
    chunks = spark.createDataFrame([(1, "a", "red fox", [1.0, 0.0]), (2, "a / b", "red red dog", [0.6, 0.8]), (3, "c", "blue", [0.0, 0.0]), (4, "c", "", None)], f"chunk_id long, section_path string, text string, embedding {vector}")
    assert [x.chunk_id for x in R.search(chunks, ["red"], mode="bm25").orderBy("rank").collect()] == [2, 1]
    assert [x.chunk_id for x in R.search(chunks, query=[1.0, 0.0], mode="dense").orderBy("rank").collect()] == [1, 2]
    both = R.search(chunks, ["red"], [1.0, 0.0], verbosity="full").orderBy("rank").collect()
    assert {x.chunk_id for x in both} == {1, 2} and both[0].bm25_rank is not None
    assert "embedding" not in R.search(chunks, ["red"], mode="bm25").columns
    assert R.search(chunks, ["red"], mode="bm25", section_path_prefix="a / ").count() == 1
    assert R.clamp_k(90) == 40 and R.clamp_k(900, hard=True) == 100


def test_streams(spark, tmp_path):
    source, seen = tmp_path / "ledger", []
    source.mkdir()
    row = {"note": "a", "audit_type": "content", "score": 1, "ts": "2024-01-01T00:00:00Z", "content_hash": "h"}
    (source / "1.jsonl").write_text(json.dumps(row) + "\n{bad\n" + json.dumps(row) + "\n")
    stream = distinct_measurements(ledger_stream(spark, str(source)))
    run_batches(stream, lambda df: seen.extend(df.select("note", "score").collect()), str(tmp_path / "c1")).awaitTermination()
    assert [tuple(x) for x in seen] == [("a", 1.0)]
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "N.md").write_text("# N\n")
    got = []
    run_batches(note_stream(spark, str(notes)), lambda df: got.extend(df.select("text").collect()), str(tmp_path / "c2")).awaitTermination()
    assert [x.text for x in got] == ["# N\n"]


def test_spread(spark, tmp_path):
    from lodestar.functions.layout import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == 4 and spread(one).count() == 100
    many = one.repartition(3)
    assert spread(many) is many


def test_mentions_both_ways(spark, monkeypatch):
    """The automaton and the join on words find the same, at the edges of words in any script."""
    lines = ["Ann Lee met ann-lee and ANN  LEE", "annlee xann lee ann lee_ _ann lee", "C++ and c++x, Straße STRASSE", "я Мария-сан, марияс Мария", "one two one", None, "", "foo_bar foo", "ann lee", "İstanbul istanbul"]
    terms = [("A", "Ann Lee"), ("A", "ann"), ("C", "C++"), ("S", "straße"), ("M", "Мария"), ("M", "мария-сан"), ("O", "one two one"), ("F", "foo"), ("F", "foo_bar"), ("N", "++"), ("N", None), ("I", "istanbul")]
    rows = spark.createDataFrame(list(enumerate(lines)), "line long, text string")
    named = spark.createDataFrame(terms, "target string, term string")
    one = sorted(tuple(x) for x in G.text_mentions(rows, named, keys=["line"]).collect())
    monkeypatch.setattr("lodestar.operators.mentions.MOST_TERMS", 3)
    assert one == sorted(tuple(x) for x in G.text_mentions(rows, named, keys=["line"]).collect()) and len(one) > 12
    assert G.text_mentions(rows, named.limit(0), keys=["line"]).count() == 0


def test_fixes_by_shortened_names(spark):
    names = ["Ann_Lee", "Ann_Leo", "Bo", "Violet_Evergarden", "violet"]
    targets = ["ann_lee", "Anm_Lee", "Ann_Le", "Boo", "Violet_Evergardne", "Voilet", "Nothing_like_it", "Bo.md", ""]
    plan = X.fix_plan(spark.createDataFrame([("p", k, t) for k, t in enumerate(targets)], "path string, line int, target string"), spark.createDataFrame([(x,) for x in names], "name string"))
    got = {x.target: (x.proposal, x.distance, x.n_names) for x in plan.collect()}
    assert got == {"ann_lee": ("Ann_Lee", 0, 1), "Anm_Lee": ("Ann_Lee", 1, 1), "Ann_Le": ("Ann_Lee", 1, 2), "Boo": ("Bo", 1, 1), "Violet_Evergardne": ("Violet_Evergarden", 2, 1), "Voilet": ("violet", 2, 1), "Bo.md": ("Bo", 0, 1), "": ("Bo", 2, 1)}


def test_shortened_names_are_not_broadcast(spark):
    """Shortened names are 150 times the names, which Spark doesn't foresee; and targets that are names aren't shortened."""
    names = spark.range(300).select(F.concat(F.lit("Name_"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("name"))
    links = names.select(F.lit("p").alias("path"), F.lit(1).alias("line"), F.upper("name").alias("target"))
    plan = X.fix_plan(links, names)
    rows = plan.collect()
    assert len(rows) == 300 and all(x.distance == 0 and x.n_names == 1 for x in rows)
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert {x.partition("Join")[0] for x in re.findall(r"\w+Join(?:\(skew=true\))? \[key#", final)} == {"SortMerge"}


def test_streams_compose(spark, tmp_path):
    """A note stream feeds the parser batch by batch; the keyed state of a ledger equals the batch operators over all files."""
    from lodestar.sources import notes as N
    from lodestar.streaming.refresh import STATE_STORE, latest_rows

    notes = tmp_path / "vault"
    (notes / "WORKS").mkdir(parents=True)
    (notes / "WORKS/A b.md").write_text("---\nscore: 7\n---\n# A\nSee [[B]]\n")
    got = []
    run_batches(note_stream(spark, str(notes)), lambda df: got.extend(N.links(N.note_lines(N.parse(df))).select("path", "line", "target").collect()), str(tmp_path / "c1")).awaitTermination()
    assert [tuple(x) for x in got] == [("WORKS/A b.md", 5, "B")]

    spark.conf.set(*STATE_STORE)
    source, seen = tmp_path / "ledger", {}
    source.mkdir()
    row = lambda note, axis, ts, score, fix=False: json.dumps({"note": note, "audit_type": axis, "ts": ts, "score": score, "fixes_applied": fix})
    files = [
        [row("a", "content", "2024-01-01", 1), row("a", "content", "2024-01-01", 2), row("a", "structural", "2024-01-02", 3, True), "{bad", "", row("b", "content", "2024-01-01", 4)],
        [row("a", "content", "2024-01-01", 5), row("a", "content", "2024-01-03", 6), row("b", "content", "2023-12-31", 7), row("c", "content", "2024-02-01", 8), row("c", "content", "2024-02-02", 9)],
    ]
    for k, lines in enumerate(files):
        (source / f"{k}.jsonl").write_text("\n".join(lines))
        stream = latest_rows(ledger_stream(spark, str(source)))
        run_batches(stream, lambda df: seen.update({(x.note, x.audit_type): (x.ts, x.score, x.pristine) for x in df.collect()}), str(tmp_path / "c2"), "update").awaitTermination()
    text = spark.createDataFrame([(x, k, i) for k, lines in enumerate(files) for i, x in enumerate(lines)], "value string, file int, at long")
    rows = valid(parse_ledger(text.withColumn("file_pos", F.col("file") * 100 + F.col("at")).drop("file", "at")))
    batch = {(x.note, x.audit_type): (x.ts, x.score) for x in A.latest(rows, ["note", "audit_type"], "ts", ["file_pos"]).collect()}
    assert {k: v[:2] for k, v in seen.items()} == batch
    assert {k: v[2] for k, v in seen.items()} == {("a", "content"): False, ("a", "structural"): True, ("b", "content"): True, ("c", "content"): True}


def test_cuts_depend_on_content(spark):
    """Parts stay under the bound, join to the text, and an edit changes at most two of them, in prose and without spaces."""
    import random

    from lodestar.functions.cuts import cut_places, cut_texts

    rng = random.Random(5)
    parts = lambda data, most: [data[a:b] for a, b in zip([0, *cut_places(data, most)], [*cut_places(data, most), len(data)])]
    moved = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(2500)]
        text = " ".join(words) if k % 4 else "".join(words)
        before = parts(text.encode(), 1000)
        assert b"".join(before).decode() == text and max(map(len, before)) <= 1000 and all(x.decode() for x in before)
        at = rng.randrange(len(text))
        after = parts((text[:at] + rng.choice(["x", "new words here ", ""]) + text[at + rng.randint(0, 5) :]).encode(), 1000)
        moved.append(len(set(after) - set(before)))
    assert max(moved) <= 4 and sum(x <= 2 for x in moved) >= 57
    assert cut_places(b"", 8) == [] and parts("é".encode() * 50, 9) and all(x.decode() for x in parts("é".encode() * 50, 9))
    row = spark.createDataFrame([("aa " * 40,), (None,)], "text string").select(cut_texts(F.col("text"), 16).alias("x")).collect()
    assert "".join(x.text for x in row[0].x) == "aa " * 40 and len({(x.text, x.before) for x in row[0].x}) == len(row[0].x)


def test_approximate_neighbours(spark):
    """Null, zero, short and repeated vectors have a defined place, and most neighbours are found."""
    import numpy as np

    from lodestar.functions.layout import shared_folder
    from lodestar.operators import vectors as V

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    data = [(k, (centres[k % 12] + 0.6 * rng.normal(size=16)).tolist()) for k in range(1500)]
    data += [(5000 + k, centres[0].tolist()) for k in range(400)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [None] * 16), (9004, [float("nan")] * 16)]
    rows = spark.createDataFrame(data, "key long, vector array<double>")
    queries = rows.where("key % 50 = 0").withColumnRenamed("key", "query")
    path = shared_folder(spark)
    model = V.build(rows, path, "key", "vector", cells=20)
    found, wanted = V.search(spark, path, model, queries, probes=8), V.exhaustive(rows, queries)
    total = V.recall(found, wanted).first()
    assert total.wanted == 12 * total.queries and total.met >= 0.9 * total.wanted
    want = R.top_k(R.dense(rows.where("key < 9001"), data[50][1], "key", "vector"), 12, "key").collect()
    got = wanted.where("query = 50").orderBy("rank").collect()
    assert [x.key for x in got] == [x.key for x in want] and all(abs(a.score - b.score) < 1e-9 for a, b in zip(got, want))
    empty = V.build(rows.limit(0), shared_folder(spark), "key", "vector")
    assert len(empty.cells) == 1


def test_neighbours_of_vectors_that_lie_anywhere(spark):
    """Without clusters most cells hold neighbours: the index finds out how many to look at. Of many equal vectors the first count."""
    import numpy as np

    from lodestar.functions.layout import shared_folder
    from lodestar.operators import vectors as V

    rng = np.random.default_rng(5)
    data = [(k, rng.normal(size=64).tolist()) for k in range(4000)]
    data += [(5000 + k, data[0][1]) for k in range(500)] + [(9999, None)]
    rows = spark.createDataFrame(data, "key long, vector array<double>").repartition(3)
    queries = rows.where("key % 50 = 0 and key < 4000").withColumnRenamed("key", "query")
    path = shared_folder(spark)
    model = V.build(rows, path, "key", "vector")
    found = V.search(spark, path, model, queries)
    total = V.recall(found, V.exhaustive(rows, queries)).first()
    assert total.wanted == 12 * total.queries == 12 * 80 and total.met >= 0.95 * total.wanted
    assert [x.key for x in found.where("query = 0").orderBy("rank").collect()] == [0, *range(5000, 5011)]
    # vectors in clusters need few cells; rows without a key are in no list
    centres = rng.normal(size=(40, 16))
    near = spark.createDataFrame([(k, (centres[k % 40] + 0.05 * rng.normal(size=16)).tolist()) for k in range(4000)] + [(None, centres[0].tolist())], "key long, vector array<double>")
    assert V.build(near, shared_folder(spark), "key", "vector").probes < 20
