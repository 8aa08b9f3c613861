"""Vector codes, spelling variants and URL filters against plain brute-force versions, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import common
from lodestar.llm import spelling_variants as W
from lodestar.llm import url_filter as U
from lodestar.llm import vector_codes as V

# ---- vector codes


def brute_codes(rows, parts, entries, rounds):
    """rows: vec_id, vector, label. What each kept row's code, error and label_error are, and the codebooks' digest."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    size = len(kept[0][1])
    cut = lambda v: [v[p * size // parts : (p + 1) * size // parts] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in [x for x in kept if len(x[1]) == size][:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for _, v, _ in kept:
                if len(v) == size:
                    groups.setdefault(nearest(p, cut(v)[p]), []).append(cut(v)[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else x for e, x in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        if len(v) != size:
            out.append((i, None, None, label))
            continue
        codes = [nearest(p, cut(v)[p]) for p in range(parts)]
        out.append((i, "".join(f"{x:02x}" for x in codes), sum(distance(cut(v)[p], books[p][x]) for p, x in enumerate(codes)), label))
    sums = Counter()
    for *_, error, label in out:
        sums[label] += error or 0
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, code, error, label in out)


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(0, 0.1, 8).round(2).tolist(), [1, 2, None][k % 3]) for k in rng.permutation(90)]
    rows += [(3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (3, [-0.001] * 8, 7), (None, [0.1] * 8, None), (200, None, 1), (201, [0.1] * 7 + [None], 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1)]
    return rows + [(300 + k, [0.02] * 8, 5) for k in range(60)]


@pytest.mark.parametrize("sent", [50_000, 1])
def test_vector_codes(spark, monkeypatch, sent):
    """Ties, repeated rows and ids, null ids and labels, rows that go; label totals broadcast or salted."""
    monkeypatch.setattr(common, "MOST_SENT", sent)
    rows = vector_rows()
    table = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    rows = [(x.vec_id, x.embedding, x.label) for x in table.collect()]
    for entries, rounds in ((16, 2), (5, 1)):
        got = V.vector_codes(table, parts=4, entries=entries, rounds=rounds)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(map(tuple, got.collect())) == brute_codes(rows, 4, entries, rounds)


def test_vector_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert V.vector_codes(spark.createDataFrame([], kinds)).count() == 0
    assert V.vector_codes(spark.createDataFrame([(1, None, 1)], kinds)).count() == 0
    odd = V.vector_codes(spark.createDataFrame([(1, [0.1] * 16, 1), (2, [0.1] * 15, 1), (3, [], 1)], kinds)).collect()
    assert {(x.vec_id, x.code, x.error) for x in odd} == {(1, "00" * 16, 0), (2, None, None), (3, None, None)}
    assert {x.code for x in V.vector_codes(spark.createDataFrame([(1, [0.1] * 10, 1)], kinds)).collect()} == {None}


def test_decoding(spark):
    """A code's entries lie as far from the vector as its error says."""
    rows = [x for x in vector_rows() if x[0] is not None and x[0] < 90 and len(x[1]) == 8]
    table = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, vector array<double>")
    books = V.train(table, 4, 16, 2)
    of = dict(zip([i for i, *_ in rows], rows))
    for x in V.decode(V.encode(table.where("vec_id > 3"), books), books).collect():
        whole = [round(a * 256 - 0.5) for a in x.approximation]
        assert sum((int(np.floor(256 * a)) - b) ** 2 for a, b in zip(of[x.vec_id][1], whole)) == x.error


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(1, 3), st.integers(0, 10**6), st.sampled_from([2, 30, 1 << 20]))
def test_equal_average_search(entries, parts, width, seed, span):
    """The nearest entry, the lower index among equals, at any magnitude; many entries are never looked at."""
    rng = np.random.default_rng(seed)
    books = rng.integers(-span, span, (parts, entries, width))
    rows = rng.integers(-span, span, (50, parts, width))
    index, best, looked = V.nearest(rows, books)
    every = ((rows[:, :, None, :] - books[None]) ** 2).sum(-1)
    assert (index == every.argmin(2)).all() and (best == every.min(2)).all() and looked <= 50 * parts * entries


def test_search_looks_at_few():
    rng = np.random.default_rng(1)
    books = np.sort(rng.integers(-1000, 1000, (2, 64, 1)), axis=1)
    assert V.nearest(rng.integers(-1000, 1000, (500, 2, 1)), books)[2] < 500 * 2 * 5


# ---- spelling variants


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one(x, w)] for w in n}
    best = {w: min(own, key=lambda x: (-n[x], x)) for w, own in near.items() if own}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def spelling_rows():
    rng = np.random.default_rng(9)
    base = ["receive", "separate", "überall", "aaaaaaaa", "ÀÉÎõüÿ", "necessary", "abcdef"]
    letters = list("abcdeéÿ")
    words = []
    for w in base:
        for _ in range(12):
            k, kind = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
            words += [(w[:k] + str(rng.choice(letters)) + w[k + (kind == 0) :] if kind < 2 else w[:k] + w[k + 1 :], int(rng.integers(4, 9)))]
        words += [(w, int(rng.choice([30, 60, 150])))]
    # a chain of forms, and ties of their number
    words += [("zzzzzz", 8), ("zzzzzy", 70), ("zzzzxy", 500), ("kkkkkk", 8), ("kkkkka", 60), ("kkkkkb", 60), ("x" * 400, 6), ("x" * 399 + "y", 40), ("short", 99)]
    every = [w for w, n in words for _ in range(n)]
    rng.shuffle(every)
    rows = [(k, " ".join(every[k::30]).replace("receive", "Receive")) for k in range(30)]
    rows += [(None, "necessary-necessary, necessary"), (7, None), (8, ""), (3, rows[3][1]), (9, "123 _ ++")]
    # runs that lose a letter
    return rows + [(5000 + k, f"separate.überall×receive÷{k}") for k in range(400)]


def test_pieces_cut_no_run():
    text = "ab cdefgh, ijklmnopq rst"
    for size in (1, 3, 8, 100):
        assert "".join(W.pieces(text, size)) == text and all(not (a[-1:].isalpha() and b[:1].isalpha()) for a, b in zip(list(W.pieces(text, size)), list(W.pieces(text, size))[1:]))


def test_spelling_variants(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute_variants(rows)
    out = W.spelling_variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in out.collect()}
    assert got == want and want["zzzzzz"][:2] == ("zzzzzy", "zzzzxy") and want["kkkkkk"][0] in ("kkkkka", "kkkkkb")
    assert any(v[0] for w, v in want.items() if "\u00c0" <= max(w)) and W.spelling_variants(docs.limit(0)).count() == 0


def test_near_pairs(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(500)}
    got = {(x.a, x.b) for x in W.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    edits = lambda w: {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in ("", *"abé") for d in (0, 1)} - {w}
    assert got == {(a, b) for a in words for b in edits(a) & words}


def test_crowded_prefix_grows_with_the_words(spark, monkeypatch):
    """Words that all share their first half make no more states than words times letters."""
    rng = np.random.default_rng(2)
    words = sorted({"prefix" + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(600)})
    made, level = [], W.one_level
    monkeypatch.setattr(W, "one_level", lambda states, edges: (lambda x: (made.append(x.count()), x)[1])(level(states, edges)))
    W.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).count()
    assert sum(made) < 60 * len(words)


# ---- URL filters

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"), U.Rule("allow", "com", "/fr/"), U.Rule("block", "com", "/de/")]
HELD_OUT = """allow https://www.somenewspaper.com/en/12
allow http://opera-house.org/en/5
allow https://m.gardeners-weekly.net/fr/88
allow https://blog.linguistics.edu/papers/3
allow https://www.bakery-recipes.com/en/bread
allow https://northernlights.net/de/71
allow https://www.cityparks.gov/maps
allow https://philosophy.review.org/es/19
block http://casino-slots.net/en/5
block https://m.adult-xx.com/en/1
block https://cheap-pills-store.com/en/2
block http://track-ads.net/en/9
block https://www.win-jackpot.biz/en/7
block http://sex-cams.com/fr/6
block https://fast-cash-loan.net/en/31
block http://click-banner-ads.com/de/5"""


@pytest.fixture(scope="module")
def model(spark):
    return U.train(U.labelled_urls(spark))


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def brute_rule(host, path):
    fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
    best = max(fit, key=lambda x: (len(x.host + x.path), len(x.host)), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def test_urls(spark, model):
    urls = [
        "https://Example.ORG/es/1", "https://a.example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/x", "https://example.org", "https://x.org?es/", "https://shop.COM/fr/a?b=://c", "ftp://com/de/",
        "http://a.com/de/", "http://com.net/de/", "no scheme/x", "", None, "://", "://org/", "http://É.com/fr/#x", "a://b://c.com/fr/", "http://x.com/\n/fr/", "https://a.org/" + "x" * 50_000, "https://user@a.com:80/de/", "http://y.net/" + "d/" * 300,
    ]
    rows = [(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, urls[0], "h", "v"), (0, urls[0], "h", "v")]
    out = U.url_filter(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string"), RULES, model)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "block_score"]
    got = out.collect()
    assert Counter((x.page_id, x.host, x.path, x.rule) for x in got) == Counter((k, *brute_url(u), brute_rule(*brute_url(u))[0]) for k, u, *_ in rows)
    for x in got:
        rule = brute_rule(x.host, x.path)[1]
        assert x.verdict == (rule or ("block" if x.block_score >= 0.5 else "allow")) and 0 <= x.block_score <= 1
    assert {x.verdict for x in got if x.host == "" and x.path == ""} == {"allow"}
    assert U.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES, model).count() == 0


def test_url_model_on_other_urls(spark, model):
    """Hosts that no labelled URL has."""
    held = U.labelled_urls(spark, HELD_OUT).selectExpr("monotonically_increasing_id() as page_id", "url", "label")
    got = U.url_filter(held, [], model).join(held, "page_id").collect()
    assert len(got) == 16 and sum((x.verdict == "block") == (x.label == 1) for x in got) >= 15


def test_url_filter_stays_in_the_jvm(spark, model, capsys):
    U.url_filter(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), RULES, model).explain()
    assert not re.search("Python|Pandas|Arrow|Exchange", capsys.readouterr().out)


def test_too_many_rules():
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="rules"):
        U.matched_rule(F.lit(""), F.lit(""), [U.Rule("allow", str(k)) for k in range(U.MOST_RULES + 1)])
