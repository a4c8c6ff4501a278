import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusloom.operators import evidence as V


def test_abstracts_and_ids(spark):
    df = spark.createDataFrame([({"deep": [0, 2], "nets": [1]}, " https://doi.org/10.1/AB ", "ftp://x"), (None, "a b", "HTTP://y")], "i map<string,array<int>>, d string, u string")
    got = df.select(V.abstract_of(F.col("i")).alias("a"), V.doi(F.col("d")).alias("d"), V.public_url(F.col("u")).alias("u"), V.record_id(F.lit("p"), F.lit(""), F.lit("Title")).alias("r")).collect()
    assert [(r.a, r.d, r.u) for r in got] == [("deep nets deep", "10.1/ab", ""), ("", "", "HTTP://y")]
    assert got[0].r.startswith("academic_p_") and len(got[0].r) == 31


def test_records_merge_by_doi_then_address_then_title(spark):
    rows = [(1, "10.1/A", "u1", "T", None), (2, "https://doi.org/10.1/a", "", "", 2020), (3, "", "u3", "X", 1), (4, None, "U3", "Y", 2), (5, "", "", " t ", 9), (6, None, None, None, 1)]
    df = spark.createDataFrame(rows, "o int, doi string, url string, title string, year int")
    got = {r.record: (r.n, r.title, r.year) for r in V.merged_records(df, ["title", "year"], "o").collect()}
    assert got == {"doi:10.1/a": (2, "T", 2020), "url:u3": (2, "X", 1), "title:t": (1, " t ", 9)}


def test_agreement(spark):
    rows = [("c", 1, "A"), ("c", 1, "b"), ("c", 2, "a"), ("c", 3, "z"), ("d", 1, "q"), ("d", 1, ""), ("d", 1, None)]
    df = spark.createDataFrame(rows, "part string, s int, n string")
    got = V.stability(df, "part", "s", "n").collect()
    assert [(r.part, r.pairs, round(r.stability, 4)) for r in got] == [("c", 3, round(0.5 / 3, 4))]
    assert {(r.part, r.s) for r in V.best_sample(df, "part", "s", "n").collect()} == {("c", 1), ("d", 1)}


def test_votes_and_titles(spark):
    d = spark.createDataFrame([(1, "tidal waves and tidal locks"), (2, None)], "k int, t string")
    w = spark.createDataFrame([("sea", "tidal"), ("lock", "locks"), ("sea", "tidal")], "topic string, word string")
    assert [tuple(r) for r in V.keyword_votes(d, w, "k", "t").collect()] == [(1, "sea", 2)]
    t = spark.createDataFrame([("a", "x", "graph neural network"), ("b", "x", "graph neural networks"), ("c", "y", "graph neural network"), ("d", "x", None), ("e", "x", "other thing")], "k string, kind string, t string")
    assert {(r.k, r.other) for r in V.near_titles(t, "k", "kind", "t").collect()} == {("a", "b"), ("b", "a")}


def test_near_titles_equal_brute_force(spark):
    r = random.Random(5)
    made = ["weak hollow turbine schedule", "wеаk hоllоw turbinе schеdulе", "tokenizer", "tokeniser", "tok\u200benizer", "a", "a", "", "  ", "colour of flavour", "color of flavor", "图神经网络模型", "图神经网路模型", "ab" * 90, "ab" * 70 + "c"]
    for _ in range(120):
        x = "".join(r.choice("abcde ") for _ in range(r.randrange(3, 90)))
        y = list(x)
        for _ in range(r.randrange(0, len(x) // 3 + 1)):
            y[r.randrange(len(y))] = r.choice(["", "x", "yz"])
        made += [x, "".join(y)]
    rows = [(n, "k" if n % 7 else "j", x) for n, x in enumerate(made)] + [(900, "k", None), (901, None, "a"), (0, "k", "weak hollow")]
    clean = [(k, kind, x.strip(" ").lower()) for k, kind, x in rows if x and kind and x.strip(" ")]
    want = {}
    for k, kind, x in clean:
        for o, other, y in clean:
            if k != o and kind == other and (s := round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6)) >= 0.78:
                want[k, o] = max(s, want.get((k, o), 0))
    df = spark.createDataFrame(rows, "k bigint, kind string, t string")
    for block in (1000, 20):
        got = {(x.k, x.other): x.ratio for x in V.near_titles(df, "k", "kind", "t", most=1000, block=block).collect()}
        assert got == want
    assert len(want) > 50
    top = {(x.k, x.other) for x in V.near_titles(df, "k", "kind", "t").collect()}
    assert top == {p for p in want if sum(a == p[0] and (-s, o) < (-want[p], p[1]) for (a, o), s in want.items()) < 3}


def test_natural_paths(spark):
    g = spark.createDataFrame([("d", "a", ["law"]), ("d", "e", ["law", "application"]), ("x", "a", ["law"])], "src string, dst string, missing array<string>")
    e = spark.createDataFrame([("d", "l"), ("l", "a"), ("d", "a"), ("x", "o"), ("o", "a")], "src string, dst string")
    t = spark.createDataFrame([("l", "law"), ("o", "other")], "node string, type string")
    assert {tuple(r) for r in V.natural_paths(g, e, t).collect()} == {("d", "a", True), ("x", "a", False)}
