import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import linking as K
from corpusloom.operators import review as R


def test_aliases(spark):
    df = spark.createDataFrame([("RAG", ["rag", " R-A-G 2", "rag2", None, "", "x" * 130]), ("n", None), (None, ["a"])], "name string, al array<string>")
    got = [r.x for r in df.select(R.cleaned_aliases(F.col("al"), F.col("name")).alias("x")).collect()]
    assert got == [["R-A-G 2", "x" * 120], [], ["a"]]
    c = spark.createDataFrame([("RAG", "RAG (retrieval augmented), 检索增强 (RAG) and BM25 (a ranking)"), ("BM25", "no brackets"), ("RAG", None)], "name string, description string")
    assert {(r.name, r.alias) for r in R.inferred_aliases(c).collect()} == {("RAG", "retrieval augmented"), ("RAG", "检索增强")}


def test_best_pairs(spark):
    rows = [("A b", "C", "R1", 0.5, ["s1"]), ("c", "ab", "R2", 0.7, ["s2", "s1"]), ("x", "X ", "R", 1.0, None), ("x", None, "R", 1.0, None), ("p", "q", None, None, None)]
    df = spark.createDataFrame(rows, "left string, right string, relation string, confidence double, signals array<string>")
    assert {(r.left, r.right, r.relation, r.confidence, r.n, tuple(r.signals)) for r in R.best_pairs(df).collect()} == {("c", "ab", "R2", 0.7, 2, ("s1", "s2")), ("p", "q", None, 0.0, 1, ())}


def test_chosen_names(spark):
    rows = [("a", "b", "b"), ("b", "c", "c"), ("d", "e", "zz"), ("f", "g", None), ("h", "h", "h"), ("", "x", "x")]
    got = {r.member: r.name for r in R.chosen_names(spark.createDataFrame(rows, "left string, right string, chosen string")).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "d", "f": "f", "g": "f"}


def test_checked_advice(spark):
    rows = [("a", "b", "merge", 0.95, "a", True, True), ("a", "b", "MERGE", 0.95, "z", True, True), ("a", "b", "MERGE", 0.95, "b", False, True), ("a", "b", "MERGE", 0.5, "b", True, False), ("a", "b", "what", 7.0, "b", True, True), ("a", "b", "separate", -1.0, "b", None, None), ("a", "b", None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, left string, right string, decision string, confidence double, canonical_name string, proven boolean, same_type boolean")
    got = [(r.decision, r.confidence, r.canonical_name) for r in R.checked_advice(df).orderBy("i").collect()]
    assert got == [("MERGE", 0.95, "a"), ("UNCERTAIN", 0.49, ""), ("MERGE", 0.89, "b"), ("MERGE", 0.5, "b"), ("UNCERTAIN", 1.0, ""), ("SEPARATE", 0.0, ""), ("UNCERTAIN", 0.0, "")]


def test_gate_and_nodes(spark):
    c = spark.createDataFrame([("b", "1", "merge"), ("b", "1", None), ("b", "2", " "), ("d", "3", "separate")], "part string, key string, decision string")
    assert {tuple(r) for r in R.gate(c, "part", "key").collect()} == {("b", 2, 1, 1, False), ("d", 1, 1, 0, True)}
    p = spark.createDataFrame([("7",), ("[3, 4]",), (" 12 ",), ("x",), ("[]",), (None,)], "t string")
    assert [r.n for r in p.select(R.page_number(F.col("t")).alias("n")).collect()] == [7, 3, 12, None, None, None]
    m = spark.createDataFrame([("k", "Name", 2), ("k", "name ", 1), ("k", "", 0), (None, "x", 1), ("l", "Name", 5)], "chunk string, name string, pos int")
    assert {tuple(r) for r in R.mention_nodes(m, "chunk", "name", "pos").collect()} == {("k", "name ", 1), ("l", "Name", 5)}


def test_explained_variance(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) * [5, 3, 1, 1, 0.5, 0.1] + 4
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "e array<double>").repartition(3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = [r.share for r in K.explained_variance(df, "e", 3).orderBy("axis").collect()]
    assert np.allclose(got, (values / values.sum())[:3], atol=1e-5)
    assert K.explained_variance(df.limit(0), "e", 3).count() == 0
