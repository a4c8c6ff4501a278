import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import linking as K

CONCEPTS = "canonical_id string, name string, concept_type string, parent_hint string, aliases array<string>"


def test_hints_prefer_names_then_other_types(spark):
    rows = [("p1", "Base", "law", None, None), ("p2", "x", "law", "", ["base"]), ("c1", "one", "law", " base ", None), ("c2", "two", "definition", "BASE", None), ("c3", "three", "law", "three", None), ("c4", "four", "law", "nowhere", [None])]
    got = {r.child: (r.parent, r.strategy) for r in K.hint_links(spark.createDataFrame(rows, CONCEPTS)).collect()}
    assert got == {"c1": ("p1", 2), "c2": ("p1", 1)}


def test_unordered_pairs_keep_the_last(spark):
    df = spark.createDataFrame([("b", "x", "y", 1, "no"), ("b", "y", "x", 2, "yes"), ("b", "x", "x", 3, "no"), ("b", None, "x", 4, "no")], "k string, l string, r string, t int, said string")
    assert [tuple(r) for r in K.unordered_pairs(df, "l", "r", ["k"], ["t"], ["said"]).collect()] == [("b", "x", "y", 2, "yes")]


def test_vector_health_equals_all_pairs(spark):
    r = np.random.default_rng(2)
    data = [([float(x) for x in r.normal(size=4)], i % 3) for i in range(30)]
    got = K.vector_health(spark.createDataFrame(data, "v array<float>, label int"), "v", "label").first()
    v = np.array([np.asarray(e, dtype=np.float32) for e, _ in data], dtype=float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s, lab = u @ u.T, np.array([x for _, x in data])
    same = (lab[:, None] == lab) & ~np.eye(30, dtype=bool)
    assert abs(got.intra - s[same].mean()) < 1e-6 and abs(got.inter - s[lab[:, None] != lab].mean()) < 1e-6


def test_budget_lines_and_quotes(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 1), ("b", 1, 99)], "p string, o int, n int")
    assert [(r.p, r.o) for r in K.within_budget(df, "p", F.col("o"), "n", 9).orderBy("p", "o").collect()] == [("a", 1), ("a", 2)]
    ch = spark.createDataFrame([("d", "1", "x\nx\nx\ny"), ("d", "2", "x\n\nz"), ("d", "3", None)], "d string, k string, t string")
    assert {tuple(r) for r in K.repeated_lines(ch, "d", "k", "t").collect()} == {("d", "1", 4, 0), ("d", "2", 1, 1)}
    q = spark.createDataFrame([("c", "Deep  NET"), ("c", "shallow"), ("c", "")], "chunk string, q string")
    c = spark.createDataFrame([("c", "a deep net here")], "chunk_id string, text string")
    assert [r.q for r in K.quotes(q, c, "chunk", "q").collect()] == ["Deep  NET"]


def test_overlay_closes_a_gap(spark):
    g = spark.createDataFrame([("a", "d", ["x", "y"], ["R1", "R2", "R3"])], "src string, dst string, missing array<string>, replacement array<string>")
    got = [(r.src, r.rel, r.dst) for r in K.overlay(g).collect()]
    assert got[0][0] == "a" and got[-1][2] == "d" and got[0][2] == got[1][0] and [x[1] for x in got] == ["R1", "R2", "R3"]
