import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.catalog import concepts as CC
from corpusloom.catalog import review as CR
from corpusloom.operators import gaps as GP
from corpusloom.operators import likeness as N
from corpusloom.operators import linker as K


def _made(spark, n=120):
    r = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    rows = [(f"k{i:03}", r.choice(["x", "y", None]), " ".join(r.choice(words) for _ in range(r.randrange(0, 7)))) for i in range(n)] + [("n", "x", None), ("e", "x", " "), ("é", "x", "w1 w2 w3"), ("z", "x", "w3 W1\tw2")]
    return spark.createDataFrame(rows, "k string, g string, t string")


def _brute(rows, least, within=None):
    held, of = {}, {r.k: r.g for r in rows.collect()}
    for x in K.word_vectors(rows, "k", F.col("t")).collect():
        held.setdefault(x.k, {})[x.slot] = x.w
    every = {(a, b): round(sum(w * held[b].get(s, 0) for s, w in held[a].items()), 6) for a in held for b in held if a.encode() < b.encode()}
    return {p: s for p, s in every.items() if s >= least and (within is None or of[p[0]] is not None and of[p[0]] == of[p[1]])}


def test_likeness_equals_brute_force_in_blocks_and_groups(spark, monkeypatch):
    rows = _made(spark)
    for block, whole in ((16_384, 12), (7, 12), (7, 1000)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "WHOLE", whole)
        for least, within in ((0.72, None), (0.95, "g"), (0.6, "g")):
            got = N.alike(N.word_rows(rows, F.col("t")).drop("t"), "k", least, within).collect()
            assert {(x.a.k, x.b.k): x.score for x in got} == _brute(rows, least, within)
            assert len(got) == len({(x.a.k, x.b.k) for x in got}) and (within is None or all(x.a.g == x.b.g for x in got))
    assert N.alike(N.word_rows(rows.limit(0), F.col("t")).drop("t"), "k", 0.72).count() == 0


def test_words_are_hashed_as_the_column_does(spark):
    rows = _made(spark, 20)
    want = {(x.k, x.slot): x.w for x in K.word_vectors(rows, "k", F.col("t")).collect()}
    got = {}
    for x in N.word_rows(rows, F.col("t")).collect():
        got |= {(x.k, int(s)): float(w) for s, w in zip(np.frombuffer(x.s, "<u2"), np.frombuffer(x.w, "<f8"), strict=True)}
    assert got == want


def test_no_pair_is_moved_to_be_scored(spark):
    """Pairs that met in a slot were joined, made distinct and joined with both vectors."""
    v = K.word_vectors(_made(spark), "k", F.col("t"))
    plan = K.alike(v, "k", 0.72)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_cache_compares_within_a_subject_only(spark, tmp_path, monkeypatch):
    words = " ".join(f"w{i}" for i in range(30))
    at = lambda d: f"2024-01-0{d} 00:00:00"
    rows = [("q1", "x", words, at(3)), ("q2", "x", words.upper(), at(2)), ("q3", "x", words.replace("w7 ", "v7 "), at(1)), ("q4", "y", words, at(4)), ("q5", None, words, at(1)), ("q6", "x", "", at(1)), ("q7", "x", "other words here", None)]
    spark.createDataFrame(rows, "id string, subject string, question string, t string").selectExpr("id", "subject", "question", "timestamp(t) as created_at").write.parquet(f"{tmp_path}/question_bank.parquet")
    within, run = [], N.alike
    monkeypatch.setattr(N, "alike", lambda v, key, least, group=None: within.append(group) or run(v, key, least, group))
    got = {(r.id, r.hit, r.how) for r in CR.question_cache(spark, str(tmp_path)).collect()}
    assert got == {("q1", "q2", "exact"), ("q2", "q3", "near")} and within == ["subject"]


def test_links_alike_skip_edges_and_move_no_pairs(spark):
    (first, second), rel = next((k, r) for k, r in GP.THEORY.relations.items() if k[0] != k[1])
    nodes = spark.createDataFrame([("a", "one two three four", first), ("b", "one two three five", second), ("c", "one two three six", second), ("d", "one two three six", None), ("e", None, first)], "node string, name string, type string")
    edges = spark.createDataFrame([("a", "c"), ("b", "zz"), ("a", "c")], "src string, dst string")
    df = K.likeness_links(nodes, edges, GP.THEORY, 0.72)
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.parent, r.child): r.rel for r in df.collect()}
    assert got[("a", "b")] == rel and ("a", "c") not in got and not {x for p in got for x in p} & {"d", "e"}


def test_ladder_runs_where_pairs_alike_are_found(spark, tmp_path):
    names = ["red green blue cat", "red green blue dog", "red green blue", "blue", "x y", "y x"]
    spark.createDataFrame([(n, ["y x"] if n == "x y" else [], "t", "", "", ["s"]) for n in names], "name string, aliases array<string>, concept_type string, description string, parent_hint string, source_chunks array<string>").write.parquet(f"{tmp_path}/canonical_concepts.parquet")
    df = CC.pair_classify_likeness(spark, str(tmp_path))
    got = sorted((r.left, r.right, r.relation, r.confidence) for r in df.collect())
    assert [x[:3] for x in got if "cat" in x[0] + x[1]] == [("blue", "red green blue cat", "NARROWER_THAN"), ("red green blue", "red green blue cat", "NARROWER_THAN"), ("red green blue cat", "red green blue dog", "RELATED_TO")]
    assert [x[3] for x in got if {x[0], x[1]} == {"x y", "y x"}] == [0.99] and len(got) == len({x[:2] for x in got})
    # candidates aren't joined with all pairs alike, which are classified where they are found
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any("SortMergeJoin" in x and "LeftOuter" in x for x in plan.splitlines())
