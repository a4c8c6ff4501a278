import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval as R


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first().x


def test_tokens_and_claims(spark):
    assert one(spark, T.tokens(F.col("t")), "RAG 2 检索增强, ok") == ["rag", "2", "ok", "检索", "索增", "增强"]
    assert one(spark, T.keywords(F.col("t")), "请 介绍一下 Vector 数据库 a") == ["Vector", "数据库"]
    assert one(spark, T.claims(F.col("t")), "The value is 42 here。is it true or not?\n请注意这一点很重要的。short") == ["The value is 42 here"]
    assert one(spark, T.plain_text(F.col("t")), "<p>a &amp; b</p>\n c") == "a & b c"
    assert one(spark, T.intent(F.col("t")), "Give me a question about X") == "quiz" and one(spark, T.intent(F.col("t")), None) == "concept"
    assert one(spark, T.query_variants(F.col("t")), "rag 优化") == ["rag 优化", "检索增强生成 优化", "rag 优化 原理"]
    assert one(spark, T.string_list(F.col("t")), '["a", "b"]') == ["a", "b"] and one(spark, T.string_list(F.col("t")), "a; b，c") == ["a", "b", "c"] and one(spark, T.string_list(F.col("t")), None) == []
    assert one(spark, T.page_type(F.col("t")), "x" * 60 + "|" * 11) == "table" and one(spark, T.page_type(F.col("t")), None) == "scan"


def test_bm25_equals_the_formula(spark):
    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry date"), (4, None), (5, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, term string")
    q = spark.createDataFrame([(9, "apple cherry cherry")], "query_id int, text string")
    got = {r.doc_id: r.score for r in R.bm25_scores(df, q).collect()}
    toks = {i: (t or "").split() for i, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    vocab = {w for t in toks.values() for w in t}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in vocab for k in [sum(w in t for t in toks.values())]}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, s in got.items():
        want = sum(idf[w] * toks[i].count(w) * 2.5 / (toks[i].count(w) + 1.5 * (0.25 + 0.75 * len(toks[i]) / mean)) for w in ("apple", "cherry", "cherry"))
        assert s == pytest.approx(want)
    assert set(got) == {1, 2, 3}


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, d string, rank int")
    got = {r.d: r.score for r in R.rrf([a, b], "q", "d").collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)
    m = R.rank_metrics(a, "q", F.col("d") == "y").first()
    assert (m.hit_1, m.hit_3, m.mrr) == (0.0, 1.0, 0.5)


def test_cosine_and_mmr(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    c = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "q int, v int, score double, embedding array<double>")
    assert [r.v for r in R.mmr(c, "q", "v", 2).orderBy("pick").collect()] == [1, 3]


def test_parent_text_goes_to_the_first_child_only(spark):
    chunks = spark.createDataFrame([("p", None, "parent"), ("a", "p", "x"), ("b", "p", "y")], "chunk_id string, parent_id string, text string")
    hits = spark.createDataFrame([(1, 1, "a", "p"), (1, 2, "b", "p"), (1, 3, "c", None)], "query_id int, rank int, chunk_id string, parent_id string")
    assert {r.chunk_id: r.parent_text for r in R.with_parent_context(hits, chunks).collect()} == {"a": "parent", "b": None, "c": None}


def test_hashed_words_fit_two_engines(spark):
    import hashlib

    got = one(spark, T.hashed_words(F.col("t")), "Deep  learning")
    want = [int(hashlib.md5(w.encode()).hexdigest(), 16) % 2048 for w in ("deep", "learning")]
    assert [h.slot for h in got[:2]] == want and [h.weight for h in got] == [1.0, 1.0, 0.5, 0.5]
