"""Lexical and vector retrieval, fusion, re-ranking, diversity and metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.plans.lineage import cut
from corpusloom.plans.sizes import is_small

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Queries of a block, which every worker holds.
QUERY_BLOCK = 10_000


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the inverted index, map-side combined."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """(query, doc, score) of BM25 Okapi for all pairs that share a term.

    k1 = 1.5, b = 0.75; a negative idf becomes a quarter of the mean idf, as the Okapi
    variant has it. A repeated query term counts each time. Statistics cover all documents.
    Document frequencies are combined map-side from each document's distinct terms, and only
    occurrences of query terms are counted by document, so the whole index is never shuffled.
    Null and empty texts have no terms and only count as documents of length 0.
    """
    toks = docs.select(F.col(doc_key), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("toks"))
    whole = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("mean_len"))
    # the vocabulary is kept, as its mean idf and the query terms would both scan all documents for it
    df = cut(toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = df.crossJoin(F.broadcast(whole.select("n"))).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms = term_counts(queries, query_key, text).withColumnRenamed("tf", "times")
    few = is_small(terms)  # one idf a term, so what follows has no more rows
    asked = (F.broadcast(terms) if few else terms).join(idf, "term")
    words = toks.select(doc_key, F.size("toks").alias("len"), F.explode("toks").alias("term"))
    hit = words.join(F.broadcast(asked) if few else asked, "term").groupBy(query_key, doc_key, "term", "times", "idf", "len").agg(F.count(F.lit(1)).alias("tf"))
    size = 1 - B + B * F.col("len") / F.col("mean_len")
    gain = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * size)
    return hit.crossJoin(F.broadcast(whole.select("mean_len"))).groupBy(query_key, doc_key).agg(F.sum(gain).alias("score"))


def ranked(scores: DataFrame, query: str, key: str, k: int, score: str = "score", best_first: bool = True) -> DataFrame:
    """The best ``k`` of each query with their rank from 1; ties by key."""
    order = F.col(score).desc() if best_first else F.col(score).asc()
    w = Window.partitionBy(query).orderBy(order, F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score): cosine of every query with every vector, the query set in blocks.

    The queries are a stated set. Blocks of about ``QUERY_BLOCK`` of them are broadcast, and the
    vectors are read once for each block.
    """
    q = queries.select(F.col(query_key), F.col(vector).alias("qv"))
    n = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    for k in range(n):
        own = q if n == 1 else q.where(F.pmod(F.xxhash64(query_key), F.lit(n)) == k)
        s = vectors.select(key, vector).crossJoin(F.broadcast(own)).select(query_key, key, V.cosine(F.col(vector), F.col("qv")).alias("score"))
        out = s if out is None else out.unionByName(s)
    return out


def rrf(rankings: list[DataFrame], query: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the rankings."""
    every = rankings[0].select(query, key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(query, key, "rank"))
    return every.groupBy(query, key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def with_parent_context(hits: DataFrame, chunks: DataFrame, query: str = "query_id") -> DataFrame:
    """Add a parent's text to the first (best ranked) of its children in each query."""
    w = Window.partitionBy(query, "parent_id").orderBy("rank", "chunk_id")
    first = hits.withColumn("nth", F.when(F.col("parent_id").isNotNull(), F.row_number().over(w)))
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return first.join(parents, "parent_id", "left").withColumn("parent_text", F.when(F.col("nth") == 1, F.col("parent_text"))).drop("nth")


def mmr(candidates: DataFrame, query: str, key: str, k: int, weight: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance: (query, key, pick) of ``k`` picks for each query.

    ``candidates`` has score and embedding; the candidates of one query are a re-ranked list
    of bounded length (callers cut it first), so a query is one group. Similarity is the dot
    product. Ties go to the candidate listed first (by score, then key).
    """
    kinds = {c: t for c, t in candidates.dtypes}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.stack(pdf["embedding"].map(lambda e: np.asarray(e, dtype=float)))
        left, chosen = list(range(len(pdf))), []
        near = np.zeros(len(pdf))
        while left and len(chosen) < k:
            value = [weight * pdf["score"][i] - (1 - weight) * (near[i] if chosen else 0.0) for i in left]
            best = left[int(np.argmax(value))]
            chosen.append(best)
            left.remove(best)
            near = np.maximum(near, v @ v[best]) if len(chosen) > 1 else v @ v[best]
        return pd.DataFrame({query: pdf[query].iloc[chosen], key: pdf[key].iloc[chosen], "pick": range(1, len(chosen) + 1)})

    return candidates.select(query, key, "score", "embedding").groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {key} {kinds[key]}, pick int")


def rank_metrics(ranking: DataFrame, query: str, relevant: Column, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k and MRR over queries, by the rank of the first relevant result."""
    first = ranking.groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    hits = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in at]
    return first.agg(F.count(F.lit(1)).alias("n_queries"), *hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))

