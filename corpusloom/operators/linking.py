"""Linking concepts by hints, cleaning pairs, assembling contexts and quality measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hint_links(concepts: DataFrame) -> DataFrame:
    """(parent, child, strategy): the concept that a concept's parent hint names.

    ``concepts`` has canonical_id, name, concept_type, parent_hint and aliases. Names come
    before aliases, another type before the same one; within a strategy the smallest id. A
    concept is never its own parent.
    """
    c = concepts.select("canonical_id", "concept_type", F.lower(F.trim("parent_hint")).alias("hint")).where("hint <> ''")
    names = concepts.select(F.col("canonical_id").alias("parent"), F.col("concept_type").alias("parent_type"), F.lower(F.trim("name")).alias("hint"), F.lit(0).alias("via"))
    alias = concepts.select(F.col("canonical_id").alias("parent"), F.col("concept_type").alias("parent_type"), F.explode("aliases").alias("a")).select("parent", "parent_type", F.lower(F.trim("a")).alias("hint"), F.lit(1).alias("via"))
    hit = c.join(names.unionByName(alias).where("hint <> ''").distinct(), "hint").where("parent <> canonical_id")
    rank = F.col("via") * 2 + (F.col("parent_type") == F.col("concept_type")).cast("int")
    best = hit.groupBy("canonical_id").agg(F.min(F.struct(rank.alias("strategy"), "parent")).alias("m"))
    return best.select(F.col("m.parent").alias("parent"), F.col("canonical_id").alias("child"), (F.col("m.strategy") + 1).alias("strategy"))


def unordered_pairs(pairs: DataFrame, left: str, right: str, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row for each pair in either order: how often it came, and its last row's columns."""
    x = pairs.where(f"{left} <> '' and {right} <> '' and {left} <> {right}")
    a, b = F.least(left, right).alias("a"), F.greatest(left, right).alias("b")
    last = F.max_by(F.struct(*keep), F.struct(*order))
    return x.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"), last.alias("s")).select(*keys, "a", "b", "n", "s.*")


def within_budget(items: DataFrame, part: str, first: Column, tokens: str, budget: int) -> DataFrame:
    """Items of a part in the order of ``first`` while their running sum keeps the budget."""
    w = Window.partitionBy(part).orderBy(first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def repeated_lines(chunks: DataFrame, part: str, key: str, text: str, most: int = 3) -> DataFrame:
    """(part, key, kept, dropped): lines that stay when each may occur ``most`` times a part."""
    lines = chunks.select(part, key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where("trim(line) <> ''")
    nth = F.row_number().over(Window.partitionBy(part, "line").orderBy(key, "pos"))
    return lines.withColumn("nth", nth).groupBy(part, key).agg(F.count_if(F.col("nth") <= most).alias("kept"), F.count_if(F.col("nth") > most).alias("dropped"))


def carried_forward(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Rows with the last known ``value`` of their part."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def vector_health(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean and deviation of norms, zero share, mean likeness within and between labels.

    The means over pairs come from sums of vectors, (|sum|^2 - sum of squares) / pairs, so
    no pair is formed; vectors are normalised first.
    """
    e = F.transform(vector, lambda x: x.cast("double"))
    v = vectors.select(F.col(label).alias("label"), e.alias("e")).withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    base = v.agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"), F.avg((F.col("norm") == 0).cast("int")).alias("zero_share"))
    unit = v.where("norm > 0").select("label", F.posexplode(F.transform("e", lambda x: x / F.col("norm"))).alias("i", "x"))
    per = unit.groupBy("label", "i").agg(F.sum("x").alias("s"))
    sizes = v.where("norm > 0").groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    inside = per.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(sizes, "label").agg(F.sum(F.col("ss") - F.col("m")).alias("in_dot"), F.sum(F.col("m") * (F.col("m") - 1)).alias("in_pairs"), F.sum("m").alias("k"))
    whole = per.groupBy("i").agg(F.sum("s").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("all_dot"))
    x = base.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(whole))
    between = (F.col("all_dot") - F.col("k") - F.col("in_dot")) / (F.col("k") * (F.col("k") - 1) - F.col("in_pairs"))
    return x.select("n", F.round("mean_norm", 6).alias("mean_norm"), F.round("std_norm", 6).alias("std_norm"), F.round("zero_share", 6).alias("zero_share"), F.round(F.col("in_dot") / F.col("in_pairs"), 6).alias("intra"), F.round(between, 6).alias("inter"))


def explained_variance(vectors: DataFrame, vector: str, most: int) -> DataFrame:
    """(axis, share): how much of the variance the largest principal axes explain.

    Each partition adds its vectors up to one matrix of sums of products, and the matrices
    are summed by entry; only one, of the vectors' dimension, comes to the driver. Null
    vectors don't count; fewer than two give no row.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), dtype=float)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    v = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    got = v.mapInArrow(summed, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    schema = "axis int, share double"
    d = max((r.i for r in got), default=0)
    m = np.zeros((d + 1, d + 1))
    for r in got:
        m[r.i, r.j] = r.s
    if m[0, 0] < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    mean = m[0, 1:] / m[0, 0]
    values = np.linalg.eigvalsh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[::-1].clip(0)
    share = values / max(values.sum(), 1e-300)
    return vectors.sparkSession.createDataFrame([(k + 1, round(float(x), 6)) for k, x in enumerate(share[:most])], schema)


def sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows by the MD5 of key and seed: the same on any partitioning."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).limit(n)


def quotes(rows: DataFrame, chunks: DataFrame, chunk: str, quote: str) -> DataFrame:
    """Rows whose quote stands in the chunk they cite, white space aside."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    c = chunks.select(F.col("chunk_id").alias(chunk), F.col("text").alias("_text"))
    return rows.join(c, chunk).where(F.contains(flat(F.col("_text")), flat(F.col(quote))) & (flat(F.col(quote)) != "")).drop("_text")


def extraction_coverage(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(chunk_id, n, score): 1 less 0.15 for each concept off the number a text's length expects."""
    n = concepts.groupBy("chunk_id").agg(F.countDistinct("concept_id").alias("n"))
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    want = F.when(size <= 500, 3).when(size <= 1500, 5).otherwise(7)
    x = chunks.join(n, "chunk_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return x.select("chunk_id", "n", F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("n") - want) * 0.15), 6).alias("score"))


def overlay(gaps: DataFrame) -> DataFrame:
    """(src, dst, rel, virtual): the chain of placeholder edges that would close each gap.

    ``gaps`` has src, dst, missing and replacement, as gap detection gives them.
    """
    key = F.concat_ws("|", "src", "dst")
    stops = F.concat(F.array("src"), F.transform("missing", lambda m: F.concat(F.lit("__virtual_"), key, F.lit("#"), m)), F.array("dst"))
    x = gaps.select(F.col("replacement"), stops.alias("stops")).select("stops", F.posexplode("replacement").alias("i", "rel"))
    return x.select(F.element_at("stops", F.col("i") + 1).alias("src"), F.element_at("stops", F.col("i") + 2).alias("dst"), "rel")
