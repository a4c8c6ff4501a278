"""Learner ability, calibration, mastery and the reports built on them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions import irt
from corpusloom.plans.lineage import shared_folder


def _clip(p: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def rasch(answers: DataFrame, least: int = 50) -> DataFrame:
    """(question_id, n, b): difficulty from the share of right answers, from ``least`` on."""
    g = answers.where("question_id is not null").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("is_correct").cast("int"), F.lit(0))).alias("p"))
    return g.where(F.col("n") >= least).select("question_id", "n", F.round(-_logit(_clip(F.col("p"))), 2).alias("b"))


def two_pl(answers: DataFrame, least: int = 100) -> DataFrame:
    """(question_id, n, a, b): moments over answers ordered by the ability before them.

    Quarters and the lower half are cut by row number; records without an ability sort as 0.
    A question without any ability falls back to a = 1 and the Rasch difficulty.
    """
    x = answers.where("question_id is not null").select("question_id", "answer_id", "theta_before", F.coalesce(F.col("is_correct").cast("int"), F.lit(0)).alias("ok"))
    w = Window.partitionBy("question_id")
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    x = x.withColumn("i", F.row_number().over(w.orderBy(F.coalesce("theta_before", F.lit(0.0)), "answer_id")) - 1)
    q25, q75, mid = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4), F.floor(F.col("n") / 2)
    at = lambda q: F.max(F.when(F.col("i") == q, F.col("theta_before")))
    g = x.groupBy("question_id", "n").agg(
        F.avg(F.when(F.col("i") < q25, F.col("ok"))).alias("p25"), F.avg(F.when(F.col("i") >= q75, F.col("ok"))).alias("p75"), F.avg(F.when(F.col("i") <= mid, F.col("ok"))).alias("pm"),
        at(q25).alias("t25"), at(q75).alias("t75"), at(mid).alias("tm"), F.count("theta_before").alias("known"), F.avg("ok").alias("p"),
    )
    lo, hi, m = (_clip(F.coalesce(c, F.lit(0.0))) for c in ("p25", "p75", "pm"))
    gap = F.coalesce("t75", F.lit(0.0)) - F.coalesce("t25", F.lit(0.0))
    a = F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.when(F.abs(gap) > 0.1, (_logit(hi) - _logit(lo)) / gap).otherwise(1.0)))
    b = F.coalesce("tm", F.lit(0.0)) - _logit(m) / a
    none = F.col("known") == 0
    return g.select("question_id", "n", F.when(none, 1.0).otherwise(F.round(a, 2)).alias("a"), F.when(none, F.round(-_logit(_clip(F.col("p"))), 2)).otherwise(F.round(b, 2)).alias("b"))


#: Answers of one key that are folded as one array.
BLOCK = 500_000


def folded(answers: DataFrame, *keys: str, rounded: bool = False, block: int = BLOCK) -> DataFrame:
    """(keys, theta, n, correct, streak): ability folded over each key's answers in time order.

    Clipping makes the fold sequential. A key's answers are one sorted array of (time, id,
    correct) triples while there are ``block`` of them at most; keys with more are spread
    over range partitions and folded one partition after the other, with only the state
    passed on, so no task or array grows with the hottest key. ``streak`` grows with right
    answers and falls below zero with wrong ones; a null outcome counts as wrong.
    """
    rows = answers.select(*keys, "answered_at", "answer_id", F.coalesce(F.col("is_correct").cast("int"), F.lit(0)).alias("ok"))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    found = hot.collect()  # at most (all answers / block) keys
    if not found:
        return _fold_arrays(rows, keys, rounded)
    few = F.broadcast(answers.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], rows.select(*keys).schema))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    cold = rows.alias("r").join(few.alias("f"), same, "left_anti")
    parts = -(-sum(r.n for r in found) // block)
    spread = rows.alias("r").join(few.alias("f"), same, "left_semi").repartitionByRange(parts, *keys, "answered_at", "answer_id")
    # a folder for each partition, so that a step reads its own rows only
    folder = f"{shared_folder(answers.sparkSession)}/fold-{uuid.uuid4().hex}"
    spread.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(folder)
    spark = answers.sparkSession
    found_parts = sorted(int(p.rpartition("=")[2]) for p in _folders(spark, folder))
    state: dict[tuple, tuple[float, int, int, int]] = {}
    schema = T.StructType([*rows.select(*keys).schema.fields, *T._parse_datatype_string("theta double, n bigint, correct bigint, streak bigint").fields])
    for i in found_parts:
        before = dict(state)

        def run(batches: Iterator[pd.DataFrame], before: dict = before) -> Iterator[pd.DataFrame]:
            own: dict[tuple, tuple[float, int, int, int]] = {}
            for pdf in batches:
                for *key, ok in pdf[[*keys, "ok"]].itertuples(index=False, name=None):
                    k = tuple(key)
                    own[k] = _stepped(own.get(k, before.get(k, (0.0, 0, 0, 0))), ok, rounded)
            if own:
                yield pd.DataFrame([(*k, *v) for k, v in own.items()], columns=[f.name for f in schema.fields])

        own = spark.read.schema(rows.schema).parquet(f"{folder}/part={i}").coalesce(1).sortWithinPartitions(*keys, "answered_at", "answer_id")
        for r in own.mapInPandas(run, schema).collect():
            state[tuple(r[k] for k in keys)] = (r.theta, r.n, r.correct, r.streak)
    done = answers.sparkSession.createDataFrame([(*k, *v) for k, v in state.items()], schema)
    return _fold_arrays(cold, keys, rounded).unionByName(done)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of a partitioned table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory()]


def _stepped(s: tuple[float, int, int, int], ok: int, rounded: bool) -> tuple[float, int, int, int]:
    theta, n, correct, streak = s
    theta = max(irt.LOW, min(irt.HIGH, theta + irt.RATE * (ok - (irt.GUESS + (1 - irt.GUESS) / (1 + math.exp(-theta))))))
    streak = (streak + 1 if streak >= 0 else 1) if ok else (streak - 1 if streak <= 0 else -1)
    return round(theta, 2) if rounded else theta, n + 1, correct + ok, streak


def _fold_arrays(rows: DataFrame, keys: tuple[str, ...], rounded: bool) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("answered_at", "answer_id", "ok"))).alias("h"))
    theta = F.aggregate("h", F.lit(0.0), lambda t, x: irt.stepped(t, x["ok"], rounded))
    streak = F.aggregate("h", F.lit(0), lambda s, x: F.when(x["ok"] == 1, F.when(s >= 0, s + 1).otherwise(1)).otherwise(F.when(s <= 0, s - 1).otherwise(-1)))
    correct = F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + x["ok"])
    return g.select(*keys, theta.alias("theta"), F.size("h").cast("bigint").alias("n"), correct.alias("correct"), streak.cast("bigint").alias("streak"))


def knowledge_state(answers: DataFrame) -> DataFrame:
    """(user_id, subject_id, concept_id, theta, mastery, confidence, n, correct, streak)."""
    a = answers.withColumn("concept_id", F.explode("primary_concepts")).where("concept_id is not null")
    s = folded(a, "user_id", "subject_id", "concept_id")
    return s.withColumn("mastery", irt.mastery(F.col("theta"))).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10))


def propagate(state: DataFrame, answers: DataFrame, edges: DataFrame) -> DataFrame:
    """State after a batch spread along the graph: +0.05 mastery to prerequisites of concepts
    answered right (once each answer, up to 1), confidence x 0.9 for applications of those
    answered wrong. Concepts without a state are left out."""
    a = answers.select("user_id", "subject_id", F.coalesce("is_correct", F.lit(False)).alias("ok"), F.explode("primary_concepts").alias("c"))
    up = a.where("ok").join(edges.where("rel = 'DEPENDS_ON'").select(F.col("dst").alias("c"), F.col("src").alias("concept_id")), "c").groupBy("user_id", "subject_id", "concept_id").agg(F.count(F.lit(1)).alias("ups"))
    down = a.where("not ok").join(edges.where("rel = 'SOLUTION'").select(F.col("src").alias("c"), F.col("dst").alias("concept_id")), "c").groupBy("user_id", "subject_id", "concept_id").agg(F.count(F.lit(1)).alias("downs"))
    keys = ["user_id", "subject_id", "concept_id"]
    x = state.join(up, keys, "left").join(down, keys, "left")
    return x.withColumn("mastery", F.least(F.lit(1.0), F.col("mastery") + 0.05 * F.coalesce("ups", F.lit(0)))).withColumn("confidence", F.col("confidence") * F.pow(F.lit(0.9), F.coalesce("downs", F.lit(0)))).drop("ups", "downs")


def streak_islands(answers: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, correct, length, n): runs of equal outcomes by length, as gaps and islands."""
    w = Window.partitionBy(key).orderBy("answered_at", "answer_id")
    x = answers.select(key, "answered_at", "answer_id", F.coalesce(F.col("is_correct").cast("int"), F.lit(0)).alias("ok"))
    x = x.withColumn("isle", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "ok").orderBy("answered_at", "answer_id")))
    runs = x.groupBy(key, "ok", "isle").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy(key, F.col("ok").alias("correct"), "length").agg(F.count(F.lit(1)).alias("n"))


def profile(state: DataFrame) -> DataFrame:
    """One row a learner and subject: overall mastery, counts by band, five weakest concepts."""
    m = F.col("mastery")
    weak = F.array_sort(F.collect_list(F.when(m < 0.5, F.struct(F.round(m, 2).alias("m"), F.col("concept_id").alias("c")))))
    band = lambda lo, hi: F.count_if((m >= lo) & (m < hi))
    return state.groupBy("user_id", "subject_id").agg(F.round(F.avg("mastery"), 6).alias("overall"), F.count(F.lit(1)).alias("total"), F.count_if(m >= 0.7).alias("mastered"), band(0.8, 9).alias("excellent"), band(0.6, 0.8).alias("good"), band(0.4, 0.6).alias("fair"), band(-1, 0.4).alias("weak"), F.array_join(F.transform(F.slice(weak, 1, 5), lambda s: s["c"]), ",").alias("weakest"))


def progress(answers: DataFrame) -> DataFrame:
    """(user_id, points, first_half, second_half, trend) of the ability before each answer.

    The halves are cut at floor(n / 2); a trend needs three points and a change above 0.05.
    """
    x = answers.where("theta_before is not null")
    w = Window.partitionBy("user_id")
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("answered_at", "answer_id")))
    half = F.floor(F.col("n") / 2)
    g = x.groupBy("user_id", F.col("n").alias("points")).agg(F.round(F.avg(F.when(F.col("i") <= half, F.col("theta_before"))), 6).alias("first_half"), F.round(F.avg(F.when(F.col("i") > half, F.col("theta_before"))), 6).alias("second_half"))
    d = F.col("second_half") - F.col("first_half")
    return g.withColumn("trend", F.when((F.col("points") >= 3) & (d > 0.05), "up").when((F.col("points") >= 3) & (d < -0.05), "down").otherwise("flat"))


def wrong_answers(answers: DataFrame) -> DataFrame:
    """(user_id, question_id, wrong_count, first_wrong, last_wrong, mastered).

    ``mastered`` tells whether the last answer to the question was right.
    """
    last = F.max_by("is_correct", F.struct("answered_at", "answer_id"))
    g = answers.where("question_id is not null and is_correct is not null").groupBy("user_id", "question_id").agg(F.count_if(~F.col("is_correct")).alias("wrong_count"), F.min(F.when(~F.col("is_correct"), F.col("answered_at"))).alias("first_wrong"), F.max(F.when(~F.col("is_correct"), F.col("answered_at"))).alias("last_wrong"), last.alias("mastered"))
    return g.where("wrong_count > 0")


def recommendations(answers: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` concepts of a learner with most wrong answers, and a mastery guess
    of max(0, 1 - 0.3 * wrong / questions)."""
    a = answers.where("is_correct = false and question_id is not null").select("user_id", "question_id", F.explode("primary_concepts").alias("concept_id"))
    g = a.groupBy("user_id", "concept_id").agg(F.count(F.lit(1)).alias("wrong"), F.countDistinct("question_id").alias("questions"))
    g = g.withColumn("mastery", F.round(F.greatest(F.lit(0.0), 1 - 0.3 * F.col("wrong") / F.col("questions")), 6))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("wrong").desc(), "concept_id"))
    return g.withColumn("rank", rank).where(F.col("rank") <= k)
