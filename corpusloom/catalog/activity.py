"""Queries of caches, requests, messages and filters over activity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import learning as CL
from corpusloom.operators import activity as A
from corpusloom.operators import learning as L
from corpusloom.sources import store as S
from corpusloom.sources.tables import table


def cache_kept(spark: SparkSession, d: str) -> DataFrame:
    """A cache of users that holds 50 for a week: which stay, by last access (the bound is the feature)."""
    return A.cache_kept(table(spark, d, "events"), "user_id", 50, 7)


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a cache keyed by user and type: every access after the first."""
    return A.cache_stats(table(spark, d, "events"), ["user_id", "event_type"], "event_type")


def slow_by_type(spark: SparkSession, d: str) -> DataFrame:
    return A.slow_by(table(spark, d, "events"), "event_type")


def message_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a day's clicks, newest first (paging is the feature)."""
    e = table(spark, d, "events")
    return A.messages(e, topic="click", since="2024-01-03", until="2024-01-04", limit=20, offset=20).select("event_id", "ts", "user_id")


def question_page(spark: SparkSession, d: str) -> DataFrame:
    """Approved questions whose topic holds a word, newest first."""
    q = table(spark, d, "question_bank").groupBy("id").agg(F.max("topic").alias("topic"), F.max("is_approved").alias("is_approved"), F.max("created_at").alias("created_at"))
    x = q.where((F.col("is_approved") == 1) & F.lower("topic").contains("o"))
    return S.page(x, [F.col("created_at").desc_nulls_last(), F.col("id")], 50).select("id", "topic", "created_at")


def wrong_answer_page(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers not mastered yet, the most frequent first (paging is the feature)."""
    w = L.wrong_answers(CL._answers(spark, d)).where("not mastered")
    return S.page(w, [F.col("wrong_count").desc(), F.col("last_wrong").desc(), F.col("user_id"), F.col("question_id")], 50).select("user_id", "question_id", "wrong_count", "last_wrong")


def mastery_bars(spark: SparkSession, d: str) -> DataFrame:
    """Summary over the hundred best mastered concepts of each learner (the bars shown)."""
    m = F.round("mastery", 6)
    s = L.knowledge_state(CL._answers(spark, d)).withColumn("mastery", m)
    return A.bars(s, "user_id", "mastery", "concept_id", 100)


def subject_totals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    q = table(spark, d, "question_bank").groupBy("subject").agg(F.countDistinct("id").alias("questions"))
    z = F.lit(0).cast("bigint")
    return x.join(q, x["subject"].eqNullSafe(q["subject"]), "full_outer").select(F.coalesce(x["subject"], q["subject"], F.lit("")).alias("subject"), F.coalesce("documents", z).alias("documents"), F.coalesce("chars", z).alias("chars"), F.coalesce("questions", z).alias("questions"))


QUERIES = {f.__name__: f for f in (cache_kept, cache_stats, slow_by_type, message_page, question_page, wrong_answer_page, mastery_bars, subject_totals)}

SQL = {
    "cache_kept": "with u as (select user_id, max(ts) as last_access, count(*) as hits from events group by 1), n as (select max(ts) as now from events) select user_id, last_access, hits, row_number() over (order by last_access desc, user_id)::int as rank from u, n where last_access >= now - interval 7 day order by last_access desc, user_id limit 50",
    "cache_stats": "with k as (select user_id, event_type, count(*) as n from events group by 1, 2) select event_type, count(*) as entries, (sum(n) - count(*))::bigint as hits, round((sum(n) - count(*)) / sum(n), 6) as hit_rate from k group by 1",
    "slow_by_type": "with x as (select * from events order by ts desc, event_id desc limit 100) select event_type, count(*) as n, count_if(value > 50)::bigint as slow, round(avg(value), 6) as mean, round(max(value), 6) as most from x group by 1",
    "message_page": "select event_id, ts, user_id from events where event_type = 'click' and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-04' order by ts desc, event_id desc limit 20 offset 20",
    "question_page": "with q as (select id, max(topic) as topic, max(is_approved) as is_approved, max(created_at) as created_at from question_bank group by 1) select id, topic, created_at from q where is_approved = 1 and contains(lower(topic), 'o') order by created_at desc nulls last, id limit 50",
    "wrong_answer_page": f"select user_id, question_id, wrong_count, last_wrong from ({CL.SQL['wrong_answer_book']}) where not mastered order by wrong_count desc, last_wrong desc, user_id, question_id limit 50",
    "mastery_bars": f"with {CL._STATE}, m as (select user_id, concept_id, round(mastery, 6) as v from state), r as (select *, row_number() over (partition by user_id order by v desc, concept_id) as i from m) select user_id, count(*) as bars, round(avg(v), 6) as mean, count_if(v >= 0.7)::bigint as strong, count_if(v >= 0.4 and v < 0.7)::bigint as medium, count_if(v < 0.4)::bigint as weak from r where i <= 100 group by 1",
    "subject_totals": "with x as (select subject, count(*) as documents, sum(coalesce(n_chars, 0))::bigint as chars from documents group by 1), q as (select subject, count(distinct id) as questions from question_bank group by 1) select coalesce(x.subject, q.subject, '') as subject, coalesce(documents, 0) as documents, coalesce(chars, 0) as chars, coalesce(questions, 0) as questions from x full join q on x.subject is not distinct from q.subject",
}
