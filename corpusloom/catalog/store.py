"""Queries over stored tables, activity and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import activity as A
from corpusloom.operators import documents as D
from corpusloom.sources import store as S
from corpusloom.sources.tables import table


def scan_filter_sql(spark: SparkSession, d: str) -> DataFrame:
    """!= in SQL drops rows without a subject."""
    x = S.where_sql(table(spark, d, "documents"), doc_type="lecture_note", subject=("$ne", "generic"))
    return x.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def scan_filter_matcher(spark: SparkSession, d: str) -> DataFrame:
    """!= of the matcher keeps them."""
    x = S.where_matching(table(spark, d, "documents"), doc_type="lecture_note", subject=("$ne", "generic"))
    return x.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def scan_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of documents by id: the third of fifty (paging is the feature)."""
    return S.page(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 50, 100)


def lookup_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every concept in the order of its list."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", "source_chunks").distinct()
    k = table(spark, d, "chunks").select("chunk_id", "chunk_type").distinct()
    return S.lookup(k, "chunk_id", c, "source_chunks", ["canonical_id"])


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The stored state of chunks: the last delivery of each id."""
    k = table(spark, d, "chunks").select("chunk_id", "source", "chunk_type", "ingested_at")
    return S.upsert(k.limit(0), k, ["chunk_id"], ["ingested_at"])


def replaced_source(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of sources that a later delivery brings again are replaced."""
    k = table(spark, d, "chunks").select("chunk_id", "source", "document_name", "chunk_type", "ingested_at")
    late = "ingested_at >= timestamp_ntz'2025-06-01 00:00:00'"
    out = S.replace_source(k.where(f"not ({late})"), k.where(late), F.coalesce("source", "document_name"), ["paragraph"])
    return out.groupBy("source", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.min("ingested_at").alias("first"))


def deleted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no concept refers to, by type."""
    c = table(spark, d, "canonical_concepts").select(F.explode("source_chunks").alias("chunk_id"))
    return S.delete(table(spark, d, "chunks").select("chunk_id", "chunk_type").distinct(), "chunk_id", c).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


def retained_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("now"))
    x = S.retain(e.crossJoin(F.broadcast(last)), "ts", 7, F.col("now"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def dialog_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk to concept, distinct pairs, by chunk type: how many concepts and chunks."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", F.explode("source_chunks").alias("chunk_id")).distinct()
    k = table(spark, d, "chunks").select("chunk_id", "chunk_type").distinct()
    return c.join(k, "chunk_id").groupBy("chunk_type").agg(F.countDistinct("canonical_id").alias("concepts"), F.countDistinct("chunk_id").alias("chunks"))


def media_of_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Media of a concept's chunks, one of each type and path."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", F.explode("source_chunks").alias("chunk_id")).distinct()
    m = table(spark, d, "chunks").select("chunk_id", F.explode("media_refs").alias("m"))
    return c.join(m, "chunk_id").select("canonical_id", F.coalesce("m.type", F.lit("")).alias("type"), F.coalesce("m.path", F.lit("")).alias("path")).distinct()


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return A.usage(table(spark, d, "events"), F.to_date("ts"), "day")


def usage_monthly(spark: SparkSession, d: str) -> DataFrame:
    return A.usage(table(spark, d, "events"), F.date_format("ts", "yyyy-MM"), "month")


def usage_model(spark: SparkSession, d: str) -> DataFrame:
    return A.usage(table(spark, d, "events"), F.col("event_type"), "model")


def monitor_stage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("stage", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def slow_requests(spark: SparkSession, d: str) -> DataFrame:
    return A.slow(table(spark, d, "events"))


def dialog_last_n(spark: SparkSession, d: str) -> DataFrame:
    return A.last_n(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", 5).select("user_id", "pos", "event_id", "event_type")


def dialog_sessions(spark: SparkSession, d: str) -> DataFrame:
    return A.sessions(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id")


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_counters(table(spark, d, "events"), "user_id", "event_type")


def bus_topic_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every user subscribes to the type of their first event."""
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("user_id").alias("sender"), "ts", "event_id")
    s = e.groupBy(F.col("sender").alias("subscriber")).agg(F.min_by("topic", F.struct("ts", "event_id")).alias("topic"))
    return A.deliveries(e, s)


def linkage_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Concept sets of neighbouring chunks of a document."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", F.explode("source_chunks").alias("chunk_id")).distinct()
    k = table(spark, d, "chunks").select("chunk_id", "document_name").dropDuplicates(["chunk_id"])
    sets = k.join(c, "chunk_id", "left").groupBy("document_name", "chunk_id").agg(F.collect_set("canonical_id").alias("ids"))
    return A.adjacent_jaccard(sets, "chunk_id", "ids", "chunk_id", "document_name")


def concept_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of concept types by the chunk's document."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", "concept_type", F.explode("source_chunks").alias("chunk_id")).distinct()
    k = table(spark, d, "chunks").select("chunk_id", "document_name").distinct()
    return A.entropy(c.join(k, "chunk_id"), "document_name", "concept_type")


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.generate(table(spark, d, "documents"), "doc_id", "text", D.fixed_windows, "start bigint, end bigint, piece string")


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    x = D.generate(table(spark, d, "documents"), "doc_id", "text", D.page_sections, "kind string, level int, heading_path string, content string")
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.generate(table(spark, d, "documents"), "doc_id", "text", D.merged_sections, "kind string, heading_path string, content string")


def header_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.generate(table(spark, d, "documents"), "doc_id", "text", D.header_sections, "level int, title string, content string")


def md_tree_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.generate(table(spark, d, "documents"), "doc_id", "text", D.tree_chunks, "chunk_id string, chunk_type string, level int, heading_path string, parent_id string, content string")


QUERIES = {
    f.__name__: f
    for f in (
        scan_filter_sql, scan_filter_matcher, scan_page, lookup_ordered, latest_chunks, replaced_source, deleted_chunks, retained_events, dialog_concepts, media_of_concepts, usage_daily, usage_monthly, usage_model, monitor_stage,
        slow_requests, dialog_last_n, dialog_sessions, topic_counts, bus_topic_stats, linkage_jaccard, concept_diversity, fixed_chunks, page_sections, merged_chunks, header_chunks, md_tree_chunks,
    )
}

_USE = "select {k}, count(*) as n, round(coalesce(sum(value), 0), 4) as total, round(avg(value), 6) as mean, count_if(value > 50)::bigint as large from events group by 1"

_END = "regexp_extract(substr(text, s + 751, 750), '(?s)^(.*)' || {p}, 1)"
_SEPS = (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'。'", 1), ("'．'", 1), ("'[.] '", 2), ("'[?] '", 2), ("'! '", 2), ("'；'", 1), ("';'", 1))
_CUT = "case " + " ".join(f"when regexp_matches(substr(text, s + 751, 750), '(?s)' || {p}) then s + 750 + length({_END.format(p=p)}) + {n}" for p, n in _SEPS) + " else s + 1500 end"
_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

SQL = {
    "fixed_chunks": f"""with recursive d as (select doc_id, text, length(text) as n from documents where text <> ''), w as (
            select doc_id, text, n, 0::bigint as s, (case when n <= 1500 then n else (select {_CUT} from (select d.text as text, 0 as s)) end)::bigint as e from d
            union all select doc_id, text, n, e - 200, (case when e - 200 + 1500 >= n then n else (select {_CUT} from (select w.text as text, w.e - 200 as s)) end)::bigint from w where e < n),
        p as (select doc_id, s, e, regexp_replace(regexp_replace(substr(text, s + 1, e - s), '^{_BLANK}', ''), '{_BLANK}$', '') as piece from w)
        select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as pos, s as start, e as "end", piece from p where length(piece) >= 100""",
    "scan_filter_sql": "select subject, count(*) as n from documents where doc_type = 'lecture_note' and subject <> 'generic' group by 1",
    "scan_filter_matcher": "select subject, count(*) as n from documents where doc_type = 'lecture_note' and subject is distinct from 'generic' group by 1",
    "scan_page": "select doc_id, lang, n_chars from documents order by doc_id limit 50 offset 100",
    "lookup_ordered": "with c as (select distinct canonical_id, source_chunks from canonical_concepts), w as (select canonical_id, unnest(source_chunks) as chunk_id, (generate_subscripts(source_chunks, 1) - 1)::int as pos from c), k as (select distinct chunk_id, chunk_type from chunks) select chunk_id, canonical_id, pos, chunk_type from w join k using (chunk_id)",
    "latest_chunks": "select chunk_id, source, chunk_type, ingested_at from chunks qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last) = 1",
    "replaced_source": """with k as (select chunk_id, source, chunk_type, ingested_at, coalesce(source, document_name) as s, coalesce(ingested_at >= timestamp '2025-06-01', false) as late, ingested_at < timestamp '2025-06-01' as early from chunks), g as (select distinct s from k where late),
        o as (select * from k where late or (early and not (s in (select s from g) and chunk_type = 'paragraph'))) select source, chunk_type, count(*) as n, min(ingested_at) as first from o group by 1, 2""",
    "deleted_chunks": "with c as (select unnest(source_chunks) as chunk_id from canonical_concepts), k as (select distinct chunk_id, chunk_type from chunks) select chunk_type, count(*) as n from k where chunk_id not in (select chunk_id from c) group by 1",
    "retained_events": "select event_type, count(*) as n from events where ts >= (select max(ts) from events) - interval 7 day group by 1",
    "dialog_concepts": "with c as (select distinct canonical_id, chunk_id from (select canonical_id, unnest(source_chunks) as chunk_id from canonical_concepts)), k as (select distinct chunk_id, chunk_type from chunks) select chunk_type, count(distinct canonical_id) as concepts, count(distinct chunk_id) as chunks from c join k using (chunk_id) group by 1",
    "media_of_concepts": "with c as (select distinct canonical_id, chunk_id from (select canonical_id, unnest(source_chunks) as chunk_id from canonical_concepts)), m as (select chunk_id, unnest(media_refs) as m from chunks) select distinct canonical_id, coalesce(m.type, '') as type, coalesce(m.path, '') as path from c join m using (chunk_id)",
    "usage_daily": _USE.format(k="ts::date as day"),
    "usage_monthly": _USE.format(k="strftime(ts, '%Y-%m') as month"),
    "usage_model": _USE.format(k="event_type as model"),
    "monitor_stage": "select event_type, json_extract_string(props, '$.k') as stage, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2",
    "slow_requests": "select count(*) as n, count_if(value > 50)::bigint as slow, round(avg(value), 6) as mean, round(max(value), 6) as most from (select * from events order by ts desc, event_id desc limit 100)",
    "dialog_last_n": "with x as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events) select user_id, row_number() over (partition by user_id order by ts, event_id)::int as pos, event_id, event_type from x where back <= 5",
    "dialog_sessions": "with x as (select user_id, ts, event_id, case when ts - lag(ts) over w > interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id)::bigint as session from x) select user_id, session, count(*) as n, min(ts) as began, max(ts) as ended from s group by 1, 2",
    "topic_counts": "with x as (select *, row_number() over (partition by user_id order by ts, event_id)::int as turn from events) select user_id, event_type, count(*) as n, min(turn) as first_turn, max(turn) as last_turn from x group by 1, 2",
    "bus_topic_stats": """with m as (select event_type as topic, user_id as sender, count(*) as n from events group by 1, 2), s as (select user_id as subscriber, arg_min(event_type, (ts, event_id)) as topic from events group by 1),
        o as (select m.topic, m.sender, m.n, count(case when s.subscriber <> m.sender then 1 end) as t from m left join s using (topic) group by 1, 2, 3) select topic, sum(n)::bigint as n, sum(n * t)::bigint as delivered, sum(case when t = 0 then n else 0 end)::bigint as dropped from o group by 1""",
    "linkage_jaccard": """with c as (select distinct canonical_id, chunk_id from (select canonical_id, unnest(source_chunks) as chunk_id from canonical_concepts)), k as (select distinct on (chunk_id) chunk_id, document_name from chunks),
        s as (select document_name, chunk_id, coalesce(list(canonical_id) filter (where canonical_id is not null), []) as ids from k left join c using (chunk_id) group by 1, 2), l as (select *, lag(ids) over (partition by document_name order by chunk_id) as b from s)
        select document_name, chunk_id, round(case when len(list_distinct(list_concat(ids, b))) > 0 then len(list_intersect(ids, b)) / len(list_distinct(list_concat(ids, b))) else 0 end, 6) as jaccard from l where b is not null""",
    "concept_diversity": """with c as (select distinct canonical_id, concept_type, chunk_id from (select canonical_id, concept_type, unnest(source_chunks) as chunk_id from canonical_concepts)), k as (select distinct chunk_id, document_name from chunks),
        n as (select document_name, concept_type, count(*) as n from c join k using (chunk_id) group by 1, 2) select document_name, sum(n)::bigint as "all", round(least(1.0, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 2), 6) as diversity from n group by 1""",
}
