"""Queries on links, pairs, contexts and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import graph as CG
from corpusloom.functions import text as T
from corpusloom.operators import gaps as GP
from corpusloom.operators import linking as K
from corpusloom.sources.tables import table


def parent_hint_links(spark: SparkSession, d: str) -> DataFrame:
    return K.hint_links(table(spark, d, "canonical_concepts"))


def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a build in either order, with the last review."""
    m = table(spark, d, "merge_candidates")
    return K.unordered_pairs(m, "left_name", "right_name", ["build_id"], ["reviewed_at", "candidate_id", "decision"], ["decision"])


def merge_counters(spark: SparkSession, d: str) -> DataFrame:
    said = F.coalesce(F.lower(F.trim("decision")), F.lit(""))
    m = table(spark, d, "merge_candidates").groupBy("build_id")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(said == "merge").alias("merge"), F.count_if(said == "separate").alias("separate"), F.count_if(said == "").alias("pending"), F.count_if(F.col("advisor_conflict") == 1).alias("conflicts"), F.count_if(F.col("reviewed_at").isNull()).alias("unreviewed"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of each type, those with more sources first, within 200 tokens of description."""
    c = table(spark, d, "canonical_concepts").where("description is not null").groupBy("canonical_id").agg(F.max("concept_type").alias("concept_type"), F.max("description").alias("description"), F.max(F.size("source_chunks")).alias("sources"))
    c = c.withColumn("tokens", T.context_tokens(F.col("description")))
    order = F.struct((-F.col("sources")).alias("s"), F.col("canonical_id"))
    return K.within_budget(c, "concept_type", order, "tokens", 200).select("concept_type", "canonical_id", "tokens", "used")


def line_repetition(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).where("text is not null")
    return K.repeated_lines(k, "document_name", "chunk_id", "text")


def heading_fill(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "document_name", "heading_path")
    return K.carried_forward(k, "document_name", ["chunk_id"], "heading_path")


def embedding_health(spark: SparkSession, d: str) -> DataFrame:
    return K.vector_health(table(spark, d, "embeddings"), "embedding", "label")


def sample_deterministic(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions by hash (a sampling operator)."""
    return K.sampled(table(spark, d, "question_bank").select("id").distinct(), "id", 20, "7")


def evidence_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose last heading is quoted as it stands in the chunk above them."""
    k = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    last = F.element_at(F.split("heading_path", " > ", -1), -1)
    q = k.where("parent_id is not null and heading_path is not null").select("chunk_id", F.col("parent_id").alias("chunk"), last.alias("quote"))
    return K.quotes(q, k, "chunk", "quote").select("chunk_id", "chunk")


def extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").select(F.col("canonical_id").alias("concept_id"), F.explode("source_chunks").alias("chunk_id"))
    return K.extraction_coverage(table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "text"), c)


def gap_overlay(spark: SparkSession, d: str) -> DataFrame:
    return K.overlay(GP.edge_gaps(CG._edges(spark, d), CG._types(spark, d), GP.THEORY).where("outcome = 'gap'").select("src", "dst", "missing", "replacement").distinct())


def concept_types(spark: SparkSession, d: str) -> DataFrame:
    """Votes for each concept's type over its repeats, ties to the smaller."""
    c = table(spark, d, "canonical_concepts").where("concept_type <> ''").groupBy("canonical_id", "concept_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("canonical_id").agg(F.min_by("concept_type", F.struct(-F.col("n"), "concept_type")).alias("concept_type"), F.sum("n").alias("votes"))


QUERIES = {f.__name__: f for f in (parent_hint_links, merge_pairs, merge_counters, context_budget, line_repetition, heading_fill, embedding_health, sample_deterministic, evidence_quotes, extraction_coverage, gap_overlay, concept_types)}

_K = "k as (select distinct on (chunk_id) * from chunks)"

SQL = {
    "parent_hint_links": """with c as (select canonical_id, concept_type, lower(trim(parent_hint, ' ')) as hint from canonical_concepts where lower(trim(parent_hint, ' ')) <> ''),
        l as (select canonical_id as parent, concept_type as pt, lower(trim(name, ' ')) as hint, 0 as via from canonical_concepts union select canonical_id, concept_type, lower(trim(a, ' ')), 1 from (select canonical_id, concept_type, unnest(aliases) as a from canonical_concepts)),
        h as (select c.canonical_id as child, parent, via * 2 + (pt = concept_type)::int as s from c join l using (hint) where hint <> '' and parent <> c.canonical_id)
        select arg_min(parent, (s, parent)) as parent, child, (min(s) + 1)::int as strategy from h group by child""",
    "merge_pairs": """select build_id, least(left_name, right_name) as a, greatest(left_name, right_name) as b, count(*) as n, (array_agg(decision order by reviewed_at desc nulls last, candidate_id desc nulls last, decision desc nulls last))[1] as decision
        from merge_candidates where left_name <> '' and right_name <> '' and left_name <> right_name group by 1, 2, 3""",
    "merge_counters": """with m as (select *, coalesce(lower(trim(decision, ' ')), '') as said from merge_candidates) select build_id, count(*) as n, count_if(said = 'merge')::bigint as merge, count_if(said = 'separate')::bigint as separate, count_if(said = '')::bigint as pending,
        count(case when advisor_conflict = 1 then 1 end) as conflicts, count_if(reviewed_at is null)::bigint as unreviewed from m group by 1""",
    "context_budget": """with c as (select canonical_id, max(concept_type) as concept_type, max(description) as description, max(len(source_chunks)) as sources from canonical_concepts where description is not null group by 1),
        t as (select *, len(regexp_extract_all(description, '[\\x{4E00}-\\x{9FFF}]')) as cjk from c), u as (select *, (cjk + (length(description) - cjk) // 4)::bigint as tokens from t),
        s as (select concept_type, canonical_id, tokens, sum(tokens) over (partition by concept_type order by sources desc, canonical_id)::bigint as used from u) select * from s where used <= 200""",
    "line_repetition": f"""with {_K}, l as (select document_name, chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from k where text is not null),
        n as (select *, row_number() over (partition by document_name, line order by chunk_id, pos) as nth from l where trim(line, ' ') <> '') select document_name, chunk_id, count_if(nth <= 3)::bigint as kept, count_if(nth > 3)::bigint as dropped from n group by 1, 2""",
    "heading_fill": f"with {_K} select chunk_id, document_name, last_value(heading_path ignore nulls) over (partition by document_name order by chunk_id rows between unbounded preceding and current row) as heading_path from k",
    "embedding_health": """with v as (select vec_id, label, embedding::double[] as e from embeddings), n as (select *, sqrt(list_inner_product(e, e)) as norm from v),
        p as (select a.label = b.label as same, list_inner_product(a.e, b.e) / (a.norm * b.norm) as s from n a join n b on a.vec_id < b.vec_id where a.norm > 0 and b.norm > 0)
        select (select count(*) from n) as n, (select round(avg(norm), 6) from n) as mean_norm, (select round(stddev_pop(norm), 6) from n) as std_norm, (select round(avg((norm = 0)::int), 6) from n) as zero_share,
            (select round(avg(s), 6) from p where same) as intra, (select round(avg(s), 6) from p where not same) as inter""",
    "sample_deterministic": "select id from (select distinct id from question_bank) order by md5(id || '7') limit 20",
    "evidence_quotes": """with k as (select distinct on (chunk_id) chunk_id, parent_id, heading_path, text from chunks), q as (select chunk_id, parent_id as chunk, lower(regexp_replace(string_split(heading_path, ' > ')[-1], '\\s+', '', 'g')) as quote from k where parent_id is not null and heading_path is not null)
        select q.chunk_id, q.chunk from q join k on k.chunk_id = q.chunk where quote <> '' and contains(lower(regexp_replace(k.text, '\\s+', '', 'g')), quote)""",
    "extraction_coverage": f"""with {_K}, c as (select chunk_id, count(distinct canonical_id) as n from (select canonical_id, unnest(source_chunks) as chunk_id from canonical_concepts) group by 1),
        x as (select k.chunk_id, coalesce(n, 0) as n, length(trim(coalesce(text, ''), ' ')) as size from k left join c using (chunk_id)) select chunk_id, n, round(greatest(0.0, 1 - abs(n - case when size <= 500 then 3 when size <= 1500 then 5 else 7 end) * 0.15), 6)::double as score from x""",
    "gap_overlay": f"""with g as (select distinct src, dst, string_split(missing, ',') as m, string_split(replacement, ',') as r from ({CG.SQL['gap_linear']}) where outcome = 'gap'),
        s as (select list_concat(list_concat([src], list_transform(m, lambda x: '__virtual_' || src || '|' || dst || '#' || x)), [dst]) as stops, r from g), i as (select stops, unnest(r) as rel, generate_subscripts(r, 1) as i from s)
        select stops[i] as src, stops[i + 1] as dst, rel from i""",
    "concept_types": "with c as (select canonical_id, concept_type, count(*) as n from canonical_concepts where concept_type <> '' group by 1, 2) select canonical_id, arg_min(concept_type, (-n, concept_type)) as concept_type, sum(n)::bigint as votes from c group by 1",
}
