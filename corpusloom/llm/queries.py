"""Queries of the operators for training data, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chosen_path, components, leakage, ocr, packing, pii, splitting, visual
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.similar_pairs(table(spark, d, "question_bank"), "id", chosen_path.question_text())


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.near_duplicate_groups(table(spark, d, "question_bank"), "id", chosen_path.question_text())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.defects(table(spark, d, "chunks"), table(spark, d, "wordlist"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr.paragraphs(table(spark, d, "chunks"), table(spark, d, "wordlist"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.same_looks(table(spark, d, "canonical_concepts"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    texts = visual.concept_texts(table(spark, d, "canonical_concepts"))
    return visual.canonical_text(texts.withColumn("as_stored", F.col("text")), "text")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_classes(table(spark, d, "canonical_concepts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = components.merge_pairs(table(spark, d, "merge_candidates"))
    return components.connected_groups(pairs, "left_name", "right_name", "build_id").select(F.col("scope").alias("build_id"), "name", "group_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunks"), "chunk_id", "text")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "heading_path", "text").where("length(text) > 3000").distinct()
    return splitting.split_rows(rows, "text")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.where(F.col("exact_run") >= leakage.SHORTEST).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    got = pii.find_personal(table(spark, d, "documents"), table(spark, d, "roster"))
    return got.where(F.col("kind").isin(*pii.KINDS)).select("doc_id", "kind", "value").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "roster"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_paragraphs, p3_found, p3_canonical, p3_classes, p4_found, p6_found, p6_pieces, p7_packed, p8_found, p8_overlaps,
        p9_found, p9_redacted,
    )
}

SQL: dict[str, str] = {
    "p1_found": """
        with q as (select distinct id, regexp_replace(lower(coalesce(question, '') || coalesce(options, '')), '[^\\p{L}\\p{N}]', '', 'g') as bare from question_bank where id is not null),
        k as (select *, row_number() over () as k from q), g as (select distinct id, k, substr(bare, i, 4) as gram from (select *, unnest(range(1, length(bare) - 2)) as i from k)),
        n as (select k, count(*) as n from g group by 1), j as (select a.id as x, b.id as y, a.k as kx, b.k as ky, count(*) as both_ from g a join g b on a.gram = b.gram and a.id < b.id group by 1, 2, 3, 4)
        select distinct x as id_a, y as id_b from j join n s on s.k = kx join n t on t.k = ky where both_ >= 0.7 * (s.n + t.n - both_) - 1e-9""",
    "p8_found": """
        with d as (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as b from documents where doc_id is not null), i as (select item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as b from eval_items where item_id is not null),
        ig as (select distinct item_id, substr(b, k, 50) as g from (select *, unnest(range(1, length(b) - 48)) as k from i)),
        dc as (select doc_id, substr(b, p, 1049) as b from (select *, unnest(range(1, greatest(length(b), 1) + 1, 1000)) as p from d)), dg as (select doc_id, substr(b, k, 50) as g from (select *, unnest(range(1, length(b) - 48)) as k from dc))
        select distinct doc_id, item_id from dg join ig using (g)""",
    "p4_found": """
        with recursive e as (
            select build_id, left_name as a, right_name as b from merge_candidates
            where lower(regexp_replace(decision, '^\\s+|\\s+$', '', 'g')) = 'merge' and left_name <> '' and right_name <> '' and left_name <> right_name
            union
            select build_id, right_name, left_name from merge_candidates
            where lower(regexp_replace(decision, '^\\s+|\\s+$', '', 'g')) = 'merge' and left_name <> '' and right_name <> '' and left_name <> right_name
        ), r as (
            select distinct build_id, a as name, a as other from e
            union
            select r.build_id, r.name, e.b from r join e on e.build_id = r.build_id and e.a = r.other
        )
        select build_id, name, min(other) as group_name from r group by 1, 2""",
    "p6_found": """
        select chunk_id, max(case when regexp_matches(text, '[^ \\t\\r\\n。！？；，]{1000}[^ \\t\\r\\n。！？；，]{1000}[^ \\t\\r\\n。！？；，]{1000}[^ \\t\\r\\n。！？；，]') then 1 else 0 end)::bigint as unbreakable
        from chunks where length(text) > 3000 and chunk_id is not null group by 1""",
}
