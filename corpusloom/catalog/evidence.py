"""Queries on agreement, votes and near titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import graph as CG
from corpusloom.catalog.retrieval import TOKENS
from corpusloom.operators import evidence as V
from corpusloom.operators import gaps as GP
from corpusloom.sources.tables import table


def link_stability(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of relation types that a parent's links have in the linker's stages."""
    e = table(spark, d, "concept_edges").where("parent_id <> ''")
    return V.stability(e, "parent_id", "stage", "relation_type")


def best_stage(spark: SparkSession, d: str) -> DataFrame:
    return V.best_sample(table(spark, d, "concept_edges").where("parent_id <> ''"), "parent_id", "stage", "relation_type")


def subject_votes(spark: SparkSession, d: str) -> DataFrame:
    """Subjects whose name's words stand in a document."""
    docs = table(spark, d, "documents")
    words = docs.where("subject is not null").select(F.col("subject").alias("topic")).distinct().select("topic", F.explode(F.split("topic", "_")).alias("word")).where("length(word) > 3")
    return V.keyword_votes(docs, words, "doc_id", "text")


def near_names(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of one type with similar names."""
    return V.near_titles(table(spark, d, "canonical_concepts").dropDuplicates(["canonical_id", "name"]), "canonical_id", "concept_type", "name")


def gap_natural(spark: SparkSession, d: str) -> DataFrame:
    edges, types = CG._edges(spark, d), CG._types(spark, d)
    return V.natural_paths(GP.edge_gaps(edges, types, GP.THEORY).where("outcome = 'gap'"), edges, types)


QUERIES = {f.__name__: f for f in (link_stability, best_stage, subject_votes, near_names, gap_natural)}

_SETS = "s as (select parent_id, stage, list(distinct lower(trim(relation_type, ' '))) as names from concept_edges where parent_id <> '' and trim(relation_type, ' ') <> '' group by 1, 2)"
_J = "len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names)))"

SQL = {
    "link_stability": f"with {_SETS} select a.parent_id, count(*) as pairs, round(avg({_J}), 6) as stability from s a join s b on a.parent_id = b.parent_id and a.stage < b.stage group by 1",
    "best_stage": f"with {_SETS}, m as (select a.parent_id, a.stage, round(avg(coalesce({_J}, 0)), 9) as j from s a left join s b on a.parent_id = b.parent_id and a.stage <> b.stage group by 1, 2) select parent_id, arg_min(stage, (-j, stage)) as stage from m group by 1",
    "subject_votes": f"""with k as (select distinct subject as topic, word from (select subject, unnest(string_split(subject, '_')) as word from documents where subject is not null) where length(word) > 3),
        t as (select doc_id, unnest({TOKENS.format(t='text')}) as word from documents), v as (select doc_id, topic, count(*) as n from t join k using (word) group by 1, 2)
        select doc_id, arg_min(topic, (-n, topic)) as topic, max(n) as votes from v group by 1""",
    "gap_natural": f"""with g as (select distinct src, dst, missing as want from ({CG.SQL['gap_linear']}) where outcome = 'gap' and not contains(missing, ',')),
        e as (select distinct parent_id as src, child_id as dst from concept_edges where parent_id <> '' and child_id <> '' and parent_id <> child_id), t as (select canonical_id as node, min(concept_type) as type from canonical_concepts group by 1)
        select src, dst, exists (select 1 from e a join e b on a.dst = b.src join t on t.node = a.dst where a.src = g.src and b.dst = g.dst and t.type = g.want) as "natural" from g""",
}
