"""Registered queries of the core and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.catalog import activity, concepts, evidence, graph, learning, lifecycle, linking, retrieval, review, sections, store, streams
from corpusloom.operators import hierarchy
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy.hierarchy(table(spark, d, "concept_edges"))
    return full.select("node_id", "root_id", "depth", "path", "n_descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "concept_edges")).select("node_id", "descendant_id")


AREAS = (evidence, retrieval, graph, learning, linking, store, streams, concepts, lifecycle, sections, activity, review)

QUERIES: dict[str, Query] = {"p5_found": p5_found, "p5_descendants": p5_descendants}

SQL: dict[str, str] = {
    "p5_found": """
        with recursive up as (
            select node, min(parent) as parent from (
                select child_id as node, nullif(parent_id, '') as parent from concept_edges where child_id <> ''
                union all select parent_id, null from concept_edges where parent_id <> '')
            group by 1
        ), tree as (
            select node, node as root, 0::bigint as depth, node as path from up where parent is null
            union all
            select u.node, t.root, t.depth + 1, t.path || ' > ' || u.node from tree t join up u on u.parent = t.node
        ), pairs as (
            select parent as anc, node as below from up where parent is not null
            union
            select p.anc, u.node from pairs p join up u on u.parent = p.below
        ), counts as (select anc, count(*) as n from pairs where anc <> below group by 1)
        select u.node as node_id, coalesce(t.root, '') as root_id, coalesce(t.depth, -1)::bigint as depth, coalesce(t.path, '') as path, coalesce(c.n, 0)::bigint as n_descendants
        from up u left join tree t on t.node = u.node left join counts c on c.anc = u.node""",
    "p5_descendants": """
        with recursive up as (
            select child_id as node, min(nullif(parent_id, '')) as parent from concept_edges where child_id <> '' group by 1
        ), pairs as (
            select parent as anc, node as below from up where parent is not null
            union
            select p.anc, u.node from pairs p join up u on u.parent = p.below
        )
        select anc as node_id, below as descendant_id from pairs where anc <> below""",
}

for _area in AREAS:
    QUERIES |= _area.QUERIES
    SQL |= _area.SQL
