"""Graph and gap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gaps as GP
from corpusloom.operators import graph as G
from corpusloom.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_table(table(spark, d, "concept_edges"), "parent_id", "child_id", "relation_type", "confidence")


def _types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_concepts").select(F.col("canonical_id").alias("node"), F.col("concept_type").alias("type")).distinct()


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that rows declare to be roots."""
    return table(spark, d, "concept_edges").where("coalesce(parent_id, '') = '' and child_id <> ''").select(F.col("child_id").alias("seed")).distinct()


def edge_scan(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("confidence", F.round("confidence", 6))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    rel = _edges(spark, d).groupBy(F.col("rel").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("relation"))
    node = _types(spark, d).groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    return rel.unionByName(node)


def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


def star_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(_edges(spark, d), _seeds(spark, d))


def tree_bfs(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs(_edges(spark, d), _seeds(spark, d), 3)


def expand_capped(spark: SparkSession, d: str) -> DataFrame:
    """Two hops, at most twenty nodes a seed by level and id (the cap is the feature)."""
    return G.bfs(G.real_edges(_edges(spark, d)), _seeds(spark, d), 2, 20).select("seed", "node", "depth")


def chain_path(spark: SparkSession, d: str) -> DataFrame:
    """From every declared root to the smallest and largest id two hops away."""
    two = G.bfs(_edges(spark, d), _seeds(spark, d), 3).where("depth = 3")
    ends = two.groupBy(F.col("seed").alias("source")).agg(F.min("node").alias("target"))
    return G.shortest_paths(_edges(spark, d), ends, 4)


def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = _types(spark, d).where("type in ('definition', 'law', 'application', 'extension')")
    return G.induced(_edges(spark, d), kept).select("src", "dst", "rel")


def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    e = G.real_edges(_edges(spark, d)).where("rel in ('SOLUTION', 'DEPENDS_ON', 'HAS_DETAIL')")
    return G.pagerank(e, _types(spark, d)).withColumn("score", F.round("score", 6))


def concept_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_edges(spark, d))


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.cyclic_nodes(_edges(spark, d))


def type_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Concept types that reach themselves through edges between other types."""
    t = _types(spark, d).groupBy("node").agg(F.min("type").alias("type"))
    e = _edges(spark, d).join(t.withColumnRenamed("node", "src").withColumnRenamed("type", "a"), "src").join(t.withColumnRenamed("node", "dst").withColumnRenamed("type", "b"), "dst")
    return G.cyclic_nodes(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def acyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.acyclic(_edges(spark, d).select("src", "dst", "rel"), ["rel"])


def adjacent_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacent(table(spark, d, "chunks").dropDuplicates(["chunk_id"]))


def belongs_to_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.belongs_to(table(spark, d, "chunks").dropDuplicates(["chunk_id"]))


def orphan_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without any incident edge."""
    e = G.undirected(_edges(spark, d)).select(F.col("a").alias("node")).distinct()
    return _types(spark, d).join(e, "node", "left_anti")


def invalid_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose relation the theory paradigm doesn't allow between their types."""
    allowed = [f"{a}>{r}>{b}" for (a, b), r in GP.THEORY.relations.items()]
    t = _types(spark, d).groupBy("node").agg(F.min("type").alias("type"))
    e = _edges(spark, d).join(t.withColumnRenamed("node", "src").withColumnRenamed("type", "a"), "src").join(t.withColumnRenamed("node", "dst").withColumnRenamed("type", "b"), "dst")
    e = e.where(F.col("a").isin(*GP.THEORY.chain) & F.col("b").isin(*GP.THEORY.chain))
    return e.where(~F.concat_ws(">", "a", "rel", "b").isin(*allowed)).select("src", "dst", "rel")


def _show(df: DataFrame) -> DataFrame:
    return df.withColumn("missing", F.array_join("missing", ",")).withColumn("replacement", F.array_join("replacement", ","))


def gap_linear(spark: SparkSession, d: str) -> DataFrame:
    return _show(GP.edge_gaps(_edges(spark, d), _types(spark, d), GP.THEORY))


def gap_cyclic(spark: SparkSession, d: str) -> DataFrame:
    return _show(GP.edge_gaps(_edges(spark, d), _types(spark, d), GP.ENGINEERING))


def gap_root(spark: SparkSession, d: str) -> DataFrame:
    return _show(GP.root_gaps(_edges(spark, d), _types(spark, d), GP.THEORY))


def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    """Open gaps by missing type."""
    g = GP.edge_gaps(_edges(spark, d), _types(spark, d), GP.THEORY).where("outcome = 'gap'")
    return g.select(F.explode("missing").alias("missing_type")).groupBy("missing_type").agg(F.count(F.lit(1)).alias("n"))


def gap_ids(spark: SparkSession, d: str) -> DataFrame:
    g = GP.edge_gaps(_edges(spark, d), _types(spark, d), GP.THEORY).where("outcome = 'gap'")
    return g.select(GP.gap_id(F.lit("s1"), "theory", F.col("src"), F.col("dst"), F.col("missing")).alias("gap_id")).distinct()


def gap_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the linker's first two stages as stored, all gaps as found."""
    types, rows = _types(spark, d), table(spark, d, "concept_edges")
    old = G.edge_table(rows.where("stage in ('parent_hint', 'embedding_llm')"), "parent_id", "child_id", "relation_type", "confidence")
    name = F.concat_ws("|", "src", "dst", F.array_join("missing", ","))
    stored = GP.edge_gaps(old, types, GP.THEORY).where("outcome = 'gap'").select(name.alias("gap_id"), F.when(F.col("rel") == "EXTENDS", "ignored").when(F.col("rel") == "APPLIES_TO", "obsolete").otherwise("open").alias("status")).groupBy("gap_id").agg(F.min("status").alias("status"))
    found = GP.edge_gaps(_edges(spark, d).where("rel <> 'HAS_LAW'"), types, GP.THEORY).where("outcome = 'gap'").select(name.alias("gap_id"))
    return GP.reconcile(stored, found)


QUERIES = {f.__name__: f for f in (edge_scan, graph_stats, graph_degree, star_neighbours, tree_bfs, expand_capped, chain_path, induced_edges, pagerank10, concept_components, cycle_nodes, type_cycle, acyclic_edges, adjacent_edges, belongs_to_edges, orphan_concepts, invalid_relations, gap_linear, gap_cyclic, gap_root, gap_summary, gap_ids, gap_reconcile)}

_E = """e as (select parent_id as src, child_id as dst, relation_type as rel, max(coalesce(confidence, 0.85)) as confidence from concept_edges where parent_id <> '' and child_id <> '' and parent_id <> child_id group by 1, 2, 3)"""
_T = """t as (select distinct canonical_id as node, concept_type as type from canonical_concepts)"""
_U = """u as (select src as a, dst as b from e union all select dst, src from e)"""
_S = """s as (select distinct child_id as seed from concept_edges where coalesce(parent_id, '') = '' and child_id <> '')"""
_PR = "with " + _E + ", " + _T + """, n as (select distinct node from t), c as (select count(*) as n from n),
    r as (select * from e where rel in ('SOLUTION', 'DEPENDS_ON', 'HAS_DETAIL') and src in (select node from n) and dst in (select node from n) and not contains(src, '__virtual_') and not contains(dst, '__virtual_')),
    u as (select src as a, dst as b from r union all select dst, src from r), g as (select a, count(*) as deg from u group by 1), p0 as (select node, 1.0 / n as s from n, c)""" + "".join(
    f""", p{i} as (select n.node, 0.15 / max(c.n) + 0.85 * coalesce(sum(p.s / g.deg), 0) as s from n cross join c left join u on u.b = n.node left join p{i - 1} p on p.node = u.a left join g on g.a = u.a group by 1)""" for i in range(1, 11)
) + " select node, round(least(s / (select max(s) from p10), 1.0), 6) as score from p10"


def _gap_sql(chain: tuple[str, ...], p: GP.Paradigm, cyclic: bool) -> str:
    """The edge ladder in SQL: positions, missing slice, replacement relations."""
    values = ", ".join(f"('{a}>{b}', '{r}')" for (a, b), r in p.relations.items())
    lst = "[" + ", ".join(f"'{c}'" for c in chain) + "]"
    n = len(chain)
    missing = f"case when i > 0 and i = j then [{lst}[(i % {n}) + 1]] end" if cyclic else f"case when i > 0 and j > i + 1 then {lst}[i + 1:j - 1] end"
    wrong = f"(i <> j and j <> i % {n} + 1)" if cyclic else "j <= i"
    return "with " + _E + ", " + _T + f""", m as (select map_from_entries(list((k, v))) as m from (values {values}) x(k, v)), ty as (select node, min(type) as type from t group by 1),
        x as (select e.src, e.dst, e.rel, a.type as st, b.type as tt, coalesce(list_position({lst}, a.type), 0) as i, coalesce(list_position({lst}, b.type), 0) as j from e left join ty a on a.node = src left join ty b on b.node = dst),
        y as (select *, case when i > 0 and j > 0 then {missing} end as mi from x),
        z as (select *, case when mi is not null then list_concat(list_concat([st], mi), [tt]) end as path from y),
        w as (select z.*, case when path is not null then list_transform(range(1, len(path)), lambda k: m.m[path[k] || '>' || path[k + 1]]) end as rp from z, m)
        select src, dst, rel, case when st is null or tt is null then 'unknown_endpoint' when src = dst then 'self_loop' when i = 0 or j = 0 then 'type_not_in_chain' when {wrong} then 'illegal_direction' when mi is null then 'ok'
            when len(list_filter(rp, lambda k: k is null)) > 0 then 'missing_replacement_relation' else 'gap' end as outcome, array_to_string(mi, ',') as missing,
            case when len(list_filter(rp, lambda k: k is null)) = 0 then array_to_string(rp, ',') end as replacement from w"""


_GAP = _gap_sql(GP.THEORY.chain, GP.THEORY, False)

SQL = {
    "edge_scan": "with " + _E + " select src, dst, rel, round(confidence, 6) as confidence from e",
    "graph_stats": "with " + _E + ", " + _T + " select rel as label, count(*) as n, 'relation' as kind from e group by 1 union all select type, count(*), 'node' from t group by 1",
    "graph_degree": "with " + _E + ", x as (select src as node, dst as other, 1 as o, 0 as i from e union all select dst, src, 0, 1 from e) select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(distinct other) as n_neighbours from x group by 1",
    "star_neighbours": "with " + ", ".join((_E, _U, _S)) + " select distinct seed, b as node from s join u on a = seed",
    "tree_bfs": "with " + ", ".join((_E, _U, _S)) + """, v as (select distinct a, b from u),
        d0 as (select seed, seed as node from s), d1 as (select seed, b as node, min(a) as via from d0 join v on a = node group by 1, 2 having b <> seed),
        k1 as (select seed, node from d0 union select seed, node from d1), d2 as (select seed, b as node, min(a) as via from d1 join v on a = node where (seed, b) not in (select (seed, node) from k1) group by 1, 2),
        k2 as (select * from k1 union select seed, node from d2), d3 as (select seed, b as node, min(a) as via from d2 join v on a = node where (seed, b) not in (select (seed, node) from k2) group by 1, 2)
        select seed, node, 0 as depth, null::varchar as via from d0 union all select seed, node, 1, via from d1 union all select seed, node, 2, via from d2 union all select seed, node, 3, via from d3""",
    "expand_capped": "with " + ", ".join((_E, _S)) + """, r as (select * from e where not contains(src, '__virtual_') and not contains(dst, '__virtual_')), v as (select src as a, dst as b from r union select dst, src from r),
        d1 as (select *, row_number() over (partition by seed order by node) + 1 as i from (select distinct seed, b as node from s join v on a = seed where b <> seed)), k1 as (select seed, node from d1 where i <= 20),
        n1 as (select seed, count(*) + 1 as has from k1 group by 1), d2 as (select distinct k1.seed, b as node from k1 join v on a = k1.node where b <> k1.seed and (k1.seed, b) not in (select (seed, node) from k1)),
        x2 as (select d2.seed, d2.node, row_number() over (partition by d2.seed order by d2.node) + has as i from d2 join n1 on n1.seed = d2.seed)
        select seed, seed as node, 0 as depth from s union all select seed, node, 1 from k1 union all select seed, node, 2 from x2 where i <= 20""",
    "induced_edges": "with " + _E + ", " + _T + ", k as (select node from t where type in ('definition', 'law', 'application', 'extension')) select src, dst, rel from e where src in (select node from k) and dst in (select node from k)",
    "pagerank10": _PR,
    "concept_components": "with recursive " + ", ".join((_E, _U)) + ", r as (select distinct a as node, a as other from u union select r.node, u.b from r join u on u.a = r.other) select node, min(other) as component from r group by 1",
    "cycle_nodes": "with recursive " + _E + ", r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select distinct src as node from r where src = dst",
    "type_cycle": "with recursive " + _E + ", " + _T + ", ty as (select node, min(type) as type from t group by 1), x as (select distinct a.type as src, b.type as dst from e join ty a on a.node = src join ty b on b.node = dst where a.type <> b.type), r as (select src, dst from x union select r.src, x.dst from r join x on x.src = r.dst) select distinct src as node from r where src = dst",
    "acyclic_edges": "with recursive " + _E + """, r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst), c as (select distinct src as node from r where src = dst),
        o as (select e.* from e where src in (select node from c) and dst in (select node from c)), g as (select a.src as node, min(least(a.src, b.dst)) as comp from r a join r b on a.src = b.src where a.src in (select node from c) and b.dst in (select node from c) group by 1),
        l as (select comp, max((rel, src, dst)) as m from o join g on g.node = o.src group by 1)
        select src, dst, rel from e where (src, dst) not in (select (m[2], m[3]) from l)""",
    "adjacent_edges": "with c as (select distinct on (chunk_id) chunk_id, source, heading_path, chunk_type, coalesce(try_cast(nullif(regexp_extract(chunk_id, '_(\\d+)_', 1), '') as int), 0) as nr from chunks) select * from (select chunk_id as src, lead(chunk_id) over (partition by source, heading_path, chunk_type order by nr, chunk_id) as dst from c) where dst is not null",
    "belongs_to_edges": """with c as (select distinct on (chunk_id) chunk_id, document_name, chunk_type, heading_path from chunks),
        h as (select document_name, heading_path as want, min(chunk_id) as head from c where chunk_type = 'heading' and heading_path is not null group by 1, 2), r as (select document_name, min(chunk_id) as root from c where chunk_type = 'document' group by 1),
        x as (select *, case when chunk_type = 'heading' then rtrim(regexp_replace(heading_path, '( > )?[^>]*$', '')) else heading_path end as want from c where chunk_type <> 'document')
        select coalesce(head, root) as parent, chunk_id as child from x left join h using (document_name, want) left join r using (document_name) where coalesce(head, root) is not null and coalesce(head, root) <> chunk_id""",
    "orphan_concepts": "with " + ", ".join((_E, _U, _T)) + " select node, type from t where node not in (select a from u)",
    "invalid_relations": "with " + _E + ", " + _T + ", ty as (select node, min(type) as type from t group by 1) select src, dst, rel from e join ty a on a.node = src join ty b on b.node = dst where a.type in ('definition', 'law', 'application', 'extension') and b.type in ('definition', 'law', 'application', 'extension') and (a.type || '>' || rel || '>' || b.type) not in (" + ", ".join(f"'{a}>{r}>{b}'" for (a, b), r in GP.THEORY.relations.items()) + ")",
    "gap_linear": _GAP,
    "gap_cyclic": _gap_sql(GP.ENGINEERING.chain, GP.ENGINEERING, True),
    "gap_root": "with " + _E + ", " + _T + """, ty as (select node, min(type) as type from t group by 1), x as (select node, type from ty where node not in (select dst from e))
        select node, case type when 'law' then 'definition' when 'application' then 'definition,law' else 'definition,law,application' end as missing,
            case type when 'law' then 'HAS_LAW' when 'application' then 'HAS_LAW,APPLIES_TO' else 'HAS_LAW,APPLIES_TO,EXTENDS' end as replacement from x where type in ('law', 'application', 'extension')""",
    "gap_summary": f"select missing_type, count(*) as n from (select unnest(string_split(missing, ',')) as missing_type from ({_GAP}) where outcome = 'gap') group by 1",
    "gap_reconcile": "with " + _E.replace("from concept_edges where", "from concept_edges where stage in ('parent_hint', 'embedding_llm') and") + f""", og as (select * from ({_GAP.replace("from concept_edges where", "from concept_edges where stage in ('parent_hint', 'embedding_llm') and")}) where outcome = 'gap'),
        o as (select src || '|' || dst || '|' || missing as gap_id, min(case rel when 'EXTENDS' then 'ignored' when 'APPLIES_TO' then 'obsolete' else 'open' end) as old from og group by 1),
        f as (select distinct src || '|' || dst || '|' || missing as gap_id, true as now from ({_GAP}) where outcome = 'gap' and rel <> 'HAS_LAW'), x as (select coalesce(o.gap_id, f.gap_id) as gap_id, old, coalesce(now, false) as now from o full join f on o.gap_id = f.gap_id)
        select gap_id, case when old is null then 'open' when not now and old in ('open', 'supplemented') then 'obsolete' when now and old = 'obsolete' then 'open' else old end as status,
            case when old is null then 'inserted' when not now and old in ('open', 'supplemented') then 'obsoleted' when now and old = 'obsolete' then 'reopened' when now then 'refreshed' else 'kept' end as action from x""",
    "gap_ids": f"""select distinct 'gap_' || sha256('{{"detector_version":"v1","missing_types":["' || replace(missing, ',', '","') || '"],"paradigm_id":"theory","source_id":"' || src || '","subject_id":"s1","target_id":"' || dst || '"}}') as gap_id from ({_GAP}) where outcome = 'gap'""",
}
