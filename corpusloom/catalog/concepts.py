"""Queries that find, choose, link and assemble concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import graph as CG
from corpusloom.catalog import learning as CL
from corpusloom.functions import text as T
from corpusloom.operators import concepts as C
from corpusloom.operators import gaps as GP
from corpusloom.operators import learning as L
from corpusloom.operators import likeness as N
from corpusloom.operators import linker as K
from corpusloom.operators import resolve as E
from corpusloom.plans.lineage import cut
from corpusloom.sources.tables import table


def concept_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The concept that each topic of the question bank stands for."""
    return C.resolve(table(spark, d, "question_bank").select(F.col("topic").alias("query")), table(spark, d, "canonical_concepts"))


def weak_concepts(spark: SparkSession, d: str) -> DataFrame:
    state = L.knowledge_state(CL._answers(spark, d)).withColumn("mastery", F.round("mastery", 6))
    return C.weakest(state).select("user_id", "subject_id", "concept_id", "mastery", "rank")


def uncovered_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The most central concepts that the guest's answers haven't touched."""
    return C.uncovered(CG.pagerank10(spark, d), table(spark, d, "answers").where("user_id = 'u_guest'"))


def context_trim(spark: SparkSession, d: str) -> DataFrame:
    """Twelve nodes of each root's two-hop subgraph: the root, then by centrality."""
    near = CG.tree_bfs(spark, d).where("depth <= 2")
    return C.trimmed(near, CG.pagerank10(spark, d), 12).select("seed", "node", "rank")


def context_assembled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").groupBy(F.col("canonical_id").alias("node")).agg(F.max("name").alias("name"), F.max("concept_type").alias("concept_type"), F.max("description").alias("description"))
    return C.assembled(context_trim(spark, d), c).select("seed", F.md5("text").alias("digest"), "tokens")


def concept_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts whose hash embeddings of the name are alike."""
    c = table(spark, d, "canonical_concepts").groupBy("canonical_id").agg(F.max("name").alias("name"))
    x = N.alike(cut(N.word_rows(c.where("canonical_id is not null"), F.col("name")).drop("name")), "canonical_id", 0.72)
    return x.select("a.canonical_id", "b.canonical_id", "score").toDF("a", "b", "score")


def likeness_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").where("canonical_id is not null").groupBy("canonical_id").agg(F.max("name").alias("name"), F.min("concept_type").alias("type"))
    return K.likeness_links(c.select(F.col("canonical_id").alias("node"), "name", "type"), CG._edges(spark, d), GP.THEORY, 0.72)


def pair_classify_likeness(spark: SparkSession, d: str) -> DataFrame:
    """The whole ladder: candidates by alias, base and containment, and by likeness of names."""
    p = cut(E.profiles(CL._mentions(spark, d), native=True))
    return E.classify_alike(E.candidate_pairs(p), p)


def has_detail_layers(spark: SparkSession, d: str) -> DataFrame:
    return K.semantic_layers(table(spark, d, "chunks"), table(spark, d, "canonical_concepts"))


def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return K.without_orphans(CG._edges(spark, d).select("src", "dst", "rel"))


def virtual_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = K.placeholders(CG._edges(spark, d))
    return x.select("node", "n_in", "n_out", F.array_join("sources", "|").alias("sources"), F.array_join("targets", "|").alias("targets"))


def edge_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels that an edge skips and the relation its types call for."""
    t = CG._types(spark, d).groupBy("node").agg(F.min("type").alias("type"))
    e = CG._edges(spark, d).select("src", "dst", "rel").join(t.toDF("src", "a"), "src").join(t.toDF("dst", "b"), "dst")
    return e.select("src", "dst", "rel", K.levels_between(F.col("a"), F.col("b"), GP.THEORY).alias("levels"), K.cross_relation(F.col("a"), F.col("b"), GP.THEORY).alias("called_for"))


def vague_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").where("name is not null").select("canonical_id", "name").distinct()
    return c.groupBy(F.length("name").alias("chars"), T.is_vague(F.col("name")).alias("vague")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_stats(spark: SparkSession, d: str) -> DataFrame:
    """The twenty commonest concept types (the limit is the report's)."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", F.coalesce("concept_type", F.lit("unknown")).alias("concept_type")).distinct()
    return c.groupBy("concept_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "concept_type").limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        concept_resolve, weak_concepts, uncovered_concepts, context_trim, context_assembled, concept_likeness, likeness_links, pair_classify_likeness, has_detail_layers,
        orphan_cleanup, virtual_nodes, edge_levels, vague_names, dedupe_stats,
    )
}

_NEAR = f"b as (select seed, node from ({CG.SQL['tree_bfs']}) where depth <= 2), p as ({CG.SQL['pagerank10']})"
_TRIM = f"{_NEAR}, r as (select seed, b.node, row_number() over (partition by seed order by (seed <> b.node)::int, coalesce(score, 0.0) desc, b.node)::int as rank from b left join p on p.node = b.node), t as (select * from r where rank <= 12)"
_COS = """wd as (select k, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda w: w <> '')) as w from c),
    h as (select k, ('0x' || right(md5(w), 3))::int % 2048 as slot, 1.0::double as weight from wd union all select k, ('0x' || right(sha256(w), 3))::int % 2048, 0.5::double from wd),
    s as (select k, slot, sum(weight) as x from h group by 1, 2), nn as (select k, sqrt(sum(x * x)) as norm from s group by 1), v as (select k, slot, x / norm as x from s join nn using (k)),
    co as (select a.k as a, b.k as b, round(sum(a.x * b.x), 6) as score from v a join v b on a.slot = b.slot and a.k < b.k group by 1, 2 having round(sum(a.x * b.x), 6) >= 0.72)"""
_ALIKE = "c as (select canonical_id as k, max(name) as t from canonical_concepts group by 1), " + _COS
_CMP = "regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
_H = "trim(last_part)"
_BARE = f"trim(regexp_replace(regexp_replace({_H}, '^[\\d.\\s、]+', ''), '^第[一二三四五六七八九十\\d]+[章节]\\s*', ''))"
_FORMS = ", ".join(_CMP.format(t=x) for x in (_H, _BARE, f"regexp_extract({_H}, '\\(([A-Z-]+)\\)', 1)", f"trim(regexp_replace({_H}, '\\s*\\([^)]+\\)', '', 'g'))"))
_RELS = ", ".join(f"('{a}', '{b}', '{r}')" for (a, b), r in GP.THEORY.relations.items())
_CHAIN = "[" + ", ".join(f"'{c}'" for c in GP.THEORY.chain) + "]"

SQL = {
    "concept_resolve": """with q as (select distinct trim(topic, ' ') as query from question_bank where trim(topic, ' ') <> ''), c as (select distinct canonical_id, name, aliases from canonical_concepts where not contains(canonical_id, '__virtual_') and trim(name, ' ') <> ''),
        x as (select query, canonical_id, case when query = name then 1 when contains(name, query) or contains(query, name) then 2 when contains(lower(name), lower(query)) or contains(lower(query), lower(name)) then 3
            when len(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) >= 2 and contains(lower(name), w))) > 0 then 4 when len(list_filter(coalesce(aliases, []), lambda a: contains(a, query))) > 0 then 5 end as strategy from q, c)
        select query, arg_min(canonical_id, (strategy, canonical_id)) as canonical_id, min(strategy)::int as strategy from x where strategy is not null group by 1""",
    "weak_concepts": f"with {CL._STATE}, m as (select user_id, subject_id, concept_id, round(mastery, 6) as mastery from state) select * from (select *, row_number() over (partition by user_id, subject_id order by mastery, concept_id)::int as rank from m) where rank <= 5",
    "uncovered_concepts": f"with p as ({CG.SQL['pagerank10']}), s as (select distinct unnest(primary_concepts) as node from answers where user_id = 'u_guest') select *, row_number() over (order by score desc, node)::int as rank from p where node not in (select node from s where node is not null) order by score desc, node limit 5",
    "context_trim": f"with {_TRIM} select seed, node, rank from t",
    "context_assembled": f"""with {_TRIM}, c as (select canonical_id as node, max(name) as name, max(concept_type) as concept_type, max(description) as description from canonical_concepts group by 1),
        x as (select seed, rank, '**' || name || '** (' || coalesce(concept_type, '') || ') - ' || substr(coalesce(description, ''), 1, 80) || case when length(description) > 80 then '...' else '' end as line from t join c using (node) where name <> ''),
        n as (select *, row_number() over (partition by seed order by rank) as i from x), a as (select seed, string_agg(i || '. ' || line, chr(10) order by i) as text from n group by 1),
        k as (select *, length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) as cjk from a) select seed, md5(text) as digest, floor(cjk * 1.5 + (length(text) - cjk) * 0.5)::bigint as tokens from k""",
    "concept_likeness": f"with {_ALIKE} select a, b, score from co",
    "likeness_links": f"""with {_ALIKE}, {CG._E}, {CG._T}, ty as (select node, min(type) as type from t group by 1), rl(pt, ct, rel) as (values {_RELS}), bo as (select a as parent, b as child, score from co union all select b, a, score from co)
        select parent, child, rl.rel, score from bo join ty x on x.node = parent join ty y on y.node = child join rl on rl.pt = x.type and rl.ct = y.type where (parent, child) not in (select (src, dst) from e)""",
    "has_detail_layers": f"""with k as (select distinct chunk_id, document_name, chunk_type, heading_path from chunks), hd as (select chunk_id as head, document_name, heading_path as path, string_split(heading_path, ' > ')[-1] as last_part from k where chunk_type = 'heading' and heading_path <> ''),
        bl as (select chunk_id, document_name, unnest(list_transform(range(1, len(string_split(heading_path, ' > ')) + 1), lambda i: array_to_string(string_split(heading_path, ' > ')[1:i], ' > '))) as path from k where chunk_type = 'paragraph' and heading_path <> ''),
        cc as (select distinct canonical_id, name, unnest(source_chunks) as chunk_id from canonical_concepts), fm as (select *, list_filter([{_FORMS}], lambda f: f <> '') as forms from hd),
        he as (select distinct head, forms, canonical_id, name from fm join bl using (document_name, path) join cc using (chunk_id)), mk as (select head, canonical_id, bool_or(coalesce({_CMP.format(t='name')} <> '' and len(list_filter(forms, lambda f: contains(f, {_CMP.format(t='name')}) or contains({_CMP.format(t='name')}, f))) > 0, false)) as theme from he group by 1, 2),
        th as (select head, canonical_id as src from mk where theme), ow as (select distinct hd.head, canonical_id as src from hd join cc on cc.chunk_id = hd.head where hd.head in (select head from mk) and hd.head not in (select head from th)), ev as (select * from th union all select * from ow)
        select distinct ev.src, mk.canonical_id as dst, 0.85::double as confidence from ev join mk on mk.head = ev.head where (mk.head, mk.canonical_id) not in (select (head, src) from ev)""",
    "orphan_cleanup": f"with {CG._E}, n as (select src as node from e union select dst from e), o as (select node from n where contains(node, '__virtual_') and node not in (select src from e)) select src, dst, rel from e where src not in (select node from o) and dst not in (select node from o)",
    "virtual_nodes": f"""with {CG._E}, i as (select dst as node, count(distinct src) as n_in, array_to_string(list_sort(list(distinct src)), '|') as sources from e where contains(dst, '__virtual_') and not contains(src, '__virtual_') group by 1),
        o as (select src as node, count(distinct dst) as n_out, array_to_string(list_sort(list(distinct dst)), '|') as targets from e where contains(src, '__virtual_') and not contains(dst, '__virtual_') group by 1)
        select coalesce(i.node, o.node) as node, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(sources, '') as sources, coalesce(targets, '') as targets from i full join o on i.node = o.node""",
    "edge_levels": f"""with {CG._E}, {CG._T}, ty as (select node, min(type) as type from t group by 1), rl(pt, ct, rel) as (values {_RELS}), x as (select distinct src, dst, e.rel, a.type as a, b.type as b, coalesce(list_position({_CHAIN}, a.type), 0) as i, coalesce(list_position({_CHAIN}, b.type), 0) as j from e join ty a on a.node = src join ty b on b.node = dst)
        select src, dst, x.rel, (case when i > 0 and j > 0 then greatest(0, abs(i - j) - 1) else 0 end)::int as levels, coalesce(rl.rel, 'DEPEND_ON') as called_for from x left join rl on pt = a and ct = b""",
    "vague_names": "with c as (select distinct canonical_id, name from canonical_concepts where name is not null) select length(name)::int as chars, length(name) <= 4 and ("
    + " or ".join([*(f"ends_with(lower(name), '{w}')" for w in T.VAGUE_ENDS), *(f"starts_with(lower(name), '{w}')" for w in T.VAGUE_STARTS)])
    + ") as vague, count(*) as n from c group by 1, 2",
    "dedupe_stats": "with c as (select distinct canonical_id, coalesce(concept_type, 'unknown') as concept_type from canonical_concepts) select concept_type, count(*) as n from c group by 1 order by n desc, concept_type limit 20",
}
_LADDER = CL.SQL["pair_classify"]
for _old, _new in (
    (" from z)", " from z)"),
    ("cont, contains(l, r) or contains(r, l) or contains(lb, rb) or contains(rb, lb) as edge,", "cont, contains(l, r) or contains(r, l) or (lb <> rb and (contains(lb, rb) or contains(rb, lb))) as edge, coalesce(sc, 0) as sim,"),
    (" from x),", " from x left join (select a as sl, b as sr, score as sc from co) on sl = l and sr = r),"),
    ("when mark and cont then 5 else 6 end as rule from y where ex or lb = rb or edge)", "when mark and (cont or sim >= 0.85) then 5 when edge then 6 when sim >= 0.94 then 7 when sim >= 0.85 then 8 when sim >= 0.72 then 9 end as rule from y where ex or lb = rb or edge or sim >= 0.72)"),
    ("case when rule in (4, 6) then 'NARROWER_THAN' when rule = 5 then 'RELATED_TO' else 'SAME_AS' end as relation from z", "case when rule in (4, 6) then 'NARROWER_THAN' when rule in (5, 9) then 'RELATED_TO' else 'SAME_AS' end as relation from z where rule is not null"),
    ("when 3 then 0.88 when 4 then 0.8 when 5 then 0.8 else 0.76 end)", "when 3 then greatest(0.88, sim) when 4 then greatest(0.8, sim) when 5 then greatest(0.8, sim) when 6 then greatest(0.76, sim) else sim end)"),
    ("when rule = 3 then 'review'", "when rule = 7 then 'auto_merge' when rule in (3, 8) then 'review'"),
    ("with m as", "with c as (select norm as k, name as t from (" + CL.SQL["name_profiles"] + ")), " + _COS + ", m as"),
):
    assert _old in _LADDER, _old
    _LADDER = _LADDER.replace(_old, _new, 1)
SQL["pair_classify_likeness"] = _LADDER
