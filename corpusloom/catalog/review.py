"""Queries of reviews, aliases and the rows that build the graph; contexts of gaps and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.catalog import concepts as CC
from corpusloom.catalog import graph as CG
from corpusloom.catalog import learning as CL
from corpusloom.catalog import lifecycle as LC
from corpusloom.functions import irt
from corpusloom.functions import text as T
from corpusloom.operators import concepts as C
from corpusloom.operators import graph as G
from corpusloom.operators import likeness as N
from corpusloom.operators import linking
from corpusloom.operators import resolve as E
from corpusloom.operators import review as R
from corpusloom.plans.lineage import cut
from corpusloom.sources.tables import table


def aliases_cleaned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").where("name is not null").select("canonical_id", "name", "aliases").distinct()
    return c.select("canonical_id", F.array_join(R.cleaned_aliases(F.col("aliases"), F.col("name")), "|").alias("aliases")).distinct()


def inline_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What documents write as X (Y), by the length of X."""
    x = table(spark, d, "documents").select(F.explode(R.inline_aliases(F.col("text"))).alias("p"))
    return x.groupBy(F.length("p.left").alias("chars")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p.left").alias("terms"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("payload_json", "relation string, confidence double, signals array<string>")
    return table(spark, d, "merge_candidates").withColumn("p", p)


def pairs_best(spark: SparkSession, d: str) -> DataFrame:
    x = _candidates(spark, d).select(F.col("left_name").alias("left"), F.col("right_name").alias("right"), "p.relation", "p.confidence", "p.signals")
    return R.best_pairs(x).withColumn("signals", F.array_join("signals", "|"))


def group_names(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the nightly build under their reviewers' names."""
    said = F.lower(F.trim("decision")) == "merge"
    m = table(spark, d, "merge_candidates").where(said & (F.col("build_id") == "build_nightly_main"))
    return R.chosen_names(m.select(F.col("left_name").alias("left"), F.col("right_name").alias("right"), F.col("canonical_name").alias("chosen")))


def advice_checked(spark: SparkSession, d: str) -> DataFrame:
    proven = F.array_contains("p.signals", "explicit_alias_evidence")
    x = _candidates(spark, d).select("candidate_id", "build_id", "reviewed_at", F.col("left_name").alias("left"), F.col("right_name").alias("right"), "decision", "p.confidence", "canonical_name", proven.alias("proven"), (F.col("p.relation") == "SAME_AS").alias("same_type"))
    return R.checked_advice(x.distinct()).select("candidate_id", "build_id", "reviewed_at", "decision", "confidence", "canonical_name")


def review_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gate(table(spark, d, "merge_candidates"), "build_id", "candidate_id")


def bulk_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that may be confirmed together: undecided, ready, without conflict, sure."""
    x = _candidates(spark, d).where("trim(coalesce(decision, '')) = '' and advisor_status = 'ready' and coalesce(advisor_conflict, 0) = 0 and p.confidence >= 0.9")
    return x.select("candidate_id", "build_id", F.round("p.confidence", 6).alias("confidence")).distinct()


def mention_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "canonical_concepts").select("canonical_id", "name", "concept_type", F.explode("source_chunks").alias("chunk_id")).distinct()
    return R.mention_nodes(m, "chunk_id", "name", "canonical_id").select("chunk_id", "canonical_id", "name")


def bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts")
    return R.bridge_edges(c, E.name_mapping(c)).groupBy("dst", "rel").agg(F.count(F.lit(1)).alias("n"))


def chunk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as nodes: page numbers from whatever they are stored as, paths without a folder."""
    k = table(spark, d, "chunks").select("chunk_id", "page_number", "media_refs", "ingested_at")
    first = F.element_at("media_refs", F.lit(1))
    last = F.max_by(F.struct(F.concat(F.lit("["), F.col("page_number").cast("string"), F.lit("]")).alias("stored"), F.when(F.size("media_refs") > 0, first["path"]).alias("path")), "ingested_at")
    x = k.groupBy("chunk_id").agg(last.alias("s"))
    return x.select("chunk_id", R.page_number(F.col("s.stored")).alias("page"), F.element_at(F.split("s.path", "/"), -1).alias("image"))


def paragraph_index(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs whose parent is a heading."""
    k = table(spark, d, "chunks").select("chunk_id", "parent_id", "chunk_type").distinct()
    heads = k.where("chunk_type = 'heading'").select(F.col("chunk_id").alias("parent_id")).distinct()
    return k.where("chunk_type = 'paragraph'").join(heads, "parent_id", "left_semi").select("chunk_id", "parent_id")


def gap_context(spark: SparkSession, d: str) -> DataFrame:
    """For each gap up to sixteen edges at its ends and eight chunks of its concepts (the caps are the feature)."""
    g = LC._stored(spark, d).select("gap_id", "src", "dst").distinct()
    ends = g.select("gap_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    e = CG._edges(spark, d).select("src", "dst", "rel", "confidence")
    both = e.select(F.col("src").alias("node"), "*").unionByName(e.select(F.col("dst").alias("node"), "*"))
    near = ends.join(both, "node").select("gap_id", F.concat_ws(">", "src", "rel", "dst").alias("edge"), "confidence").distinct()
    top = C.first_n(near, ["gap_id"], [F.col("confidence").desc(), F.col("edge")], 16).groupBy("gap_id").agg(F.array_join(F.array_sort(F.collect_list("edge")), "|").alias("edges"))
    k = table(spark, d, "canonical_concepts").select(F.col("canonical_id").alias("node"), F.explode("source_chunks").alias("chunk_id"))
    chunks = C.first_n(ends.join(k, "node").select("gap_id", "chunk_id").distinct(), ["gap_id"], [F.col("chunk_id")], 8).groupBy("gap_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), "|").alias("chunks"))
    return g.select("gap_id").join(top, "gap_id", "left").join(chunks, "gap_id", "left").select("gap_id", F.coalesce("edges", F.lit("")).alias("edges"), F.coalesce("chunks", F.lit("")).alias("chunks"))


def related_media(spark: SparkSession, d: str) -> DataFrame:
    """Media of the chunks of each root's trimmed subgraph, one of each path."""
    c = table(spark, d, "canonical_concepts").select(F.col("canonical_id").alias("node"), F.explode("source_chunks").alias("chunk_id")).distinct()
    m = table(spark, d, "chunks").select("chunk_id", F.explode("media_refs").alias("m")).where("m.path <> ''").select("chunk_id", "m.path", "m.caption")
    x = CC.context_trim(spark, d).join(c, "node").join(m, "chunk_id")
    return x.groupBy("seed", "path").agg(F.min("caption").alias("caption"))


def concept_irt(spark: SparkSession, d: str) -> DataFrame:
    """Item parameters of concepts before any answer: difficulty by place in the graph and description."""
    c = table(spark, d, "canonical_concepts").groupBy(F.col("canonical_id").alias("node")).agg(F.max("description").alias("description"))
    x = c.join(CG.pagerank10(spark, d), "node").join(G.degrees(CG._edges(spark, d)), "node", "left").fillna(0, ["n_neighbours"])
    return x.select("node", F.lit(1.0).alias("a"), irt.heuristic_b(F.round("score", 3), F.col("n_neighbours"), F.col("description")).alias("b"), F.lit(irt.GUESS).alias("c"))


def question_cache(spark: SparkSession, d: str) -> DataFrame:
    """The earlier question of the same subject that a cache would answer with: the same text, else one alike by 0.95."""
    q = table(spark, d, "question_bank").where("question <> '' and subject is not null").groupBy("id").agg(F.min("subject").alias("subject"), F.min("question").alias("question"), F.min("created_at").alias("at"))
    q = q.withColumn("norm", F.md5(T.normalized_question(F.col("question"))))
    q = cut(N.word_rows(q, F.col("question")).drop("question"))
    earlier = F.min("id").over(Window.partitionBy("subject", "norm").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    same = q.select("id", earlier.alias("hit"), F.lit(0).alias("how"), F.lit(-1.0).alias("s")).where("hit is not null")
    near = N.alike(q.drop("norm"), "id", 0.95, "subject")
    later = F.struct("b.at", "b.id") > F.struct("a.at", "a.id")
    near = near.select(F.when(later, F.col("b.id")).otherwise(F.col("a.id")).alias("id"), F.when(later, F.col("a.id")).otherwise(F.col("b.id")).alias("hit"), F.lit(1).alias("how"), (-F.col("score")).alias("s"))
    best = same.unionByName(near).groupBy("id").agg(F.min(F.struct("how", "s", "hit")).alias("m"))
    return best.select("id", "m.hit", F.when(F.col("m.how") == 0, "exact").otherwise("near").alias("how"))


def embedding_variance(spark: SparkSession, d: str) -> DataFrame:
    """Share of the variance that the five largest principal axes explain."""
    return linking.explained_variance(table(spark, d, "embeddings"), "embedding", 5)


QUERIES = {
    f.__name__: f
    for f in (
        aliases_cleaned, inline_pairs, pairs_best, group_names, advice_checked, review_gate, bulk_eligible, mention_nodes, bridge_edges, chunk_nodes, paragraph_index, gap_context,
        related_media, concept_irt, question_cache, embedding_variance,
    )
}

_NORM = CL._NORM
_P = "m as (select *, json_extract_string(payload_json, '$.relation') as relation, json_extract(payload_json, '$.confidence')::double as conf, from_json(json_extract(payload_json, '$.signals'), '[\"varchar\"]') as signals from merge_candidates)"
_TIDY = "regexp_replace({c}, '^[ ：:，,。.;；]+|[ ：:，,。.;；]+$', '', 'g')"
_LATIN = "\\b([A-Za-z][A-Za-z0-9.+_-]{1,30})\\s*[（(]\\s*([^()（）]{1,80})\\s*[)）]"
_HAN = "([\\x{4E00}-\\x{9FFF}]{2,20})\\s*[（(]\\s*([A-Z][A-Z0-9.+_-]{1,20})\\s*[)）]"

SQL = {
    "aliases_cleaned": f"""with c as (select distinct canonical_id, name, aliases from canonical_concepts where name is not null), x as (select *, list_filter(list_transform(coalesce(aliases, []), lambda a: trim(coalesce(a, ''), ' ')), lambda a: a <> '') as tr from c),
        y as (select *, list_transform(tr, lambda a: {_NORM.format(n='a')}) as ns, {_NORM.format(n='name')} as own from x)
        select distinct canonical_id, array_to_string(list_transform(list_filter(tr, lambda a, i: ns[i] <> '' and ns[i] <> own and list_position(ns, ns[i]) = i), lambda a: substr(a, 1, 120)), '|') as aliases from y""",
    "inline_pairs": f"with x as (select unnest(list_concat(regexp_extract_all(text, '{_LATIN}', 1), regexp_extract_all(text, '{_HAN}', 1))) as l from documents), y as (select {_TIDY.format(c='l')} as l from x) select length(l)::int as chars, count(*) as n, count(distinct l) as terms from y group by 1",
    "pairs_best": f"""with {_P}, x as (select *, least({_NORM.format(n='left_name')}, {_NORM.format(n='right_name')}) as l, greatest({_NORM.format(n='left_name')}, {_NORM.format(n='right_name')}) as r from m where left_name is not null and right_name is not null),
        b as (select l, r, max((coalesce(conf, 0), left_name, right_name, relation)) as b, count(*) as n, array_to_string(list_sort(list_distinct(flatten(list(coalesce(signals, []))))), '|') as signals from x where l <> '' and r <> '' and l <> r group by 1, 2)
        select b[2] as left, b[3] as right, b[4] as relation, b[1] as confidence, n, signals from b""",
    "group_names": """with recursive m as (select distinct left_name as l, right_name as r, canonical_name as c from merge_candidates where lower(trim(decision, ' ')) = 'merge' and build_id = 'build_nightly_main' and left_name <> '' and right_name <> '' and left_name <> right_name), u as (select l as a, r as b from m union select r, l from m),
        t as (select distinct a as node, a as other from u union select t.node, u.b from t join u on u.a = t.other), k as (select node, min(other) as comp from t group by 1),
        p as (select a.comp, arg_min(m.c, (least(l, r), greatest(l, r), m.c)) as pick from m join k a on a.node = l join k b on b.node = m.c and b.comp = a.comp where m.c <> '' group by 1) select node as member, coalesce(pick, k.comp) as name from k left join p on p.comp = k.comp""",
    "advice_checked": f"""with {_P}, d as (select distinct candidate_id, build_id, reviewed_at, left_name, right_name, decision, conf, canonical_name, list_contains(signals, 'explicit_alias_evidence') as proven, relation = 'SAME_AS' as same_type from m),
        x as (select *, case when upper(trim(coalesce(decision, ''), ' ')) in ('MERGE', 'SEPARATE', 'UNCERTAIN') then upper(trim(decision, ' ')) else 'UNCERTAIN' end as said, greatest(0.0, least(1.0, coalesce(conf, 0))) as sure, trim(coalesce(canonical_name, ''), ' ') as nm from d),
        y as (select *, said = 'MERGE' and not (coalesce(nm = left_name, false) or coalesce(nm = right_name, false)) as stray from x), z as (select *, said = 'MERGE' and not stray as mg from y)
        select candidate_id, build_id, reviewed_at, case when stray then 'UNCERTAIN' else said end as decision, round(case when stray then least(sure, 0.49) when mg and not (coalesce(proven, false) and coalesce(same_type, true)) then least(sure, 0.89) else sure end, 4)::double as confidence, case when mg then nm else '' end as canonical_name from z""",
    "review_gate": "with c as (select build_id, candidate_id, bool_or(coalesce(trim(decision, ' ') <> '', false)) as done from merge_candidates group by 1, 2) select build_id, count(*) as candidates, count_if(done)::bigint as resolved, count_if(not done)::bigint as unresolved, count_if(not done) = 0 as passed from c group by 1",
    "bulk_eligible": f"with {_P} select distinct candidate_id, build_id, round(conf, 6) as confidence from m where trim(coalesce(decision, ''), ' ') = '' and advisor_status = 'ready' and coalesce(advisor_conflict, 0) = 0 and conf >= 0.9",
    "mention_nodes": "with m as (select distinct canonical_id, name, unnest(source_chunks) as chunk_id from canonical_concepts where trim(name, ' ') <> ''), r as (select *, row_number() over (partition by chunk_id, lower(trim(name, ' ')) order by canonical_id, name) as i from m) select chunk_id, canonical_id, name from r where i = 1 and chunk_id is not null",
    "bridge_edges": f"with h as (select unnest(source_chunks) as src, canonical_id as dst, 'HAS_CONCEPT' as rel from canonical_concepts union select key, canonical_id, 'DERIVED_FROM' from ({CL.SQL['name_map']})) select dst, rel, count(*) as n from h where src <> '' and dst <> '' group by 1, 2",
    "chunk_nodes": "with k as (select chunk_id, arg_max({'p': page_number, 'm': case when len(media_refs) > 0 then media_refs[1].path end}, ingested_at) as s from chunks group by 1) select chunk_id, s.p as page, string_split(s.m, '/')[-1] as image from k",
    "paragraph_index": "select distinct chunk_id, parent_id from chunks where chunk_type = 'paragraph' and parent_id in (select chunk_id from chunks where chunk_type = 'heading')",
    "gap_context": f"""with {LC._G}, {CG._E}, gg as (select distinct gap_id, src, dst from st), en as (select gap_id, src as node from gg union select gap_id, dst from gg), bo as (select src as node, * from e union all select dst, * from e),
        nr as (select distinct gap_id, src || '>' || rel || '>' || dst as edge, confidence from en join bo using (node)), ed as (select *, row_number() over (partition by gap_id order by confidence desc, edge) as i from nr), et as (select gap_id, array_to_string(list_sort(list(edge)), '|') as edges from ed where i <= 16 group by 1),
        ck as (select distinct gap_id, chunk_id from en join (select canonical_id as node, unnest(source_chunks) as chunk_id from canonical_concepts) using (node)), cr as (select *, row_number() over (partition by gap_id order by chunk_id) as i from ck), ct as (select gap_id, array_to_string(list_sort(list(chunk_id)), '|') as chunks from cr where i <= 8 group by 1)
        select distinct gg.gap_id, coalesce(edges, '') as edges, coalesce(chunks, '') as chunks from gg left join et using (gap_id) left join ct using (gap_id)""",
    "related_media": f"with {CC._TRIM}, c as (select distinct canonical_id as node, unnest(source_chunks) as chunk_id from canonical_concepts), md as (select chunk_id, unnest(media_refs) as m from chunks) select seed, m.path as path, min(m.caption) as caption from t join c using (node) join md using (chunk_id) where m.path <> '' group by 1, 2",
    "concept_irt": f"""with {CG._E}, p as ({CG.SQL['pagerank10']}), c as (select canonical_id as node, max(description) as description from canonical_concepts group by 1), u as (select src as a, dst as b from e union select dst, src from e), g as (select a as node, count(distinct b) as n from u group by 1)
        select c.node, 1.0::double as a, round_even(0.3 * (1 - round(score, 3)) + 0.3 * least(coalesce(n, 0) / 10, 1.0) + 0.2 * least(coalesce(length(description), 0) / 500, 1.0) + 0.1 - 0.5, 2) as b, 0.25::double as c from c join p using (node) left join g using (node)""",
    "question_cache": "with q as (select id, min(subject) as subject, min(question) as question, min(created_at) as at from question_bank where question <> '' and subject is not null group by 1), c as (select id as k, question as t from q), "
    + CC._COS.replace("0.72", "0.95")
    + """, n as (select *, md5(lower(regexp_replace(question, '\\s+', '', 'g'))) as norm from q), bo as (select a, b, score from co union all select b, a, score from co),
        hits as (select a.id, b.id as hit, 0 as how, -1.0 as sc from n a join n b on a.subject = b.subject and a.norm = b.norm and (b.at, b.id) < (a.at, a.id) union all select a.id, b.id, 1, -score from bo join n a on a.id = bo.a join n b on b.id = bo.b and a.subject = b.subject and (b.at, b.id) < (a.at, a.id))
        select id, arg_min(hit, (how, sc, hit)) as hit, case when min(how) = 0 then 'exact' else 'near' end as how from hits group by 1""",
}
