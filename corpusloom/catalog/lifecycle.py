"""Queries over stored gaps: listing, import, changes of status, filling, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import graph as CG
from corpusloom.operators import gaps as GP
from corpusloom.operators.graph import VIRTUAL
from corpusloom.sources.tables import table


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Detected gaps under a readable name, with the relation of their edge."""
    g = GP.edge_gaps(CG._edges(spark, d), CG._types(spark, d), GP.THEORY).where("outcome = 'gap'")
    return g.withColumn("gap_id", F.concat_ws("|", "src", "dst", F.array_join("missing", ",")))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """A store of gaps: status and version told by the relation, changed when the target was."""
    at = table(spark, d, "canonical_concepts").groupBy(F.col("canonical_id").alias("dst")).agg(F.max("updated_at").alias("updated_at"))
    status = F.when(F.col("rel") == "EXTENDS", "ignored").when(F.col("rel") == "APPLIES_TO", "obsolete").otherwise("open")
    g = _gaps(spark, d).groupBy("gap_id", "src", "dst", "missing", "replacement").agg(F.min(status).alias("status"), F.count(F.lit(1)).alias("version"))
    return g.join(at, "dst", "left")


def gap_listed(spark: SparkSession, d: str) -> DataFrame:
    """The first page of ten open gaps that miss a law (paging is the feature)."""
    return GP.listed(_stored(spark, d), "open", "law", 10).select("gap_id", "updated_at")


def gap_statuses(spark: SparkSession, d: str) -> DataFrame:
    return GP.by_status(_stored(spark, d))


def gap_imported(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of confident edges are stored, then all are imported."""
    sure = CG._edges(spark, d).where("confidence >= 0.8").select("src", "dst").distinct()
    return GP.imported(_stored(spark, d).join(sure, ["src", "dst"], "left_semi"), _gaps(spark, d))


def gap_moved(spark: SparkSession, d: str) -> DataFrame:
    """Every gap is to be ignored as if it were open in its first version; one isn't there."""
    s = _stored(spark, d)
    w = s.select("gap_id").unionByName(spark.createDataFrame([("none",)], "gap_id string"))
    return GP.moved(s, w.select("gap_id", F.lit("open").alias("old"), F.lit("ignored").alias("new"), F.lit(1).cast("bigint").alias("expected")))


def gap_supplemented(spark: SparkSession, d: str) -> DataFrame:
    """Open gaps that miss one type are filled with a new node."""
    fill = _stored(spark, d).where("status = 'open' and size(missing) = 1")
    fill = fill.select("src", "dst", F.array(F.concat(F.lit("new:"), "gap_id")).alias("nodes"), "replacement")
    return GP.supplemented(CG._edges(spark, d).select("src", "dst", "rel"), fill)


def virtual_migration(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders as gaps; the type is that of the concept whose id they begin with."""
    t = CG._types(spark, d)
    kind = F.regexp_extract("node", r"(definition|law|application|extension)", 1)
    return GP.migrated(CG._edges(spark, d), t, VIRTUAL, F.when(kind != "", kind).otherwise("law"), GP.THEORY)


def gap_queries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").groupBy("canonical_id").agg(F.max("name").alias("n"), F.max(F.coalesce("aliases", F.array().cast("array<string>"))).alias("al"))
    x = _stored(spark, d).select("gap_id", "src", "dst", "missing").distinct()
    x = x.join(c.toDF("src", "sn", "sa"), "src").join(c.toDF("dst", "tn", "ta"), "dst")
    q = GP.search_queries(F.col("sn"), F.col("tn"), F.col("sa"), F.col("ta"), F.col("missing"))
    return x.select("gap_id", F.posexplode(q).alias("pos", "query"))


QUERIES = {f.__name__: f for f in (gap_listed, gap_statuses, gap_imported, gap_moved, gap_supplemented, virtual_migration, gap_queries)}

_G = f"""g as (select *, src || '|' || dst || '|' || missing as gap_id from ({CG._GAP}) where outcome = 'gap'),
    ch as (select canonical_id as dst, max(updated_at) as updated_at from canonical_concepts group by 1),
    st as (select gap_id, src, dst, missing, replacement, min(case rel when 'EXTENDS' then 'ignored' when 'APPLIES_TO' then 'obsolete' else 'open' end) as status, count(*) as version from g group by 1, 2, 3, 4, 5)"""
_V = VIRTUAL
_TIDY = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_TERMS = "list_filter(list_concat(list_transform(({a})[1:2], lambda v: " + _TIDY.format(c="v") + "), [" + _TIDY.format(c="{n}") + "]), lambda v: v <> '')"


def _distinct(expression: str) -> str:
    """DuckDB: a list without repeats, in order."""
    return f"list_filter({expression}, lambda v, i: list_position({expression}, v) = i)"


SQL = {
    "gap_listed": f"with {_G} select gap_id, updated_at from st left join ch using (dst) where status = 'open' and list_contains(string_split(missing, ','), 'law') order by updated_at desc nulls last, gap_id limit 10",
    "gap_statuses": f"with {_G}, sp as (select unnest(['open', 'ignored', 'supplemented', 'obsolete']) as status), n as (select status, count(*) as n from st group by 1) select status, coalesce(n, 0) as n from sp left join n using (status)",
    "gap_imported": f"""with {_G}, {CG._E}, su as (select distinct src, dst from e where confidence >= 0.8), o as (select * from st where (src, dst) in (select (src, dst) from su)), nw as (select distinct gap_id from g)
        select nw.gap_id, case when o.gap_id is null or status = 'obsolete' then 'open' else status end as status, case when o.gap_id is null then 1 else version + 1 end as version,
            case when o.gap_id is null then 'created' when status = 'obsolete' then 'reopened' else 'refreshed' end as action from nw left join o using (gap_id)""",
    "gap_moved": f"""with {_G}, w as (select gap_id from st union all select 'none') select w.gap_id, case when st.gap_id is null then 'not_found' when status = 'open' and version = 1 then 'done' else 'conflict' end as outcome,
        case when status = 'open' and version = 1 then 'ignored' else status end as status, case when status = 'open' and version = 1 then 2 else version end as version from w left join st using (gap_id)""",
    "gap_supplemented": f"""with {_G}, {CG._E}, f as (select src, dst, 'new:' || gap_id as node, string_split(replacement, ',') as rp from st where status = 'open' and not contains(missing, ','))
        select distinct src, dst, rel from e where (src, dst) not in (select (src, dst) from f) union select src, node, rp[1] from f union select node, dst, rp[2] from f""",
    "virtual_migration": f"""with {CG._E}, {CG._T}, ty as (select node, min(type) as type from t group by 1), i as (select dst as node, count(*) as n, min((src, rel, confidence)) as m from e where contains(dst, '{_V}') and not contains(src, '{_V}') group by 1),
        o as (select src as node, count(*) as n, min((dst, rel, confidence)) as m from e where contains(src, '{_V}') and not contains(dst, '{_V}') group by 1), n as (select src as node from e where contains(src, '{_V}') union select dst from e where contains(dst, '{_V}')),
        x as (select node, coalesce(nullif(regexp_extract(node, '(definition|law|application|extension)', 1), ''), 'law') as kind, i.m[1] as src, o.m[1] as dst, i.m[2] as r1, o.m[2] as r2, least(i.m[3], o.m[3]) as c, coalesce(i.n = 1 and o.n = 1 and i.m[1] <> o.m[1], false) as fit from n left join i using (node) left join o using (node)),
        re as (select distinct src, dst from e where not contains(src, '{_V}') and not contains(dst, '{_V}')), na as (select distinct x.node from x join re a on a.src = x.src join re b on b.src = a.dst and b.dst = x.dst join ty on ty.node = a.dst and ty.type = x.kind where fit)
        select node, case when fit then src end as src, case when fit then dst end as dst, case when fit then kind end as missing, case when fit then r1 || ',' || r2 end as replacement, case when fit then c end as confidence,
            case when not fit then 'skipped' when node in (select node from na) then 'natural' else 'gap' end as outcome from x""",
    "gap_queries": f"""with {_G}, c as (select canonical_id, max(name) as n, max(coalesce(aliases, [])) as al from canonical_concepts group by 1),
        x as (select distinct gap_id, {_TERMS.format(a='a.al', n='a.n')} as s0, {_TERMS.format(a='b.al', n='b.n')} as t0, string_split(missing, ',') as m from st join c a on a.canonical_id = src join c b on b.canonical_id = dst),
        y as (select gap_id, {_distinct('s0')} as s, {_distinct('t0')} as t, m from x),
        z as (select gap_id, list_transform([array_to_string(list_concat(list_concat(s[1:2], m), t[1:2]), ' '), array_to_string(list_concat(s[1:1], t[1:1]), ' '), array_to_string(list_concat(s[-1:], m), ' ')], lambda q: substr(q, 1, 300)) as q from y),
        u as (select gap_id, list_filter({_distinct('q')}, lambda v: v <> '')[1:5] as q from z) select gap_id, (i - 1)::int as pos, q[i] as query from (select gap_id, q, unnest(range(1, len(q) + 1)) as i from u)""",
}
