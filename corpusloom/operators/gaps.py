"""Structural gaps of a typed graph against a paradigm.

A paradigm is a small table of types in order and of relations between types; both are
literals of fixed size, so their joins are maps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Paradigm:
    """Types in ideal order, relations by (source type, target type), and legal roots."""

    name: str
    chain: tuple[str, ...]
    relations: dict[tuple[str, str], str]
    roots: tuple[str, ...] = ()
    cyclic: bool = False
    aliases: dict[str, str] = field(default_factory=dict)


# The built-in paradigms.
THEORY = Paradigm(
    "theory", ("definition", "law", "application", "extension"),
    {("definition", "law"): "HAS_LAW", ("definition", "application"): "APPLIES_TO", ("law", "application"): "APPLIES_TO", ("definition", "extension"): "EXTENDS", ("law", "extension"): "EXTENDS", ("application", "extension"): "EXTENDS"},
    roots=("definition",),
)
ENGINEERING = Paradigm("engineering", ("requirement", "technology"), {("requirement", "technology"): "IMPLEMENTS", ("technology", "requirement"): "DEPEND_ON", ("technology", "technology"): "DEPEND_ON"}, cyclic=True)
HIERARCHICAL = Paradigm("hierarchical", ("fact", "concept", "method", "evaluation"), {("fact", "concept"): "DEFINES_AS", ("concept", "method"): "USES", ("method", "evaluation"): "EVALUATES"}, roots=("fact",))


def _place(kind: Column, p: Paradigm) -> Column:
    """Position in the chain from 1; 0 for another type, null for none."""
    return F.array_position(F.array(*map(F.lit, p.chain)), kind)


def _path(types: Column, p: Paradigm) -> Column:
    """Relations between neighbouring types; null where one is missing."""
    m = F.create_map(*[F.lit(x) for (a, b), r in p.relations.items() for x in (f"{a}>{b}", r)])
    steps = F.transform(F.sequence(F.lit(1), F.size(types) - 1), lambda i: m[F.concat(F.element_at(types, i), F.lit(">"), F.element_at(types, i + 1))])
    return F.when(~F.exists(steps, lambda s: s.isNull()), steps)


def gap_id(subject: Column, paradigm: str, source: Column, target: Column, missing: Column, version: str = "v1") -> Column:
    """gap_ and the SHA-256 of the canonical JSON of what defines a gap."""
    q = lambda c: F.regexp_replace(F.to_json(F.array(F.trim(F.coalesce(c, F.lit(""))))), r"^\[|\]$", "")
    doc = F.concat(F.lit('{"detector_version":"' + version + '","missing_types":'), F.to_json(missing), F.lit(',"paradigm_id":"' + paradigm + '","source_id":'), q(source), F.lit(',"subject_id":'), q(subject), F.lit(',"target_id":'), q(target), F.lit("}"))
    return F.concat(F.lit("gap_"), F.sha2(doc, 256))


def edge_gaps(edges: DataFrame, types: DataFrame, p: Paradigm) -> DataFrame:
    """(src, dst, rel, outcome, missing, replacement) for every edge.

    ``types`` has node and type. Outcomes: ok, gap, unknown_endpoint, self_loop,
    type_not_in_chain, illegal_direction, missing_replacement_relation. A cyclic paradigm
    takes an edge within one type as a gap of the type between.
    """
    t = types.groupBy("node").agg(F.min("type").alias("type"))
    e = edges.select("src", "dst", "rel").distinct()
    e = e.join(t.select(F.col("node").alias("src"), F.col("type").alias("st")), "src", "left").join(t.select(F.col("node").alias("dst"), F.col("type").alias("tt")), "dst", "left")
    i, j = _place(F.col("st"), p), _place(F.col("tt"), p)
    chain = F.array(*map(F.lit, p.chain))
    n = len(p.chain)
    if p.cyclic:
        missing = F.when(i == j, F.array(F.element_at(chain, (F.pmod(i, F.lit(n)) + 1).cast("int"))))
        wrong = (i != j) & (j != F.pmod(i, F.lit(n)) + 1)
    else:
        missing = F.when(j > i + 1, F.slice(chain, (i + 1).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int")))
        wrong = j <= i
    e = e.withColumn("missing", F.when((i > 0) & (j > 0), missing))
    e = e.withColumn("replacement", F.when(F.col("missing").isNotNull(), _path(F.concat(F.array("st"), "missing", F.array("tt")), p)))
    outcome = (
        F.when(F.col("st").isNull() | F.col("tt").isNull(), "unknown_endpoint").when(F.col("src") == F.col("dst"), "self_loop").when((i == 0) | (j == 0), "type_not_in_chain")
        .when(wrong, "illegal_direction").when(F.col("missing").isNull(), "ok").when(F.col("replacement").isNull(), "missing_replacement_relation").otherwise("gap")
    )
    return e.select("src", "dst", "rel", outcome.alias("outcome"), "missing", "replacement")


def root_gaps(edges: DataFrame, types: DataFrame, p: Paradigm) -> DataFrame:
    """(node, missing, replacement): nodes without an incoming edge that skip the chain's start."""
    t = types.groupBy(F.col("node")).agg(F.min("type").alias("type"))
    first = min(p.chain.index(r) + 1 for r in p.roots)
    i = _place(F.col("type"), p)
    top = t.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").where(~F.col("type").isin(*p.roots)).withColumn("i", i).where(F.col("i") > first)
    missing = F.slice(F.array(*map(F.lit, p.chain)), F.lit(first), (F.col("i") - first).cast("int"))
    top = top.withColumn("missing", missing)
    top = top.withColumn("replacement", _path(F.concat("missing", F.array("type")), p))
    return top.where("replacement is not null").select("node", "missing", "replacement")


def reconcile(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Merge newly found gap ids into stored ones: (gap_id, status, action).

    New ids are inserted as open, open and supplemented ones that vanished become obsolete,
    obsolete ones found again are reopened; ignored ones stay.
    """
    s, f = stored.select("gap_id", F.col("status").alias("old")), found.select("gap_id").distinct().withColumn("now", F.lit(True))
    x = s.join(f, "gap_id", "full_outer")
    gone = F.col("now").isNull() & F.col("old").isin("open", "supplemented")
    status = F.when(F.col("old").isNull(), "open").when(gone, "obsolete").when(F.col("now") & (F.col("old") == "obsolete"), "open").otherwise(F.col("old"))
    action = F.when(F.col("old").isNull(), "inserted").when(gone, "obsoleted").when(F.col("now") & (F.col("old") == "obsolete"), "reopened").when(F.col("now"), "refreshed").otherwise("kept")
    return x.select("gap_id", status.alias("status"), action.alias("action"))


#: Statuses a stored gap can have.
STATUSES = ("open", "ignored", "supplemented", "obsolete")


def listed(stored: DataFrame, status: str | None = "open", missing: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of stored gaps, the last changed first (paging is the feature, 200 rows at most)."""
    x = stored if status is None else stored.where(F.col("status") == status)
    x = x if missing is None else x.where(F.array_contains("missing", missing))
    return x.orderBy(F.col("updated_at").desc_nulls_last(), "gap_id").offset(max(0, offset)).limit(max(1, min(limit, 200)))


def by_status(stored: DataFrame) -> DataFrame:
    """(status, n) of stored gaps, zero for a status that none has."""
    n = stored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    spine = stored.sparkSession.createDataFrame([(x,) for x in STATUSES], "status string")
    return spine.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def imported(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored gaps after an import that makes none obsolete: (gap_id, status, version, action).

    New ids are created as open, known ones refreshed with a higher version, obsolete ones
    reopened; the others are kept. ``stored`` has gap_id, status and version.
    """
    new = candidates.select("gap_id").where("gap_id is not null").distinct().withColumn("now", F.lit(True))
    x = stored.select("gap_id", F.col("status").alias("old"), "version").join(new, "gap_id", "full_outer")
    fresh, hit = F.col("old").isNull(), F.coalesce("now", F.lit(False))
    action = F.when(fresh, "created").when(hit & (F.col("old") == "obsolete"), "reopened").when(hit, "refreshed").otherwise("kept")
    status = F.when(fresh | (hit & (F.col("old") == "obsolete")), "open").otherwise(F.col("old"))
    version = F.when(fresh, 1).when(hit, F.col("version") + 1).otherwise(F.col("version"))
    return x.select("gap_id", status.alias("status"), version.cast("bigint").alias("version"), action.alias("action"))


def moved(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gap_id, outcome, status, version) of wanted changes of status.

    ``wanted`` has gap_id, old, new and expected (a version); of several for a gap the
    smallest is taken. A change is done if the gap is in ``old`` with the expected version,
    which then rises; else it is a conflict, or not_found. Changes are checked against the
    stored state only, so they don't depend on their order.
    """
    one = wanted.groupBy("gap_id").agg(F.min(F.struct("old", "new", "expected")).alias("w")).select("gap_id", "w.*")
    x = one.join(stored.select("gap_id", "status", "version"), "gap_id", "left")
    done = (F.col("status") == F.col("old")) & (F.col("version") == F.col("expected"))
    outcome = F.when(F.col("status").isNull(), "not_found").when(done, "done").otherwise("conflict")
    return x.select("gap_id", outcome.alias("outcome"), F.when(done, F.col("new")).otherwise(F.col("status")).alias("status"), F.when(done, F.col("version") + 1).otherwise(F.col("version")).cast("bigint").alias("version"))


def supplemented(edges: DataFrame, fills: DataFrame) -> DataFrame:
    """Edges after gaps are filled: the skipping edge goes, a chain through the new nodes comes.

    ``fills`` has src, dst, nodes (one for each missing type) and replacement (one relation
    more). A fill whose lengths don't match or that holds a blank or an end of its own is left
    out. Edges that are there already aren't doubled.
    """
    fit = (F.size("replacement") == F.size("nodes") + 1) & (F.size("nodes") > 0) & F.forall("nodes", lambda n: n.isNotNull() & (n != "") & (n != F.col("src")) & (n != F.col("dst")))
    good = fills.where(fit).select("src", "dst", "nodes", "replacement").distinct()
    stops = F.concat(F.array("src"), "nodes", F.array("dst"))
    chain = good.select(stops.alias("s"), F.posexplode("replacement").alias("i", "rel")).select(F.get("s", F.col("i")).alias("src"), F.get("s", F.col("i") + 1).alias("dst"), "rel").distinct()
    kept = edges.select("src", "dst", "rel").distinct().join(good.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return kept.unionByName(chain).distinct()


def migrated(edges: DataFrame, types: DataFrame, mark: str, kind: Column, p: Paradigm) -> DataFrame:
    """(node, src, dst, missing, replacement, confidence, outcome) of placeholder nodes.

    A placeholder (its id holds ``mark``; ``kind`` tells its type from the column node) with
    one real edge in and one out becomes a gap between their ends, with the smaller
    confidence (0.5 where none is known); natural if a real node of the type does the same
    already; skipped if it has other edges or no type.
    """
    real = lambda c: ~F.col(c).contains(mark)
    side = lambda own, far: edges.where(F.col(own).contains(mark) & real(far)).select(F.col(own).alias("node"), F.struct(F.col(far).alias("at"), "rel", F.coalesce("confidence", F.lit(0.5)).alias("c")).alias("e"))
    ins = side("dst", "src").groupBy("node").agg(F.count(F.lit(1)).alias("n_in"), F.min("e").alias("i"))
    outs = side("src", "dst").groupBy("node").agg(F.count(F.lit(1)).alias("n_out"), F.min("e").alias("o"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").contains(mark)).distinct()
    x = every.join(ins, "node", "left").join(outs, "node", "left").withColumn("kind", kind)
    fit = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.coalesce("kind", F.lit("")) != "") & (F.col("i.at") != F.col("o.at"))
    x = x.withColumn("fit", F.coalesce(fit, F.lit(False)))
    t = types.groupBy("node").agg(F.min("type").alias("mid_type")).withColumnRenamed("node", "mid")
    e = edges.where(real("src") & real("dst")).select("src", "dst").distinct()
    two = x.where("fit").select("node", "kind", F.col("i.at").alias("src"), F.col("o.at").alias("dst"))
    two = two.join(e.select("src", F.col("dst").alias("mid")), "src").join(e.select(F.col("src").alias("mid"), "dst"), ["mid", "dst"]).join(t, "mid").where("mid_type = kind")
    x = x.join(two.select("node").distinct().withColumn("natural", F.lit(True)), "node", "left")
    outcome = F.when(~F.col("fit"), "skipped").when(F.col("natural"), "natural").otherwise("gap")
    own = lambda c: F.when(F.col("fit"), c)
    return x.select("node", own(F.col("i.at")).alias("src"), own(F.col("o.at")).alias("dst"), own(F.col("kind")).alias("missing"), own(F.concat_ws(",", "i.rel", "o.rel")).alias("replacement"), own(F.least("i.c", "o.c")).alias("confidence"), outcome.alias("outcome"))


def search_queries(source: Column, target: Column, source_aliases: Column, target_aliases: Column, missing: Column) -> Column:
    """Up to five distinct queries for what a gap lacks, from names, two aliases and types."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    some = lambda a: F.array_distinct(F.filter(a, lambda v: v != ""))
    terms = lambda name, al: some(F.concat(F.transform(F.slice(F.coalesce(al, F.array().cast("array<string>")), 1, 2), tidy), F.array(tidy(name))))
    s, t, m = terms(source, source_aliases), terms(target, target_aliases), some(F.transform(missing, tidy))
    last = F.slice(s, F.greatest(F.size(s), F.lit(1)), F.lit(1))
    every = F.array(F.array_join(F.concat(F.slice(s, 1, 2), m, F.slice(t, 1, 2)), " "), F.array_join(F.concat(F.slice(s, 1, 1), F.slice(t, 1, 1)), " "), F.array_join(F.concat(last, m), " "))
    return F.slice(some(F.transform(every, lambda q: F.substring(q, 1, 300))), 1, 5)
