"""Reviewing matches of concept names: aliases, pairs, chosen names, checks of advice; graph rows of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.operators.resolve import ascii_name

# Decisions that advice may give, and the confidence it may keep when a check fails.
DECISIONS = ("MERGE", "SEPARATE", "UNCERTAIN")
UNSURE, INCOMPLETE, UNPROVEN = 0.49, 0.79, 0.89


def cleaned_aliases(aliases: Column, name: Column, norm=ascii_name) -> Column:  # noqa: ANN001
    """Distinct aliases by normal form, without blank ones and the name itself, 120 characters each."""
    trimmed = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
    norms = F.transform(trimmed, norm)
    first = F.filter(F.transform(trimmed, lambda a, i: F.struct(a.alias("a"), norm(a).alias("n"), i.alias("i"))), lambda s: (s["n"] != "") & (s["n"] != F.coalesce(norm(name), F.lit(""))) & (F.array_position(norms, s["n"]) == s["i"] + 1))
    return F.transform(first, lambda s: F.substring(s["a"], 1, 120))


def inline_aliases(text: Column) -> Column:
    """Structs (left, right) of what a text writes as X (Y): a Latin term and anything short, or
    ideographs and an acronym."""
    latin = r"\b([A-Za-z][A-Za-z0-9.+_-]{1,30})\s*[（(]\s*([^()（）]{1,80})\s*[)）]"
    han = r"([\x{4E00}-\x{9FFF}]{2,20})\s*[（(]\s*([A-Z][A-Z0-9.+_-]{1,20})\s*[)）]"
    tidy = lambda c: F.regexp_replace(c, r"^[ ：:，,。.;；]+|[ ：:，,。.;；]+$", "")
    found = lambda p: F.zip_with(F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2), lambda a, b: F.struct(tidy(a).alias("left"), tidy(b).alias("right")))
    return F.concat(found(latin), found(han))


def inferred_aliases(concepts: DataFrame) -> DataFrame:
    """(name, alias): what descriptions write beside a concept's own name in brackets.

    ``concepts`` has name and description; repeats by normal form are kept once (the smallest).
    """
    x = concepts.where("name <> ''").select("name", F.explode(inline_aliases(F.col("description"))).alias("p"))
    own, l, r = ascii_name(F.col("name")), ascii_name(F.col("p.left")), ascii_name(F.col("p.right"))
    x = x.select("name", F.when(own == l, F.col("p.right")).when(own == r, F.col("p.left")).alias("alias"))
    x = x.withColumn("n", ascii_name(F.col("alias"))).where((F.col("n") != "") & (F.col("n") != ascii_name(F.col("name"))))
    return x.groupBy("name", "n").agg(F.min("alias").alias("alias")).select("name", "alias")


def best_pairs(pairs: DataFrame, norm=ascii_name) -> DataFrame:  # noqa: ANN001
    """One row for each pair in either order and any spelling: the surest, with all signals.

    ``pairs`` has left, right, relation, confidence and signals. The highest confidence wins,
    then the larger names. Pairs with a name that is empty in normal form, and of a name with
    itself, are dropped.
    """
    a, b = norm(F.col("left")), norm(F.col("right"))
    x = pairs.withColumn("l", F.least(a, b)).withColumn("r", F.greatest(a, b)).where("l <> '' and r <> '' and l <> r")
    best = F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "left", "right", "relation"))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("signals", F.array().cast("array<string>"))))))
    return x.groupBy("l", "r").agg(best.alias("b"), F.count(F.lit(1)).alias("n"), every.alias("signals")).select("b.left", "b.right", "b.relation", "b.confidence", "n", "signals")


def chosen_names(merges: DataFrame) -> DataFrame:
    """(member, name): groups of merged names under the name a reviewer chose.

    ``merges`` has left, right and chosen (null or blank if none). Of the choices whose pair
    and name are in the group the one of the smallest pair counts; without one the smallest
    member names the group.
    """
    m = merges.where("left <> '' and right <> '' and left <> right").select("left", "right", "chosen").distinct()
    comp = components(m.select(F.col("left").alias("src"), F.col("right").alias("dst")))
    own = comp.select(F.col("node").alias("chosen"), F.col("component").alias("of"))
    at = m.where("chosen <> ''").join(comp.select(F.col("node").alias("left"), "component"), "left").join(own, "chosen").where("component = of")
    pair = F.struct(F.least("left", "right"), F.greatest("left", "right"), F.col("chosen"))
    pick = at.groupBy("component").agg(F.min(pair).alias("p")).select("component", F.col("p.chosen").alias("pick"))
    return comp.join(pick, "component", "left").select(F.col("node").alias("member"), F.coalesce("pick", "component").alias("name"))


def checked_advice(advice: DataFrame) -> DataFrame:
    """``advice`` with decision, confidence and canonical_name as far as checks bear them out.

    Has left, right, decision, confidence, canonical_name, proven (whether a source or alias
    evidence stands behind it) and same_type. An unknown decision is UNCERTAIN; a merge under
    a name of neither side too, at most 0.49; a merge that isn't proven or joins types that
    have nothing in common keeps 0.89 at most.
    """
    said = F.upper(F.trim(F.coalesce("decision", F.lit(""))))
    said = F.when(said.isin(*DECISIONS), said).otherwise("UNCERTAIN")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    name = F.trim(F.coalesce("canonical_name", F.lit("")))
    stray = (said == "MERGE") & ~(F.coalesce(name == F.col("left"), F.lit(False)) | F.coalesce(name == F.col("right"), F.lit(False)))
    merge = (said == "MERGE") & ~stray
    weak = merge & ~(F.coalesce("proven", F.lit(False)) & F.coalesce("same_type", F.lit(True)))
    sure = F.when(stray, F.least(sure, F.lit(UNSURE))).when(weak, F.least(sure, F.lit(UNPROVEN))).otherwise(sure)
    out = {"decision": F.when(stray, "UNCERTAIN").otherwise(said), "confidence": F.round(sure, 4), "canonical_name": F.when(merge, name).otherwise("")}
    return advice.select(*[c for c in advice.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def gate(candidates: DataFrame, part: str, key: str) -> DataFrame:
    """(part, candidates, resolved, open_, passed): whether all candidates of a run are decided.

    A candidate counts once however often it came; it is resolved if one of its rows is.
    """
    one = candidates.groupBy(part, key).agg(F.max(F.coalesce(F.trim("decision") != "", F.lit(False))).alias("done"))
    return one.groupBy(part).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("done").alias("resolved"), F.count_if(~F.col("done")).alias("unresolved")).withColumn("passed", F.col("unresolved") == 0)


def page_number(value: Column) -> Column:
    """A page number from text: digits, or the first of a JSON list of numbers; else null."""
    t = F.trim(value)
    listed = F.regexp_extract(t, r"^\[\s*(\d+)", 1)
    return F.when(listed != "", listed).when(t.rlike(r"^\d+$"), t).try_cast("bigint")


def mention_nodes(mentions: DataFrame, chunk: str, name: str, order: str) -> DataFrame:
    """Mentions of a chunk once each name (without regard to case): the first in ``order`` stays."""
    x = mentions.where(f"{chunk} is not null and trim({name}) <> ''").withColumn("_key", F.lower(F.trim(name)))
    rest = [c for c in mentions.columns if c != chunk]
    return x.groupBy(chunk, "_key").agg(F.min_by(F.struct(*rest), F.struct(order, name)).alias("m")).select(chunk, "m.*")


def bridge_edges(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, rel): HAS_CONCEPT from chunks, DERIVED_FROM from mentioned names to their concept.

    ``concepts`` has canonical_id and source_chunks, ``names`` key and canonical_id (as
    ``resolve.name_mapping`` gives them).
    """
    has = concepts.select(F.explode("source_chunks").alias("src"), F.col("canonical_id").alias("dst"), F.lit("HAS_CONCEPT").alias("rel"))
    of = names.select(F.col("key").alias("src"), F.col("canonical_id").alias("dst"), F.lit("DERIVED_FROM").alias("rel"))
    return has.unionByName(of).where("src <> '' and dst <> ''").distinct()
