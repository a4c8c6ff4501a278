"""Entity resolution of concept mentions: profiles, pair classes, canonical concepts.

The pairwise comparison is blocked: explicit aliases are found by equi-joins on normalised
names, equal bases and containment by hashes of their substrings; pairs that only likeness of
vectors joins come from ``likeness.alike``, behind a bound that follows from its threshold. No
step compares all pairs.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import likeness
from corpusloom.operators.graph import components
from corpusloom.operators.substrings import contained
from corpusloom.plans.lineage import cut

# Endings that don't change what a name means, and parts that do.
SAFE_SUFFIXES = "技术 术语 概念".split()
MARKERS = "阶段 流程 步骤 链 系统 平台 模块 组件 模型 方法 算法 应用 案例 问题 挑战 方案 实现 查询 评估 优化 框架 架构 服务 工具 数据集 指标".split()
# Thresholds of similarity for a related pair, a review, an automatic merge.
RELATED, REVIEW, MERGE = 0.72, 0.85, 0.94
_DROP = re.compile(r"[\s\-_·•/\\()（）\[\]【】]+")


def normalized_name(name: Column) -> Column:
    """NFKC, case folded, without white space and joining marks (no built-in has NFKC)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _DROP.sub("", unicodedata.normalize("NFKC", v).casefold().strip()))

    return run(name)


def ascii_name(name: Column) -> Column:
    """The same for names of plain letters, without Python."""
    return F.regexp_replace(F.lower(name), r"[\s\-_·•/\\()（）\[\]【】]+", "")


def weak_base(norm: Column) -> Column:
    """A normalised name without one safe suffix, if more than one character is left."""
    return F.regexp_replace(norm, f"^(.{{2,}})(?:{'|'.join(SAFE_SUFFIXES)})$", "$1")


def marker(norm: Column) -> Column:
    """The first structural part a name holds, else null."""
    out = F.lit(None).cast("string")
    for m in reversed(MARKERS):
        out = F.when(norm.contains(m), m).otherwise(out)
    return out


def marked(norm: Column) -> Column:
    """Whether a name holds a structural part."""
    return norm.rlike("|".join(MARKERS))


def profiles(mentions: DataFrame, native: bool = False) -> DataFrame:
    """One row for each normalised name: name, norm, frequency, aliases and their norms.

    ``mentions`` has name and aliases. The surface form is the most frequent, then longest,
    then smallest. Names that normalise to nothing are dropped.
    """
    norm = ascii_name if native else normalized_name
    m = mentions.where("name is not null").select("name", "aliases").withColumn("norm", norm(F.col("name"))).where("norm <> ''")
    surface = m.groupBy("norm", "name").agg(F.count(F.lit(1)).alias("n"))
    best = surface.groupBy("norm").agg(F.min_by("name", F.struct(-F.col("n"), -F.length("name"), "name")).alias("name"), F.sum("n").alias("frequency"))
    a = m.select("norm", F.explode("aliases").alias("alias")).where("alias is not null").withColumn("alias_norm", norm(F.col("alias"))).where("alias_norm <> '' and alias_norm <> norm")
    alias = a.groupBy("norm").agg(F.array_sort(F.collect_set("alias_norm")).alias("alias_norms"))
    return best.join(alias, "norm", "left").withColumn("alias_norms", F.coalesce("alias_norms", F.array().cast("array<string>")))


def candidate_pairs(p: DataFrame) -> DataFrame:
    """Unordered pairs (l, r), l < r in norm, that an alias, a base or containment joins.

    A base is a part of its name, so whatever containment joins has one's base inside the
    other's name; equal bases do too.
    """
    n = p.select("norm", weak_base(F.col("norm")).alias("base"), "alias_norms")
    alias = n.select(F.col("norm").alias("l"), F.explode("alias_norms").alias("r")).join(n.select(F.col("norm").alias("r")).hint("merge"), "r", "left_semi")
    bases = n.select(F.col("norm").alias("r"), "base")
    inside = contained(bases.select(F.col("base").alias("s_id"), F.col("base").alias("s")).distinct(), n.select(F.col("norm").alias("l_id"), F.col("norm").alias("l")))
    inside = inside.select(F.col("s_id").alias("base"), F.col("l_id").alias("l")).join(bases.hint("merge"), "base")
    every = alias.select("l", "r").unionByName(inside.select("l", "r")).where("l <> r")
    return every.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()


def classify(pairs: DataFrame, p: DataFrame, similarity: Column | None = None) -> DataFrame:
    """(left, right, subject, object, relation, confidence, decision) of candidate pairs.

    The ladder, first match: explicit alias; equal base of an acronym; equal base; a
    structural part with containment or likeness; containment; likeness in three steps.
    """
    side = lambda s: p.select(F.col("norm").alias(s), _side().alias(f"{s}p"))
    x = pairs.join(side("l").hint("merge"), "l").join(side("r").hint("merge"), "r")
    return _ladder(x, similarity if similarity is not None else F.lit(0.0))


def _side() -> Column:
    """What the ladder needs of a profile besides its norm."""
    return F.struct("name", "alias_norms", weak_base(F.col("norm")).alias("base"), marked(F.col("norm")).alias("mark"))


def _ladder(x: DataFrame, sim: Column) -> DataFrame:
    """The ladder for pairs l, r (norms) with what it needs of either side, lp and rp."""
    l, r = F.col("l"), F.col("r")
    lb, rb = F.col("lp.base"), F.col("rp.base")
    explicit = F.array_contains("lp.alias_norms", r) | F.array_contains("rp.alias_norms", l)
    equal, mark = lb == rb, F.col("lp.mark") | F.col("rp.mark")
    inside = l.contains(r) | r.contains(l)
    base_inside = (lb != rb) & (lb.contains(rb) | rb.contains(lb))
    shorter = F.when(F.length(l) <= F.length(r), F.col("lp.name")).otherwise(F.col("rp.name"))
    acronym = shorter.rlike("^[A-Z][A-Z0-9.+_-]{1,10}$")
    ladder = [
        (explicit, "SAME_AS", F.lit(0.99), "auto_merge"),
        (equal & ~mark & acronym, "SAME_AS", F.lit(0.96), "auto_merge"),
        (equal & ~mark, "SAME_AS", F.greatest(F.lit(0.88), sim), "review"),
        (mark & inside & (F.length(l) != F.length(r)), "NARROWER_THAN", F.greatest(F.lit(0.80), sim), "keep_separate"),
        (mark & (inside | (sim >= REVIEW)), "RELATED_TO", F.greatest(F.lit(0.80), sim), "keep_separate"),
        (inside | base_inside, "NARROWER_THAN", F.greatest(F.lit(0.76), sim), "keep_separate"),
        (sim >= MERGE, "SAME_AS", sim, "auto_merge"),
        (sim >= REVIEW, "SAME_AS", sim, "review"),
        (sim >= RELATED, "RELATED_TO", sim, "keep_separate"),
    ]
    rule = F.lit(None).cast("int")
    for i, (test, *_) in reversed(list(enumerate(ladder))):
        rule = F.when(test, i).otherwise(rule)
    x = x.withColumn("rule", rule).where("rule is not null")
    pick = lambda k: F.element_at(F.array(*[row[k] if isinstance(row[k], Column) else F.lit(row[k]) for row in ladder]), F.col("rule") + 1)
    relation, confidence, decision = pick(1), pick(2), pick(3)
    narrow = (relation == "NARROWER_THAN") & (F.length(l) <= F.length(r))
    out = x.select(F.col("lp.name").alias("left"), F.col("rp.name").alias("right"), F.when(narrow, F.col("rp.name")).otherwise(F.col("lp.name")).alias("subject"), F.when(narrow, F.col("lp.name")).otherwise(F.col("rp.name")).alias("object"), relation.alias("relation"), F.round(confidence, 6).alias("confidence"), decision.alias("decision"))
    return out


def classify_alike(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """``classify`` of candidate ``pairs`` (l, r) and of all pairs whose names are alike by words.

    What the ladder needs travels with the vectors (a base only where it isn't the norm), so
    pairs alike are classified where they are found. Candidates are scored by themselves;
    those alike are among the others already.
    """
    base = weak_base(F.col("norm"))
    held = p.select("norm", "name", F.when(F.size("alias_norms") > 0, F.col("alias_norms")).alias("alias_norms"), F.when(base != F.col("norm"), base).alias("base"), marked(F.col("norm")).alias("mark"))
    x = likeness.alike(cut(likeness.word_rows(held, F.col("name"))), "norm", RELATED)
    none = F.array().cast("array<string>")
    full = lambda s: F.struct(F.col(f"{s}.name").alias("name"), F.coalesce(f"{s}.alias_norms", none).alias("alias_norms"), F.coalesce(f"{s}.base", f"{s}.norm").alias("base"), F.col(f"{s}.mark").alias("mark"))
    found = x.select(F.col("a.norm").alias("l"), F.col("b.norm").alias("r"), full("a").alias("lp"), full("b").alias("rp"), "score")
    side = lambda s: p.select(F.col("norm").alias(s), _side().alias(f"{s}p")).hint("merge")
    rest = pairs.join(side("l"), "l").join(side("r"), "r")
    rest = likeness.word_scores(rest, F.col("lp.name"), F.col("rp.name")).where(F.round("score", 6) < RELATED).withColumn("score", F.lit(0.0))
    return _ladder(found, F.col("score")).unionByName(_ladder(rest, F.col("score")))


def canonical_names(classified: DataFrame, p: DataFrame) -> DataFrame:
    """(name, canonical): merge closure of SAME_AS pairs with an automatic merge.

    The canonical name has no structural part, no safe suffix, is Chinese rather than an
    acronym, frequent and short; then the smallest.
    """
    e = classified.where("relation = 'SAME_AS' and decision = 'auto_merge'").select(F.col("left").alias("src"), F.col("right").alias("dst"))
    comp = components(e).withColumnRenamed("node", "name")
    full = p.join(comp.hint("merge"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    n, name = F.col("norm"), F.col("name")
    points = F.when(name.rlike(r"[\x{4E00}-\x{9FFF}]"), 1).otherwise(0) - F.when(name.rlike("^[A-Za-z][A-Za-z0-9.+_-]{1,15}$"), 1).otherwise(0)
    order = F.struct(marked(n), weak_base(n) != n, -points, -F.col("frequency"), F.length(name), name)
    best = full.groupBy("component").agg(F.min_by("name", order).alias("canonical"))
    return full.join(best.hint("merge"), "component").select("name", "canonical")


def canonical_concepts(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical_id, name, concept_type, description, parent_hint, n_mentions, source_chunks).

    ``mentions`` has name, concept_type, description, parent_hint and source_chunks; the type
    and hint are the most frequent (then smallest), the description the longest.
    """
    return gathered(mentions.join(names.hint("merge"), "name").drop("name"))


def gathered(m: DataFrame) -> DataFrame:
    """``canonical_concepts`` of mentions that have their canonical name already (no name)."""

    def most(col: str) -> DataFrame:
        c = m.where(f"{col} <> ''").groupBy("canonical", col).agg(F.count(F.lit(1)).alias("n"))
        return c.groupBy("canonical").agg(F.min_by(col, F.struct(-F.col("n"), col)).alias(col))

    rest = m.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_mentions"), F.min_by("description", F.struct(-F.length("description"), "description")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("source_chunks"))
    out = rest.join(most("concept_type").hint("merge"), "canonical", "left").join(most("parent_hint").hint("merge"), "canonical", "left")
    cid = F.concat(F.lit("concept_canonical_"), F.substring(F.md5(F.col("canonical").cast("binary")), 1, 10))
    return out.select(cid.alias("canonical_id"), F.col("canonical").alias("name"), "concept_type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("parent_hint", F.lit("")).alias("parent_hint"), "n_mentions", "source_chunks")


def name_mapping(concepts: DataFrame) -> DataFrame:
    """(key, canonical_id): lower-cased names and aliases; the largest id wins a key."""
    e = concepts.select("canonical_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"))
    return e.select(F.lower(F.regexp_replace("k", r"(?U)^\s+|\s+$", "")).alias("key"), "canonical_id").where("key <> ''").groupBy("key").agg(F.max("canonical_id").alias("canonical_id"))


def advice_conflicts(advice: DataFrame) -> DataFrame:
    """(left, right, group_id) of pairs to keep apart inside one group of merges.

    ``advice`` has left, right and decision (MERGE or SEPARATE); group_id is the SHA-256 of
    the sorted members.
    """
    comp = components(advice.where("decision = 'MERGE'").select(F.col("left").alias("src"), F.col("right").alias("dst")))
    apart = advice.where("decision = 'SEPARATE'").select("left", "right").distinct()
    a = apart.join(comp.select(F.col("node").alias("left"), F.col("component").alias("c")), "left").join(comp.select(F.col("node").alias("right"), F.col("component").alias("c")), ["right", "c"])
    hit = comp.join(a.select(F.col("c").alias("component")).distinct(), "component", "left_semi")
    ids = hit.groupBy(F.col("component").alias("c")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("node")), "|"), 256).alias("group_id"))
    return a.join(ids, "c").select("left", "right", "group_id")
