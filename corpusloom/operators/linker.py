"""Linking typed concepts: likeness above a threshold, semantic layers, placeholder clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import likeness
from corpusloom.operators.gaps import Paradigm
from corpusloom.operators.graph import VIRTUAL
from corpusloom.plans.lineage import cut
from corpusloom.plans.sizes import small


def word_vectors(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, slot, w): hash embeddings of unit length, one row for each entry that isn't zero."""
    x = rows.select(F.col(key), F.explode(T.hashed_words(text)).alias("h")).groupBy(key, F.col("h.slot").alias("slot")).agg(F.sum("h.weight").alias("w"))
    size = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_size"))
    return x.join(size, key).select(key, "slot", (F.col("w") / F.col("_size")).alias("w"))


def alike(vectors: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b, score), a < b: pairs of sparse unit vectors (key, slot, w) with a cosine of ``least`` or more."""
    x = likeness.alike(cut(likeness.entry_rows(vectors, key)), key, least)
    return x.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), "score")


def transitions(p: Paradigm) -> Column:
    """A map from "source>target" types to the relation between them."""
    return F.create_map(*[F.lit(x) for (a, b), r in p.relations.items() for x in (f"{a}>{b}", r)])


def likeness_links(nodes: DataFrame, existing: DataFrame, p: Paradigm, least: float) -> DataFrame:
    """(parent, child, rel, score): pairs alike that a paradigm's transitions allow and no edge joins yet.

    ``nodes`` has a unique node, name and type, ``existing`` src and dst; names are alike by
    their words. A pair whose types allow both directions gives both.

    Types travel with the vectors. Of the edges only those between nodes alike matter; they
    are scored by themselves, so the pairs needn't be moved to meet edges while those are few.
    """
    named = nodes.where("type is not null")
    rel = lambda a, b: F.element_at(transitions(p), F.concat(a, F.lit(">"), b))
    pairs = likeness.alike(cut(likeness.word_rows(named, F.col("name")).drop("name")), "node", least)
    x = pairs.select(F.explode(F.array(*[F.struct(F.col(f"{s}.node").alias("parent"), F.col(f"{t}.node").alias("child"), rel(F.col(f"{s}.type"), F.col(f"{t}.type")).alias("rel")) for s, t in ("ab", "ba")])).alias("x"), "score")
    x = x.select("x.*", "score").where("rel is not null")
    e = existing.select("src", "dst").distinct().join(named.toDF("src", "an", "at"), "src").join(named.toDF("dst", "bn", "bt"), "dst").where(rel(F.col("at"), F.col("bt")).isNotNull())
    e = likeness.word_scores(e.select("src", "dst", "an", "bn"), F.col("an"), F.col("bn")).where(F.col("score") >= least - 0.001)
    return x.join(small(cut(e.select(F.col("src").alias("parent"), F.col("dst").alias("child")))), ["parent", "child"], "left_anti").select("parent", "child", "rel", "score")


def cross_relation(parent: Column, child: Column, p: Paradigm, default: str = "DEPEND_ON") -> Column:
    """The relation a paradigm has between two types, else a default."""
    return F.coalesce(F.try_element_at(transitions(p), F.concat(parent, F.lit(">"), child)), F.lit(default))


def levels_between(parent: Column, child: Column, p: Paradigm) -> Column:
    """How many types of the chain lie between two; a cyclic paradigm has one within a type."""
    if p.cyclic:
        return F.when(parent == child, 1).otherwise(0)
    chain = F.array(*map(F.lit, p.chain))
    i, j = F.array_position(chain, parent), F.array_position(chain, child)
    return F.when((i > 0) & (j > 0), F.greatest(F.lit(0), F.abs(i - j) - 1)).otherwise(0).cast("int")


def semantic_layers(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, confidence): HAS_DETAIL edges from a heading's themes to its other concepts.

    A heading has the concepts of all paragraphs below it (sub-headings included, by heading
    path). Its themes are those whose name equals, holds or is held in a form of the heading,
    compared by letters and digits; without any, the concepts of the heading's own text. Each
    theme leads to each concept that is no theme. ``chunks`` has chunk_id, document_name,
    chunk_type and heading_path, ``concepts`` canonical_id, name and source_chunks. Null
    paths and names take no part, repeated rows count once.
    """
    k = chunks.select("chunk_id", "document_name", "chunk_type", "heading_path").distinct()
    heads = k.where("chunk_type = 'heading' and heading_path <> ''").select(F.col("chunk_id").alias("head"), "document_name", F.col("heading_path").alias("path"))
    parts = F.split("heading_path", " > ", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " > "))
    below = k.where("chunk_type = 'paragraph' and heading_path <> ''").select("chunk_id", "document_name", F.explode(above).alias("path"))
    of = concepts.select("canonical_id", "name", F.explode("source_chunks").alias("chunk_id")).distinct()
    held = heads.join(below, ["document_name", "path"]).join(of, "chunk_id").select("head", "path", "canonical_id", "name").distinct()
    name = T.comparable(F.col("name"))
    last = F.element_at(F.split("path", " > ", -1), -1)
    hit = (name != "") & F.exists(T.theme_forms(last), lambda f: f.contains(name) | name.contains(f))
    marked = cut(held.groupBy("head", "canonical_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("theme")))
    themes = marked.where("theme").select("head", F.col("canonical_id").alias("src"))
    own = heads.select("head").join(marked.select("head").distinct(), "head", "left_semi").join(themes.select("head").distinct(), "head", "left_anti").join(of.select(F.col("chunk_id").alias("head"), F.col("canonical_id").alias("src")), "head")
    every = themes.unionByName(own.select("head", "src").distinct())
    rest = marked.select("head", F.col("canonical_id").alias("dst")).join(every.select("head", F.col("src").alias("dst")), ["head", "dst"], "left_anti")
    return every.join(rest, "head").select("src", "dst").distinct().withColumn("confidence", F.lit(0.85))


def without_orphans(edges: DataFrame) -> DataFrame:
    """Edges without those of placeholders that lead nowhere (no outgoing edge)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").contains(VIRTUAL)).distinct()
    orphan = ends.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return edges.join(orphan.withColumnRenamed("node", "src"), "src", "left_anti").join(orphan.withColumnRenamed("node", "dst"), "dst", "left_anti")


def placeholders(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, sources, targets): placeholders with the real nodes beside them."""
    real = lambda c: ~F.col(c).contains(VIRTUAL)
    ins = edges.where(F.col("dst").contains(VIRTUAL) & real("src")).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_in"), F.array_sort(F.collect_set("src")).alias("sources"))
    outs = edges.where(F.col("src").contains(VIRTUAL) & real("dst")).groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n_out"), F.array_sort(F.collect_set("dst")).alias("targets"))
    z, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    x = ins.join(outs, "node", "full_outer")
    return x.select("node", F.coalesce("n_in", z).alias("n_in"), F.coalesce("n_out", z).alias("n_out"), F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"))


def write_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` and the ``new`` edges (src, dst, rel, confidence) it can take.

    Blank ends and loops are skipped, an edge that is there already stays as it is, and new
    edges go in by falling confidence, then ends; what would close a cycle is refused.
    """
    from corpusloom.operators.graph import acyclic

    ok = new.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))
    ok = ok.join(stored.select("src", "dst", "rel").distinct(), ["src", "dst", "rel"], "left_anti")
    every = stored.select("src", "dst", "rel", "confidence", F.lit(0).alias("late")).unionByName(ok.select("src", "dst", "rel", "confidence", F.lit(1).alias("late")))
    kept = acyclic(every.select("src", "dst", "rel", "confidence", "late", (-F.col("confidence")).alias("less")), ["late", "less"])
    return kept.select("src", "dst", "rel", "confidence")
