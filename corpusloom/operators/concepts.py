"""Finding concepts by name, choosing them for practice, and assembling contexts from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.graph import VIRTUAL
from corpusloom.operators.substrings import contained


def resolve(names: DataFrame, concepts: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(query, canonical_id, strategy): the concept each wanted name stands for.

    ``names`` has query (the name), ``concepts`` canonical_id, name and aliases, ``similar``
    optionally query, canonical_id and score. Strategies in order: 1 the same name, 2 one name
    in the other, 3 the same without regard to case, 4 a word of the query in a name, 5 the
    query in an alias, 6 likeness above 0.6. Of several the smallest id is taken;
    placeholders never are. Names that find nothing, null and blank ones have no row.
    """
    q = names.select(F.trim("query").alias("query")).where("query <> ''").distinct()
    c = concepts.where(~F.col("canonical_id").contains(VIRTUAL) & (F.trim("name") != ""))
    c = c.select("canonical_id", "name", "aliases").distinct()
    low_q = q.select(F.col("query").alias("s_id"), F.lower("query").alias("s"))
    names_ = c.select("canonical_id", "name").distinct()
    low_c = names_.select(F.struct("canonical_id", "name").alias("l_id"), F.lower("name").alias("l"))
    one = contained(low_q, low_c).select(F.col("s_id").alias("query"), "l_id.canonical_id", "l_id.name")
    two = contained(low_c.toDF("s_id", "s"), low_q.toDF("l_id", "l")).select(F.col("l_id").alias("query"), "s_id.canonical_id", "s_id.name")
    exact, inside = F.col("query") == F.col("name"), F.col("name").contains(F.col("query")) | F.col("query").contains(F.col("name"))
    found = one.unionByName(two).select("query", "canonical_id", F.when(exact, 1).when(inside, 2).otherwise(3).alias("strategy"))
    words = q.select("query", F.explode(F.split(F.lower("query"), r"\s+")).alias("s")).where("length(s) >= 2").distinct()
    first = contained(words.select(F.col("s").alias("s_id"), "s").distinct(), low_c).groupBy(F.col("s_id").alias("s")).agg(F.min("l_id.canonical_id").alias("canonical_id"))
    word = words.join(first, "s").select("query", "canonical_id", F.lit(4).alias("strategy"))  # each word needs its smallest id only
    alias = c.select("canonical_id", F.explode("aliases").alias("l")).distinct().select(F.struct("canonical_id", "l").alias("l_id"), "l")
    alias = contained(q.select(F.col("query").alias("s_id"), F.col("query").alias("s")), alias).select(F.col("s_id").alias("query"), "l_id.canonical_id", F.lit(5).alias("strategy"))
    every = found.unionByName(word).unionByName(alias)
    if similar is not None:
        every = every.unionByName(similar.where("score > 0.6").select("query", "canonical_id", F.lit(6).alias("strategy")))
    best = every.groupBy("query").agg(F.min(F.struct("strategy", "canonical_id")).alias("m"))
    return best.select("query", "m.canonical_id", "m.strategy")


def first_n(rows: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each part in an order, numbered from 1 as rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= n)


def weakest(state: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` concepts a learner masters least in a subject; ties by id."""
    return first_n(state, ["user_id", "subject_id"], [F.col("mastery").asc(), F.col("concept_id")], n)


def uncovered(scores: DataFrame, answers: DataFrame, n: int = 5) -> DataFrame:
    """(node, score, rank): the ``n`` most central concepts that no answer has touched.

    Only ``n`` rows leave each partition (the limit is the feature).
    """
    seen = answers.select(F.explode("primary_concepts").alias("node")).distinct()
    top = scores.join(seen, "node", "left_anti").orderBy(F.col("score").desc(), "node").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "node")))


def trimmed(nodes: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Nodes of each seed's subgraph within a budget: the seed, then by centrality, then id."""
    x = nodes.select("seed", "node").join(scores, "node", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return first_n(x, ["seed"], [(F.col("seed") != F.col("node")).cast("int"), F.col("score").desc(), F.col("node")], most)


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters, with three points if more follow."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, "...").otherwise(""))


def assembled(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(seed, text, tokens): a numbered list of a trimmed subgraph's concepts.

    ``nodes`` has seed, node and rank, bounded by the budget they were trimmed to; ``concepts``
    node, name, concept_type and description. Concepts without a name are left out.
    """
    from corpusloom.functions.text import assembly_tokens

    x = nodes.join(concepts, "node").where("name <> ''")
    line = F.concat(F.lit("**"), F.col("name"), F.lit("** ("), F.coalesce("concept_type", F.lit("")), F.lit(") - "), shortened(F.col("description"), 80))
    lists = x.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["line"])), "\n")
    return lists.select("seed", text.alias("text")).withColumn("tokens", assembly_tokens(F.col("text")))
