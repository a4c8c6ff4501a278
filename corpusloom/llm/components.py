"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond". Records get 64-bit numbers in
the order of their names (a range sort), so rounds move 16 bytes an edge and the smallest
number is the smallest name. Both steps are one aggregate (the smallest neighbour, combined
map-side) and a join of the edges with it. At the end every group is one node that all its
edges touch, so hubs are the rule: nodes with more than ``HUB`` edges are kept out of that
join, and their few smallest neighbours are broadcast instead. There are at most
2 x edges / HUB such nodes, and HUB grows with the edges so that this stays below
``MOST_HUBS``; any other key of a join has at most HUB edges. The number of rounds is
logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut, release

SCOPE = "scope"
#: Edges from which a node is a hub, at least, and hubs (16 bytes each) there may be.
HUB, MOST_HUBS = 50_000, 100_000


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return pairs.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()


def _rewired(directed: DataFrame, wanted: DataFrame, hub: int | None) -> tuple[DataFrame, DataFrame]:
    """Edges (x, m) for every (u, v) of ``wanted``: m is the smallest of u and its neighbours.

    Also returns (u, m), the smallest for every node. ``hub`` is None if no node can be one.
    """
    low = directed.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
    low = low.select("u", F.least("u", "low").alias("m"), "n")
    own = low.select(F.col("u").alias("x"), "m")
    if hub is None:
        return wanted.join(low.select("u", "m"), "u").select(F.col("v").alias("x"), "m"), own
    hubs = F.broadcast(low.where(F.col("n") > hub).select("u", "m"))
    rest = wanted.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= hub).select("u", "m"), "u")
    out = wanted.join(hubs, "u").select(F.col("v").alias("x"), "m").unionByName(rest.select(F.col("v").alias("x"), "m"))
    return out, own


def large_star(edges: DataFrame, hub: int | None = HUB) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _edges(_rewired(both, both.where("v > u"), hub)[0])


def small_star(edges: DataFrame, hub: int | None = HUB) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    out, own = _rewired(edges, edges, hub)
    return _edges(out.unionByName(own))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_groups(pairs: DataFrame, left: str, right: str, scope: str | None = None, hub: int = HUB) -> DataFrame:
    """Group every record linked directly or through others.

    ``pairs`` holds one match per row; ``scope`` optionally names a column within which
    records are told apart. Returns (scope, name, group_name), one row for each record in a
    group of two or more; ``group_name`` is the smallest member in code-point order. Pairs
    with a null or empty side and pairs of a record with itself link nothing; repeated pairs
    in either order count once; a null scope is a scope of its own, returned as null; other
    columns are ignored. An empty table gives an empty result. ``hub`` bounds the edges a
    node may have in a join (see the module); it doesn't change the result.
    """
    s = F.col(scope).cast("string") if scope else F.lit("")
    # a leading mark keeps a null scope apart from an empty one and makes it joinable
    marked = F.when(s.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), s))
    x, m = F.col(left).cast("string"), F.col(right).cast("string")
    raw = pairs.select(marked.alias(SCOPE), x.alias("x"), m.alias("m")).where("x <> '' and m <> '' and x <> m")
    raw = cut(raw.select(SCOPE, F.least("x", "m").alias("x"), F.greatest("x", "m").alias("m")).distinct())
    names = raw.select(SCOPE, F.explode(F.array("x", "m")).alias("name")).distinct()
    # partitions of a range sort are in order, and so are the numbers given along them
    names = names.repartitionByRange(SCOPE, "name").sortWithinPartitions(SCOPE, "name")
    names = cut(names.withColumn("id", F.monotonically_increasing_id()))
    one = raw.join(names.withColumnRenamed("name", "x"), [SCOPE, "x"]).select(SCOPE, F.col("id").alias("v"), "m")
    edges = cut(one.join(names.withColumnRenamed("name", "m"), [SCOPE, "m"]).select(F.col("id").alias("u"), "v"))
    release(raw)
    before = _state(edges)
    while before[0]:
        least = max(hub, -(-2 * before[0] // MOST_HUBS))
        most = least if before[0] > least else None  # a node has no more edges than there are
        new = cut(small_star(large_star(edges, most), most))
        release(edges)
        edges, now = new, _state(new)
        if now == before:
            break
        before = now
    # every edge now leads from a member to the smallest one of its group
    heads = edges.select(F.col("v").alias("id"), "v").distinct()
    groups = edges.select(F.col("u").alias("id"), "v").unionByName(heads)
    back = F.when(F.col(SCOPE) != "0", F.substring(SCOPE, 2, 2**31 - 1))
    named = groups.join(names, "id").select("v", back.alias("scope"), "name")
    return named.join(names.select(F.col("id").alias("v"), F.col("name").alias("group_name")), "v").select("scope", "name", "group_name")


def merge_pairs(candidates: DataFrame) -> DataFrame:
    """Rows of merge_candidates whose decision joins the two names.

    A decision counts without regard to case and surrounding white space.
    """
    said = F.lower(F.regexp_replace("decision", r"(?U)^\s+|\s+$", ""))
    return candidates.where(said == "merge").select("build_id", "left_name", "right_name")
