"""Graph operators over an edge table (src, dst, rel).

Edges are DataFrames; every step is a join or an aggregate on node ids. Loops are cut with
reliable checkpoints. An undirected view has each edge in both directions, with multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.hierarchy import parent_table, resolved
from corpusloom.plans.lineage import cut, cut_unsized, release

# Marks of placeholder nodes.
VIRTUAL = "__virtual_"
#: Links that one task merges in memory.
LOCAL_LINKS = 1_000_000


def edge_table(rows: DataFrame, src: str, dst: str, rel: str, confidence: str) -> DataFrame:
    """Distinct (src, dst, rel) with the highest confidence (0.85 where none is known).

    Rows without a source or target, and links of a node to itself, are no edges.
    """
    e = rows.where(f"{src} <> '' and {dst} <> '' and {src} <> {dst}").select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(rel).alias("rel"), F.coalesce(F.col(confidence), F.lit(0.85)).alias("confidence"))
    return e.groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))


def real_edges(edges: DataFrame) -> DataFrame:
    """Edges both ends of which are no placeholders."""
    return edges.where(~F.col("src").contains(VIRTUAL) & ~F.col("dst").contains(VIRTUAL))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, with multiplicity."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, n_neighbours) for every node of an edge."""
    d = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("s")).select("s.*")
    return d.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.countDistinct("other").alias("n_neighbours"))


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): one hop in either direction."""
    return undirected(edges).join(seeds.select(F.col("seed").alias("a")), "a").select(F.col("a").alias("seed"), F.col("b").alias("node")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int | None = None) -> DataFrame:
    """(seed, node, depth, via): breadth-first from every seed, over undirected edges.

    ``via`` is the smallest neighbour one level up (null at the seed). With ``max_nodes`` a
    seed keeps its first nodes by level and id, and the search goes on from those only.
    """
    both = cut(undirected(edges).distinct())
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    front = seen
    for d in range(1, depth + 1):
        step = front.select("seed", F.col("node").alias("a")).join(both, "a").groupBy("seed", F.col("b").alias("node")).agg(F.min("a").alias("via"))
        new = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("depth"), "via")
        if max_nodes is not None:
            left = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("has"))
            nth = F.row_number().over(Window.partitionBy("seed").orderBy("node"))
            new = new.withColumn("nth", nth).join(left, "seed").where(F.col("nth") + F.col("has") <= max_nodes).select("seed", "node", "depth", "via")
        front = cut(new)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """(source, target, hops, path): unweighted shortest paths of up to ``limit`` hops.

    Among the shortest the path whose nodes, read from the target, are smallest is given.
    A search ends where it has met its target.
    """
    both = cut(undirected(edges).distinct())
    front = pairs.select("source", "target", F.col("source").alias("node"), F.array("source").alias("path"))
    seen = front.select("source", "target", "node")
    done = front.where("node = target")
    for _ in range(limit):
        open_ = front.join(done.select("source", "target"), ["source", "target"], "left_anti")
        step = open_.join(both, F.col("node") == F.col("a")).select("source", "target", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        best = step.groupBy("source", "target", "node").agg(F.min_by("path", F.reverse("path")).alias("path"))
        front = cut(best.join(seen, ["source", "target", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("source", "target", "node")))
        done = cut(done.unionByName(front.where("node = target")))
    return done.select("source", "target", (F.size("path") - 1).cast("bigint").alias("hops"), F.array_join("path", " > ").alias("path"))


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges both ends of which are among the nodes."""
    n = nodes.select(F.col(node).alias("n")).distinct()
    return edges.join(n, edges["src"] == n["n"], "left_semi").join(n, edges["dst"] == n["n"], "left_semi")


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, score): PageRank over undirected edges with multiplicity, divided by the maximum.

    (1 - d) / N + d * sum of score / degree of the neighbours; the mass of nodes without an
    edge is dropped. ``nodes`` lists all nodes (column node); edges beyond them don't count.
    """
    n = nodes.select("node").distinct()
    total = n.count()
    both = undirected(induced(edges, n))
    links = cut(both.join(both.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), "a").groupBy("a", "b", "deg").agg(F.count(F.lit(1)).alias("times")))
    score = n.withColumn("score", F.lit(1.0 / max(total, 1)))
    for i in range(iterations):
        sent = links.join(score.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("times") * F.col("score") / F.col("deg")).alias("got"))
        score = n.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(total, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 4 == 3:
            score = cut(score)
    score = cut(score)
    most = score.agg(F.max("score").alias("most"))
    return score.crossJoin(F.broadcast(most)).select("node", F.when(F.col("most") > 0, F.least(F.col("score") / F.col("most"), F.lit(1.0))).otherwise(F.col("score")).alias("score"))


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number joined to each of ``n`` numbers by the links ``a`` - ``b``."""
    low = np.arange(n)
    while len(a):  # larger roots hook onto smaller ones: at least half of the joined roots go
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := low[low], low):
            low = up
        a, b = low[a], low[b]
        a, b = a[a != b], b[a != b]
    return low


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the links of one partition."""
    x = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if x is None:
        return
    ends = pa.chunked_array(x.column(0).chunks + x.column(1).chunks).combine_chunks().cast("large_string").dictionary_encode()
    names, code = ends.dictionary, ends.indices.to_numpy()
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    names, code = names.take(pa.array(order)), rank[code].astype(np.int64)
    low = _least(code[: x.num_rows], code[x.num_rows :], len(names))
    for i in range(0, len(names), 50_000):
        yield pa.RecordBatch.from_arrays([names[i : i + 50_000].cast("string"), names.take(pa.array(low[i : i + 50_000])).cast("string")], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by disjoint sets, hooking and contraction.

    Up to ``LOCAL_LINKS`` links are merged in one task. More are spread over partitions of that
    size, and only the links from nodes to the smallest of their sets there go on in rounds:
    every label hooks onto the smallest label beside it, the chains that form are halved until
    flat, and edges are contracted to labels; at most half of a component's labels are left,
    so rounds are logarithmic and the edges shrink, until one task merges the rest. Null ends
    join nothing.
    """
    e = edges.select(F.coalesce("src", "dst").cast("string").alias("src"), F.coalesce("dst", "src").cast("string").alias("dst")).where("src is not null")
    e = cut(e.distinct())
    n = e.count()
    parts = e.coalesce(1) if n <= LOCAL_LINKS else e.repartition(-(-n // LOCAL_LINKS), "src")
    found = cut(parts.mapInArrow(_merged, "node string, component string"))
    release(e)
    if n <= LOCAL_LINKS:
        return found
    links = cut_unsized(undirected(found.toDF("src", "dst")).distinct())
    label = cut_unsized(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    release(found)
    links = links.where("a <> b")
    while True:
        local = links.count() <= LOCAL_LINKS
        if local:
            hooks = cut_unsized(links.coalesce(1).mapInArrow(_merged, "node string, component string").toDF("node", "up"))
        else:
            hooks = cut_unsized(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        while not local:  # node -> up -> up: a label's chain falls strictly, so it has no cycle
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = cut_unsized(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks = step.select("node", "up")
            if step.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("component"), "up")
        old, label = label, cut_unsized(label.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        release(old)
        if local:
            return label
        one = links.join(hooks.withColumnRenamed("node", "a"), "a").select(F.col("up").alias("x"), "b")
        links = cut_unsized(one.join(hooks.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("up").alias("b")).where("a <> b").distinct())


def _forest(edges: DataFrame) -> bool:
    """Whether no node has two incoming edges."""
    return edges.groupBy("dst").count().where("count > 1").isEmpty()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an incoming or outgoing edge go, again and again."""
    e, n = edges, edges.count()
    while n:
        ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e2 = cut(e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        m = e2.count()
        if m == n:
            break
        if e is not edges:
            release(e)
        e, n = e2, m
    return e


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(node, c): the smallest label of a node and of all nodes before it."""
    while True:
        got = edges.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("low"))
        new = cut(label.join(got, "node", "left").select("node", F.least("c", F.coalesce("low", "c")).alias("c"), (F.col("low") < F.col("c")).alias("moved")))
        still = not new.where("moved").isEmpty()
        label = new.select("node", "c")
        if not still:
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other, in groups of two or more.

    Colouring: after trimming, each node takes the smallest id that reaches it, and what
    reaches that node within its colour is its group. What is found is taken out, and the
    rest is coloured again. Only edges and one label a node are kept, never pairs of nodes.
    """
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    e = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(e, cut(nodes.withColumn("c", F.col("node"))))
        inner = e.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "a")
        inner = cut(inner)
        group = cut(colour.where("node = c"))
        front = group
        while True:  # backwards from the node that gave the colour
            step = inner.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("a").alias("c")).distinct()
            front = cut(step.join(group, "node", "left_anti"))
            if front.isEmpty():
                break
            group = cut(group.unionByName(front))
        big = group.groupBy("c").count().where("count > 1").select("c")
        found = cut(found.unionByName(group.join(big, "c", "left_semi").select("node", F.col("c").alias("component"))))
        gone = group.select("node")
        left = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        e = _trimmed(cut(left))
    return found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves.

    Where no node has two incoming edges (checked), disjoint sets over the parent links find
    them in a logarithmic number of rounds; else they are the strong components.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    if _forest(e):
        return resolved(cut(parent_table(e, "src", "dst"))).where("label is not null and size(seg) = 1").select("node")
    return strong_components(e).select("node")


def acyclic(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges that stay when they are inserted in ``order`` and each that would close a cycle is refused.

    Only edges inside a strong component can be refused. With one incoming edge a node (the
    linker's output) a component is one cycle, which loses its last edge. Otherwise insertion
    is a sequence by nature, and a component's edges go through one task in their order.
    """
    e = cut(edges)
    if _forest(e.select("src", "dst").distinct()):
        ring = resolved(cut(parent_table(e, "src", "dst"))).where("label is not null and size(seg) = 1").select("node", F.col("label").alias("component"))
    else:
        ring = strong_components(e)
    ring = cut(ring)
    own = ring.select(F.col("node").alias("dst"), F.col("component").alias("of"))
    on = e.join(ring.withColumnRenamed("node", "src"), "src").join(own, "dst").where("component = of")

    def refused(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, "src", "dst"], kind="stable")
        after: dict[str, list[str]] = {}
        out = []
        for a, b in zip(pdf["src"], pdf["dst"]):
            seen, todo = {b}, [b]
            while todo and a not in seen:
                for x in after.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if a in seen:
                out.append((a, b))
            else:
                after.setdefault(a, []).append(b)
        return pd.DataFrame(out, columns=["src", "dst"])

    gone = on.select("component", *dict.fromkeys([*order, "src", "dst"])).groupBy("component").applyInPandas(refused, "src string, dst string")
    return e.join(gone, ["src", "dst"], "left_anti")


def adjacent(chunks: DataFrame) -> DataFrame:
    """(src, dst): next sibling within source, heading path and type, by number in the id."""
    w = Window.partitionBy("source", "heading_path", "chunk_type").orderBy("nr", "chunk_id")
    nr = F.coalesce(F.regexp_extract("chunk_id", r"_(\d+)_", 1).try_cast("int"), F.lit(0))
    return chunks.select("chunk_id", "source", "heading_path", "chunk_type", nr.alias("nr")).select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst")).where("dst is not null")


def belongs_to(chunks: DataFrame) -> DataFrame:
    """(parent, child): headings under their parent heading, others under their heading.

    A parent is looked up by document and heading path (for a heading: the path without its
    last part); what finds none falls back to the document's root.
    """
    c = chunks.select("chunk_id", "document_name", "chunk_type", "heading_path")
    heads = c.where("chunk_type = 'heading' and heading_path is not null").groupBy("document_name", F.col("heading_path").alias("want")).agg(F.min("chunk_id").alias("head"))
    roots = c.where("chunk_type = 'document'").groupBy("document_name").agg(F.min("chunk_id").alias("root"))
    up = F.regexp_replace("heading_path", r"( > )?[^>]*$", "")
    want = F.when(F.col("chunk_type") == "heading", F.rtrim(up)).otherwise(F.col("heading_path"))
    x = c.where("chunk_type <> 'document'").withColumn("want", want).join(heads, ["document_name", "want"], "left").join(roots, "document_name", "left")
    return x.select(F.coalesce("head", "root").alias("parent"), F.col("chunk_id").alias("child")).where("parent is not null and parent <> child")
