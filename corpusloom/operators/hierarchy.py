"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles.

Plan, for links (child -> parent) of unknown depth:

1. *Partition-local weighted disjoint sets.* Links are spread by child over as many
   partitions as hold ``LOCAL_LINKS`` each. A partition unites its links in a disjoint-set
   forest by weight, with path compression; every member keeps its offset (levels) from the
   representative, so offsets from the top of the set follow. A link inside one set closes a
   cycle. An indexed traversal from the tops then gives each node the ids between.
2. *Merging.* The sets of one partition hang from nodes of others. Only those tops (one row
   for each node that a set hangs from) are merged: each round replaces what a top hangs
   from by what that hangs from, so merged sets double in height a round and the rounds are
   logarithmic in the number of partitions a path crosses. With one partition there is none.
3. *Cycles across partitions* are what is left when a round closes nothing. Their members
   are the stable image of the parent function; they become tops, and their trees are
   resolved by the same steps.
4. *Descendants* are counted in each set by offsets, bottom up; a set that hangs from a node
   of another partition adds its size along that node's path.

Only joins and aggregates cross partitions: nothing is collected, no task holds more than
``LOCAL_LINKS`` links, and a hot parent is one row in one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut, release

#: Links of a partition, which one task holds at once.
LOCAL_LINKS = 400_000
#: Kinds of sets: under a root, on or below a cycle, under a node of another partition.
ROOTED, CYCLIC, OPEN = 0, 1, 2
_SETS = "node string, anc string, kind int, label string, n bigint, seg array<string>"


class Forest:
    """Weighted disjoint sets over links; ``off`` is the offset from the one above."""

    def __init__(self, size: int) -> None:
        self.rep = list(range(size))
        self.off = [0] * size
        self.weight = [1] * size

    def find(self, x: int) -> tuple[int, int]:
        """Representative and offset from it; what lies between is compressed."""
        rep, chain = self.rep, []
        while rep[x] != x:
            chain.append(x)
            x = rep[x]
        off = 0
        for y in reversed(chain):
            off += self.off[y]
            rep[y], self.off[y] = x, off
        return x, off

    def link(self, child: int, parent: int) -> bool:
        """Unite the sets so that ``child`` is one level below ``parent``; False if they are one."""
        (a, x), (b, y) = self.find(child), self.find(parent)
        if a == b:
            return False
        apart = y + 1 - x  # levels of a below b
        if self.weight[a] > self.weight[b]:
            a, b, apart = b, a, -apart
        self.rep[a], self.off[a] = b, apart
        self.weight[b] += self.weight[a]
        return True


def local_sets(nodes: list[str], parents: list[str | None]) -> Iterator[tuple[str, str, int, str | None, int, list[str]]]:
    """(node, anc, kind, label, n, seg) of the links of one partition.

    ``anc`` is the root, the cycle member or the outside node that the set hangs from,
    ``seg`` the ids from the top of the set down to the node (the outside node is left out),
    ``n`` the descendants in the set, ``label`` the smallest id of a cycle.
    """
    m = len(nodes)
    index = {x: i for i, x in enumerate(nodes)}
    names = list(nodes)
    up = []
    for p in parents:
        if p is not None and p not in index:
            index[p] = len(names)
            names.append(p)
        up.append(-1 if p is None else index[p])
    sets = Forest(len(names))
    closing = [i for i in range(m) if up[i] >= 0 and not sets.link(i, up[i])]
    depth = np.array([sets.find(i)[1] for i in range(m)], dtype=np.int64)
    label: dict[int, str] = {}
    for i in closing:
        ring = [i]
        while up[ring[-1]] != i:
            ring.append(up[ring[-1]])
        label.update(dict.fromkeys(ring, min(names[x] for x in ring)))
    for i in label:
        up[i] = -1  # a member of a cycle is a top
    below: list[list[int]] = [[] for _ in range(m)]
    tops = []
    n = [0] * m
    for i in np.argsort(-depth, kind="stable").tolist():  # a level of a set after the ones below it
        if 0 <= up[i] < m:
            n[up[i]] += n[i] + 1
            below[up[i]].append(i)
        else:
            tops.append(i)
    for t in tops:
        kind = CYCLIC if t in label else OPEN if up[t] >= 0 else ROOTED
        anc = names[up[t]] if kind == OPEN else names[t]
        path: list[str] = []
        todo = [(t, 0)]
        while todo:
            x, d = todo.pop()
            del path[d:]
            path.append(names[x])
            yield names[x], anc, kind, label.get(t), n[x], path[:]
            todo += [(y, d + 1) for y in below[x]]


def local_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (node, parent) rows of a partition to the rows of ``local_sets``, some at a time."""
    nodes: list[str] = []
    parents: list[str | None] = []
    for b in batches:
        nodes += b.column(0).to_pylist()
        parents += b.column(1).to_pylist()
    rows: list[tuple] = []
    held = 0
    for row in local_sets(nodes, parents):
        rows.append(row)
        held += len(row[5])
        if held > 500_000 or len(rows) >= 50_000:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["node", "anc", "kind", "label", "n", "seg"])


def parent_table(links: DataFrame, parent: str, child: str) -> DataFrame:
    """One row (node, parent) per id; parent is null at roots and parent-less declarations.

    A null or empty child is no node, and only its parent counts. Repeated links count once.
    Where a child has several parents the smallest id is kept, as a tree needs one.
    """
    p = F.when(F.col(parent) != "", F.col(parent))
    c = F.when(F.col(child) != "", F.col(child))
    rows = links.select(c.alias("node"), p.alias("parent"))
    tops = rows.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return rows.unionByName(tops).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))


def cycle_members(up: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """(node, label): the nodes on cycles, label being the smallest id of the cycle.

    ``open_nodes`` are on or below cycles, and all that is above one of them is among them.
    """
    own = cut(up.join(open_nodes, "node", "left_semi").select("node", F.col("parent").alias("anc")))
    jump, size = own, own.select("anc").distinct().count()
    while True:
        j2 = jump.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        new = cut(jump.join(j2, "anc").select("node", F.col("anc2").alias("anc")))
        if jump is not own:
            release(jump)
        jump, now = new, new.select("anc").distinct().count()
        if now == size:
            break
        size = now
    on = jump.select(F.col("anc").alias("node")).distinct()
    ring = cut(own.join(on, "node", "left_semi").select("node", "anc", F.least("node", "anc").alias("label")))
    while True:
        r2 = ring.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("label").alias("label2"))
        new = cut(ring.join(r2, "anc").select("node", F.col("anc2").alias("anc"), F.least("label", "label2").alias("label"), (F.col("label2") < F.col("label")).alias("moved")))
        release(ring)
        ring = new.drop("moved")
        if new.where("moved").isEmpty():
            return ring.select("node", "label")


def resolved(up: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, kind, label, n, seg): the top, the ids from it and the descendants of every node.

    ``kind`` is ROOTED or CYCLIC, ``seg`` begins with the root or a member of the cycle;
    ``n`` of a cycle's member counts what hangs from it, the cycle itself left out.
    """
    parts = max(1, -(-up.count() // local_links))
    local = up.repartition(parts, "node").mapInArrow(local_batches, _SETS)
    if parts == 1:
        return local.select("node", "kind", "label", "n", "seg")
    local = cut(local)
    hung = local.where(F.col("kind") == OPEN)
    tops = local.join(hung.select(F.col("anc").alias("node")).distinct(), "node", "left_semi").select("node", "anc", "kind", "label", "seg")
    tops = cut(tops)
    left = tops.where(F.col("kind") == OPEN).count()
    while left:
        over = tops.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("kind").alias("kind2"), F.col("label").alias("label2"), F.col("seg").alias("seg2"))
        grown = tops.where(F.col("kind") == OPEN).join(over, "anc").select("node", F.col("anc2").alias("anc"), F.col("kind2").alias("kind"), F.col("label2").alias("label"), F.concat("seg2", "seg").alias("seg"))
        new = cut(tops.where(F.col("kind") != OPEN).unionByName(grown))
        release(tops)
        tops, now = new, new.where(F.col("kind") == OPEN).count()
        if now == left:
            break
        left = now
    closed = tops.where(F.col("kind") != OPEN).select(F.col("node").alias("anc"), F.col("kind").alias("kind2"), F.col("label").alias("label2"), F.col("seg").alias("seg2"))
    merged = hung.join(closed, "anc").select("node", F.col("kind2").alias("kind"), F.col("label2").alias("label"), "n", F.concat("seg2", "seg").alias("seg"))
    # a set that hangs from another's node adds its size to that node and all above it
    sizes = hung.where(F.size("seg") == 1).groupBy("anc").agg(F.sum(F.col("n") + 1).alias("more"))
    more = closed.join(sizes, "anc").select(F.explode("seg2").alias("node"), "more").groupBy("node").agg(F.sum("more").alias("more"))
    rows = local.where(F.col("kind") != OPEN).select("node", "kind", "label", "n", "seg").unionByName(merged)
    rows = rows.join(more, "node", "left").select("node", "kind", "label", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "seg")
    if not left:
        return rows
    lost = cut(hung.join(tops.where(F.col("kind") == OPEN).select(F.col("node").alias("anc")), "anc", "left_semi").select("node"))
    ring = cut(cycle_members(up, lost))
    inner = up.join(lost, "node", "left_semi").join(ring, "node", "left").select("node", F.when(F.col("label").isNull(), F.col("parent")).alias("parent"))
    at = ring.select(F.col("node").alias("top"), F.col("label").alias("of"))
    again = resolved(cut(inner), local_links).withColumn("top", F.col("seg")[0]).join(at, "top")
    return rows.unionByName(again.select("node", F.lit(CYCLIC).alias("kind"), F.col("of").alias("label"), "n", "seg"))


def hierarchy(links: DataFrame, parent: str = "parent_id", child: str = "child_id", sep: str = " > ", local_links: int = LOCAL_LINKS) -> DataFrame:
    """Full hierarchy of parent-child rows.

    Returns node_id, root_id, depth (0 at a root), path (ids from root to node joined by
    ``sep``), n_descendants and cycle_id. For a node on or below a cycle, root_id and path
    are empty, depth is -1 and cycle_id is the smallest id of the cycle (null elsewhere).
    A link of a node to itself is a cycle of one. An empty table gives an empty result;
    other columns of ``links`` are ignored. See ``parent_table`` for nulls and repeats.
    """
    rows = resolved(cut(parent_table(links, parent, child)), local_links)
    rooted = F.col("kind") == ROOTED
    rows = cut(rows.select("node", "label", "n", (F.size("seg") == 1).alias("top"), F.when(rooted, F.col("seg")[0]).alias("root"), F.when(rooted, F.size("seg") - 1).alias("depth"), F.when(rooted, F.array_join("seg", sep)).alias("path")))
    # everything below a cycle is reachable from each of its members
    whole = rows.where("label is not null").groupBy("label").agg((F.count(F.lit(1)) - 1).alias("all"))
    out = rows.join(whole, "label", "left") if not rows.where("label is not null").isEmpty() else rows.withColumn("all", F.lit(None).cast("bigint"))
    return out.select(
        F.col("node").alias("node_id"),
        F.coalesce("root", F.lit("")).alias("root_id"),
        F.coalesce("depth", F.lit(-1)).cast("bigint").alias("depth"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.when(F.col("label").isNotNull() & F.col("top"), F.col("all")).otherwise(F.col("n")).cast("bigint").alias("n_descendants"),
        F.col("label").alias("cycle_id"),
    )


def descendants(links: DataFrame, parent: str = "parent_id", child: str = "child_id", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node_id, descendant_id, distance): every node reachable downwards from every node.

    ``distance`` is the number of links between the two; a node is no descendant of itself.
    Below a cycle each of its members has all that hangs from it, the other members
    included; the distance between two members, and from a member to what hangs from
    another, is null. See ``hierarchy`` for nulls, repeats and several parents.
    """
    rows = cut(resolved(cut(parent_table(links, parent, child)), local_links).select("node", "label", "seg"))
    size = F.size("seg")
    one = rows.select(F.col("node").alias("descendant_id"), size.alias("size"), F.posexplode(F.slice("seg", F.lit(1), size - 1)).alias("at", "node_id"))
    one = one.select("node_id", "descendant_id", (F.col("size") - 1 - F.col("at")).cast("bigint").alias("distance"))
    ring = rows.where(F.col("label").isNotNull() & (size == 1)).select("label", F.col("node").alias("node_id"))
    held = rows.where("label is not null").select("label", F.col("node").alias("descendant_id"), F.col("seg")[0].alias("own"))
    # pairs with the member a node hangs from are among the paths already
    other = ring.join(held, "label").where("own <> node_id").select("node_id", "descendant_id", F.lit(None).cast("bigint").alias("distance"))
    return one.unionByName(other)
