"""Near-duplicate records: chosen-path set similarity join.

After Christiani and Pagh, "Set Similarity Search Beyond MinHash", and Christiani, Pagh and
Sivertsen, "Scalable and Robust Set Similarity Join" (CPSJOIN). Every text becomes the set
of its character 4-grams, embedded as minwise tokens. In each of several independent trees
a node picks one or two minwise positions (1 / threshold on average), and a record moves to
the child named by its token there. Nodes of at most ``leaf`` records are compared
exhaustively, by sketches first; candidates are verified exactly.

Trees are repeated to a target recall. A pair at the threshold stays together in half of the
trees down to level ``HOT_LEVEL``, so ``TREES`` are enough for records whose nodes are small
by then. Records of nodes that go deeper, where fewer trees keep a pair, get ``MORE_TREES``.

Spark plan: exact copies (equal bare form) are collapsed with a map-side combined aggregate
before anything else. Branching is a narrow chain of expressions; what is shuffled to find
oversized nodes is one counter per node, and only those nodes branch on. The compared rows
carry a 16-byte sketch, never the text. Nodes that stay oversized at the last level are cut
into blocks, and each pair of blocks is a task group of its own, so no node is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_groups
from corpusloom.llm.pairs import expanded, pairs_within
from corpusloom.plans.lineage import cut

#: Trees of every record, and more of those in nodes that branch on from ``HOT_LEVEL``.
TREES, MORE_TREES, HOT_LEVEL = 12, 10, 4
#: Minwise positions of each tree.
COORDS = 32
SKETCH = 128
#: A node list of up to this many rows (about 50 bytes each in memory) may be broadcast.
BROADCAST_NODES = 200_000


def bare_form(text: Column) -> Column:
    """Lower case, only letters and digits, no space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def grams(bare: str) -> np.ndarray:
    """The distinct 4-character substrings, each packed into 64 bits.

    Four code points below 2^16 fit exactly; others are mixed into 64 bits.
    """
    c = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 4:
        return np.empty(0, dtype=np.uint64)
    if c.max() > 0xFFFF:
        c = np.where(c > 0xFFFF, c * np.uint64(0x9E3779B97F4A7C15), c)
    s = np.uint64
    return np.unique(c[:-3] ^ (c[1:-2] << s(16)) ^ (c[2:-1] << s(32)) ^ (c[3:] << s(48)))


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of 32 bits, which are multiplied some at a time where 64 bits aren't."""
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed_batches(first: int, last: int, trees: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, bare) to (rep, sig, s0, s1): minwise tokens of trees [first, last) of ``trees``, and a 1-bit minwise sketch."""
    coords = (last - first) * COORDS
    a, b = _hashes(trees * COORDS + SKETCH)
    own = np.r_[first * COORDS : last * COORDS, trees * COORDS : trees * COORDS + SKETCH]
    a, b = a[own], b[own]
    step = 16
    for batch in batches:
        reps, sigs, sk = [], [], []
        for rep, bare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g = grams(bare)
            if not len(g):
                continue
            g = (_mix(g) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            low = np.full(len(a), np.uint32(2**32 - 1))
            for i in range(0, len(g), step * 16):
                part = g[i : i + step * 16]
                low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
            low = _mix(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            reps.append(rep)
            sigs.append((low[:coords] & np.uint64(0x7FFF)).astype(np.int16))
            sk.append(np.packbits((low[coords:] & np.uint64(1)).astype(np.uint8)).view(np.int64))
        if reps:
            flat = pa.array(np.concatenate(sigs), pa.int16())
            offs = pa.array(np.arange(0, coords * len(reps) + 1, coords, dtype=np.int32))
            sk2 = np.stack(sk)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.string()), pa.ListArray.from_arrays(offs, flat), pa.array(sk2[:, 0]), pa.array(sk2[:, 1])], names=["rep", "sig", "s0", "s1"])


def compare_batches(cut_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare all rows of each node (rows sorted by node); emit pairs with near sketches.

    Input: node, block, other, s0, s1, rep. Rows of a node of blocks are compared if their
    blocks differ, rows of a plain node (block = other) always.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        node, block, other = (t.column(i).to_numpy() for i in range(3))
        s0, s1 = (t.column(i).to_numpy().view(np.uint64) for i in (3, 4))  # bit counts of signed numbers ignore the sign
        n, left, right = len(node), [], []
        live = np.arange(n)
        for d in range(1, n):
            live = live[live + d < n]
            live = live[node[live] == node[live + d]]
            if not len(live):
                break
            i, j = live, live + d
            near = np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= cut_bits
            near &= (block[i] == other[i]) | (block[i] != block[j])
            left.append(i[near])
            right.append(j[near])
        i, j = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
        reps = t.column(5).combine_chunks()
        x, y = reps.take(pa.array(i)), reps.take(pa.array(j))
        swap = pa.compute.greater(x, y)
        p, q = pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y)
        u = pa.table({"a": p, "b": q}).group_by(["a", "b"]).aggregate([]).combine_chunks()
        return pa.RecordBatch.from_arrays([u.column("a").combine_chunks(), u.column("b").combine_chunks()], names=["a", "b"]) if len(u) else None

    import pyarrow.compute  # noqa: F401

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        node = held.column(0).to_numpy()
        end = int(np.searchsorted(node, node[-1], side="left")) if len(node) and node[0] != node[-1] else 0
        if end:
            if (out := pairs(held.slice(0, end))) is not None:
                yield out
            held = held.slice(end)
    if held is not None and len(held) > 1 and (out := pairs(held)) is not None:
        yield out


def verify_batches(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, bare_a, bare_b) to the pairs (a, b) with Jaccard similarity at the threshold or above."""
    for batch in batches:
        keep, last, ga = [], None, None
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if x != last:
                last, ga = x, grams(x)
            gb = grams(y)
            both = len(np.intersect1d(ga, gb, assume_unique=True))
            keep.append(both >= threshold * (len(ga) + len(gb) - both) - 1e-9)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _branch(frontier: DataFrame, threshold: float) -> DataFrame:
    """Move every row to its one or two children."""
    second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
    pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDS)).cast("int")
    child = lambda k: F.xxhash64("node", pick(k), F.get("sig", pick(k)))
    kids = F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))
    return frontier.select(F.explode(F.array_distinct(kids)).alias("node"), "rep", "sig", "s0", "s1")


def _with_nodes(rows: DataFrame, nodes: DataFrame, n: int, how: str) -> DataFrame:
    """Join by node; the node list is broadcast only when its counted size allows."""
    return rows.join(F.broadcast(nodes) if n <= BROADCAST_NODES else nodes, "node", how)


_SLIM = ("node", "block", "other", "s0", "s1", "rep")


def _grown(sets: DataFrame, first: int, last: int, threshold: float, leaf: int, start: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows to compare of trees [first, last), and the records in nodes that branched on from ``HOT_LEVEL``."""
    roots = F.array(*[F.struct(F.xxhash64(F.lit("tree"), F.lit(k)).alias("node"), F.slice("sig", (k - first) * COORDS + 1, COORDS).alias("sig")) for k in range(first, last)])
    frontier = sets.select(F.explode(roots).alias("root"), "rep", "s0", "s1").select("root.node", "rep", "root.sig", "s0", "s1")
    for _ in range(start):
        frontier = _branch(frontier, threshold)
    leaves: list[DataFrame] = []
    slim = [F.col("node"), F.lit(0).alias("block"), F.lit(0).alias("other"), F.col("s0"), F.col("s1"), F.col("rep")]
    hot = None
    for level in range(start, depth + 1):
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
        big = cut(sizes.where(F.col("size") > leaf))
        n = big.count()
        if not n:
            leaves.append(frontier.select(*slim))
            break
        leaves.append(_with_nodes(frontier, big.select("node"), n, "left_anti").select(*slim))
        # kept, as the next level's counts, its leaves and its rows would each start from the roots
        frontier = cut(_with_nodes(frontier, big, n, "inner"))
        if level == max(start, min(HOT_LEVEL, depth)):
            hot = frontier.select("rep").distinct()
        if level < depth:
            frontier = _branch(frontier, threshold)
            continue
        # still oversized at the last level: blocks of the node, each pair of blocks by itself
        blocks = F.ceil(F.col("size") / leaf).cast("int")
        mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        cells = frontier.select("node", "rep", "s0", "s1", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        leaves.append(cells.select(F.xxhash64("node", lo, hi).alias("node"), "block", "other", "s0", "s1", "rep"))
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    return rows.select(*_SLIM), hot


def similar_sets(reps: DataFrame, threshold: float = 0.7, trees: int = TREES, more: int = MORE_TREES, leaf: int = 256, start: int = 2, depth: int = 9) -> DataFrame:
    """Pairs (a, b), a < b, of representatives whose 4-gram sets have Jaccard >= threshold.

    ``reps`` has rep (unique id) and bare (text). Every tree has minwise positions of its own,
    so trees are independent. A pair at the threshold has one common child a node on average,
    so its share of trees in which it stays together falls with depth: 0.66 at 2, 0.50 at 4,
    0.32 at 9. With 12 trees at most 0.5^12 = 0.02% of such pairs are lost before level 4; a
    pair whose records are in larger nodes there has 22, of which at most 0.683^22 = 0.02% lose
    it at the last level, and 0.05% are lost by the sketches; a pair that is found is exact.
    Texts of fewer than four characters have no set and no pair.
    """
    kind = "rep string, sig array<smallint>, s0 bigint, s1 bigint"
    every = trees + more
    texts = reps.select("rep", "bare")
    sets = cut(texts.mapInArrow(lambda it: embed_batches(0, trees, every, it), kind))
    rows, hot = _grown(sets, 0, trees, threshold, leaf, start, depth)
    if hot is not None and more:
        deep = cut(texts.join(hot, "rep", "left_semi").mapInArrow(lambda it: embed_batches(trees, every, every, it), kind))
        rows = rows.unionByName(_grown(deep, trees, every, threshold, leaf, start, depth)[0])
    # sketch bits that may differ: those of the threshold and 3.3 standard deviations
    miss = (1 - threshold) / 2
    bits = int(SKETCH * miss + 3.3 * (SKETCH * miss * (1 - miss)) ** 0.5)
    rows = rows.repartition("node").sortWithinPartitions("node")
    found = rows.mapInArrow(lambda it: compare_batches(bits, it), "a string, b string").distinct()
    a = reps.select(F.col("rep").alias("a"), F.col("bare").alias("bare_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("bare").alias("bare_b"))
    both = found.join(a, "a").join(b, "b").select("a", "b", "bare_a", "bare_b")
    return both.mapInArrow(lambda it: verify_batches(threshold, it), "a string, b string")


def text_classes(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, bare, k): distinct ids with their bare forms and the digest of the form."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.coalesce(bare_form(text), F.lit("")).alias("bare")).where("id is not null")
    return rows.withColumn("k", F.md5(F.col("bare"))).dropDuplicates(["id", "k"])


def representatives(rows: DataFrame) -> DataFrame:
    """(k, rep, bare, size): one row per class of exact copies, the smallest id standing for it."""
    return rows.groupBy("k").agg(F.min("id").alias("rep"), F.first("bare").alias("bare"), F.count(F.lit(1)).alias("size"))


def question_text() -> Column:
    return F.concat(F.coalesce("question", F.lit("")), F.coalesce("options", F.lit("")))


def similar_pairs(df: DataFrame, key: str, text: Column, threshold: float = 0.7, **how: int) -> DataFrame:
    """All pairs (id_a < id_b) of records whose 4-gram sets have Jaccard >= threshold.

    Copies are expanded, as the result asks for pairs of ids, in blocks (``pairs``). Null texts count as empty and,
    like all texts of under four letters and digits, are like nothing. A null id is dropped;
    an id with several texts is alike if one of them is. Repeated rows count once.
    """
    rows = cut(text_classes(df, key, text))
    reps = cut(representatives(rows))
    links = similar_sets(reps, threshold, **how)
    member = cut(rows.join(reps.where(F.length("bare") >= 4).select("k", "rep"), "k").select("rep", "id"))
    apart = expanded(expanded(links, "a", member, "rep", "id", "x"), "b", member, "rep", "id", "y").select("x", "y")
    pairs = apart.unionByName(pairs_within(member, "rep", "id").select("x", "y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: Column, threshold: float = 0.7, **how: int) -> DataFrame:
    """One row per record: id, class_id (of exact copies), n_links and group_id.

    ``n_links`` counts the other records alike above the threshold, copies included;
    ``group_id`` is the smallest class id among the records linked directly or through
    others. Copies are never expanded into pairs. See ``similar_pairs`` for nulls.
    """
    rows = cut(text_classes(df, key, text))
    reps = cut(representatives(rows))
    links = cut(similar_sets(reps, threshold, **how))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = reps.select(F.col("rep").alias("b"), "size")
    near = both.join(size, "b").groupBy("a").agg(F.sum("size").alias("n")).withColumnRenamed("a", "rep")
    group = connected_groups(links, "a", "b").select(F.col("name").alias("rep"), "group_name")
    of = reps.join(near, "rep", "left").join(group, "rep", "left")
    copies = F.when(F.length("bare") >= 4, F.col("size") - 1).otherwise(0)
    of = of.select("k", F.col("rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + copies).alias("n_links"), F.coalesce("group_name", "rep").alias("group_id"))
    return rows.select("id", "k").join(of, "k").select("id", "class_id", "n_links", "group_id")
