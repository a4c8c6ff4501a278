"""Evaluation texts leaking into training text: spaced-seed hashing.

Both sides are brought to their bare form (lower case, letters and digits only). A spaced
seed is a mask over a window of positions: the characters at its ones are hashed, those at
its zeros ignored, so a substitution there leaves the hash as it is. Both sides are hashed at
every position: in an overlap of 50 characters, wherever one or two of them are substituted,
some window has them outside or at zeros of its mask (with three, all but 117 of 19,600
placements). Test and training hashes are joined; a hit names a diagonal (the shift between
the two texts), and each diagonal is verified once over its whole length, substitutions too.

The positions of a seed are characters of the bare form, since overlaps are defined on it: it
has no spaces, Chinese has no words, and 50 characters may hold a single whole German one.

While the items' hashes fit a checked bound (so do then their texts), the workers hold them,
and a document is hashed, joined and verified in one scan without a shuffle. Beyond it hashes
go through a shuffle join without texts, each once a row; documents and items that share any
then meet once, with their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chosen_path import bare_form
from corpusloom.plans.lineage import cut

SHORTEST = 50
# The masks; 1 is hashed, 0 ignored. Spans of 30, weights of 20.
MASKS = ("111011010111001011011010110111", "110110111010011101100111011011")
#: Hashes of items (8 bytes each) that workers may hold to drop other hashes in the scan.
HELD_HASHES = 4_000_000
#: Characters hashed at once, so that what is made on the way stays small.
HASHED_AT_ONCE = 100_000


def codes_of(bare: str) -> np.ndarray:
    return np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def seed_hashes(codes: np.ndarray) -> np.ndarray:
    """The hashes of the windows at every position, one row for each mask."""
    span = len(MASKS[0])
    m = len(codes) - span + 1
    if m < 1:
        return np.empty((len(MASKS), 0), dtype=np.int64)
    codes = codes.astype(np.uint64)
    r = np.random.default_rng(7).integers(1, 2**63, span, dtype=np.uint64) | np.uint64(1)
    sums = np.zeros((len(MASKS), m), dtype=np.uint64)
    for j in range(span):
        part = codes[j : j + m] * r[j]
        for k, mask in enumerate(MASKS):
            if mask[j] == "1":
                sums[k] += part
    sums += np.arange(len(MASKS), dtype=np.uint64)[:, None]
    sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (sums ^ (sums >> np.uint64(32))).view(np.int64)


class Held:
    """Sorted hashes; a table of bits by their last ``BITS`` bits tells most others apart."""

    BITS = 26

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << (self.BITS - 3), dtype=np.uint8)
        x = self.spot(hashes)
        np.bitwise_or.at(self.table, x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))

    def spot(self, h: np.ndarray) -> np.ndarray:
        return h & ((1 << self.BITS) - 1)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where ``h`` has a held hash."""
        x = self.spot(h)
        at = np.nonzero((self.table[x >> 3] >> (x & 7).astype(np.uint8)) & 1)[0]
        i = np.searchsorted(self.hashes, h[at])
        return at[self.hashes[np.minimum(i, len(self.hashes) - 1)] == h[at]]


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all windows of some texts, hashed end to end."""
    span = len(MASKS[0])
    codes = [codes_of(x) for x in texts]
    size = np.array([len(c) for c in codes], dtype=np.int64)
    ends = np.cumsum(size)
    h = seed_hashes(np.concatenate(codes)) if codes else np.empty((len(MASKS), 0), dtype=np.int64)
    at = np.tile(np.arange(h.shape[1], dtype=np.int64), len(MASKS))
    of = np.searchsorted(ends, at, side="right")
    inside = at + span <= ends[np.minimum(of, len(ends) - 1)] if len(at) else np.zeros(0, dtype=bool)
    return of[inside], (at - (ends - size)[np.minimum(of, len(ends) - 1)])[inside] if len(at) else at, h.reshape(-1)[inside]


def grouped(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts, some at a time, so that what is made on the way stays small."""
    some, size = [], 0
    for k, x in enumerate(texts):
        if x:
            some.append(k)
            size += len(x)
        if size >= HASHED_AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bare) to the distinct (h, row)."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for some in grouped(texts):
            of, _, h = windows_of([texts[k] for k in some])
            if len(h):
                u = np.unique(np.stack([h, np.array(b.column(0).take(pa.array(some)), dtype=np.int64)[of]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["h", "row"])


def stretch(same: np.ndarray, miss: int) -> tuple[int, int]:
    """(longest run of equal characters, longest stretch with up to ``miss`` differing ones).

    A stretch begins and ends with equal characters.
    """
    off = np.concatenate(([-1], np.nonzero(~same)[0], [len(same)]))
    exact = int(np.diff(off).max()) - 1
    most = exact
    for m in range(1, miss + 1):
        if len(off) < m + 2:
            break
        size = off[m + 1 :] - off[: -m - 1] - 1
        good = (np.diff(off)[: len(size)] > 1) & (np.diff(off)[m:] > 1)
        most = max(most, int(size[good].max()) if good.any() else 0)
    return exact, most


def overlap(a: np.ndarray, b: np.ndarray, shift: int, miss: int) -> tuple[int, int]:
    """``stretch`` of the diagonal on which a[i] meets b[i - shift]."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    return stretch(a[lo:hi] == b[lo - shift : hi - shift], miss)


class Items:
    """Held items: where each hash stands, behind a table of bits that drops most others."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.codes = ids, [codes_of(x) for x in texts]
        parts = [(np.array(some)[of], at, h) for some in grouped(texts) for of, at, h in [windows_of([texts[k] for k in some])]]
        of, at, h = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(3))
        order = np.argsort(h, kind="stable")
        self.of, self.at, self.h = of[order], at[order], h[order]
        self.held = Held(np.unique(h)) if len(h) else None

    def hits(self, texts: list[str]) -> dict[tuple[int, int], set[int]]:
        """(text, item) to the diagonals on which they share a hash."""
        out: dict[tuple[int, int], set[int]] = {}
        if self.held is None:
            return out
        of, at, h = windows_of(texts)
        near = self.held.places(h)
        lo, hi = (np.searchsorted(self.h, h[near], side=x) for x in ("left", "right"))
        n = hi - lo
        which = np.repeat(near, n)
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        for d, i, s in np.unique(np.stack([of[which], self.of[entry], at[which] - self.at[entry]]), axis=1).T.tolist():
            out.setdefault((d, i), set()).add(s)
        return out


def scan_batches(items: Items, shortest: int, miss: int, kinds: tuple[pa.DataType, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bare) of documents to (key, item, exact, tolerant) against the held items."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for some in grouped(texts):
            own = [texts[k] for k in some]
            rows = []
            for (d, i), shifts in items.hits(own).items():
                a = codes_of(own[d])
                got = [overlap(a, items.codes[i], s, miss) for s in shifts]
                most = max(t for _, t in got)
                if most >= shortest:
                    rows.append((some[d], items.ids[i], max(e for e, _ in got), most))
            if rows:
                k, i, e, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(i, kinds[1]), pa.array(e, pa.int64()), pa.array(t, pa.int64())], names=["key", "item", "exact", "tolerant"])


def verify_batches(shortest: int, miss: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key, item, bare, item_bare) that share a hash to (key, item, exact, tolerant)."""
    for b in batches:
        ex, to = [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            one = Items([0], [y])
            got = [overlap(codes_of(x), one.codes[0], s, miss) for s in one.hits([x]).get((0, 0), ())] or [(0, 0)]
            ex.append(max(e for e, _ in got))
            to.append(max(t for _, t in got))
        keep = pa.array(np.array(to) >= shortest)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ex, pa.int64()), pa.array(to, pa.int64())], names=["key", "item", "exact", "tolerant"]).filter(keep)


def leaked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", shortest: int = SHORTEST, substitutions: int = 2, held_hashes: int = HELD_HASHES) -> DataFrame:
    """Documents that hold passages of evaluation items, one row for each of both.

    Returns the two keys, exact_run (the longest run of equal characters, in bare form) and
    overlap (the longest stretch with up to ``substitutions`` differing characters, equal at
    both ends), each over the whole texts. Rows have an overlap of ``shortest`` or more; an
    exact run of that length is found always, and from 50 on one with up to two substitutions;
    one with more if a mask ignores them. Null keys and null, empty or shorter texts give
    nothing; repeated rows count once. An empty table on either side gives an empty result.
    """
    span = len(MASKS[0])
    if shortest < span:
        raise ValueError(f"the shortest overlap must be {span} or more")
    kinds = tuple(d.schema[k].dataType for d, k in ((docs, doc_key), (items, item_key)))
    out = f"key {kinds[0].simpleString()}, item {kinds[1].simpleString()}, exact bigint, tolerant bigint"
    item = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), bare_form(F.col(text)).alias("bare")).where(F.length("bare") >= shortest).distinct()
    doc = docs.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("key"), bare_form(F.col(text)).alias("bare")).where(F.length("bare") >= shortest)
    # each character begins one window a mask at most; the sum is the checked bound of what is held
    windows = item.agg(F.sum(F.length("bare"))).first()[0] or 0
    if windows * len(MASKS) <= held_hashes:
        from pyspark.sql.pandas.types import to_arrow_type

        own = item.collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r.item for r in own], [r.bare for r in own]))
        types = tuple(map(to_arrow_type, kinds))
        looked = doc.mapInArrow(lambda it: scan_batches(Items(*shared.value), shortest, substitutions, types, it), out)
    else:
        item = cut(item.withColumn("row", F.xxhash64("item", "bare")))
        doc = doc.distinct().withColumn("doc_row", F.xxhash64("key", "bare"))
        ih = item.select("row", "bare").mapInArrow(hash_batches, "h bigint, row bigint")
        dh = doc.select(F.col("doc_row").alias("row"), "bare").mapInArrow(hash_batches, "h bigint, row bigint").withColumnRenamed("row", "doc_row")
        # rows that share a hash, one for both however many hashes they share
        met = dh.join(ih, "h").select("doc_row", "row").distinct()
        hits = met.join(item.withColumnRenamed("bare", "item_bare"), "row").join(doc, "doc_row").select("key", "item", "bare", "item_bare")
        looked = hits.mapInArrow(lambda it: verify_batches(shortest, substitutions, it), out)
    found = looked.groupBy("key", "item").agg(F.max("exact").alias("exact_run"), F.max("tolerant").alias("overlap"))
    return found.select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "exact_run", "overlap")
