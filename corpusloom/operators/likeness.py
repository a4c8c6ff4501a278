"""Pairs of sparse vectors that are alike, compared where they meet: no pair is moved unless it is alike.

Vectors travel packed, s holding slots (two bytes each) and w weights (doubles) of unit length,
ordered by weight, which shuffles compress well. What belongs to a vector travels with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from corpusloom.plans.lineage import cut
from corpusloom.plans.sizes import small

#: Vectors of a block; larger groups are compared as pairs of blocks.
BLOCK = 32_768
#: Blocks of the largest group up to which groups are compared whole.
WHOLE = 12
#: Sums that slots are folded to for a bound, pairs scored at once, rows sent at once.
FOLD, SCORED, SENT = 64, 200_000, 20_000
_BITS = 15  # of a slot; the next bit marks an entry of the head
_SLACK = 1e-6  # scores are rounded to six digits


def _packed(rows: pa.RecordBatch, of: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """``rows`` with s and w of unit length; entries of one row and slot are summed."""
    key, at = np.unique(of.astype(np.int64) << _BITS | slot, return_inverse=True)
    w, row = np.bincount(at, weights=weight, minlength=len(key)), key >> _BITS
    w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=rows.num_rows))[row]
    order = np.lexsort((key, w, row))
    n = np.bincount(row, minlength=rows.num_rows)
    return _with(rows, n, (key[order] & ((1 << _BITS) - 1)).astype("<u2"), w[order])


def _with(rows: pa.RecordBatch, n: np.ndarray, s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(n)])
    made = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())]) for x in (s, w)]
    return pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, "s", "w"])


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of entries of each row, slots and weights of all."""
    raw = lambda c, kind: np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), dtype=kind)
    n = pc.binary_length(b.column(b.schema.get_field_index("s"))).to_numpy(zero_copy_only=False) // 2
    return n.astype(np.int64), raw("s", "<u2").astype(np.int64), raw("w", "<f8")


def _hashed(words: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and weight of lists of words: 1 at md5 and 0.5 at sha256 of each, as ``text.hashed_words``."""
    coded = words.flatten().dictionary_encode()
    every = [x.encode() for x in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy()
    of = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    slots = [np.array([int(f(x).hexdigest()[-3:], 16) % dim for x in every], dtype=np.int64)[at] for f in (hashlib.md5, hashlib.sha256)]
    return np.concatenate([of, of]), np.concatenate(slots), np.repeat([1.0, 0.5], len(at))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def _vectors_of(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("s", BinaryType()), StructField("w", BinaryType())])


def word_rows(rows: DataFrame, text: Column, dim: int = 2048) -> DataFrame:
    """``rows`` with the packed hash embedding of a text, empty if it has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _packed(b.select(b.schema.names[:-1]), *_hashed(b.column(b.num_columns - 1), dim))

    return rows.withColumn("_words", _words(text)).mapInArrow(run, _vectors_of(rows))


def entry_rows(vectors: DataFrame, key: str) -> DataFrame:
    """Packed vectors of (key, slot, w) of unit length."""
    rows = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("w", "slot"))).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1)
                w, slot = (v.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("w", "slot"))
                if len(slot) and not 0 <= slot.min() <= slot.max() < 1 << _BITS:
                    raise ValueError(f"slots must be below {1 << _BITS}")
                yield _with(b.select([key]), pc.list_value_length(v).to_numpy(), slot.astype("<u2"), w.astype("<f8"))

    return rows.mapInArrow(run, _vectors_of(rows.select(key)))


def word_scores(pairs: DataFrame, left: Column, right: Column, dim: int = 2048) -> DataFrame:
    """``pairs`` with the score (not rounded) of the hash embeddings of two texts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows))], names=["at"])
                score = np.zeros(b.num_rows)
                a, c = (_Block(_packed(at, *_hashed(b.column(b.num_columns - k), dim))) for k in (2, 1))
                both = np.flatnonzero((a.n > 0) & (c.n > 0))
                for k in range(0, len(both), SCORED):
                    part = both[k : k + SCORED]
                    score[part] = a.scores(c, part, part)[0]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(score)], names=[*b.schema.names[:-2], "score"])

    return pairs.withColumn("_left", _words(left)).withColumn("_right", _words(right)).mapInArrow(run, StructType([*pairs.schema.fields, StructField("score", DoubleType())]))


class _Block:
    """Vectors that are compared with those of another block."""

    def __init__(self, rows: pa.RecordBatch, fold: bool = False):
        self.n, slot, self.w = _entries(rows)
        self.slot, self.head = (slot & ((1 << _BITS) - 1)).astype(np.int32), slot >> _BITS > 0
        self.start, of = np.cumsum(self.n) - self.n, np.repeat(np.arange(len(self.n)), self.n)
        key = of << _BITS | self.slot
        self.order = np.argsort(key).astype(np.int32)
        self.key = key[self.order]
        if fold:
            self.fold = np.sqrt(np.bincount(of * FOLD + self.slot % FOLD, weights=self.w * self.w, minlength=len(self.n) * FOLD)).reshape(-1, FOLD).astype(np.float32)

    def scores(self, other: _Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of pairs, and the smallest slot that both have in their heads."""
        n = self.n[i]
        pair = np.repeat(np.arange(len(i)), n)
        mine = np.arange(len(pair)) + np.repeat(self.start[i] - (np.cumsum(n) - n), n)
        key = j[pair] << _BITS | self.slot[mine]
        at = np.minimum(np.searchsorted(other.key, key), len(other.key) - 1)
        hit = np.flatnonzero(other.key[at] == key)
        pair, mine, its = pair[hit], mine[hit], other.order[at[hit]]
        score = np.bincount(pair, weights=self.w[mine] * other.w[its], minlength=len(i))
        head, first = np.flatnonzero(self.head[mine] & other.head[its]), np.full(len(i), 1 << _BITS)
        np.minimum.at(first, pair[head], self.slot[mine[head]])
        return score, first


def _compared(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i < j) and scores of the pairs of a group: of all its rows, or of two blocks."""
    b = rows.combine_chunks().to_batches()[0]
    lo, hi, slot = (b.column(b.schema.get_field_index(c))[0].as_py() for c in ("lo", "hi", "slot"))
    mine = b.column(b.schema.get_field_index("mine")).to_numpy()
    at = [np.flatnonzero(mine == k) for k in (lo, hi)]
    left = _Block(b.take(pa.array(at[0])), True)
    right = left if lo == hi else _Block(b.take(pa.array(at[1])), True)
    for k in range(0, len(at[0]), 256):
        # by Cauchy and Schwarz, lengths of folded parts give a bound of the score
        most = left.fold[k : k + 256] @ (right.fold[k:] if lo == hi else right.fold).T
        i, j = np.divmod(np.flatnonzero(most >= least - 1e-4), max(1, most.shape[1]))
        i, j = i + k, j + (k if lo == hi else 0)
        if lo == hi:
            i, j = i[i < j], j[i < j]
        for m in range(0, len(i), SCORED):
            x, y = i[m : m + SCORED], j[m : m + SCORED]
            score, first = left.scores(right, x, y)
            ok = score >= least - _SLACK
            if slot >= 0:  # a pair that meets in several groups belongs to one
                ok &= first == slot
            x, y = at[0][x[ok]], at[1][y[ok]]
            yield np.minimum(x, y), np.maximum(x, y), score[ok]


def alike(vectors: DataFrame, key: str, least: float, within: str | None = None) -> DataFrame:
    """(a, b, score): pairs of packed vectors with a cosine of ``least`` or more, a.key < b.key.

    ``vectors`` has a unique key, s, w and any other columns, and is read several times, so it
    should be cut; a and b are structs of all but s and w. Empty vectors are like nothing. With ``within`` only pairs with an equal value of that column count (null equals
    nothing). Small groups are compared whole. Else entries are ordered by how few vectors have
    them; once what is left of a vector is shorter than ``least``, it can't make a pair by
    itself, so two vectors that are alike share an entry before that point, their heads: each
    vector is sent to the slots of its head, and the commonest slots are left alone.
    """
    own = [c for c in vectors.columns if c not in ("s", "w")]
    full = vectors if within is None else vectors.where(F.col(within).isNotNull())
    fields = StructType([f for f in full.schema.fields if f.name in own])
    group = F.lit("") if within is None else F.col(within).cast("string")
    rows = full.withColumn("slot", F.lit(-1)).withColumn("g", group)
    most = full.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if within is None or most > WHOLE * BLOCK:
        rows = _by_head(full, least).withColumn("g", F.concat_ws(" ", F.col("slot"), group))
    sizes = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    work = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    hot = small(sizes.where(F.col("n") > BLOCK).select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(hot, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("mine", "_with")).withColumn("hi", F.greatest("mine", "_with")).drop("_with", "blocks")
    parts = int(min(2000, max(24, work / 2e8)))
    rows = rows.repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", key)
    schema = StructType([StructField("a", fields), StructField("b", fields), StructField("score", DoubleType())])

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        cols = table.select(own).combine_chunks()
        cols = cols.to_batches()[0]
        for i, j, score in _compared(table, least):
            for k in range(0, len(i), SENT):
                sides = [pa.StructArray.from_arrays(cols.take(pa.array(x[k : k + SENT])).columns, fields=list(cols.schema)) for x in (i, j)]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(score[k : k + SENT])], names=["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = [b.column(b.schema.get_field_index(c)) for c in ("g", "lo", "hi")]
            codes = [ids[0].dictionary_encode().indices.to_numpy(), *(x.to_numpy() for x in ids[1:])]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in codes], axis=0)) + 1
            bounds = [0, *new.tolist(), b.num_rows]
            if held and any(x[0] != held[-1].column(held[-1].schema.get_field_index(c))[-1] for x, c in zip(ids, ("g", "lo", "hi"), strict=True)):
                yield from sent(held)
                held = []
            for i, j in zip(bounds, bounds[1:], strict=False):
                if i:
                    yield from sent(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from sent(held)

    return rows.mapInArrow(run, schema).withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def _by_head(full: DataFrame, least: float) -> DataFrame:
    """The rows of packed vectors once for each slot of their heads; s marks the heads' entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _BITS, dtype=np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u2"), minlength=1 << _BITS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])

    often = np.zeros(1 << _BITS, dtype=np.int64)
    for r in full.select("s").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        often[r["slot"]] = r["n"]
    rank = np.empty(1 << _BITS, dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(1 << _BITS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, slot, w = _entries(b)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((-rank[slot], of))  # the commonest first
            sums = np.concatenate([[0.0], np.cumsum(w[order] ** 2)])
            before = sums[np.cumsum(n) - n]
            head = np.empty(len(slot), dtype=bool)
            head[order] = sums[1:] - np.repeat(before, n) >= (least - 2 * _SLACK) ** 2
            rows = _with(b.select([c for c in b.schema.names if c not in ("s", "w")]), n, (slot | head.astype(np.int64) << _BITS).astype("<u2"), w)
            at = np.flatnonzero(head)
            out = rows.take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(slot[at].astype(np.int32))], names=[*out.schema.names, "slot"])

    fields = [f for f in full.schema.fields if f.name not in ("s", "w")]
    return full.mapInArrow(heads, StructType([*_vectors_of(full.select([f.name for f in fields])).fields, StructField("slot", IntegerType())]))
