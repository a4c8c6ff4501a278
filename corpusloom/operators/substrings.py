"""Texts inside texts, by hashes of all their substrings of the lengths that are wanted."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Hashes of wanted texts that a worker holds at once; more take more passes.
HELD_KEYS = 4_000_000
#: Characters hashed at once (one text at least).
SLICE = 1 << 20
_BASE, _BITS = 0x9E3779B97F4A7C15, 25


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _slices(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, lengths, sums): sums of powers times characters before each place of some texts."""
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= SLICE:
            n += len(texts[j])
            j += 1
        code = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(_mixed((code + np.uint64(1)) * np.uint64(_BASE)) * _powers(_BASE, len(code)), out=sums[1:])
        yield i, np.array([len(t) for t in texts[i:j]]), sums
        i = j


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, key, n): the hash and the length of each text."""
    inverse = pow(_BASE, -1, 1 << 64)
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, sizes, sums in _slices(texts):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            key = _mixed((sums[ends] - sums[starts]) * _powers(inverse, len(sums))[starts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sizes)), pa.array(key), pa.array(sizes, pa.int64())], names=["s", "key", "n"])


def _found(texts: list[str], lengths: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every substring of one of the ``lengths`` whose hash is among the sorted ``keys``."""
    inverse, shift, at, hit = pow(_BASE, -1, 1 << 64), np.uint64(64 - _BITS), [], []
    for i, sizes, sums in _slices(texts):
        back = _powers(inverse, len(sums))
        of = np.repeat(np.arange(len(sizes)), sizes)
        room = np.cumsum(sizes)[of] - np.arange(len(of))
        place = np.arange(len(of))
        for n in lengths:  # ascending, so places without room for one length have none for the next
            place = place[room[place] >= n]
            if not len(place):
                break
            h = _mixed((sums[place + n] - sums[place]) * back[place])
            some = np.flatnonzero(bits[h >> shift])
            h = h[some]
            ok = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            at.append(of[place[some[ok]]] + i)
            hit.append(h[ok])
    none = np.empty(0, dtype=np.int64)
    pairs = np.unique(np.rec.fromarrays([np.concatenate(at or [none]), np.concatenate(hit or [none.view(np.uint64)])], names="at,hit"))
    return pairs["at"], pairs["hit"]


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s_id, l_id) for every text s of ``short`` that stands inside a text l of ``long``.

    ``short`` has s_id and s, ``long`` l_id and l. The workers hold the hashes of the short
    texts (``HELD_KEYS`` at a time) and look up every substring of their lengths; what is found
    is joined on the hash and compared, so no other substring is moved. Null and empty texts are
    in nothing.
    """
    spark = short.sparkSession
    short, long = short.where("s <> ''"), long.where("l <> ''").select("l_id", "l")
    keyed = short.select("s").distinct().mapInArrow(_keys, "s string, key bigint, n bigint")
    wanted = keyed.select("key", "n").distinct()
    passes = max(1, -(-wanted.count() // HELD_KEYS))
    schema = StructType([*long.schema.fields, StructField("key", LongType())])

    def part(k: int) -> DataFrame:
        got = wanted.where(F.pmod("key", F.lit(passes)) == k).toArrow()
        held = spark.sparkContext.broadcast((np.unique(got["n"].to_numpy()), np.unique(got["key"].to_numpy().view(np.uint64))))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths, keys = held.value
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            for b in batches:
                if len(keys) and b.num_rows:
                    at, hit = _found(b.column(1).to_pylist(), lengths, keys, bits)
                    for i in range(0, len(at), 20_000):
                        x = b.take(pa.array(at[i : i + 20_000]))
                        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(hit[i : i + 20_000].view(np.int64))], names=["l_id", "l", "key"])

        return long.mapInArrow(look, schema)

    hits = reduce(DataFrame.unionByName, [part(k) for k in range(passes)])
    # sizes of what comes from Python aren't known to the planner, so it mustn't choose a broadcast
    pairs = hits.join(keyed.select("s", "key").hint("merge"), "key").where(F.col("l").contains(F.col("s"))).select("s", "l_id")
    return pairs.join(short.select("s_id", "s").hint("merge"), "s").select("s_id", "l_id").distinct()
