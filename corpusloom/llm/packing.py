"""Filling fixed-capacity containers with items: bounded-space online packing.

Each partition keeps a fixed number of open containers. An item goes into the open one that
it fills best; if none has room, the fullest is closed and a new one opened. Containers that
are still open at the end of a partition (a constant number, whatever its size) are merged
by the same rule over fewer and fewer partitions. Only an item above the capacity is
divided: into full containers and a rest, which is packed like any other item.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

CAPACITY, OPEN = 2048, 64
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes a vocabulary file may have; it is sent to the workers.
VOCABULARY_BYTES = 64_000_000
# Fixed value: the split pattern the public byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The number of a partition's container of empty items.
EMPTY = (1 << 31) - 1
#: Partitions whose leftovers one task merges in a round.
FAN_IN = 64


@lru_cache(2)
def counter_of(raw: bytes) -> Callable[[str], int]:
    """Number of tokens of a text by a vocabulary file's bytes; special tokens' strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    e = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(e.encode_ordinary(text))


def vocabulary_bytes(vocabulary: str) -> bytes:
    """A vocabulary file, read where the driver runs; above ``VOCABULARY_BYTES`` an error."""
    with open(vocabulary, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    return raw


def counter(vocabulary: str) -> Callable[[str], int]:
    return counter_of(vocabulary_bytes(vocabulary))


class Windows:
    """Open containers, kept in order of their free space."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.free = capacity, limit, []  # free: sorted (free, container)
        self.made = 0

    def place(self, size: int) -> tuple[int, int | None]:
        """The container for an item of ``size``, and the one closed for it, if any."""
        closed = None
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, c = self.free.pop(i)
        else:
            if len(self.free) == self.limit:
                closed = self.free.pop(0)[1]
            room, c, self.made = self.capacity, self.made, self.made + 1
        if room > size:
            insort(self.free, (room - size, c))
        return c, closed


def pack_batches(capacity: int, limit: int, size_of: Callable[[str], int] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text or size) to (key, part, start, size, place, left); left: in an open container."""
    part_no = TaskContext.get().partitionId() if TaskContext.get() else 0
    w = Windows(capacity, limit)
    base = part_no << 32
    kind = None
    held: dict[int, list[tuple]] = {}  # rows of open containers; bounded: limit * capacity
    for b in batches:
        kind = b.schema.field(0).type
        keys, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
        if size_of:
            sizes = [size_of(x) if x else 0 for x in sizes]
        done: list[tuple] = []
        for k, n in zip(keys, sizes):
            if not n:  # empty items share a container of their own, and none is held
                done.append((k, 0, 0, 0, base + EMPTY, False))
                continue
            at, part = 0, 0
            while n - at > capacity:
                done.append((k, part, at, capacity, base + w.made, False))
                w.made += 1
                at, part = at + capacity, part + 1
            c, closed = w.place(n - at)
            held.setdefault(c, []).append((k, part, at, n - at, base + c, True))
            if closed is not None:
                done += [(*x[:5], False) for x in held.pop(closed)]
        # rows of containers that are full by now leave as well
        still = {c for _, c in w.free}
        for c in [c for c in held if c not in still]:
            done += [(*x[:5], False) for x in held.pop(c)]
        if done:
            yield _rows(done, kind)
    rest = [x for rows in held.values() for x in rows]
    if rest:
        yield _rows(rest, kind)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "part", "start", "size", "place", "left"])


def pack(items: DataFrame, key: str, text: str, capacity: int = CAPACITY, open_windows: int = OPEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """Assign every item to containers of ``capacity`` tokens.

    Returns key, part (0 but for divided items), token_start, tokens and container_id. A
    null or empty text has no tokens and goes to a partition's container of such items;
    rows repeat as they come, null keys included. An empty table gives an empty result; other columns are ignored.
    """
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, part int, start bigint, size bigint, place bigint, left boolean"
    # checkpointed at once: the containers' names depend on the partitions of this run
    shared = items.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    placed = cut(rows.mapInArrow(lambda it: pack_batches(capacity, open_windows, counter_of(shared.value), it), schema))
    # open containers, as items: at most open_windows of each partition
    level = cut(placed.where("left").groupBy("place").agg(F.sum("size").alias("size")).select(F.col("place").alias("key"), "size"))
    n = (placed.agg(F.max(F.shiftright("place", 32))).first()[0] or 0) + 1  # partitions, by the last that placed a row
    moves: list[DataFrame] = []
    up = "key bigint, part int, start bigint, size bigint, place bigint, left boolean"
    while True:
        n = -(-n // FAN_IN)
        fewer = level.repartition(n, F.col("key")).sortWithinPartitions(F.col("size").desc(), "key")
        step = cut(fewer.mapInArrow(lambda it: pack_batches(capacity, open_windows, None, it), up))
        moves.append(step.select(F.col("key").alias("place"), F.col("place").alias("to"), "left"))
        if n == 1:
            break
        level = step.where("left").groupBy("place").agg(F.sum("size").alias("size")).select(F.col("place").alias("key"), "size")
    out = placed.withColumn("round", F.when(F.col("left"), 0).otherwise(-1))
    for r, m in enumerate(moves):
        # a join over leftovers only: rows closed earlier pass by
        open_ = out.where(F.col("round") == r).join(m.withColumnRenamed("left", "on"), "place").withColumn("place", F.col("to")).withColumn("round", F.when(F.col("on"), r + 1).otherwise(-2 - r))
        out = out.where(F.col("round") != r).unionByName(open_.select(*out.columns))
    # the round a container was closed in keeps names of different rounds apart
    closed_in = F.when(F.col("round") < 0, -1 - F.col("round")).otherwise(F.col("round"))
    return out.select(F.col("key").alias(key), "part", F.col("start").alias("token_start"), F.col("size").alias("tokens"), F.concat_ws("-", closed_in, F.col("place")).alias("container_id"))
