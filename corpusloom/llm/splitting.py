"""Splitting oversized items at natural boundaries, by byte ranges with halos.

A text is worked through in byte ranges, each with a halo on both sides, and a worker decodes
no more than its own range. Where a piece ends depends on where the one before it ended, so
ranges are put together in three steps:

1. *Boundary tables.* A piece is a function of the end of the piece before it and of the
   characters nearby. So each range, by itself, tells for every place a piece may have ended
   at just inside it (its entries) where the pieces leave it again. Chains from different
   entries soon meet, so the table is a few numbers. The range's characters are counted too.
2. *Stitching.* One pass over the tables of a text, in order, follows the entries from range
   to range and sums the characters before each (a prefix sum). It streams: nothing but the
   last entry and the sum is held.
3. *Pieces.* Each range cuts its own pieces from its entry and names them by their offsets
   in the whole text.

So pieces are the same for every size of range and any partitioning, overlaps at the edges of
ranges included. ``split_rows`` does this for texts of a table, ``split_files`` for files,
where every step reads its byte range from storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.visual import clear_of
from corpusloom.plans.lineage import cut

LIMIT, OVERLAP = 3000, 200
#: Bytes of a range of a text, and of a file.
RANGE, FILE_RANGE = 16_384, 4_000_000
# Where a text may be cut without harm, weakest first, by kind of boundary.
WEAK, LINES, ENDS = " \t，", "\n\r", "。！？；"
_KIND = np.zeros(65536, dtype=np.uint8)
for _k, _chars in ((1, WEAK), (3, LINES), (2, ENDS)):
    _KIND[[ord(c) for c in _chars]] = _k
_STOP = np.zeros(65536, dtype=bool)
_STOP[[ord(c) for c in ".!?:;"]] = True

PIECES = "start bigint, end bigint, hard boolean, piece string"
_TABLE = "row bigint, k bigint, chars bigint, entry array<int>, leaves array<int>"


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundary_table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions a piece may end at (after the boundary character), and their strength.

    1: white space or a comma, 2: the end of a sentence, 3: of a line, 4: of a paragraph.
    """
    c = np.where(codes > 65535, 0, codes)
    kind = _KIND[c]
    at = np.nonzero(kind)[0]
    k = kind[at].copy()
    prev = np.where(at > 0, c[at - 1], 0)
    k[(k == 1) & _STOP[prev]] = 2
    line = k == 3
    k[line & (np.isin(prev, (10, 13))) & (at > 0)] = 4
    return at + 1, k


class Slice(NamedTuple):
    """Bytes of a range with its halos: ``lead`` bytes come before it, ``own`` are its own."""

    data: bytes
    lead: int
    own: int
    ends: bool  # whether the text ends with these bytes


def halos(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes that a range must see before and after itself."""
    return 4 * (overlap + 2), 4 * (limit + 2)


def slice_of(read: Callable[[int, int], bytes], n: int, k: int, size: int, limit: int, overlap: int) -> Slice:
    """Range ``k`` of ``n`` bytes; ranges and halos begin and end between characters."""
    before, after = halos(limit, overlap)
    lo, hi = k * size, min(n, (k + 1) * size)
    first, last = max(0, lo - before), min(n, hi + after + 4)
    raw = read(first, last)
    part = np.frombuffer(raw, dtype=np.uint8)

    def aligned(at: int) -> int:  # a character has at most three bytes of continuation
        for _ in range(3):
            if not 0 < at < n or at - first >= len(part) or part[at - first] & 0xC0 != 0x80:
                break
            at += 1
        return at

    a, b = aligned(lo), aligned(hi)
    s = aligned(first)
    e = last if last == n else aligned(min(last - 4, n))
    return Slice(raw[s - first : e - first], a - s, b - a, e == n)


class Cutter:
    """The pieces around one range; positions are in characters from its beginning."""

    def __init__(self, s: Slice, limit: int, overlap: int) -> None:
        self.limit, self.overlap = limit, overlap
        lead = s.data[: s.lead].decode("utf-8", "replace")
        rest = s.data[s.lead :].decode("utf-8", "replace")
        self.text, self.lead = lead + rest, len(lead)
        self.own = len(s.data[s.lead : s.lead + s.own].decode("utf-8", "replace"))
        self.end = len(rest) if s.ends else None
        pos, self.kind = boundary_table(codes_of(self.text))
        self.pos = pos - self.lead

    def piece(self, e: int) -> tuple[int, int, bool]:
        """(start, end, hard) of the piece after one that ended at ``e``.

        It starts at the first boundary of the overlap and ends at the strongest, then latest
        boundary in the second half of what fits; else at the latest that fits; then again
        without the overlap; else at the limit. ``hard`` tells that it ends inside a run of
        more than ``limit`` characters without a boundary.
        """
        pos, limit = self.pos, self.limit
        i = int(np.searchsorted(pos, e - self.overlap))
        s = int(pos[i]) if i < len(pos) and pos[i] < e else e
        lo = int(np.searchsorted(pos, e, side="right"))
        for s in dict.fromkeys((s, e)):
            if self.end is not None and self.end - s <= limit:
                return s, self.end, False
            hi = int(np.searchsorted(pos, s + limit, side="right"))
            half = max(lo, int(np.searchsorted(pos, s + limit // 2)))
            if half < hi:
                best = self.kind[half:hi]
                return s, int(pos[half + len(best) - 1 - int(np.argmax(best[::-1]))]), False
            if lo < hi:
                return s, int(pos[hi - 1]), False
        at = e + limit
        j = int(np.searchsorted(pos, at + 1))
        return e, at, not (j < len(pos) and pos[j] == at + 1)

    def pieces(self, entry: int) -> Iterator[tuple[int, int, bool]]:
        """The pieces that begin their new part in this range."""
        e = entry
        while e < self.own:
            s, e, hard = self.piece(e)
            yield s, e, hard

    def entries(self) -> np.ndarray:
        """Places inside the range at which a piece that began before it may have ended."""
        p = np.arange(min(self.limit, self.own))
        i = np.searchsorted(self.pos, p, side="right") - 1
        last = np.where(i >= 0, self.pos[np.maximum(i, 0)], -self.limit) if len(self.pos) else np.full(len(p), -self.limit)
        return p[(last == p) | (last <= p - self.limit)]

    def table(self, first: bool) -> tuple[list[int], list[int]]:
        """(entry, leaves): from each entry on, up to the next one listed, the pieces leave there."""
        leaves: dict[int, int] = {}
        known = [0] if first else self.entries().tolist()
        for p in reversed(known):
            chain, e = [], p
            while e < self.own and e not in leaves:
                chain.append(e)
                e = self.piece(e)[1]
            out = leaves.get(e, e - self.own)
            leaves.update(dict.fromkeys(chain, out))
        entry, to = [], []
        for p in known:
            if not to or leaves[p] != to[-1]:
                entry.append(p)
                to.append(leaves[p])
        return entry, to


def stitched_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables in order of (row, k) to (row, k, enter, first): entries and prefix sums."""
    row, e, first = None, 0, 0
    for b in batches:
        enter, firsts = [], []
        for r, _, chars, entry, leaves in zip(*(b.column(i).to_pylist() for i in range(5))):
            if r != row:
                row, e, first = r, 0, 0
            enter.append(e)
            firsts.append(first)
            if e < chars:
                at = int(np.searchsorted(entry, e, side="right")) - 1
                e = leaves[at]
            else:
                e -= chars
            first += chars
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(enter, pa.int64()), pa.array(firsts, pa.int64())], names=["row", "k", "enter", "first"])


def _stitched(tables: DataFrame) -> DataFrame:
    """The rows of a text's tables meet in one task, a few numbers each, and stream through it."""
    return tables.repartition("row").sortWithinPartitions("row", "k").mapInArrow(stitched_batches, "row bigint, k bigint, enter bigint, first bigint")


def _piece_rows(c: Cutter, enter: int, first: int, texts: bool) -> tuple[list, list, list, list]:
    p = list(c.pieces(enter))
    own = [c.text[s + c.lead : e + c.lead] for s, e, _ in p] if texts else [None] * len(p)
    return [s + first for s, _, _ in p], [e + first for _, e, _ in p], [h for *_, h in p], own


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, hard) of a whole text in one range: what all sizes of range give."""
    raw = text.encode("utf-8", "surrogatepass")
    return list(Cutter(Slice(raw, 0, len(raw), True), limit, overlap).pieces(0)) if raw else []


def split_rows(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, texts: bool = True) -> DataFrame:
    """Pieces of the rows whose ``text`` has more than ``limit`` code points.

    Every other column is kept beside start, end (code points), hard (it ends inside a run of
    more than ``limit`` characters without a boundary) and piece (null without ``texts``).
    Null, empty and short texts give no row, repeated rows repeat. A column of the input with
    one of these names gets in_ before it. Piece k of a text is its k-th by ``start``.

    A text of one range is cut where it is read. Larger ones are cut into byte ranges, which
    are spread over all tasks and kept, as two steps read them; no task decodes more than a
    range and its halos.
    """
    new = ["start", "end", "hard", "piece"]
    if text in new:
        df, text = df.withColumnRenamed(text, f"in_{text}"), f"in_{text}"
    df = clear_of(df, [*new, "row", "k", "lead", "own", "ends", "data"])
    rest = [c for c in df.columns if c != text]
    long = df.where(F.char_length(F.col(f"`{text}`")) > limit).select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    kept = [f for f in long.schema.fields if f.name != text]
    out = T.StructType(kept + T._parse_datatype_string(PIECES).fields)
    n_kept = len(kept)
    names = [*rest, *new]

    def made(b: pa.RecordBatch, i: int, rows: tuple[list, list, list, list]) -> pa.RecordBatch:
        same = pa.array(np.zeros(len(rows[0]), dtype=np.int64))
        own = b.slice(i, 1)
        cols = [own.column(j).take(same) for j in range(n_kept)]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.string())))], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(n_kept)[i].as_buffer().to_pybytes()
                yield made(b, i, _piece_rows(Cutter(Slice(raw, 0, len(raw), True), limit, overlap), 0, 0, texts))

    one = F.octet_length(F.col(f"`{text}`")) <= size
    small = long.where(one).mapInArrow(whole, out)

    inner = T.StructType(kept + T._parse_datatype_string("row bigint, k bigint, lead bigint, own bigint, ends boolean, data binary").fields)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(n_kept)[i].as_buffer()  # the text's bytes where they are; nothing is decoded
                same = pa.array([0])
                cols = [b.slice(i, 1).column(j) for j in range(n_kept)]
                row = b.column(n_kept + 1)[i].as_py()
                for k in range(-(-raw.size // size)):
                    s = slice_of(lambda x, y: raw.slice(x, y - x).to_pybytes(), raw.size, k, size, limit, overlap)
                    own = [pa.array([v], t) for v, t in zip((row, k, s.lead, s.own, s.ends, s.data), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in cols), *own], names=[*rest, "row", "k", "lead", "own", "ends", "data"])

    giants = long.where(~one).withColumn("_row", F.monotonically_increasing_id())
    ranges = cut(giants.mapInArrow(sliced, inner).repartition("row", "k"))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, k, *s in zip(*(b.column(j).to_pylist() for j in range(6))):
                c = Cutter(Slice(s[3], s[0], s[1], s[2]), limit, overlap)
                rows.append((row, k, c.own, *c.table(k == 0)))
            if rows:
                yield _tables(rows)

    tables = ranges.select("row", "k", "lead", "own", "ends", "data").mapInArrow(tabled, _TABLE)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: n_kept + j for j, name in enumerate(("lead", "own", "ends", "data", "enter", "first"))}
            for i in range(b.num_rows):
                lead, own, ends, data, enter, first = (b.column(j)[i].as_py() for j in at.values())
                yield made(b, i, _piece_rows(Cutter(Slice(data, lead, own, ends), limit, overlap), enter, first, texts))

    met = ranges.join(_stitched(tables), ["row", "k"]).select(*[F.col(f"`{c}`") for c in rest], "lead", "own", "ends", "data", "enter", "first")
    return small.unionByName(met.mapInArrow(emitted, out))


def _tables(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["row", "k", "chars", "entry", "leaves"])


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """One row (key, unbreakable) per key with a text of more than ``limit`` code points.

    ``unbreakable`` is 1 if a piece of it had to end inside a run of more than ``limit``
    characters without a boundary. Null keys are left out, repeated rows count once.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    pieces = split_rows(rows, "text", limit=limit, overlap=min(OVERLAP, limit // 4), size=size, texts=False)
    return pieces.groupBy("key").agg(F.max(F.col("hard").cast("bigint")).alias("unbreakable")).withColumnRenamed("key", key)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of UTF-8 files on storage all workers reach, without loading a whole file.

    Returns path, start, end (code points in the file), hard, piece. Workers read byte
    ranges of ``size`` with their halos. An empty file gives no row, a missing one an error.
    Bytes that are no UTF-8 become U+FFFD.
    """
    import pyarrow.fs as pafs

    def opened(path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    files = []
    for i, p in enumerate(paths):
        f, name = opened(p)
        files.append((i, p, f.get_file_info(name).size))
    known = spark.createDataFrame(files or [(0, "", 0)], "row bigint, path string, bytes bigint").where("bytes > 0")
    ranges = known.select("row", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / size))).alias("k"))
    ranges = ranges.repartition(max(1, sum(-(-n // size) for *_, n in files)), "row", "k")

    def cutter(path: str, n: int, k: int) -> Cutter:
        f, name = opened(path)
        with f.open_input_file(name) as h:
            return Cutter(slice_of(lambda x, y: h.read_at(y - x, x), n, k, size, limit, overlap), limit, overlap)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, path, n, k in zip(*(b.column(j).to_pylist() for j in range(4))):
                c = cutter(path, n, k)
                rows.append((row, k, c.own, *c.table(k == 0)))
            if rows:
                yield _tables(rows)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n, k, enter, first in zip(*(b.column(j).to_pylist() for j in range(5))):
                start, end, hard, piece = _piece_rows(cutter(path, n, k), enter, first, True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(start), pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(hard, pa.bool_()), pa.array(piece, pa.string())], names=["path", "start", "end", "hard", "piece"])

    met = ranges.join(_stitched(ranges.mapInArrow(tabled, _TABLE)), ["row", "k"]).select("path", "bytes", "k", "enter", "first")
    return met.mapInArrow(emitted, f"path string, {PIECES}")
