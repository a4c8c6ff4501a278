"""External records, agreement of repeated extractions, votes and near titles."""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T


def abstract_of(index: Column) -> Column:
    """The text of an inverted abstract (word to its positions); empty for null."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " "), F.lit(""))


def doi(value: Column) -> Column:
    """A DOI without its resolver, in lower case; empty if it can't be one."""
    d = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    return F.when(d.rlike(r"[\s|]"), "").otherwise(d)


def public_url(value: Column) -> Column:
    """An http(s) address of at most 2,000 characters, else empty."""
    u = F.substring(F.trim(F.coalesce(value, F.lit(""))), 1, 2000)
    return F.when(F.lower(u).rlike("^https?:"), u).otherwise("")


def record_id(provider: Column, external: Column, title: Column) -> Column:
    """academic_{provider}_ and twenty hex digits of the SHA-256 of provider and id or title."""
    ref = F.coalesce(F.when(external != "", external), F.lower(title), F.lit(""))
    return F.concat(F.lit("academic_"), provider, F.lit("_"), F.substring(F.sha2(F.concat(provider, F.lit("|"), ref), 256), 1, 20))


def merged_records(records: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row for each DOI (else address, else title): the first known value of each field.

    ``records`` has doi, url, title and an order; "first" is by that, and empty text counts
    as unknown. Records without any of the three are dropped.
    """
    key = F.coalesce(F.when(doi(F.col("doi")) != "", F.concat(F.lit("doi:"), doi(F.col("doi")))), F.when(F.col("url") != "", F.concat(F.lit("url:"), F.lower("url"))), F.when(F.trim("title") != "", F.concat(F.lit("title:"), F.lower(F.trim("title")))))
    known = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    return records.withColumn("record", key).where("record is not null").groupBy("record").agg(F.count(F.lit(1)).alias("n"), *[known(c).alias(c) for c in fields])


def stability(extractions: DataFrame, part: str, sample: str, name: str) -> DataFrame:
    """(part, pairs, stability): mean likeness of a part's samples, pair by pair.

    Samples of a part are its few repeated extractions; names count in lower case. Parts
    with one sample have no row.
    """
    sets = extractions.where(F.trim(name) != "").groupBy(part, sample).agg(F.collect_set(F.lower(F.trim(name))).alias("names"))
    a, b = sets.alias("a"), sets.alias("b")
    p = a.join(b, (F.col(f"a.{part}") == F.col(f"b.{part}")) & (F.col(f"a.{sample}") < F.col(f"b.{sample}")))
    j = F.size(F.array_intersect("a.names", "b.names")) / F.size(F.array_union("a.names", "b.names"))
    return p.select(F.col(f"a.{part}").alias(part), j.alias("j")).groupBy(part).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("j"), 6).alias("stability"))


def best_sample(extractions: DataFrame, part: str, sample: str, name: str) -> DataFrame:
    """(part, sample): the one most like the others; the first wins ties."""
    sets = extractions.where(F.trim(name) != "").groupBy(part, sample).agg(F.collect_set(F.lower(F.trim(name))).alias("names"))
    a, b = sets.alias("a"), sets.alias("b")
    p = a.join(b, (F.col(f"a.{part}") == F.col(f"b.{part}")) & (F.col(f"a.{sample}") != F.col(f"b.{sample}")), "left")
    j = F.coalesce(F.size(F.array_intersect("a.names", "b.names")) / F.size(F.array_union("a.names", "b.names")), F.lit(0.0))
    m = p.select(F.col(f"a.{part}").alias(part), F.col(f"a.{sample}").alias(sample), j.alias("j")).groupBy(part, sample).agg(F.round(F.avg("j"), 9).alias("j"))
    return m.groupBy(part).agg(F.min_by(sample, F.struct(-F.col("j"), sample)).alias(sample))


def keyword_votes(docs: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic, votes): the topic whose keywords a text holds most often, ties to the smaller.

    ``keywords`` has topic and word (as functions.text.tokens makes words).
    """
    t = docs.select(key, F.explode(T.tokens(F.col(text))).alias("word"))
    v = t.join(keywords.distinct(), "word").groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy(key).agg(F.min_by("topic", F.struct(-F.col("n"), "topic")).alias("topic"), F.max("n").alias("votes"))


def common_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No fewer than the characters (with repeats) two titles share; rows of code points, -1 behind."""
    counts = []
    for c in (a, b):
        n = np.zeros((len(c), 128), dtype=np.int64)
        rows, places = np.nonzero(c >= 0)
        np.add.at(n, (rows, c[rows, places] % 128), 1)
        counts.append(n)
    # the smaller of two counts is the number of levels both reach; what is over 8 is bounded as a whole
    levels = [np.concatenate([n >= k for k in range(1, 9)], axis=1) for n in counts]
    used = levels[0].any(axis=0) & levels[1].any(axis=0)
    over = [np.maximum(n - 8, 0).sum(axis=1) for n in counts]
    x, y = (level[:, used].astype(np.float32) for level in levels)
    return (x @ y.T).astype(np.int64) + np.minimum(over[0][:, None], over[1][None, :])


def longest_common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a[i] and b[j], bit-parallel; a has up to 64 columns."""
    known = np.unique(a)
    masks = np.zeros((len(a), len(known) + 1), dtype=np.uint64)
    for k in range(a.shape[1]):
        rows = np.nonzero(a[:, k] >= 0)[0]
        masks[rows, np.searchsorted(known, a[rows, k])] |= np.uint64(1 << k)
    at = np.minimum(np.searchsorted(known, b), len(known) - 1)
    at = np.where((known[at] == b) & (b >= 0), at, len(known))
    v = np.full(len(i), np.uint64(2**64 - 1))
    for k in range(b.shape[1]):
        u = v & masks[i, at[j, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def near_in_cell(least: float, cell: pa.Table) -> pa.Table:
    """(k, t, side) of a cell to (k, o, ratio), both ways, of titles of the two sides (or the only one).

    The matching blocks of a pair are a common subsequence, so neither the characters it shares
    nor its longest common subsequence can be below the ratio's share of both lengths.
    """
    keys, texts, side = cell.column("k").combine_chunks(), cell.column("t").to_pylist(), cell.column("side").to_numpy()
    ours, theirs = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for x in texts]
    size = np.array([len(c) for c in codes], dtype=np.int64)
    left, right, ratios = [], [], []
    if len(ours) and len(theirs):
        rows = []
        for part in (ours, theirs):
            c = np.full((len(part), size[part].max()), -1, dtype=np.int64)
            for n, x in enumerate(part):
                c[n, : size[x]] = codes[x]
            rows.append(c)
        need = (least - 5e-7) * (size[ours][:, None] + size[theirs][None, :]) / 2
        i, j = np.nonzero(common_bound(*rows) >= need)
        keep = (side[ours[i]] != 2) | (ours[i] < theirs[j])
        i, j = i[keep], j[keep]
        short = np.nonzero(size[ours[i]] <= 64)[0]
        if len(short):
            good = np.ones(len(i), dtype=bool)
            good[short] = longest_common(rows[0][:, :64], rows[1], i[short], j[short]) >= need[i[short], j[short]]
            i, j = i[good], j[good]
        for x, y in zip(ours[i].tolist(), theirs[j].tolist()):
            for p, q in ((x, y), (y, x)):
                r = round(SequenceMatcher(None, texts[p], texts[q], autojunk=False).ratio(), 6)
                if r >= least:
                    left.append(p)
                    right.append(q)
                    ratios.append(r)
    return pa.table({"k": keys.take(pa.array(left, pa.int64())), "o": keys.take(pa.array(right, pa.int64())), "ratio": pa.array(ratios, pa.float64())})


def near_titles(rows: DataFrame, key: str, kind: str, title: str, least: float = 0.78, most: int = 3, block: int = 1000) -> DataFrame:
    """(key, other, ratio): up to ``most`` rows of the same kind with the most similar titles.

    The ratio is the matching-blocks one, from the row's title to the other's; of several titles
    of a key the best counts. No pair is left out before it but by bounds that follow from the
    ratio: lengths (pairs are taken from the same or neighbouring classes of length only), then
    shared characters and longest common subsequences (``near_in_cell``). So the work grows with
    the square of a kind's titles of like length; blocks of about ``block`` titles meet in cells
    that are spread over the tasks. Null and empty titles and null kinds or keys have no row.
    """
    kt = rows.schema[key].dataType.simpleString()
    t = rows.select(F.col(key).alias("k"), F.col(kind).alias("kind"), F.lower(F.trim(title)).alias("t")).where("k is not null and kind is not null and t <> ''").distinct()
    # the shorter of a pair has at least least / (2 - least) of the longer one's length
    apart = math.log((2 - least) / least) + 1e-5
    t = t.withColumn("b", F.floor(F.log(F.length("t").cast("double")) / apart).cast("int"))
    sizes = t.groupBy("kind", "b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    t = t.join(sizes.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("blocks")), "kind")
    blocks_of = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0))
    t = t.withColumn("i", F.pmod(F.xxhash64("k", "t"), blocks_of(F.col("b"))).cast("int"))
    b, i = F.col("b"), F.col("i")

    def cells(other: Column, cell: Callable[[Column], Column]) -> Column:
        n = blocks_of(other)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cell)).otherwise(F.array().cast("array<struct<lb:int,li:int,hb:int,hi:int,side:int>>"))

    place = lambda lb, li, hb, hi, side: F.struct(lb.alias("lb"), li.alias("li"), hb.alias("hb"), hi.alias("hi"), side.alias("side"))
    same = cells(b, lambda j: place(b, F.least(i, j), b, F.greatest(i, j), F.when(i == j, 2).when(i < j, 0).otherwise(1)))
    longer = cells(b + 1, lambda j: place(b, i, b + 1, j, F.lit(0)))
    shorter = cells(b - 1, lambda j: place(b - 1, j, b, i, F.lit(1)))
    met = t.select("kind", "k", "t", F.explode(F.concat(same, longer, shorter)).alias("c")).select("kind", "k", "t", "c.*")
    near = met.groupBy("kind", "lb", "li", "hb", "hi").applyInArrow(lambda cell: near_in_cell(least, cell), f"k {kt}, o {kt}, ratio double")
    best = near.where("k <> o").groupBy("k", "o").agg(F.max("ratio").alias("ratio"))
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.col("ratio").desc(), "o"))
    return best.withColumn("nth", nth).where(F.col("nth") <= most).select(F.col("k").alias(key), F.col("o").alias("other"), "ratio")


def natural_paths(gaps: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst, natural): whether a gap of one type is closed by a path through such a node."""
    t = types.groupBy("node").agg(F.min("type").alias("type"))
    one = gaps.where(F.size("missing") == 1).select("src", "dst", F.col("missing")[0].alias("want")).distinct()
    e = edges.select("src", "dst").distinct()
    mid = one.join(e.select("src", F.col("dst").alias("mid")), "src").join(e.select(F.col("src").alias("mid"), "dst"), ["mid", "dst"]).join(t.select(F.col("node").alias("mid"), "type"), "mid").where("type = want")
    hit = mid.select("src", "dst").distinct().withColumn("hit", F.lit(True))
    return one.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("natural"))
