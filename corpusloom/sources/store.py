"""Scans, filters and changes of stored tables.

Changes are functions from old and new rows to the next state of a table; ``publish``
writes a state beside the old one and returns its path, so readers never see half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_sql(df: DataFrame, **conditions: object) -> DataFrame:
    """Rows that meet all conditions as SQL has it: ("$ne", x) drops missing values."""
    for c, v in conditions.items():
        df = df.where(F.col(c) != v[1] if isinstance(v, tuple) and v[0] == "$ne" else F.col(c) == (v[1] if isinstance(v, tuple) else v))
    return df


def where_matching(df: DataFrame, **conditions: object) -> DataFrame:
    """Rows that meet all conditions as a matcher has it: ("$ne", x) keeps missing values."""
    for c, v in conditions.items():
        df = df.where(~F.col(c).eqNullSafe(F.lit(v[1])) if isinstance(v, tuple) and v[0] == "$ne" else F.col(c).eqNullSafe(F.lit(v[1] if isinstance(v, tuple) else v)))
    return df


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered scan."""
    return df.orderBy(*order).offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, wanted: DataFrame, ids: str, keep: list[str]) -> DataFrame:
    """Rows of the ids in an array column, with their position in it; missing ids drop out."""
    w = wanted.select(*keep, F.posexplode(ids).alias("pos", key))
    return w.join(df, key)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of both, the last in ``order`` for each key."""
    every = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return every.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def replace_source(old: DataFrame, new: DataFrame, source: Column, kinds: list[str] | None = None, kind: str = "chunk_type") -> DataFrame:
    """``old`` without the rows of the sources that ``new`` brings (of the kinds given), and ``new``."""
    gone = new.select(source.alias("_source")).distinct()
    o = old.withColumn("_source", source)
    stay = o.join(gone, "_source", "left_anti") if kinds is None else o.join(gone, "_source", "left_anti").unionByName(o.where(~F.col(kind).isin(kinds) | F.col(kind).isNull()).join(gone, "_source", "left_semi"))
    return stay.drop("_source").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key isn't among ``ids`` (column of the same name)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def retain(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new state under ``root`` and return its path."""
    path = f"{root}/{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` routed by suffix: path, kind (text, pdf, image, other) and, for
    text, its content. Only text files are decoded; bytes of others aren't kept."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.col("path"))
    kind = F.when(name.rlike(r"\.(txt|md|markdown)$"), "text").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(png|jpe?g)$"), "image").otherwise("other")
    return raw.select("path", kind.alias("kind"), "length", F.when(kind == "text", F.decode("content", "UTF-8")).alias("text"))
