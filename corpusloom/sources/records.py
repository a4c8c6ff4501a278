"""Readers and writers of side files: CSV concepts and usage, JSON maps, records of academic providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.evidence import abstract_of, doi, public_url, record_id

CONCEPTS = "canonical_id string, name string, concept_type string, description string, parent_hint string, aliases string, source_chunks string"


def write_concepts(concepts: DataFrame, path: str) -> None:
    """Concepts as CSV files with a header below ``path``; lists as JSON text."""
    text = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>")))
    cols = [text(F.col(c)).alias(c) if c in ("aliases", "source_chunks") else F.col(c).cast("string").alias(c) for c in CONCEPTS.replace(" string", "").split(", ")]
    concepts.select(*cols).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of CSV files; the columns are told by the header, others are ignored."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(CONCEPTS).option("enforceSchema", False).csv(path)
    lists = lambda c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))
    return raw.withColumn("aliases", lists("aliases")).withColumn("source_chunks", lists("source_chunks"))


def overlaid(rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """``rows`` in which the details of the same key win where they are known.

    Details are once a key (the largest value of each column counts); their other columns
    are added.
    """
    cols = [c for c in details.columns if c != key]
    d = details.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in cols])
    x = rows.join(d, key, "left")
    kept = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns]
    return x.select(*kept, *[F.col(f"_{c}").alias(c) for c in cols if c not in rows.columns])


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of strings or numbers in a file, as of name or score maps."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question, answer) of a JSON file {questions: [...], answers: [...]}.

    A question beyond the last answer has an empty one.
    """
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.from_json("value", "questions array<string>, answers array<string>").alias("b")).select("b.*")
    x = both.select(F.posexplode("questions").alias("pos", "question"), "answers")
    return x.select("pos", "question", F.coalesce(F.get("answers", F.col("pos")), F.lit("")).alias("answer"))


#: The parts of a work as OpenAlex gives it that are read.
WORK = (
    "id string, doi string, title string, publication_year int, is_retracted boolean, cited_by_count bigint, "
    "abstract_inverted_index map<string,array<int>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>, "
    "authorships array<struct<author:struct<display_name:string>>>"
)


def academic_works(raw: DataFrame, json: str = "json", provider: str = "openalex") -> DataFrame:
    """Works of a provider's JSON, one a row: id, doi, url, title, year, abstract, authors, source.

    Retracted works and such without a title are dropped; text that is no JSON gives no row.
    """
    w = raw.select(F.from_json(json, WORK).alias("w")).select("w.*").where("trim(title) <> '' and not coalesce(is_retracted, false)")
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    return w.select(
        record_id(F.lit(provider), F.coalesce("id", F.lit("")), F.col("title")).alias("record_id"), doi(F.col("doi")).alias("doi"), public_url(F.col("primary_location.landing_page_url")).alias("url"),
        F.trim("title").alias("title"), F.col("publication_year").alias("year"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.coalesce("primary_location.source.display_name", F.lit("")).alias("source"), F.coalesce("cited_by_count", F.lit(0)).alias("cited"),
    )


def academic_order(evidence: Column, level: Column, score: Column) -> list[Column]:
    """The order of results: usable evidence first, then by level (high, medium, low), then score."""
    rank = F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)
    return [F.when(evidence, 0).otherwise(1), rank, score.desc_nulls_last()]


def evidence_chunks(works: DataFrame) -> DataFrame:
    """(chunk_id, text, chunk_type, source) of works that have an abstract."""
    text = F.concat_ws("\n\n", F.col("title"), F.col("abstract"))
    return works.where("abstract <> ''").select(F.concat(F.lit("evidence_"), F.col("record_id")).alias("chunk_id"), text.alias("text"), F.lit("evidence").alias("chunk_type"), F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("doi")).alias("source"))
