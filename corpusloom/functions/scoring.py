"""Scores of answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter(answer: Column) -> Column:
    """The choice an answer names: a letter alone or before a point, else its first character."""
    raw = F.trim(F.coalesce(answer, F.lit("")))
    rest = F.upper(F.trim(F.regexp_replace(raw, r"^[A-Fa-f][.．、]\s*", "")))
    return F.when(rest.isin(*"ABCDEF"), rest).otherwise(F.upper(F.substring(raw, 1, 1)))


def objective(correct: Column, given: Column, most: float = 1.0) -> Column:
    """Full score if both name the same choice and one is given."""
    return F.when((letter(given) == letter(correct)) & (letter(given) != ""), F.lit(float(most))).otherwise(0.0)


def fill_blank(correct: Column, given: Column, most: int = 10) -> Column:
    """By the share of the answer's keywords given: full from 0.8, half from 0.5."""
    keys = F.regexp_extract_all(F.trim(correct), F.lit(r"([\x{4E00}-\x{9FFF}]{2,}|[A-Za-z]{3,})"), 1)
    low = F.lower(F.trim(F.coalesce(given, F.lit(""))))
    ratio = F.size(F.filter(keys, lambda k: F.contains(low, F.lower(k)))) / F.greatest(F.size(keys), F.lit(1))
    return F.when(low == "", 0).when(ratio >= 0.8, most).when(ratio >= 0.5, most // 2).otherwise(0).cast("bigint")
