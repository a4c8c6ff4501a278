"""Item-response functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, LOW, HIGH = 0.3, -3.0, 3.0
GUESS = 0.25


def probability(theta: Column, a: Column | float = 1.0, b: Column | float = 0.0, c: Column | float = GUESS) -> Column:
    """3PL: c + (1 - c) / (1 + exp(-a (theta - b))), with cut-offs at exponents of 700."""
    a, b, c = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b, c))
    e = -a * (theta - b)
    return F.when(e > 700, c).when(e < -700, F.lit(1.0)).otherwise(c + (1 - c) / (1 + F.exp(e)))


def information(theta: Column, a: Column | float = 1.0, b: Column | float = 0.0, c: Column | float = GUESS) -> Column:
    """a^2 P (1 - P) / (1 - c)^2, rounded to four places."""
    a, b, c = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b, c))
    p = probability(theta, a, b, c)
    return F.when(c >= 1, 0.0).otherwise(F.round(a * a * p * (1 - p) / ((1 - c) * (1 - c)), 4))


def stepped(theta: Column, correct: Column, rounded: bool = False, b: Column | float = 0.0) -> Column:
    """One step of the ability fold, clipped to [-3, 3], rounded to two places on demand."""
    new = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), theta + RATE * (correct - probability(theta, 1.0, b))))
    return F.bround(new, 2) if rounded else new


def mastery(theta: Column) -> Column:
    return 1 / (1 + F.exp(-theta))


def level(theta: Column) -> Column:
    """Five levels, cut at -1.5, -0.5, 0.5 and 1.5."""
    return F.when(theta < -1.5, "beginner").when(theta < -0.5, "elementary").when(theta < 0.5, "intermediate").when(theta < 1.5, "advanced").otherwise("expert")


def heuristic_b(centrality: Column, neighbours: Column, description: Column) -> Column:
    """Difficulty from a concept's place in the graph and the length of its description."""
    size = F.least(F.coalesce(F.length(description), F.lit(0)) / 500, F.lit(1.0))
    return F.bround(0.3 * (1 - centrality) + 0.3 * F.least(neighbours / 10, F.lit(1.0)) + 0.2 * size + 0.1 - 0.5, 2)
