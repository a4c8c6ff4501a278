"""All pairs within groups, and of groups, without a task that holds a large group.

Groups above ``BLOCK`` members are cut into blocks by the members' hash; pairs of blocks are
join keys of their own, so a group of a third of all rows is spread over many tasks, each
with at most about BLOCK x BLOCK pairs. Only such groups are known by name: there are at most
rows / BLOCK of them, and they are broadcast if their count allows, else joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.sizes import small

BLOCK = 2000


def blocked(rows: DataFrame, group: str, member: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``mine`` (block of the member) and ``blocks`` (of its group), and the hot groups."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = small(sizes.select(group, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    held = rows.join(hot, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return held.withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")), hot


def pairs_within(rows: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """(group, x, y), x < y: every pair of distinct members of each group once."""
    held, _ = blocked(rows.select(group, member).distinct(), group, member, block)
    upper = held.select(group, F.col(member).alias("x"), F.col("mine").alias("lo"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("hi"))
    lower = held.select(group, F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("lo"), F.col("mine").alias("hi"))
    met = upper.join(lower, [group, "lo", "hi"]).where("lo < hi or x < y")
    return met.select(group, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def expanded(links: DataFrame, side: str, members: DataFrame, group: str, member: str, to: str, block: int = BLOCK) -> DataFrame:
    """``links`` with ``to`` for each member of the group that its column ``side`` names."""
    held, hot = blocked(members.select(group, member), group, member, block)
    own = held.select(F.col(group).alias(side), F.col("mine").alias("_block"), F.col(member).alias(to))
    met = links.join(hot.withColumnRenamed(group, side), side, "left")
    met = met.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return met.join(own, [side, "_block"]).drop("_block")
