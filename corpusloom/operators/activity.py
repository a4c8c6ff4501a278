"""Usage, monitoring, messages and dialogs over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usage(events: DataFrame, by: Column, name: str, value: str = "value") -> DataFrame:
    """Requests, sum, mean and large ones (above 50) by a key."""
    v = F.col(value)
    return events.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.count_if(v > 50).alias("large"))


def slow(events: DataFrame, last: int = 100, above: float = 50.0) -> DataFrame:
    """Share, mean and maximum of the slow among the ``last`` events (the limit is the feature)."""
    x = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(last)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > above).alias("slow"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))


def last_n(messages: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` messages of each key in time order, numbered from 1."""
    w = Window.partitionBy(key)
    x = messages.withColumn("back", F.row_number().over(w.orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where(F.col("back") <= n)
    return x.withColumn("pos", F.row_number().over(w.orderBy("ts", "event_id"))).drop("back")


def sessions(messages: DataFrame, key: str, minutes: int = 30) -> DataFrame:
    """Sessions of a key that end after ``minutes`` without a message."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr(f"interval '{minutes}' minute"), F.lit(True))
    x = messages.withColumn("new", new).withColumn("session", F.sum(F.col("new").cast("int")).over(w))
    return x.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def topic_counters(messages: DataFrame, key: str, topic: str) -> DataFrame:
    """Per key and topic: count, first and last turn."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return messages.withColumn("turn", turn).groupBy(key, topic).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages to all subscribers of their topic but the sender; dropped if there is none.

    Returns topic, n, delivered and dropped counts. ``subscriptions`` has topic, subscriber.
    """
    m = messages.groupBy("topic", "sender").agg(F.count(F.lit(1)).alias("n"))
    s = subscriptions.distinct()
    held = s.groupBy("topic").agg(F.count(F.lit(1)).alias("all"))
    own = s.select("topic", F.col("subscriber").alias("sender"), F.lit(1).alias("own"))
    # senders never meet the subscribers one by one: a topic's number less the sender itself
    out = m.join(held, "topic", "left").join(own, ["topic", "sender"], "left")
    out = out.withColumn("to", F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0)))
    return out.groupBy("topic").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("to")).alias("delivered"), F.sum(F.when(F.col("to") == 0, F.col("n")).otherwise(0)).alias("dropped"))


def adjacent_jaccard(sets: DataFrame, key: str, items: str, order: str, part: str) -> DataFrame:
    """Likeness of each row's set to the one before it within ``part``."""
    x = sets.withColumn("_before", F.lag(items).over(Window.partitionBy(part).orderBy(order))).where("_before is not null")
    union = F.size(F.array_union(items, "_before"))
    return x.select(part, F.col(order), F.round(F.when(union > 0, F.size(F.array_intersect(items, "_before")) / union).otherwise(0.0), 6).alias("jaccard"))


def entropy(df: DataFrame, part: str, label: str) -> DataFrame:
    """Shannon entropy of labels divided by two, at most 1."""
    c = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(part).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    return t.select(part, "all", F.round(F.least(F.lit(1.0), (F.log2("all") - F.col("nlog") / F.col("all")) / 2), 6).alias("diversity"))


def cache_kept(accesses: DataFrame, key: str, most: int, days: int) -> DataFrame:
    """(key, last_access, hits, rank): what a cache of ``most`` entries with a life of ``days`` holds.

    The time is that of the last access. The oldest entries go first; ties stay by key.
    """
    now = accesses.agg(F.max("ts").alias("now"))
    u = accesses.groupBy(key).agg(F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("hits"))
    alive = u.crossJoin(F.broadcast(now)).where(F.col("last_access") >= F.col("now") - F.make_dt_interval(F.lit(days)))
    top = alive.orderBy(F.col("last_access").desc(), key).limit(most).drop("now")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("last_access").desc(), key)))


def cache_stats(accesses: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, entries, hits, hit_rate): every access to a key after the first is a hit."""
    k = accesses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hits = F.sum("n") - F.count(F.lit(1))
    return k.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), hits.alias("hits"), F.round(hits / F.sum("n"), 6).alias("hit_rate"))


def slow_by(events: DataFrame, by: str, last: int = 100, above: float = 50.0) -> DataFrame:
    """The report of ``slow`` for each value of a column among the ``last`` events."""
    x = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(last)
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > above).alias("slow"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))


def messages(events: DataFrame, topic: str | None = None, sender: int | None = None, since: str | None = None, until: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the messages that meet all conditions given, the newest first."""
    x = events
    for test, value in ((lambda v: F.col("event_type") == v, topic), (lambda v: F.col("user_id") == v, sender), (lambda v: F.col("ts") >= F.lit(v).cast("timestamp_ntz"), since), (lambda v: F.col("ts") < F.lit(v).cast("timestamp_ntz"), until)):
        x = x if value is None else x.where(test(value))
    return x.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(offset).limit(limit)


def bars(state: DataFrame, part: str, value: str, key: str, most: int) -> DataFrame:
    """(part, bars, mean, strong, medium, weak) over the ``most`` highest values of each part."""
    rank = F.row_number().over(Window.partitionBy(part).orderBy(F.col(value).desc(), key))
    x = state.withColumn("_i", rank).where(F.col("_i") <= most)
    v = F.col(value)
    return x.groupBy(part).agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg(v), 6).alias("mean"), F.count_if(v >= 0.7).alias("strong"), F.count_if((v >= 0.4) & (v < 0.7)).alias("medium"), F.count_if(v < 0.4).alias("weak"))
