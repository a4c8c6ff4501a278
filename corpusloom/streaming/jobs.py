"""Structured Streaming jobs: monitoring windows, sessions, deduplication, ability state.

Each takes a streaming (or batch) DataFrame of events with ts, event_id, user_id,
event_type and value, and returns the transformed DataFrame. Timestamps without a zone are
read as UTC.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.plans.lineage import shared_folder

LATE = "2 hours"
#: Minutes without a message after which a dialog ends.
SILENT = 30


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A file stream over Parquet parts, ``files`` each trigger, with ts as a UTC timestamp.

    ``path`` is a folder of parts or one file, which is streamed from its folder by name.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        x = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        x = stream.parquet(path)
    return x.withColumn("ts", F.col("ts").cast("timestamp"))


def monitor(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts, mean and maximum of values by tumbling window and type, with a watermark."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "most")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def still_open(events: DataFrame, closed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions that a stream ended before the watermark closed them.

    ``events`` is what the stream has read, as a batch, ``closed`` what it wrote. A user's open
    events are those after the end of their last closed session.
    """
    last = closed.groupBy("user_id").agg(F.max("ended").alias("until"))
    rest = events.join(last, "user_id", "left").where("until is null or ts > until")
    return rest.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def budgets(events: DataFrame, most: float) -> DataFrame:
    """Spending of each month and how much of a budget it has used: 0, 80 or 100 percent."""
    total = F.sum("value")
    level = F.when(total >= most, 100).when(total >= 0.8 * most, 80).otherwise(0)
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(total, 4).alias("total"), level.alias("level"))


def _dialog(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out = []
    topic, began, last, n = state.get if state.exists else ("", 0, 0, 0)
    limit = SILENT * 60 * 1_000_000
    if state.hasTimedOut:
        out.append((key[0], topic, began, last, n, "expired"))
        state.remove()
    else:
        for pdf in batches:  # a batch at a time; the stream brings a user's events in time order
            for at, _, what in sorted(zip(pdf["at"], pdf["event_id"], pdf["topic"])):
                if n and at - last > limit:
                    out.append((key[0], topic, began, last, n, "expired"))
                    n = 0
                elif n and what != topic:
                    out.append((key[0], topic, began, last, n, "suspended"))
                    n = 0
                topic, began, last, n = what, began if n else at, at, n + 1
        state.update((topic, began, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + SILENT * 60 * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["user_id", "topic", "began", "ended", "n", "why"])


def dialogs(events: DataFrame) -> DataFrame:
    """Dialogs of a user about one topic: (user_id, topic, began, ended, n, why).

    A dialog is suspended when the user turns to another topic, and expires after ``SILENT``
    minutes without a message, when its state is dropped. ``events`` has user_id, ts,
    event_id and topic; began and ended are microseconds. Dialogs that are still open when a
    stream is stopped stay in its state.
    """
    kind = dict(events.dtypes)["user_id"]
    x = events.withWatermark("ts", LATE).withColumn("at", F.unix_micros("ts"))
    schema = f"user_id {kind}, topic string, began bigint, ended bigint, n bigint, why string"
    return x.groupBy("user_id").applyInPandasWithState(_dialog, schema, "topic string, began bigint, last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each, within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream-static join of messages with the subscribers of their topic."""
    return events.join(subscriptions, F.col("event_type") == F.col("topic"), "left").select("event_id", "event_type", "subscriber", F.col("subscriber").isNull().alias("dropped"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    theta, n, streak = state.get if state.exists else (0.0, 0, 0)
    # only what the fold needs is held: time, id and outcome of a user's answers in this batch
    held = [np.rec.fromarrays([b["ts"].astype("int64"), b["event_id"], b["correct"].astype(bool)], names="ts,id,ok") for b in batches]
    rows = np.sort(np.concatenate(held), order=["ts", "id"])
    for ok in rows["ok"]:
        p = 0.25 + 0.75 / (1 + math.exp(-theta))
        theta = max(-3.0, min(3.0, theta + 0.3 * (float(ok) - p)))
        streak = (streak + 1 if streak >= 0 else 1) if ok else (streak - 1 if streak <= 0 else -1)
        n += 1
    state.update((theta, n, streak))
    yield pd.DataFrame({"user_id": [key[0]], "theta": [theta], "n": [n], "streak": [streak]})


def ability(answers: DataFrame) -> DataFrame:
    """Ability, count and streak of each user, kept as state and updated in event-time order
    within a batch. ``answers`` has user_id, ts, event_id and correct; later batches are
    folded in as they come. Emits one row a user and batch."""
    kind = dict(answers.dtypes)["user_id"]
    return answers.groupBy("user_id").applyInPandasWithState(_fold, f"user_id {kind}, theta double, n bigint, streak bigint", "theta double, n bigint, streak bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_files(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now and return what it wrote, with its batch.

    Each micro-batch overwrites its own folder below the shared one, so a repeated batch
    changes nothing, and the results never pass through the driver.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/nr={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/out").drop("nr")


def last_state(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key of a stream in update mode."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
