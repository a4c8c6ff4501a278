"""Cutting the lineage of iterative jobs with storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, all of whose tasks run on this machine, gets a temporary folder
    where that setting is absent (tests, notebooks); any other raises an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return named or str(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """``cut``, whose result also has no estimate of its size.

    A checkpoint keeps the estimate of its plan, and that of a join is the product of both
    sides. Where a loop joins what it made before, the digits double in every round, and
    planning soon does nothing but multiply them.
    """
    out = cut(df)
    plan, jvm = out._jdf.queryExecution().logical(), df.sparkSession._jvm
    none = jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, df.sparkSession._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plan), df.sparkSession)


def release(df: DataFrame) -> None:
    """Delete the files of a checkpoint that ``cut`` made and nothing will read any more.

    Loops call it for the state before the last one, so that what they keep on storage
    doesn't grow with their rounds. Anything but a checkpoint is left alone.
    """
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isEmpty():
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
