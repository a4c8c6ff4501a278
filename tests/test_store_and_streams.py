import datetime as dt

from pyspark.sql import functions as F

from corpusloom.operators import activity as A
from corpusloom.sources import store as S
from corpusloom.streaming import jobs as J

T0 = dt.datetime(2025, 1, 1)


def test_two_kinds_of_inequality(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert S.where_sql(df, k=("$ne", "a")).count() == 1 and S.where_matching(df, k=("$ne", "a")).count() == 2
    assert S.where_sql(df, k="a").count() == S.where_matching(df, k="a").count() == 1


def test_changes(spark, tmp_path):
    old = spark.createDataFrame([("1", "s", "paragraph", 1), ("2", "s", "heading", 1), ("3", "t", None, 1)], "id string, source string, chunk_type string, v int")
    new = spark.createDataFrame([("1", "s", "paragraph", 2), ("4", "s", "paragraph", 2)], old.schema)
    assert {(r.id, r.v) for r in S.upsert(old, new, ["id"], ["v"]).collect()} == {("1", 2), ("2", 1), ("3", 1), ("4", 2)}
    assert {(r.id, r.v) for r in S.replace_source(old, new, F.col("source")).collect()} == {("1", 2), ("3", 1), ("4", 2)}
    assert {(r.id, r.v) for r in S.replace_source(old, new, F.col("source"), ["paragraph"]).collect()} == {("1", 2), ("2", 1), ("3", 1), ("4", 2)}
    assert {r.id for r in S.delete(old, "id", new).collect()} == {"2", "3"}
    a = S.publish(old, str(tmp_path))
    b = S.publish(new, str(tmp_path))
    assert a != b and spark.read.parquet(a).count() == 3


def test_lookup_keeps_the_order_asked_for(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    w = spark.createDataFrame([("q", ["y", "missing", "x"])], "q string, ids array<string>")
    assert [(r.k, r.pos) for r in S.lookup(df, "k", w, "ids", ["q"]).orderBy("pos").collect()] == [("y", 0), ("x", 2)]


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Grün")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "c.png").write_bytes(b"\x89")
    got = {r.path.rpartition("/")[2]: (r.kind, r.text) for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("text", "# Grün"), "b.PDF": ("pdf", None), "c.png": ("image", None)}


def events(spark):
    rows = [(i, T0 + dt.timedelta(minutes=m), u, t, float(m)) for i, (m, u, t) in enumerate([(0, 1, "a"), (10, 1, "b"), (50, 1, "a"), (61, 2, "a"), (200, 2, "b")])]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


def test_activity(spark):
    e = events(spark)
    assert [(r.user_id, r.n) for r in A.sessions(e, "user_id").orderBy("user_id", "session").collect()] == [(1, 2), (1, 1), (2, 1), (2, 1)]
    assert {(r.user_id, r.pos, r.event_id) for r in A.last_n(e, "user_id", 2).collect()} == {(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)}
    m = e.select(F.col("event_type").alias("topic"), F.col("user_id").alias("sender"))
    s = spark.createDataFrame([("a", 2), ("a", 3)], "topic string, subscriber bigint")
    assert {tuple(r) for r in A.deliveries(m, s).collect()} == {("a", 3, 5, 0), ("b", 2, 0, 2)}


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "e")
    events(spark).repartition(2).write.parquet(folder)
    s = J.read_events(spark, folder)
    got = J.last_state(J.run_to_files(J.monitor(s), "m", "update"), "start", "event_type")
    want = events(spark).groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count()
    assert {(r.start.replace(tzinfo=None), r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r["count"]) for r in want.collect()}
    theta = J.last_state(J.run_to_files(J.ability(J.read_events(spark, folder, 10).select("user_id", "ts", "event_id", (F.col("event_type") == "a").alias("correct"))), "t", "update"), "user_id")
    assert {(r.user_id, r.n, r.streak) for r in theta.collect()} == {(1, 3, 1), (2, 2, -1)}
