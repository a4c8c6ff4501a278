import random

from pyspark.sql import functions as F

from corpusloom.operators import gaps as GP
from corpusloom.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(*r, "REL") if len(r) == 2 else r for r in rows], "src string, dst string, rel string")


def test_fixture_of_five_concepts(spark):
    e = edges(spark, [("mha", "sdp", "DEPENDS_ON"), ("mha", "att", "SOLUTION"), ("sdp", "att", "DEPENDS_ON"), ("trf", "mha", "SOLUTION"), ("trf", "pos", "DEPENDS_ON")])
    d = {r.node: (r.in_degree, r.out_degree, r.n_neighbours) for r in G.degrees(e).collect()}
    assert d["mha"] == (1, 2, 3) and d["pos"] == (1, 0, 1)
    tree = {(r.node, r.depth) for r in G.bfs(e, spark.createDataFrame([("trf",)], "seed string"), 2).collect()}
    assert tree == {("trf", 0), ("mha", 1), ("pos", 1), ("att", 2), ("sdp", 2)}
    capped = G.bfs(e, spark.createDataFrame([("trf",)], "seed string"), 2, 3).collect()
    assert {r.node for r in capped} == {"trf", "mha", "pos"}
    p = G.shortest_paths(e, spark.createDataFrame([("pos", "att")], "source string, target string")).first()
    assert p.hops == 3 and p.path == "pos > trf > mha > att"
    ranks = {r.node: r.score for r in G.pagerank(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).collect()}
    assert max(ranks.values()) == 1.0 and max(ranks, key=ranks.get) == "mha"
    assert G.cyclic_nodes(e).count() == 0


def test_cycles_and_components(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "b"), ("p", "q"), ("q", "p"), ("m", "n")]
    e = edges(spark, rows)
    assert {r.node for r in G.cyclic_nodes(e).collect()} == {"a", "b", "c", "p", "q"}
    assert {r.node for r in G.cyclic_nodes(edges(spark, rows[:4])).collect()} == {"a", "b", "c"}
    assert {r.node: r.component for r in G.components(e).collect()} == {**dict.fromkeys("abcdx", "a"), "p": "p", "q": "p", "m": "m", "n": "m"}
    chain = edges(spark, [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(200)])
    assert {r.component for r in G.components(chain).collect()} == {"k000"}
    assert G.components(edges(spark, []).limit(0)).count() == 0


def test_gap_ladder(spark):
    types = spark.createDataFrame([(n, t) for n, t in (("d", "definition"), ("l", "law"), ("a", "application"), ("e", "extension"), ("o", "other"))], "node string, type string")
    e = edges(spark, [("d", "l"), ("d", "a"), ("d", "e"), ("a", "d"), ("d", "o"), ("d", "zz"), ("l", "l"), ("d", "a")])
    got = {(r.src, r.dst): (r.outcome, r.missing, r.replacement) for r in GP.edge_gaps(e, types, GP.THEORY).collect()}
    assert got[("d", "l")][0] == "ok"
    assert got[("d", "a")] == ("gap", ["law"], ["HAS_LAW", "APPLIES_TO"])
    assert got[("d", "e")] == ("gap", ["law", "application"], ["HAS_LAW", "APPLIES_TO", "EXTENDS"])
    assert got[("a", "d")][0] == "illegal_direction" and got[("d", "o")][0] == "type_not_in_chain"
    assert got[("d", "zz")][0] == "unknown_endpoint" and got[("l", "l")][0] == "self_loop"
    roots = {r.node: r.missing for r in GP.root_gaps(edges(spark, [("d", "l")]), types, GP.THEORY).collect()}
    assert roots == {"a": ["definition", "law"], "e": ["definition", "law", "application"]}


def test_cyclic_gaps(spark):
    types = spark.createDataFrame([("r1", "requirement"), ("r2", "requirement"), ("t1", "technology"), ("t2", "technology")], "node string, type string")
    got = {(r.src, r.dst): (r.outcome, r.missing) for r in GP.edge_gaps(edges(spark, [("r1", "r2"), ("t1", "t2"), ("r1", "t1"), ("t1", "r1")]), types, GP.ENGINEERING).collect()}
    assert got == {("r1", "r2"): ("gap", ["technology"]), ("t1", "t2"): ("gap", ["requirement"]), ("r1", "t1"): ("ok", None), ("t1", "r1"): ("ok", None)}


def test_gap_ids_are_stable(spark):
    i = spark.range(1).select(GP.gap_id(F.lit(" s "), "p", F.lit("a"), F.lit(None).cast("string"), F.array(F.lit("x"))).alias("i")).first().i
    j = spark.range(1).select(GP.gap_id(F.lit("s"), "p", F.lit("a"), F.lit(""), F.array(F.lit("x"))).alias("i")).first().i
    assert i == j and i.startswith("gap_") and len(i) == 68


def test_reconcile(spark):
    s = spark.createDataFrame([("1", "open"), ("2", "obsolete"), ("3", "ignored"), ("4", "open")], "gap_id string, status string")
    f = spark.createDataFrame([("1",), ("2",), ("5",), ("5",)], "gap_id string")
    got = {tuple(r) for r in GP.reconcile(s, f).collect()}
    assert got == {("1", "open", "refreshed"), ("2", "open", "reopened"), ("3", "ignored", "kept"), ("4", "obsolete", "obsoleted"), ("5", "open", "inserted")}


def test_strong_components_and_refused_edges(spark):
    import random

    r = random.Random(6)
    for n, m in ((14, 24), (8, 30)):
        pairs = sorted({(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)})
        edges = [(a, b, r.choice("xyz")) for a, b in pairs if a != b]
        reach = {a: {a} for e in edges for a in e[:2]}
        for _ in reach:
            for a, b, _w in edges:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        want = {a: min(b for b in reach if b in reach[a] and a in reach[b]) for a in reach if any(b != a and b in reach[a] and a in reach[b] for b in reach)}
        df = spark.createDataFrame(edges, "src string, dst string, w string")
        assert {x.node: x.component for x in G.strong_components(df).collect()} == want
        kept, after = set(), {}
        for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
            seen, todo = {b}, [b]
            while todo:
                for x in after.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if a not in seen:
                kept.add((a, b, w))
                after.setdefault(a, []).append(b)
        assert {tuple(x) for x in G.acyclic(df, ["w"]).select("src", "dst", "w").collect()} == kept


def test_components_need_few_jobs(spark, monkeypatch):
    r = random.Random(11)
    rows = [(f"n{i:03}", f"n{i + 1:03}") for i in range(99)] + [(f"m{r.randrange(90)}", f"m{r.randrange(90)}") for _ in range(60)] + [("s", "s"), ("é", "z"), (None, "alone"), (None, None)]
    df = spark.createDataFrame(rows, "src string, dst string").repartition(3)
    low = {x: x for row in rows for x in row if x}
    for _ in range(200):
        for a, b in rows:
            if a and b:
                low[a] = low[b] = min(low[a], low[b])
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert {x.node: x.component for x in G.components(df).collect()} == low
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(G, "LOCAL_LINKS", 25)
    assert {x.node: x.component for x in G.components(df).collect()} == low
    assert G.components(df.limit(0)).count() == 0
