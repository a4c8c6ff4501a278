import random

from corpusloom.llm import components as C


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b in pairs:
        if a and b and a != b:
            x, y = find((s, a)), find((s, b))
            up[max(x, y, key=lambda v: v[1])] = min(x, y, key=lambda v: v[1])
    return {(s, n, find((s, n))[1]) for s, n in up}


def test_random_graphs_chains_and_hubs(spark):
    r = random.Random(5)
    pairs = [("r", f"n{r.randrange(120):03d}", f"n{r.randrange(120):03d}") for _ in range(90)]
    pairs += [("chain", f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    pairs += [("hub", "h999", f"h{i:03d}") for i in range(200)]
    pairs += [(None, "a", "b"), ("", "a", "c"), ("x", None, "b"), ("x", "", "b"), ("x", "s", "s"), pairs[0], (pairs[0][0], pairs[0][2], pairs[0][1])]
    df = spark.createDataFrame([(*p, "junk", "junk") for p in pairs], "b string, l string, r string, scope string, u string")
    for hub in (C.HUB, 3):  # through the joins, and hubs by broadcast
        got = [tuple(x) for x in C.connected_groups(df, "l", "r", "b", hub=hub).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_a_hub_of_most_edges_meets_no_shuffle_join(spark):
    pairs = [("h0", f"n{i:04}") for i in range(3000)] + [(f"a{i:04}", f"b{i:04}") for i in range(1000)]
    df = spark.createDataFrame(pairs, "l string, r string")
    got = {x.name: x.group_name for x in C.connected_groups(df, "l", "r", hub=100).collect()}
    assert len(got) == 5001 and got["n2999"] == "h0" and got["b0007"] == "a0007"
    edges = spark.createDataFrame([(i + 1, 0) for i in range(3000)], "u bigint, v bigint")
    plan = C.large_star(edges, 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_decisions_and_empty(spark):
    schema = "build_id string, left_name string, right_name string, decision string"
    df = spark.createDataFrame([("b", "x", "y", " MERGE\t"), ("b", "y", "z", "merged?"), ("b", "p", "q", None)], schema)
    got = C.connected_groups(C.merge_pairs(df), "left_name", "right_name", "build_id").collect()
    assert {tuple(g) for g in got} == {("b", "x", "x"), ("b", "y", "x")}
    assert C.connected_groups(spark.createDataFrame([], schema), "left_name", "right_name").count() == 0
