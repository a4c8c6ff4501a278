import random

from corpusloom.operators.hierarchy import CYCLIC, OPEN, ROOTED, descendants, hierarchy, local_sets

SCHEMA = "parent_id string, child_id string, node string, anc string, label string"


def brute(rows):
    up, kids = {}, {}
    nodes = set()
    for p, c in rows:
        p, c = p or None, c or None
        nodes |= {x for x in (p, c) if x}
        if c and p:
            up[c] = min(up.get(c, p), p)
    for c, p in up.items():
        kids.setdefault(p, set()).add(c)
    out = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        ok = path[-1] not in up
        below, todo = set(), [n]
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in below:
                    below.add(k)
                    todo.append(k)
        out[n] = (path[-1], len(path) - 1, " > ".join(path[::-1])) + (len(below - {n}),) if ok else ("", -1, "", len(below - {n}))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA)
    return {r.node_id: (r.root_id, r.depth, r.path, r.n_descendants) for r in hierarchy(df, **how).collect()}


def forest():
    r = random.Random(8)
    rows = [(f"n{r.randrange(i) if i else 0}", f"n{i}") for i in range(1, 60)]
    rows += [(f"d{i}", f"d{i + 1}") for i in range(70)]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("t", "u"), ("s", "s"), ("s", "s1"), ("p", "q"), ("q", "p")]
    rows += [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("r7", "v"), ("v", "w")]
    return [*rows, (None, "n0"), ("", "lone"), ("onlyparent", None), (None, None), rows[0], ("z2", "multi"), ("z1", "multi")]


def test_trees_chains_and_cycles(spark):
    for local_links in (10**6, 60, 17):  # one partition, and paths and cycles across some
        assert run(spark, forest(), local_links=local_links) == brute(forest())


def test_descendants(spark):
    rows = forest()
    kids = {}
    for p, c in {(min(p for p, x in rows if x == c and p), c) for _, c in rows if c and any(x == c and p for p, x in rows)}:
        kids.setdefault(p, set()).add(c)
    want = set()
    for n in {x for r in rows for x in r if x}:
        below, todo = set(), [n]
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in below:
                    below.add(k)
                    todo.append(k)
        want |= {(n, x) for x in below - {n}}
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA)
    for local_links in (10**6, 17):
        got = descendants(df, local_links=local_links).collect()
        assert len(got) == len(want) and {(r.node_id, r.descendant_id) for r in got} == want
        assert {r.distance for r in got if r.node_id == "d3" and r.descendant_id == "d60"} == {57}


def test_hub(spark):
    rows = [("hub", f"h{i}") for i in range(500)] + [("top", "hub")]
    got = run(spark, rows)
    assert got["top"] == ("top", 0, "top", 501) and got["h7"] == ("top", 2, "top > hub > h7", 0)


def test_empty(spark):
    assert run(spark, []) == {}


def test_local_sets_keep_weights():
    got = {x[0]: x[1:] for x in local_sets(["a", "b", "c", "x", "y", "p", "q", "t"], [None, "a", "b", "outside", "x", "q", "p", "q"])}
    assert got["a"] == ("a", ROOTED, None, 2, ["a"]) and got["c"] == ("a", ROOTED, None, 0, ["a", "b", "c"])
    assert got["y"] == ("outside", OPEN, None, 0, ["x", "y"])
    assert got["p"] == ("p", CYCLIC, "p", 0, ["p"]) and got["q"] == ("q", CYCLIC, "p", 1, ["q"]) and got["t"] == ("q", CYCLIC, "p", 0, ["q", "t"])
