import random

from pyspark.sql import functions as F

from corpusloom.llm import chosen_path as C

SCHEMA = "id string, t string, k string, rep string"


def jaccard(a, b):
    bare = ["".join(c for c in (x or "").lower() if c.isalnum()) for x in (a, b)]
    s, t = ({x[i : i + 4] for i in range(len(x) - 3)} for x in bare)
    return len(s & t) / len(s | t) if s | t else 0.0


def rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "omega", "sigma") for b in ("tion", "ment", "ness", "ward", "less")]
    out = []
    for g in range(40):
        base = [r.choice(words) for _ in range(30)]
        for v in range(4):
            t = list(base)
            for _ in range(v):
                t[r.randrange(30)] = r.choice(words)
            out.append((f"id{g:02d}{v}", " ".join(t), "x", "y"))
    out += [("n1", None, None, None), ("n2", "", "k", None), ("n3", "ab", None, None), (None, "lost", None, None), out[0], ("copy", out[0][1].upper(), None, None), ("long", "z" * 200_000, None, None), ("cjk", "量子力学的基本原理和应用", None, None), ("cjk2", "量子力学的基本原理和应用。", None, None), ("astral", "𝒜𝒷𝒸𝒹𝓮𝒻 𝒜𝒷𝒸𝒹", None, None)]
    return out


def test_pairs_equal_brute_force(spark):
    data = rows()
    got = {tuple(r) for r in C.similar_pairs(spark.createDataFrame(data, SCHEMA), "id", F.col("t")).collect()}
    texts = {i: t for i, t, *_ in data if i}
    ids = sorted(texts)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if jaccard(texts[a], texts[b]) >= 0.7}
    assert got == want


def test_blocks_of_an_oversized_node_lose_nothing(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    a = {tuple(r) for r in C.similar_pairs(df, "id", F.col("t")).collect()}
    b = {tuple(r) for r in C.similar_pairs(df, "id", F.col("t"), leaf=3, start=1, depth=1).collect()}
    assert a == b


def test_groups(spark):
    data = rows()
    got = {r.id: r for r in C.near_duplicate_groups(spark.createDataFrame(data, SCHEMA), "id", F.col("t")).collect()}
    assert set(got) == {i for i, *_ in data if i}
    assert got["copy"].class_id == got["id000"].class_id == "copy"
    assert got["n1"].n_links == got["n3"].n_links == 0
    assert got["cjk"].group_id == got["cjk2"].group_id == "cjk"


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.similar_pairs(empty, "id", F.col("t")).count() == 0
    assert C.near_duplicate_groups(empty, "id", F.col("t")).count() == 0


def test_deep_trees_keep_pairs_at_the_threshold(spark):
    r = random.Random(11)
    made = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for _ in range(300):  # a template in which each text has a part of its own
        x = made(200)
        texts += [x, x[:166] + made(34)]
    hot = made(170)
    texts += [hot + made(30) for _ in range(60)]
    sets = [set(C.grams(x).tolist()) for x in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    reps = spark.createDataFrame([(f"{n:04}", x) for n, x in enumerate(texts)], "rep string, bare string")
    got = {(int(x.a), int(x.b)) for x in C.similar_sets(reps, leaf=1).collect()}
    assert got <= want and len(want) > 1000 and len(want - got) <= 0.004 * len(want)


def test_copies_and_links_of_hot_classes_in_blocks(spark, monkeypatch):
    from corpusloom.llm import pairs

    base = "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm mat near the fire"
    data = [(f"a{i:02}", base) for i in range(40)] + [(f"b{i:02}", base.replace("warm", "cold")) for i in range(25)] + [("z", "nothing like the others at all, truly")]
    df = spark.createDataFrame([(*x, None, None) for x in data], SCHEMA)
    want = {tuple(r) for r in C.similar_pairs(df, "id", F.col("t")).collect()}
    assert len(want) == 65 * 64 // 2
    monkeypatch.setattr(pairs.blocked, "__defaults__", (7,))
    monkeypatch.setattr(pairs.pairs_within, "__defaults__", (7,))
    monkeypatch.setattr(pairs.expanded, "__defaults__", (7,))
    assert {tuple(r) for r in C.similar_pairs(df, "id", F.col("t")).collect()} == want
