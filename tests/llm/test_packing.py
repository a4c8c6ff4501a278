import random

import pytest

from corpusloom.llm import packing as P


def test_packing(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(("alpha", "beta", "量子", "gamma")) for _ in range(r.choice((1, 5, 50, 300, 900)))) for _ in range(300)]
    data = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(900, None, "k", 1), (901, "", "k", 1), (902, "word " * 20_000, "k", 1), (0, texts[0], "k", 1)]
    df = spark.createDataFrame(data, "id int, t string, key string, size int").repartition(5)
    check(P.pack(df, "id", "t", open_windows=4).collect(), data, 1.25)
    check(P.pack(df, "id", "t").collect(), data, 1.05)
    assert P.pack(df.limit(0), "id", "t").count() == 0


def check(got, data, waste):
    used = {}
    for x in got:
        used[x.container_id] = used.get(x.container_id, 0) + x.tokens
    assert max(used.values()) <= P.CAPACITY
    count = P.counter(P.VOCABULARY)
    for i, t, *_ in data:
        parts = sorted((x.part, x.token_start, x.tokens) for x in got if x.id == i and i != 0)
        if i:
            assert sum(n for *_, n in parts) == (count(t) if t else 0)
            assert len(parts) == max(1, -(-(count(t) if t else 0) // P.CAPACITY))
    assert sum(1 for x in got if x.id == 0) == 2
    # two items above half a container never share one
    least = max(-(-sum(used.values()) // P.CAPACITY), sum(x.tokens > P.CAPACITY / 2 for x in got))
    assert len([u for u in used.values() if u]) <= least * waste + 1


def test_windows_keep_their_bound():
    w = P.Windows(10, 3)
    r = random.Random(2)
    open_ = set()
    for _ in range(500):
        c, closed = w.place(r.randrange(0, 11))
        open_.add(c)
        assert closed is None or closed in open_
        assert len(w.free) <= 3


@pytest.mark.parametrize("text, n", [("", 0), ("<|endoftext|>", None)])
def test_special_strings_are_ordinary(text, n):
    got = P.counter(P.VOCABULARY)(text)
    assert got == n if n is not None else got > 1
