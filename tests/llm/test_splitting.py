import random

from corpusloom.llm import splitting as S


def check(text, pieces, limit, overlap):
    last, marks = 0, set(S.WEAK + S.LINES + S.ENDS)
    for s, e, hard, p in pieces:
        assert p == text[s:e] and 0 < e - s <= limit and s <= last and last - s <= overlap and e > last
        if last and set(text[max(0, last - overlap - 1) : last - 1]) & marks and e - last < limit - overlap:
            assert s < last  # an overlap where there is a boundary to begin it at
        if hard:
            assert not set(text[e - limit : e + 1]) & marks
        else:
            assert e == len(text) or text[e - 1] in marks or text[e] in marks
        last = e
    assert last == len(text)


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(("word ", "中文词。", "x" * r.randrange(1, 30) + " ", "end.\n", "\n\n", "，", "𝒜b ")) for _ in range(n))


def test_rows(spark):
    texts = [text(1, 900), text(2, 5000), "a" * 9001, None, "", "short", text(1, 900), "b " * 40 + "c" * 3500 + " d" * 100, "e" * 3000 + " f" * 900 + "中" * 7000 + "。" + text(5, 3000)]
    df = spark.createDataFrame([(i, t, "own", "h", 5) for i, t in enumerate(texts)], "id int, t string, piece string, start string, k int")
    every = []
    for size, parts in ((1 << 30, 1), (S.RANGE, 3), (5000, 4), (1777, 2)):
        got = {}
        for r in S.split_rows(df.repartition(parts), "t", size=size).collect():
            assert r.in_piece == "own" and r.in_start == "h" and r.in_k == 5
            got.setdefault(r.id, []).append((r.start, r.end, r.hard, r.piece))
        assert sorted(got) == [0, 1, 2, 6, 7, 8]
        every.append({i: sorted(p) for i, p in got.items()})
        for i, p in every[-1].items():
            check(texts[i], p, S.LIMIT, S.OVERLAP)
            assert [x[:3] for x in p] == S.split_text(texts[i])
    assert all(e == every[0] for e in every)  # whatever the ranges and partitions
    assert S.split_rows(df.limit(0), "t").count() == 0


def test_every_size_of_range_gives_the_same_pieces():
    r = random.Random(3)
    for n in range(40):
        x = text(n, 200) + "z" * r.choice((0, 30, 61, 200)) + text(n + 100, 100) + "中" * r.choice((0, 60, 400)) + " " * r.choice((0, 300))
        raw = x.encode()
        want = S.split_text(x, 60, 12)
        for size in (7, 50, 64, 333, 1000):
            e, first, got = 0, 0, []
            for k in range(-(-len(raw) // size)):
                c = S.Cutter(S.slice_of(lambda a, b: raw[a:b], len(raw), k, size, 60, 12), 60, 12)
                entry, leaves = c.table(k == 0)
                got += [(a + first, b + first, h) for a, b, h in c.pieces(e)]
                if e < c.own:
                    at = max(i for i, p in enumerate(entry) if p <= e)
                    e = leaves[at]
                else:
                    e -= c.own
                first += c.own
            assert got == want, (n, size)


def test_overlap_holds_at_the_edges_of_ranges(spark):
    x = "plain words in a row " * 3000
    df = spark.createDataFrame([(x,)], "t string")
    p = sorted((r.start, r.end) for r in S.split_rows(df, "t", size=20_000).collect())
    assert all(150 < e - s <= S.OVERLAP for (_, e), (s, _) in zip(p, p[1:]))


def test_unbreakable(spark):
    texts = ["a" * 3001, "a" * 3000 + " b" * 9, "x " * 2000, "," * 3500, None, "a" * 2999, "b " * 9000 + "c" * 3001 + " d" * 5000, "b " * 9000 + "c" * 3000 + " d" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "id int, t string")
    for size in (1 << 30, 4000, 700):
        assert {tuple(r) for r in S.oversized(df, "id", "t", size=size).collect()} == {(0, 1), (1, 0), (2, 0), (3, 1), (6, 1), (7, 0)}


def test_files(spark, tmp_path):
    whole = text(7, 30_000) + "q" * 9000 + text(8, 200)
    (tmp_path / "a.txt").write_text(whole, encoding="utf-8", newline="")
    (tmp_path / "e.txt").write_text("")
    for size in (20_000, 6_000_000):
        rows = S.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "e.txt")], size=size).collect()
        assert {r.path for r in rows} == {str(tmp_path / "a.txt")}
        got = sorted((r.start, r.end, r.hard, r.piece) for r in rows)
        check(whole, got, S.LIMIT, S.OVERLAP)
        assert [x[:3] for x in got] == S.split_text(whole)
