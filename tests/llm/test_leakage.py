import random

from corpusloom.llm import leakage as K


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "c", "h") for x in docs], "doc_id bigint, text string, context string, h string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, at int")
    return {(r.doc_id, r.item_id): (r.exact_run, r.overlap) for r in K.leaked(d, i, **how).collect()}


def test_exact_runs_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    docs = []
    for n in range(80):
        x = " ".join(word() for _ in range(60))
        if n % 2:
            src = items[r.randrange(20)][1]
            a, k = r.randrange(60), r.randrange(40, 75)
            x = x[:100] + src[a : a + k].upper() + x[100:]
        docs.append((n, x))
    docs += [(500, None), (501, ""), (502, "short"), (None, items[0][1]), docs[1], (503, items[3][1] + "z" * 100_000)]
    items += [(90, None), (91, "tiny"), items[0]]
    bare = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    want = set()
    for d, x in docs:
        for i, y in items:
            b, q = bare(x), bare(y)
            if d is not None and any(q[j : j + 50] in b for j in range(len(q) - 49)):
                want.add((d, i))
    for held in (K.HELD_HASHES, 0):  # filtered in the scan, and by the shuffle join alone
        got = run(spark, docs, items, held_hashes=held)
        assert {k for k, (exact, _) in got.items() if exact >= 50} == want
        of = {k: bare(x) for k, x in docs}, dict(items)
        for (d, i), (exact, most) in got.items():  # measured over whole texts, however long
            b, q = of[0][d], bare(of[1][i])
            runs = [k for j in range(len(q)) for k in [next(n for n in range(len(q) - j, -1, -1) if q[j : j + n] in b)]] if exact >= 50 else [exact]
            assert exact == max(runs) and most >= exact


def test_a_wholly_copied_item_is_reported_whole(spark):
    r = random.Random(2)
    item = "".join(r.choice("abcdefghij") for _ in range(900))
    copy = item[:300] + "Z" + item[301:600] + "Z" + item[601:]
    docs = [(1, "x" * 400 + item + "y" * 400), (2, "x" * 77 + copy)]
    for held in (K.HELD_HASHES, 0):
        assert run(spark, docs, [(5, item)], held_hashes=held) == {(1, 5): (900, 900), (2, 5): (300, 900)}


def test_substitutions(spark):
    x = "thequickbrownfoxjumpsoverthelazydogwhilethecatsleepsonthewarmmatnearthefire"
    y = x[:20] + "#" + x[21:]
    z = y.replace("#", "q")
    got = run(spark, [(1, z)], [(7, x)])
    assert got[(1, 7)][1] >= 70 and got[(1, 7)][0] < len(x)


def test_every_overlap_with_one_or_two_substitutions_is_found(spark):
    r = random.Random(8)
    made = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    docs, items = [], []
    for n in range(240):
        size = r.choice((50, 60, 70, 80))
        x = list(made(size))
        items.append((n, "y" + "".join(x) + "y"))
        for at in r.sample(range(1, size - 1), 1 + n % 2):
            x[at] = "z"
        docs.append((n, made(r.randrange(100)) + "x" + "".join(x) + "x" + made(50)))
    for held in (K.HELD_HASHES, 0):
        got = run(spark, docs, items, held_hashes=held)
        assert {(n, n) for n in range(240)} <= set(got)


def test_recall_of_overlaps_with_more_substitutions(spark):
    r = random.Random(21)
    made = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    docs, items = [], []
    for n in range(300):
        size, miss = r.choice((60, 80, 120)), 3 + n % 3
        x = list(made(size))
        items.append((n, "y" + "".join(x) + "y"))
        for at in r.sample(range(1, size - 1), miss):
            x[at] = "z"
        docs.append((n, made(40) + "x" + "".join(x) + "x" + made(50)))
    got = run(spark, docs, items, substitutions=5)
    found = sum((n, n) in got for n in range(300))
    assert found >= 0.97 * 300


def test_empty(spark):
    assert run(spark, [], [(1, "x" * 80)]) == {} and run(spark, [(1, "x" * 80)], []) == {}
