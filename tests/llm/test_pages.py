import random

from corpusloom.llm import ocr as O

WORDS = "measured latency of the turbine limits both adaptive and closed-form signals while every kernel rarely balances residual pressure between stable operators under modest friction gradually revealing compact structure".split()
CHUNKS = "chunk_id string, text string, document_name string, description_source string, doc string, chunk string"


def page(n, body):
    return f"Compact Signals\n\n{body}\n\n- {n} -"


def data():
    p = [
        ("b_1", page(7, "    The measurcd latency of the turbine limits both adap-\ntive and closed-\nform signals while every kernel rarely balances"), "b", "ocr", None, "x"),
        ("b_2", page(8, "residual pressure between stable operators under modest fric-"), "b", "ocr", None, "x"),
        ("b_3", page(9, "tion gradually revealing compact structure of the 5table operators.\n42\n    Every kernel limits friction."), "b", "ocr", None, "x"),
    ]
    return [*p, p[0], ("c", None, "b", "ocr", None, None), ("d", "", None, "ocr", None, None), (None, "x", "b", "ocr", None, None), ("e", "residual", "b", None, None, None)]


def words(spark):
    return spark.createDataFrame([(w, "en") for w in {*WORDS, "every"}], "word string, lang string")


def test_defects(spark):
    got = {tuple(r) for r in O.defects(spark.createDataFrame(data(), CHUNKS), words(spark)).collect()}
    assert {("b_1", 7, "page_number", ""), ("b_2", 5, "page_number", ""), ("b_3", 7, "page_number", "")} <= got
    assert {("b_1", 1, "running_line", ""), ("b_2", 1, "running_line", ""), ("b_3", 1, "running_line", "")} <= got
    assert ("b_1", 3, "split_word", "adaptive") in got and ("b_1", 4, "split_word", "closed-form") in got
    assert ("b_2", 3, "split_word", "friction") in got
    assert ("b_1", 3, "misread_word", "measured") in got and ("b_3", 3, "misread_word", "stable") in got
    assert not any(r[2] == "page_number" and r[1] == 4 for r in got)


def test_paragraphs_run_over_pages(spark):
    got = [r.text for r in O.paragraphs(spark.createDataFrame(data(), CHUNKS), words(spark)).orderBy("chunk_id", "paragraph_no").collect()]
    assert got[0].startswith("The measured latency of the turbine limits both adaptive and closed-form signals")
    assert "modest friction gradually revealing compact structure of the stable operators." in got[0]


def test_empty(spark):
    empty = spark.createDataFrame([], CHUNKS)
    assert O.defects(empty, words(spark)).count() == 0
    assert O.paragraphs(empty, words(spark)).count() == 0


def test_misread_words_are_restored_on_held_out_noise():
    r = random.Random(99)
    listed = frozenset(WORDS)
    model = O.models(listed)[2]
    right = total = 0
    import numpy as np

    for _ in range(150):
        w = r.choice([x for x in WORDS if len(x) > 3])
        x = O.misread(w, r, 1)
        if x in listed:
            continue
        cand = [(c, len(set(O.qgrams(x)) & set(O.qgrams(c)))) for c in sorted(listed)]
        cand = [(c, n) for c, n in cand if O.enough(n, len(x), len(c))]
        p = model.predict(np.array([O.rank_features(x, c, n) for c, n in cand]))
        total += 1
        right += cand[int(p.argmax())][0] == w
    assert right >= 0.95 * total


def test_page_numbers():
    for s, n in (("- 12 -", 12), ("Page 3 of 40", 3), ("[7]", 7), ("Seite 9 von 12", 9), ("xiv", 14), ("4/9", 4), ("— 2 —", 2)):
        assert O.page_number_of(s) == n
    for s in ("12 apples", "", "the end", "chapter one"):
        assert O.page_number_of(s) == 0


def test_joined_words_never_span_documents(spark):
    rows = [("a_1", "under modest fric-", "a", "ocr", None, None), ("b_1", "tion gradually", "b", "ocr", None, None)]
    got = O.defects(spark.createDataFrame(rows, CHUNKS), words(spark)).where("defect = 'split_word'").count()
    assert got == 0


def book(n):
    r = random.Random(n)
    rows = []
    for i in range(n):
        body = "\n".join(" ".join(r.choice(WORDS) for _ in range(8)) + (" adap-\ntive" if r.random() < 0.3 else "") for _ in range(r.randrange(1, 9)))
        rows.append((f"b_{i:04}", page(i + 1, "    " + body.replace("stable", "5table")), f"book{i // 30}", "ocr", None, None))
    return rows


def test_partitions_and_blocks_change_nothing(spark):
    rows = book(70)
    rows += [(f"w_{i}", ("Compact Signals " * 400 + f"\nline {i} " * 300 + "\n") * 2, "wide", "ocr", None, None) for i in range(9)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = [{tuple(r) for r in O.defects(df.repartition(parts), words(spark), size=size).collect()} for parts, size in ((1, 1000), (3, 16), (7, 9))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 150


def test_a_list_too_long_to_hold_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(data() + book(40), CHUNKS)
    want = {tuple(r) for r in O.defects(df, words(spark)).collect()}
    fitted = O.models(frozenset({*WORDS, "every"}))
    monkeypatch.setattr(O, "models", lambda sample: fitted)
    assert {tuple(r) for r in O.defects(df, words(spark), most=len(WORDS) - 1).collect()} == want


def test_rarest_grams_lose_no_candidate(spark):
    r = random.Random(4)
    listed = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(2, 12))) for _ in range(150)})
    reads = sorted({O.misread(w, r, 2) for w in listed} - set(listed))[:60]

    class Every:
        def predict(self, x):
            return 1 - x[:, 0] / 100  # the nearest by cost

    got = {x.read: x.word for x in O.corrections(spark.createDataFrame([(x,) for x in reads], "read string"), spark.createDataFrame([(w,) for w in listed], "word string"), Every()).collect()}
    for x in reads:
        cost = {w: O.misreading_cost(x, w) for w in listed if O.enough(len(set(O.qgrams(x)) & set(O.qgrams(w))), len(x), len(w))}
        near = {w: c for w, c in cost.items() if c <= 2.2}
        assert (x in got) == bool(near)
        assert x not in got or near[got[x]] == min(near.values())
