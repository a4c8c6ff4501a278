from corpusloom.llm import visual as V

SCHEMA = "canonical_id string, name string, aliases array<string>, text string, form string"


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, t string, form string")
    out = V.canonical_text(df, "t")
    assert out.columns == ["i", "in_form", "t", "form"]
    return [r.form for r in out.orderBy("i").collect()]


def test_same_looks_fall_together(spark):
    same = ["office plan-A 2", "oﬃce plan‐A 2", "ｏｆｆｉｃｅ　plan－A ２", "of​fice plan‑A 2 ", "﻿оffісе plаn-А 2", "office­ plan-Α 2"]
    assert set(forms(spark, same)) == {"office plan-A 2"}
    assert forms(spark, ["naïve", "naïve", "наïve"])[:2] == ["naïve", "naïve"]
    assert forms(spark, ["⾯面", "量"]) == ["面面", "量"]


def test_different_looks_stay_apart(spark):
    texts = ["A b", "a b", "a-b", "á b", "x²", "x2", "①", "1"]
    assert len(set(forms(spark, texts))) == len(texts)


def test_nulls_and_long_texts(spark):
    got = forms(spark, [None, "", "​  ", "ｘ" * 100_000])
    assert got == [None, "", "", "x" * 100_000]


def test_pairs(spark):
    rows = [("c1", "Alpha", ["β"], "t", "f"), ("c2", "Αlpha", None, "t", "f"), ("c3", "beta", ["​", None, ""], "t", "f"), ("c4", None, ["", "al​pha"], "t", "f"), ("c1", "Alpha", None, None, None), (None, "Alpha", None, None, None)]
    got = {tuple(r) for r in V.same_looks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("c1", "c2")}
    assert V.same_looks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_more_scripts_and_letters_of_formulas(spark):
    assert forms(spark, ["𝐀𝑏𝟟", "Ⅳ ⅷ", "ꓮꓢ", "ᎪᎷ", "Ⲟɡ"]) == ["Ab7", "IV viii", "AS", "AM", "Og"]


def test_a_form_that_most_concepts_share(spark):
    from corpusloom.llm.pairs import pairs_within

    rows = [("f", i) for i in range(90)] + [("g", 1), ("g", 2), ("h", 5)]
    df = spark.createDataFrame(rows, "form string, m int")
    got = [tuple(r) for r in pairs_within(df, "form", "m", block=8).collect()]
    assert len(got) == len(set(got)) == 90 * 89 // 2 + 1 and all(x < y for _, x, y in got)
    concepts = spark.createDataFrame([(f"c{i}", "Αlpha" if i % 2 else "alpha", [f"x{i}"], "t", "f") for i in range(6)], SCHEMA)
    got = {(r.canonical_id, r.form): (r.class_id, r.n_alike) for r in V.look_classes(concepts).collect()}
    assert got["c3", "Alpha"] == ("c1", 2) and got["c4", "alpha"] == ("c0", 2) and got["c3", "x3"] == ("c3", 0)
