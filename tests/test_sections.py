import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sections as S
from corpusloom.sources import paradigms as P
from corpusloom.sources import records as R


def test_paragraphs_over_pages_belong_to_both():
    pages = [(1, "first words of it " * 5), (2, "go on\n\n" + "second part here " * 5), (3, "  ")]
    parents, kids = S.parent_child("doc", pages)
    assert [(p[1], p[3]) for p in parents] == [(1, 1), (2, 1)] and len(kids) == 1
    assert kids[0][3] == [1, 2] and [p[0] for p in parents] == kids[0][4] and "PAGE" not in kids[0][5]
    assert S.parent_child("doc", []) == ([], [])


def test_documents_as_groups(spark):
    rows = [("d", 2, "b " * 60), ("d", 1, "a " * 60), ("d", 1, "a " * 60), (None, 1, "x"), ("e", None, "x"), ("f", 1, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "document_name string, page_number int, text string, kind string")
    got = S.parent_child_documents(df).collect()
    assert {r.document_name for r in got} == {"d"} and [r.pages for r in got if r.kind == "parent_page"] == [[1], [2]]
    assert S.parent_child_documents(df.limit(0)).count() == 0


def test_sections_fall_back_to_windows():
    heads = "".join(f"# T{i}\n{'w ' * 80}\n" for i in range(3))
    assert [x[:3] for x in S.document_sections(heads)] == [("header", 1, "T0"), ("header", 1, "T1"), ("header", 1, "T2")]
    assert {x[0] for x in S.document_sections("plain words. " * 200)} == {"window"}


def test_second_level():
    got = list(S.second_level("s", "intro\n## A\n![x](y)\n## B\ntext ![x](y)\n## C\n$q$\n## D\n| a |\n| b |\n### deep\n## E\n"))
    assert [(g[1], g[2]) for g in got] == [("text", ""), ("image", "A"), ("text_image", "B"), ("text_formula", "C"), ("text_table", "D"), ("text", "E")]
    assert got[-1][5] == "## E" and got[0][0].startswith("md_s_0_")


def test_outlines_and_headings(spark):
    x = "# a\n## b\ntext\n```\n# code\n```\n### c\n## d\n# e"
    got = spark.createDataFrame([(x,), ("none",)], "t string").select(S.heading_spans(F.col("t")).alias("h")).collect()
    assert [(h.line, h.level, h.title, h.end) for h in got[0].h] == [(0, 1, "a", 8), (1, 2, "b", 7), (6, 3, "c", 7), (7, 2, "d", 8), (8, 1, "e", 9)] and got[1].h == []
    rows = [("d", 1, 1, "A"), ("d", 2, 3, "B"), ("d", 3, 2, "C"), ("d", 4, 1, "D"), ("e", 1, 2, "x")]
    paths = S.outline_paths(spark.createDataFrame(rows, "d string, i int, l int, t string"), "d", "i", "l", "t")
    assert [(r.d, r.path) for r in paths.orderBy("d", "i").collect()] == [("d", "A"), ("d", "A > B"), ("d", "A > C"), ("d", "D"), ("e", "x")]
    spans = spark.createDataFrame([("d", 1, 12.0, False, "body"), ("d", 1, 11.0, True, "Head"), ("d", 2, 30.0, False, " "), ("d", 2, 9.0, False, "x" * 101)], "d string, p int, size double, bold boolean, t string")
    assert [tuple(r) for r in S.page_headings(spans, "d", "p", "size", "bold", "t").collect()] == [("d", 1, "Head")]


def test_anchors():
    chunks = [("h1", "heading", "Intro"), ("p1", "paragraph", "let $a^2+b^2=c^2$ hold"), ("h2", "heading", "End")]
    assert S.anchor("a^2 + b^2 = c^2", True, 0, 2, chunks) == "p1"
    assert [S.anchor("", False, i, 4, chunks) for i in range(4)] == ["h1", "h1", "h2", "h2"] and S.anchor("", False, 0, 1, []) is None


GOOD = {"name": "n", "description": "d", "types": {"def": "D", "law": "L"}, "relations": {"HAS": "has", "USES": "u"}, "relation_map": {"def": {"HAS": ["law"], "USES": ["law"]}}}


def test_paradigms(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"paradigms": {"mine": GOOD}}))
    config = P.read_paradigms(str(tmp_path / "p.json"))["mine"]
    assert P.transitions(config) == {("def", "law"): "USES"}
    errors, made = P.checked(config)
    assert errors == [] and made == {"parent_rules": {"def": [], "law": ["def"]}, "ideal_chain": ["def", "law"]}
    p = P.paradigm(config | made)
    assert p.chain == ("def", "law") and p.roots == ("def",) and not p.cyclic
    assert P.checked({})[0][0] == "paradigm_id is missing" and P.checked(config, frozenset({"mine"}))[0]
    for change in ({"types": {"A": "x", "law": ""}}, {"relations": {"has": "x"}}, {"relation_map": {"zzz": {}}}, {"relation_map": {"def": {"HAS": "law"}}}, {"relation_map": {"def": {"HAS": ["law"]}, "law": {"HAS": ["def"]}}}):
        assert P.checked(config | change)[0] and not P.checked(config | change)[1]
    with pytest.raises(ValueError):
        P.paradigm({"types": {"a": "A"}})


def test_paradigms_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("mine:\n  name: n\n  types: {def: D, law: L}\n  relation_map: {def: {HAS: [law]}}\n")
    assert P.transitions(P.read_paradigms(str(tmp_path / "p.yaml"))["mine"]) == {("def", "law"): "HAS"}


def test_side_files(spark, tmp_path):
    c = spark.createDataFrame([("c1", 'n "q", x', "law", "two\nlines", None, ["a", "b,c"], None)], "canonical_id string, name string, concept_type string, description string, parent_hint string, aliases array<string>, source_chunks array<string>")
    R.write_concepts(c, str(tmp_path / "c"))
    got = R.read_concepts(spark, str(tmp_path / "c")).first()
    assert (got.name, got.description, got.parent_hint, got.aliases, got.source_chunks) == ('n "q", x', "two\nlines", None, ["a", "b,c"], [])
    (tmp_path / "m.json").write_text('{"a": "1",\n "b": 2}')
    assert {tuple(r) for r in R.read_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}
    (tmp_path / "a.json").write_text('{"questions": ["q1", "q2"],\n "answers": ["x"]}')
    assert [tuple(r) for r in R.read_answers(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(0, "q1", "x"), (1, "q2", "")]
    d = spark.createDataFrame([("c1", "new", 5), ("c1", None, 7)], "canonical_id string, name string, extra int")
    x = R.overlaid(c, d, "canonical_id").first()
    assert x.name == "new" and x.extra == 7 and x.concept_type == "law"


def test_academic_works(spark):
    works = [
        {"id": "W1", "doi": "https://doi.org/10.1/AB", "title": " T ", "publication_year": 2020, "is_retracted": False, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "N"}}], "primary_location": {"landing_page_url": "https://x.org"}},
        {"id": "W2", "title": "gone", "is_retracted": True},
        {"id": "W3", "title": ""},
    ]
    raw = spark.createDataFrame([(json.dumps(w),) for w in works] + [("no json",), (None,)], "json string")
    got = R.academic_works(raw).collect()
    assert len(got) == 1 and got[0].abstract == "a b a" and got[0].doi == "10.1/ab" and got[0].authors == ["N"] and got[0].url == "https://x.org"
    assert R.evidence_chunks(R.academic_works(raw)).first().text == "T\n\na b a"
    rows = spark.createDataFrame([(1, False, "high", 0.9), (2, True, "low", 0.1), (3, True, "high", 0.5), (4, True, "high", 0.7)], "i int, e boolean, l string, s double")
    assert [r.i for r in rows.orderBy(*R.academic_order(F.col("e"), F.col("l"), F.col("s"))).collect()] == [4, 3, 2, 1]
