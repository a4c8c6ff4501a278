from corpusloom.operators import documents as D

MD = "# Top\nintro text\n\n## Part\nfirst block of text here\n\n```py\nx = 1\n```\n- one\n- two\n  more\n| a | b |\n| 1 | 2 |\n### Deep\nlast"


def test_sections():
    got = [(k, p) for k, _, p, _ in D.page_sections(MD)]
    assert got == [("heading", "Top"), ("paragraph", "Top"), ("heading", "Top > Part"), ("paragraph", "Top > Part"), ("code_block", "Top > Part"), ("list", "Top > Part"), ("table", "Top > Part"), ("heading", "Top > Part > Deep"), ("paragraph", "Top > Part > Deep")]
    assert next(D.page_sections("3. Numbered title"))[:2] == ("heading", 2)


def test_merged_sections_keep_atoms_whole():
    text = "# H\n" + "\n\n".join("p" * 300 for _ in range(5)) + "\n```\n" + "c" * 2000 + "\n```\ntiny"
    got = list(D.merged_sections(text))
    assert [k for k, *_ in got] == ["paragraph_group", "paragraph_group", "code_block"]
    assert all(len(c) <= 1000 + 3 for k, _, c in got if k == "paragraph_group")


def test_fixed_windows_overlap_and_end_at_separators():
    text = ("One sentence here. " * 400).strip()
    got = list(D.fixed_windows(text))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, e, _), (s, _, _) in zip(got, got[1:]):
        assert e - s == 200
    assert all(len(p) <= 1500 for *_, p in got) and list(D.fixed_windows("short")) == []


def test_headers_and_front_matter():
    body = "word " * 40
    got = list(D.header_sections(f"---\na: 1\n---\n# A\n{body}\n## B\n### c\n{body}"))
    assert [(lv, t) for lv, t, _ in got] == [(1, "A"), (2, "B")] and got[1][2].startswith("c\n")


def test_tree():
    got = list(D.tree_chunks(MD, "s", least=1))
    kinds = [k for _, k, *_ in got]
    assert kinds[0] == "document" and kinds.count("heading") == 3
    ids = {c for c, *_ in got}
    assert len(ids) == len(got) and all(p in ids for *_, p, _ in got[1:])
    promoted = [t for _, k, *_, t in D.tree_chunks("1. First question text\nbody\n2. Second question text\nbody") if k == "heading"]
    assert promoted == ["1. First question text", "2. Second question text"]


def test_short_paragraphs():
    long = "x" * 60
    assert D.short_merged(["done.", long]) == ["done.\n" + long]
    assert D.short_merged([long, "- item"]) == [long + "\n- item"]
    assert D.short_merged([long, "```\ncode\n```", "s"]) == [long, "```\ncode\n```", "s"]
    assert D.short_merged([]) == []


def test_generated_rows(spark):
    df = spark.createDataFrame([(1, "a. " * 2000, "p"), (2, None, "p"), (3, "", "p"), (1, "a. " * 2000, "p")], "id int, text string, pos string")
    got = D.generate(df, "id", "text", D.fixed_windows, "start bigint, end bigint, piece string").collect()
    assert {r.id for r in got} == {1} and len(got) % 2 == 0
    assert D.generate(df.limit(0), "id", "text", D.fixed_windows, "start bigint, end bigint, piece string").count() == 0
