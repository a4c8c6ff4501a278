import random

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import concepts as C
from corpusloom.operators import gaps as GP
from corpusloom.operators import linker as K


def test_contained_equals_brute_force(spark):
    r = random.Random(3)
    made = lambda n: "".join(r.choice("abc") for _ in range(n))
    short = [(i, made(r.randrange(1, 7))) for i in range(60)] + [(90, ""), (91, None)]
    long = [(i, made(r.randrange(1, 14))) for i in range(60)] + [(90, ""), (91, None)]
    got = {tuple(x) for x in C.contained(spark.createDataFrame(short, "s_id int, s string"), spark.createDataFrame(long, "l_id int, l string")).collect()}
    assert got == {(i, j) for i, s in short for j, x in long if s and x and s in x}


def test_resolve_by_strategy(spark):
    c = [("c1", "RAG", ["retrieval"]), ("c2", "vector index", None), ("c3", "Graph Store", []), ("c4", "agents", ["tool users"]), ("a__virtual_1", "RAG", None), ("c5", None, None), ("c1", "RAG", None)]
    df = spark.createDataFrame([(*x, "q") for x in c], "canonical_id string, name string, aliases array<string>, query string")
    q = spark.createDataFrame([(x,) for x in ("RAG", "RAG 技术", "VECTOR INDEX", "big graph", "tool users", "nothing", " ", None)], "query string")
    like = spark.createDataFrame([("nothing", "c2", 0.61), ("nothing", "c1", 0.6)], "query string, canonical_id string, score double")
    got = {r.query: (r.canonical_id, r.strategy) for r in C.resolve(q, df, like).collect()}
    assert got == {"RAG": ("c1", 1), "RAG 技术": ("c1", 2), "VECTOR INDEX": ("c2", 3), "big graph": ("c3", 4), "tool users": ("c4", 5), "nothing": ("c2", 6)}
    assert C.resolve(q, df.limit(0)).count() == 0


def test_trim_and_assemble(spark):
    nodes = spark.createDataFrame([("s", x, x) for x in ("s", "a", "b", "c", "d")], "seed string, node string, name string")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.9)], "node string, score double")
    got = [(r.node, r.rank) for r in C.trimmed(nodes, scores, 4).orderBy("rank").collect()]
    assert got == [("s", 1), ("b", 2), ("c", 3), ("a", 4)]
    about = spark.createDataFrame([("s", "S", "law", "x" * 90), ("b", "B", None, None), ("c", "", "law", "")], "node string, name string, concept_type string, description string")
    out = C.assembled(C.trimmed(nodes, scores, 4), about).first()
    assert out.text == f"1. **S** (law) - {'x' * 80}...\n2. **B** () - "


def test_alike_equals_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"k{i:02}", " ".join(r.choice(words) for _ in range(r.randrange(0, 7)))) for i in range(80)] + [("n", None), ("e", "")]
    v = K.word_vectors(spark.createDataFrame(rows, "k string, t string"), "k", F.col("t"))
    held = {}
    for x in v.collect():
        held.setdefault(x.k, {})[x.slot] = x.w
    for least in (0.72, 0.5, 0.95):
        want = {(a, b) for a in held for b in held if a < b and round(sum(w * held[b].get(s, 0) for s, w in held[a].items()), 6) >= least}
        assert {(x.a, x.b) for x in K.alike(v, "k", least).collect()} == want


def test_semantic_layers(spark):
    k = [("h1", "d", "heading", "5.4 Hybrid Search (RRF)"), ("h2", "d", "heading", "5.4 Hybrid Search (RRF) > Scores"), ("p1", "d", "paragraph", "5.4 Hybrid Search (RRF)"), ("p2", "d", "paragraph", "5.4 Hybrid Search (RRF) > Scores"), ("p3", "d", "paragraph", None), ("h3", "d", "heading", "Alone"), ("p4", "d", "paragraph", "Alone")]
    c = [("rrf", "RRF", ["p1"]), ("bm", "BM25", ["p2"]), ("sc", "score", ["p2", "p3"]), ("x", "inner", ["p4"]), ("y", "self", ["h3"]), ("z", None, None)]
    got = {(r.src, r.dst) for r in K.semantic_layers(spark.createDataFrame(k, "chunk_id string, document_name string, chunk_type string, heading_path string"), spark.createDataFrame(c, "canonical_id string, name string, source_chunks array<string>")).collect()}
    assert got == {("rrf", "bm"), ("rrf", "sc"), ("sc", "bm"), ("y", "x")}


def test_placeholders_and_writes(spark):
    e = [("a", "v__virtual_1", "R", 0.9), ("v__virtual_1", "b", "S", 0.4), ("b", "w__virtual_2", "R", None), ("a", "b", "R", 0.5)]
    df = spark.createDataFrame(e, "src string, dst string, rel string, confidence double")
    assert {r.src for r in K.without_orphans(df).collect()} == {"a", "v__virtual_1"}
    assert {(r.node, r.n_in, r.n_out) for r in K.placeholders(df).collect()} == {("v__virtual_1", 1, 1), ("w__virtual_2", 1, 0)}
    new = spark.createDataFrame([("b", "a", "R", 0.9), ("a", "c", "R", 0.9), ("c", "c", "R", 1.0), ("", "c", "R", 1.0), ("a", "b", "R", 0.99), ("c", "b", "T", 0.7), ("b", "c", "T", 0.6)], df.schema)
    got = {(r.src, r.dst, r.rel, r.confidence) for r in K.write_edges(df.where("src = 'a' and dst = 'b'"), new).collect()}
    assert got == {("a", "b", "R", 0.5), ("a", "c", "R", 0.9), ("c", "b", "T", 0.7)}


def test_gap_life_cycle(spark):
    s = spark.createDataFrame([("g1", "open", 1), ("g2", "obsolete", 3), ("g3", "ignored", 2), ("g4", "open", 5)], "gap_id string, status string, version bigint")
    new = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g9",), ("g9",), (None,)], "gap_id string")
    assert {tuple(r) for r in GP.imported(s, new).collect()} == {("g1", "open", 2, "refreshed"), ("g2", "open", 4, "reopened"), ("g3", "ignored", 3, "refreshed"), ("g4", "open", 5, "kept"), ("g9", "open", 1, "created")}
    w = spark.createDataFrame([("g1", "open", "ignored", 1), ("g3", "ignored", "open", 1), ("g4", "ignored", "open", 5), ("zz", "open", "ignored", 1)], "gap_id string, old string, new string, expected bigint")
    assert {tuple(r) for r in GP.moved(s, w).collect()} == {("g1", "done", "ignored", 2), ("g3", "conflict", "ignored", 2), ("g4", "conflict", "open", 5), ("zz", "not_found", None, None)}
    e = spark.createDataFrame([("a", "d", "EXTENDS"), ("x", "y", "R")], "src string, dst string, rel string")
    fills = spark.createDataFrame([("a", "d", ["b"], ["P", "Q"]), ("x", "y", [""], ["P", "Q"]), ("x", "y", ["m"], ["P"])], "src string, dst string, nodes array<string>, replacement array<string>")
    assert {tuple(r) for r in GP.supplemented(e, fills).collect()} == {("a", "b", "P"), ("b", "d", "Q"), ("x", "y", "R")}
    assert {r.status: r.n for r in GP.by_status(s).collect()} == {"open": 2, "ignored": 1, "supplemented": 0, "obsolete": 1}


def test_migration(spark):
    e = [("a", "p__v", "R1", 0.9), ("p__v", "b", "R2", None), ("a", "q__v", "R", 0.8), ("q__v", "b", "R", 0.7), ("q__v", "c", "R", 0.7), ("a", "m", "R", 1.0), ("m", "b", "R", 1.0), ("c", "r__v", "R", 0.6), ("r__v", "d", "R", 0.9)]
    edges = spark.createDataFrame(e, "src string, dst string, rel string, confidence double")
    types = spark.createDataFrame([("m", "law")], "node string, type string")
    kind = F.when(F.col("node").startswith("p"), "law").otherwise("definition")
    got = {r.node: (r.src, r.dst, r.missing, r.replacement, r.confidence, r.outcome) for r in GP.migrated(edges, types, "__v", kind, GP.THEORY).collect()}
    assert got["p__v"] == ("a", "b", "law", "R1,R2", 0.5, "natural") and got["q__v"] == (None,) * 5 + ("skipped",)
    assert got["r__v"] == ("c", "d", "definition", "R,R", 0.6, "gap")


def test_requests_and_marks(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c.alias("x")).first().x
    t = F.col("t")
    for v, n in (("出3道题", 3), ("给我出5题", 5), ("出3-5道题", 5), ("出99道题", None), ("give me 4 questions", 4), ("出几道题", None)):
        assert one(T.asked_count(t), v) == n
    assert one(T.asked_topic(t), "Give me 3 questions on graph search") == "graph search"
    assert one(T.asked_topic(t), "evaluate my SQL level") == "sql" and one(T.asked_topic(t), "plain") == "plain"
    assert one(T.at_mentions(t), "@Tutor and @quiz, @tutor @nobody") == ["tutor", "quiz"] and one(T.without_mentions(t), "@tutor  explain @quiz") == "explain"
    assert one(T.is_vague(t), "整体优化") and not one(T.is_vague(t), "向量检索优化方法")
    assert one(T.dialog_tokens(t), "两字 two words.") == 2 + 1 + 1 and one(T.dialog_tokens(t), "") == 0
    counts = T.markup_counts(t)
    text = "![a](b) $x$ and $$y\nz$$ \\(q\\)\n| a | b |\n  | c |\n"
    assert [one(c, text) for c in counts.values()] == [1, 1, 2, 2]


def test_contained_moves_what_is_found_only(spark, monkeypatch):
    from corpusloom.operators import substrings as S

    long = spark.createDataFrame([(i, f"{i:04}" + "abcdefgh" * 200 + ("needle" if i % 50 == 0 else "")) for i in range(100)], "l_id int, l string")
    short = spark.createDataFrame([(1, "needle"), (2, "nowhere"), (3, "0007abc"), (4, "𝒳"), (4, "")], "s_id int, s string")
    c = C.contained(short, long)
    assert {tuple(x) for x in c.collect()} == {(1, 0), (1, 50), (3, 7)}
    assert "Generate" not in c._jdf.queryExecution().executedPlan().toString()  # no table of grams
    monkeypatch.setattr(S, "HELD_KEYS", 2)
    monkeypatch.setattr(S, "SLICE", 3000)
    assert {tuple(x) for x in C.contained(short, long).collect()} == {(1, 0), (1, 50), (3, 7)}
    assert C.contained(short.limit(0), long).count() == 0 and C.contained(short, long.limit(0)).count() == 0


def test_resolve_makes_no_grams_of_names(spark):
    c = spark.createDataFrame([(f"c{i:03}", f"common thing {i}", None) for i in range(200)], "canonical_id string, name string, aliases array<string>")
    q = spark.createDataFrame([(f"common way{i}",) for i in range(50)], "query string")
    x = C.resolve(q, c)
    assert {tuple(r) for r in x.collect()} == {(f"common way{i}", "c000", 4) for i in range(50)}
    assert "sequence(" not in x._jdf.queryExecution().executedPlan().toString()
