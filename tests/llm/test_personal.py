import pytest

from corpusloom.llm import pii as P

ROSTER = [("Ilka Torvandt",), ("Surrin Yarnell-Voss",), ("瞿临川",), (None,), ("Ilka Torvandt",)]
CASES = [
    ("Write to ilka.t+x@Dept.Example.org. Soon", [("email", "ilka.t+x@Dept.Example.org")]),
    ("or ilka [at] uni [dot] example, or st1 AT lists DOT test; p@6 and recall@10. f(x)@w", [("email", "ilka [at] uni [dot] example"), ("email", "st1 AT lists DOT test")]),
    ("call +44 (0)1632 960 435, (311) 555-0166 ext. 4 or 01 99 00 74 84", [("phone", "+44 (0)1632 960 435"), ("phone", "(311) 555-0166"), ("phone", "01 99 00 74 84")]),
    ("请致电+15835550112确认，电话：（010）0550-0181；证件号：994373197202020085", [("phone", "+15835550112"), ("phone", "（010）0550-0181"), ("identity_number", "994373197202020085")]),
    ("ssn=948-40-8625; QQ 17 02 76 C; Steuer-ID 01 488 416 696; batch 640184465178, ISBN 000-0-7456-2001-2", [("identity_number", "948-40-8625"), ("identity_number", "QQ 17 02 76 C"), ("identity_number", "01 488 416 696")]),
    ("moved to 16 Old Copperstead Street. Or 77B Vesper Ave., Port X", [("street_address", "16 Old Copperstead Street"), ("street_address", "77B Vesper Ave.")]),
    ("an Am Alten Erlbachhof 81a, Port", [("street_address", "Am Alten Erlbachhof 81a")]),
    ("a Calle Olivo Hueco n.º 11, Dorn", [("street_address", "Calle Olivo Hueco n.º 11")]),
    ("刚搬到石桥湾街 59 号，资料", [("street_address", "石桥湾街 59 号")]),
    ("Thanks to Dr. Ilka K. Torvandt and Yarnell-Voss, Surrin; I. TORVANDT left", [("person_name", "Ilka K. Torvandt"), ("person_name", "Yarnell-Voss, Surrin"), ("person_name", "I. TORVANDT")]),
    ("昨天瞿临川在课上和Ilka Nobody的", [("person_name", "瞿临川"), ("person_name", "Ilka Nobody")]),
    ("See the Torvandt–Yarnell-Voss inequality. The Torvandt lemma holds. Lane 3 of the circuit", []),
    ("Please ask Zora Quill. Dear Mr. Odo Fenn, the letter to Uta Brandt came; Tutor: W. Ashby; signed by Ora van der Lind", [("person_name", "Zora Quill"), ("person_name", "Odo Fenn"), ("person_name", "Uta Brandt"), ("person_name", "W. Ashby"), ("person_name", "Ora van der Lind")]),
    ("Gestern zeigte van der Lind, Ora den Beweis, dann schrieb Frau Edda Krohn. Task 3; Ivo Marsh replied", [("person_name", "van der Lind, Ora"), ("person_name", "Edda Krohn"), ("person_name", "Ivo Marsh")]),
    ("Yesterday Linear Algebra Online was taught. Thanks to linear methods; group of Signals", []),
    ("姓名：瞿明在课上", [("person_name", "瞿明")]),
    ("pay DE89 3704 0044 0532 0130 00 or 4111 1111 1111 1111, not DE88 3704 0044 0532 0130 00 nor 4111 1111 1111 1112; mailto:a.b@c.org tel:+44 20 7946 0347", [("account_number", "DE89 3704 0044 0532 0130 00"), ("account_number", "4111 1111 1111 1111"), ("email", "a.b@c.org"), ("phone", "+44 20 7946 0347")]),
    ("证件994373197202020084 fails its check, and in a sentence this long 12345678901 has no cue near it, but Steuer-ID 03471010231 has a cue; 000-12-3456", [("identity_number", "03471010231")]),
    ("to " + "x" * 300 + "@" + "y" * 200 + ".org", [("email", "x" * 300 + "@" + "y" * 200 + ".org")]),
    ("", []),
    ("no one here " * 5000, []),
]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, (t, _) in enumerate(CASES)] + [(99, None, "k", 1)], "doc_id bigint, text string, kind string, start int")
    return docs, spark.createDataFrame(ROSTER, "display_name string")


def test_values(frames):
    docs, roster = frames
    got = {}
    for r in P.find_personal(docs, roster).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.kind, r.value))
        assert CASES[r.doc_id][0][r.start : r.end] == r.value
    for i, (_, want) in enumerate(CASES):
        assert [(k, v) for _, k, v in sorted(got.get(i, []))] == want, CASES[i][0][:60]


def test_redacted_text_keeps_the_rest(frames):
    docs, roster = frames
    out = {r.doc_id: r.text for r in P.redact(docs, roster).collect()}
    assert out[0] == "Write to [EMAIL]. Soon" and out[99] is None
    assert out[11] == CASES[11][0]
    assert P.redact(docs, roster).columns == docs.columns


def test_empty_tables(spark, frames):
    docs, roster = frames
    assert P.find_personal(docs.limit(0), roster).count() == 0
    assert {r.kind for r in P.find_personal(docs, roster.limit(0)).collect()} >= {"email", "phone", "street_address"}


def test_many_values_in_one_text_take_time_in_proportion():
    import time

    f = P.Finder(frozenset(), frozenset(), frozenset(), frozenset())
    took = []
    for n in (2000, 16_000):
        x = " ".join(f"u{i}@example.org" for i in range(n))
        t = time.perf_counter()
        assert len(f.find(x)) == n
        took.append(time.perf_counter() - t)
    assert took[1] < 24 * took[0]


def test_a_dictionary_in_shards_changes_nothing(frames):
    docs, roster = frames
    docs = docs.unionByName(docs.limit(4))
    key = lambda r: (str(r.doc_id), r.start, r.kind, r.value)
    whole = sorted(key(r) for r in P.find_personal(docs, roster).collect())
    assert sorted(key(r) for r in P.find_personal(docs, roster, most=1).collect()) == whole
    one, many = (sorted((str(r.doc_id), str(r.text)) for r in P.redact(docs, roster, most=n).collect()) for n in (P.MAX_PARTS, 1))
    assert one == many
