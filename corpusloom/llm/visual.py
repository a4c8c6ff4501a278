"""Visually identical text with different characters: one consistent form.

The work is done by DuckDB inside Arrow partitions: each batch is a DuckDB relation, and
one embedded SQL expression maps it (regexp_replace drops what is invisible and expands
ligatures, translate maps compatibility forms and look-alike letters, nfc_normalize composes
accents). Tables come from Unicode data by rule; only letters drawn alike, which Unicode's
decompositions don't know, are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.pairs import pairs_within
from corpusloom.plans.lineage import cut

# Letters of other scripts drawn like a Latin letter, with that letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters of the phonetic alphabet
    "ɑ": "a", "ɡ": "g",
}
# Hyphens that look like the ordinary one.
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
# White space besides Unicode's separators.
BLANKS = "\t\n\r\x0b\x0c\x85\u2028\u2029"
# Ranges of ideographs encoded a second time (radicals and compatibility ideographs).
IDEOGRAPHS = ((0x2E80, 0x2FD5), (0xF900, 0xFAFF), (0x2F800, 0x2FA1D))
# Invisible code points that are not of the format category.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


@lru_cache(1)
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for translate, and ligatures with their letters."""
    one: dict[str, str] = dict.fromkeys(HYPHENS, "-") | dict.fromkeys(BLANKS, " ")
    many: dict[str, str] = {}
    for o in (*range(0xA0, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA1E)):
        ch = chr(o)
        if ch in one:
            continue
        kind, _, _ = unicodedata.decomposition(ch).rpartition("> ")
        if unicodedata.category(ch) == "Zs":
            one[ch] = " "
        elif kind in ("<wide", "<narrow") or any(a <= o <= b for a, b in IDEOGRAPHS):
            to = unicodedata.normalize("NFKC", ch)
            if to != ch and len(to) == 1:
                one[ch] = one.get(to, to)
        elif kind == "<font" and 0x1D400 <= o < 0x1D800:  # letters and digits of formulas
            to = unicodedata.normalize("NFKC", ch)
            if len(to) == 1:
                one[ch] = LOOKALIKES.get(to, to)
        elif kind == "<compat" and (unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl"):
            to = unicodedata.normalize("NFKC", ch)
            if len(to) > 1 and to.isalpha():
                many[ch] = to
            elif len(to) == 1 and to.isalpha() and unicodedata.name(ch, "").startswith(("LATIN", "ROMAN")):
                one[ch] = to  # the long s differs from s in looks and is dropped below
    one.pop("ſ", None)
    one |= LOOKALIKES
    for o in range(0x370, 0x530):  # accented look-alikes, by their base letter
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and d[0] in LOOKALIKES and len(to := unicodedata.normalize("NFC", LOOKALIKES[d[0]] + d[1:])) == 1:
            one[chr(o)] = to
    return "".join(one), "".join(one.values()), many


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    a, b, many = tables()
    gone = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}" + "".join(rf"\x{{{o:X}}}" for o in INVISIBLE) + "]"
    e = f"regexp_replace(t, '{gone}', '', 'g')"
    for lig, letters in many.items():
        e = f"replace({e}, '{lig}', '{q(letters)}')"
    # texts of plain letters and ordinary ideographs, the most, have nothing to map
    plain = r"[ -~À-ÖØ-öø-ÿ\x{4E00}-\x{9FFF}]*"
    return f"select trim(case when regexp_full_match(t, '{plain}') then t else nfc_normalize(translate({e}, '{q(a)}', '{q(b)}')) end) as form from batch"


def canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append ``form`` to batches whose last column is the text."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
    sql = _sql()
    for b in batches:
        if b.num_rows:
            con.register("batch", pa.table({"t": b.column(b.num_columns - 1)}))
            got = con.sql(sql).to_arrow_table().column("form").combine_chunks()
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*b.columns, got.cast(pa.string())], names=[*b.schema.names, "form"])


def clear_of(df: DataFrame, new: list[str]) -> DataFrame:
    """``df`` with columns of the names in ``new`` renamed: in_ before them, again if taken."""
    for name in new:
        if name in df.columns:
            free = f"in_{name}"
            while free in df.columns:
                free = f"in_{free}"
            df = df.withColumnRenamed(name, free)
    return df


def canonical_text(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column ``form``: ``text`` in its one consistent form.

    Null stays null; a text of invisible characters and spaces becomes empty. Full-width and
    ordinary forms, ligatures, compatibility ideographs, kinds of spaces and hyphens, and
    look-alike letters fall together; case, accents, raised or circled digits, and the
    difference of hyphen and space stay. A column ``form`` of the input becomes ``in_form``.
    """
    df = clear_of(df, ["form"])
    rest = [c for c in df.columns if c != text]
    moved = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    schema = T.StructType([*moved.schema.fields, T.StructField("form", T.StringType())])
    return moved.mapInArrow(canonical_batches, schema)


def concept_texts(concepts: DataFrame) -> DataFrame:
    """(canonical_id, text): names and aliases, one row each, without nulls."""
    texts = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return concepts.where("canonical_id is not null").select("canonical_id", texts.alias("text")).where("text is not null").distinct()


def _forms(concepts: DataFrame) -> DataFrame:
    """Distinct (canonical_id, form) of texts that aren't empty."""
    return canonical_text(concept_texts(concepts), "text").where("form <> ''").select("canonical_id", "form").distinct()


def same_looks(concepts: DataFrame) -> DataFrame:
    """Pairs of concepts (canonical_id_a < canonical_id_b) one text of which looks the same.

    Null and empty texts, also those of invisible characters only, look like nothing. A form
    that many concepts share is worked through in blocks (``pairs``).
    """
    forms = cut(_forms(concepts))
    # a form that one concept has only can't make a pair
    shared = forms.groupBy("form").agg(F.min("canonical_id").alias("lo"), F.max("canonical_id").alias("hi")).where("lo < hi").select(F.col("form").alias("f"))
    held = forms.join(shared, F.col("form") == F.col("f"), "left_semi")
    return pairs_within(held, "form", "canonical_id").select(F.col("x").alias("canonical_id_a"), F.col("y").alias("canonical_id_b")).distinct()


def look_classes(concepts: DataFrame) -> DataFrame:
    """(canonical_id, form, class_id, n_alike): one row for each concept and form, no pairs.

    ``class_id`` is the smallest id of the concepts with a text of that form, ``n_alike`` the
    number of the others. See ``same_looks`` for nulls.
    """
    forms = cut(_forms(concepts))
    of = forms.groupBy("form").agg(F.min("canonical_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_alike"))
    return forms.join(of, "form").select("canonical_id", "form", "class_id", "n_alike")
