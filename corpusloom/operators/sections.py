"""More document operators: pages and their children, second-level sections, outlines, anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.documents import fixed_windows, header_sections, merged_sections

# Fixed value: the mark that stands before each page of a merged document.
PAGE = "<!--PAGE:{}-->"
_PAGE = re.compile(r"<!--PAGE:(\d+)-->")


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


def parent_child(name: str, pages: list[tuple[int, str]], most: int = 1000, least: int = 50) -> tuple[list[tuple], list[tuple]]:
    """Parents (id, page, text, number of children) and children (id, kind, path, pages, parents, text).

    The pages are cut as one text, so a paragraph that runs over a page's end is one child of
    both. A child without a page mark in it counts to page 1. Blank pages have no parent.
    """
    pages = [(n, x) for n, x in pages if x and x.strip()]
    whole = "".join(f"\n\n{PAGE.format(n)}\n\n{x}" for n, x in pages)
    kids = []
    for i, (kind, path, text) in enumerate(merged_sections(whole, most, least)):
        own = sorted({int(n) for n in _PAGE.findall(text)}) or [1]
        clean = re.sub(r"\n*<!--PAGE:\d+-->\n*", "\n\n", text).strip()
        kids.append((f"child_{_digest(f'{name}_{i}')}", kind, path, own, clean))
    first: dict[int, str] = {}
    for n, x in pages:
        first.setdefault(n, x)
    at = {n: f"parent_{_digest(f'{name}_page_{n}')}" for n in sorted(first)}
    parents = [(at[n], n, first[n].strip(), sum(n in k[3] for k in kids)) for n in at]
    return parents, [(*k[:4], [at[n] for n in k[3] if n in at], k[4]) for k in kids]


def page_children(name: str, text: str) -> Iterator[tuple[str, str, str, str, str]]:
    """(parent id, child id, kind, heading path, text) of a page by itself."""
    parents, kids = parent_child(name, [(1, text)])
    for k in kids:
        yield parents[0][0], k[0], k[1], k[2], k[5]


def parent_child_documents(pages: DataFrame, name: str = "document_name", page: str = "page_number", text: str = "text") -> DataFrame:
    """Parents and children of whole documents: (name, id, kind, pages, parents, text).

    Sections run over pages, so a document is one group: its pages meet in one task, in page
    order (then by text). Documents without a name, null pages and null texts are left out;
    pages delivered twice count once.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[name].iloc[0]
        rows = pdf.sort_values([page, text], kind="stable")
        parents, kids = parent_child(own, [(int(n), x) for n, x in zip(rows[page], rows[text])])
        out = [(own, i, "parent_page", [n], [], x) for i, n, x, _ in parents] + [(own, i, k, p, up, x) for i, k, _, p, up, x in kids]
        return pd.DataFrame(out, columns=[name, "id", "kind", "pages", "parents", "text"])

    x = pages.where(f"{name} is not null and {page} is not null and {text} is not null").select(name, F.col(page).cast("bigint").alias(page), text).distinct()
    return x.groupBy(name).applyInPandas(cut, f"{name} string, id string, kind string, pages array<bigint>, parents array<string>, text string")


def document_sections(text: str, most: int = 3000, least: int = 100, overlap: int = 200) -> Iterator[tuple[str, int, str, str]]:
    """(way, level, title, content): sections at headings; windows where there are too few."""
    found = list(header_sections(text, most, least))
    if found and not (len(text) > 1000 and len(found) < 2):
        for level, title, content in found:
            yield "header", level, title, content
    else:
        for _, _, piece in fixed_windows(text, most, overlap, least):
            yield "window", 0, "", piece


def second_level(source: str, text: str) -> Iterator[tuple[str, str, str, int, int, str]]:
    """(id, type, heading, formulas, table lines, content): cut at lines that begin with ##.

    What stands before the first is a section named 前言. A section's type is image,
    text_image, text_formula, text_table or text, the first that fits.
    """
    parts = re.split(r"^(#{2}\s+.*?)$", text, flags=re.MULTILINE)
    found = [("前言", parts[0])] if parts[0].strip() else []
    found += [(parts[i].strip(), parts[i + 1].strip()) for i in range(1, len(parts), 2)]
    for i, (heading, content) in enumerate(found):
        images = re.findall(r"!\[[^\]]*\]\([^)]+\)", content)
        left = re.sub(r"!\[[^\]]*\]\([^)]+\)", "", content).strip()
        formulas = len(re.findall(r"\$\$.*?\$\$", content, re.DOTALL)) + len(re.findall(r"(?<!\$)\$(?!\$)[^$]+\$(?!\$)", content))
        lines = sum(x.strip().startswith("|") for x in content.split("\n"))
        kind = "image" if images and not left else "text_image" if images else "text_formula" if formulas else "text_table" if lines >= 2 else "text"
        path = heading.lstrip("#").strip() if heading.startswith("#") else ""
        yield f"md_{source}_{i}_{hashlib.md5(heading.encode()).hexdigest()[:6]}", kind, path, formulas, lines, content or heading


def heading_spans(text: Column) -> Column:
    """Structs (line, level, title, end) of a text's headings, outside of code fences.

    ``end`` is the line of the next heading that isn't deeper, or the number of lines.
    """
    lines = F.split(text, "\n", -1)
    # a line is inside a fence if an odd number of fence lines stands before it
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, r"^(#{1,6})\s+.+$", 1)
        hit = (mark != "") & ~s["open"]
        one = F.array(F.struct(s["n"].alias("line"), F.length(mark).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("title")))
        return F.struct((s["n"] + 1).alias("n"), F.when(x.startswith("```"), ~s["open"]).otherwise(s["open"]).alias("open"), F.when(hit, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    heads = F.aggregate(lines, start, step, lambda s: s["out"])
    after = lambda h: F.array_min(F.transform(F.filter(heads, lambda o: (o["line"] > h["line"]) & (o["level"] <= h["level"])), lambda o: o["line"]))
    return F.transform(heads, lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), F.coalesce(after(h), F.size(lines)).alias("end")))


def outline_paths(rows: DataFrame, part: str, order: str, level: str, title: str) -> DataFrame:
    """(part, order, path) of the entries of an outline: titles from the top, joined by " > ".

    An entry of level k closes all entries from the k-th place on, as a stack does. The
    entries of one outline are one array.
    """
    held = rows.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).cast("int").alias("l"), F.col(title).alias("t")))).alias("e"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        stack = F.concat(F.slice(s["stack"], F.lit(1), F.greatest(x["l"] - 1, F.lit(0))), F.array(x["t"]))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.array_join(stack, " > "))).alias("out"))

    paths = F.aggregate("e", start, step, lambda s: s["out"])
    return held.select(part, F.explode(F.arrays_zip(F.transform("e", lambda x: x["o"]).alias("o"), paths.alias("p"))).alias("z")).select(part, F.col("z.o").alias(order), F.col("z.p").alias("path"))


def page_headings(spans: DataFrame, part: str, page: str, size: str, bold: str, text: str) -> DataFrame:
    """(part, page, heading): the span of each page with the largest type, five points more if bold.

    Blank spans and spans of more than 100 characters are no headings; ties go to the smaller text.
    """
    s = spans.where(f"trim({text}) <> '' and length({text}) <= 100")
    score = F.col(size) + F.when(F.col(bold), 5).otherwise(0)
    return s.groupBy(part, page).agg(F.min_by(F.trim(text), F.struct(-score, F.trim(text))).alias("heading"))


def anchor(text: str, formula: bool, index: int, count: int, chunks: list[tuple[str, str, str]]) -> str | None:
    """The id of the chunk that owns an image without a reference.

    ``chunks`` are (id, kind, text) of headings and paragraphs in order. A formula goes where
    its text fits best (ratio 0.25 at least; 0.95 if one holds the other); otherwise, as for
    any image, the place in the file decides among the headings (or all chunks).
    """
    plain = lambda s: re.sub(r"[\s$\\{}]+", "", s or "").lower()
    if not chunks:
        return None
    if formula and (needle := plain(text)):
        best, most = None, 0.0
        for own, _, x in chunks:
            hay = plain(x)
            if not hay:
                continue
            r = SequenceMatcher(None, needle, hay, autojunk=False).ratio()
            r = max(r, 0.95) if needle in hay or hay in needle else r
            if r > most:
                best, most = own, r
        if most >= 0.25:
            return best
    ordered = [c for c in chunks if c[1] == "heading"] or chunks
    return ordered[min(len(ordered) - 1, index * len(ordered) // max(count, 1))][0]
