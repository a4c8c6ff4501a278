"""Document operators: texts to chunks, as table-generating steps over Arrow batches.

Each splitter is a generator over one text; ``generate`` runs it per row within a partition,
so documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where a fixed window ends, best first.
SEPARATORS = ("\n\n", "\n", "。", "．", ". ", "? ", "! ", "；", ";")
# Openings of a short paragraph that belongs to the one after it.
LEADS_ON = "此外 但是 然而 不过 另外 其次 接着 然后 最后 总之 因此 所以 于是 从而 另一方面 除此之外 不仅如此 更重要的是 but however therefore thus moreover furthermore".split()
_HASH = re.compile(r"(#{1,6})\s+(.+)")
_NUMBERED = re.compile(r"(?:\d+\.\s+|\d+\.\s*[\d.]+\s+|第[一二三四五六七八九十\d]+[章节篇]\s+|\([\d一二三四五六七八九十]+\)\s+|[一二三四五六七八九十]+[、．]\s*)(.+)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s")
_QUESTION = re.compile(r"\d{1,3}[.、．]\s*\S.{2,}")


def fixed_windows(text: str, size: int = 1500, overlap: int = 200, least: int = 100) -> Iterator[tuple[int, int, str]]:
    """(start, end, piece) of windows that end after the last separator of their second half.

    Pieces under ``least`` characters after trimming are left out.
    """
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for sep in SEPARATORS:
                at = text.rfind(sep, start + size // 2, end)
                if at >= 0:
                    end = at + len(sep)
                    break
        if len(piece := text[start:end].strip()) >= least:
            yield start, end, piece
        if end == len(text):
            return
        start = end - overlap


def _heading(line: str) -> tuple[int, str] | None:
    if m := _HASH.fullmatch(line):
        return len(m[1]), m[2].strip()
    if m := _NUMBERED.fullmatch(line):
        return 2, m[1].strip()
    return None


def page_sections(text: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, level, heading path, content): headings, code, lists, tables and paragraphs.

    A block runs while its lines look alike: fenced or indented code, list items with their
    indented continuations, lines with a bar, other lines up to a blank line, # or fence.
    """
    lines = text.split("\n")
    path: list[str] = []
    i = 0

    def run(ok: Callable[[str], bool]) -> list[str]:
        nonlocal i
        first = i
        i += 1
        while i < len(lines) and ok(lines[i]):
            i += 1
        return lines[first:i]

    open_ = lambda s: s.strip() and not s.startswith(("#", "```"))
    while i < len(lines):
        line = lines[i]
        if h := _heading(line):
            path = [*path[: h[0] - 1], h[1]]
            yield "heading", h[0], " > ".join(path), h[1]
            i += 1
        elif line.startswith("```"):
            body = run(lambda s: not s.startswith("```"))[1:]
            i += 1
            if "".join(body).strip():
                yield "code_block", 0, " > ".join(path), f"[{line[3:].strip()}]\n" + "\n".join(body)
        elif line.startswith("    "):
            body = run(lambda s: s.startswith("    "))[1:]
            if "".join(body).strip():
                yield "code_block", 0, " > ".join(path), "[indent]\n" + "\n".join(body)
        elif _ITEM.match(line):
            yield "list", 0, " > ".join(path), "\n".join(run(lambda s: open_(s) and (_ITEM.match(s) or s[:1].isspace())))
        elif "|" in line:
            yield "table", 0, " > ".join(path), "\n".join(run(lambda s: "|" in s))
        elif line.strip():
            yield "paragraph", 0, " > ".join(path), "\n".join(run(open_))
        else:
            i += 1


def merged_sections(text: str, most: int = 1000, least: int = 50) -> Iterator[tuple[str, str, str]]:
    """(kind, heading path, content): paragraphs in a row merged up to ``most`` characters.

    Code, lists and tables stay whole; merged text under ``least`` with its heading is dropped.
    """
    held: list[str] = []
    size, path = 0, ""

    def flush() -> Iterator[tuple[str, str, str]]:
        whole = "\n".join(held)
        if held and len(((f"[{path}]\n" if path else "") + whole).strip()) >= least:
            yield "paragraph_group", path, whole
        held.clear()

    for kind, _, at, content in page_sections(text):
        if kind != "paragraph" or (held and (at != path or size + len(content) > most)):
            yield from flush()
        if kind == "paragraph":
            size = size + len(content) + 1 if held else len(content)
            path = at
            held.append(content)
        elif kind != "heading":
            yield kind, at, content
    yield from flush()


def header_sections(text: str, most: int = 3000, least: int = 100) -> Iterator[tuple[int, str, str]]:
    """(level, title, content): cut at # and ##; ### stays in the text; front matter is dropped.

    A section that reaches ``most`` characters at a blank line is closed there.
    """
    if text.startswith("---") and text.count("---") >= 2:
        text = text.split("---", 2)[2]
    held: list[str] = []
    title, level = "", 0

    def flush() -> Iterator[tuple[int, str, str]]:
        body = "\n".join(held).strip()
        if len(body) >= least:
            yield level, title, body
        held.clear()

    for line in text.split("\n"):
        m = re.fullmatch(r"(#{1,3})\s+(.+)", line)
        if m and len(m[1]) <= 2:
            yield from flush()
            level, title = len(m[1]), m[2].strip()
            continue
        if (m or not line.strip()) and sum(map(len, held)) + len(held) >= most:
            yield from flush()
        held.append(m[2].strip() if m else line)
    yield from flush()


def short_merged(paragraphs: list[str], least: int = 50) -> list[str]:
    """Paragraphs under ``least`` characters joined to a neighbour.

    A finished sentence or a word that leads on goes to the next, a list item to the one
    before; otherwise the first goes on, the others back. Code is left alone.
    """
    code = lambda s: s.startswith("```")
    out: list[str] = []
    carry = ""
    for i, p in enumerate(paragraphs):
        p, carry = carry + p, ""
        last = i == len(paragraphs) - 1
        if len(p) >= least or code(p) or (out and code(out[-1])) or (not last and code(paragraphs[i + 1])):
            out.append(p)
            continue
        s = p.strip()
        on = bool(re.search(r"[。！？.!?]$", s)) or s[:10].startswith(tuple(LEADS_ON))
        on = on or (i == 0 and not _ITEM.match(p))
        if on and not last:
            carry = p + "\n"
        elif out:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def tree_chunks(text: str, source: str = "", least: int = 50, most: int = 4000) -> Iterator[tuple[str, str, int, str, str, str]]:
    """(chunk id, type, level, heading path, parent id, text) in pre-order.

    A document node, a node for each heading, and paragraphs under their deepest heading.
    Numbered questions become headings if there are two or more and no others. Short
    paragraphs are merged, long ones cut at sentence ends. Ids are
    md_{source}_{type}_{index}_{first six of the MD5 of the text's first 50 characters}.
    """
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    lines = text.split("\n")
    if not any(_HASH.fullmatch(x) for x in lines) and sum(bool(_QUESTION.fullmatch(x)) for x in lines) >= 2:
        lines = [f"## {x}" if _QUESTION.fullmatch(x) else x for x in lines]
    count = {"document": 0, "heading": 0, "paragraph": 0}

    def made(kind: str, hint: str) -> str:
        count[kind] += 1
        return f"md_{source}_{kind}_{count[kind] - 1}_{hashlib.md5(hint[:50].encode()).hexdigest()[:6]}"

    root = made("document", text)
    yield root, "document", 0, "", "", lines[0].strip() if lines else ""
    path: list[tuple[int, str, str]] = []
    held: list[str] = []
    fence = False

    def flush() -> Iterator[tuple[str, str, int, str, str, str]]:
        blocks, now = [], []
        for x in held:
            if x.strip() or fence:
                now.append(x)
            elif now:
                blocks.append("\n".join(now))
                now = []
        if now:
            blocks.append("\n".join(now))
        held.clear()
        for p in short_merged(blocks, least):
            parts = [p]
            if len(p) > most:
                parts, room = [], ""
                for s in re.split(r"(?<=[。！？.!?])", p):
                    if room and len(room) + len(s) > most:
                        parts.append(room)
                        room = ""
                    room += s
                parts += [room] if room else []
            for s in parts:
                yield made("paragraph", s), "paragraph", path[-1][0] if path else 0, " > ".join(t for _, t, _ in path), path[-1][2] if path else root, s

    for x in lines:
        if x.startswith("```"):
            fence = not fence
        m = None if fence else _HASH.fullmatch(x)
        if not m:
            held.append(x)
            continue
        yield from flush()
        level, title = len(m[1]), m[2].strip()
        while path and path[-1][0] >= level:
            path.pop()
        parent = path[-1][2] if path else root
        me = made("heading", title)
        path.append((level, title, me))
        yield me, "heading", level, " > ".join(t for _, t, _ in path), parent, title
    yield from flush()


def generate(df: DataFrame, key: str, text: str, split: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (key, position, *schema) of a splitter over each text.

    Null and empty texts give no row; repeated rows repeat; other columns are ignored.
    """
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    out = T.StructType([rows.schema[key], T.StructField("pos", T.IntegerType()), *T._parse_datatype_string(schema).fields])
    arrow = [pa.int32(), *[{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in out.fields[2:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for pos, row in enumerate(split(x) if x else ()):
                    at.append(i)
                    made.append((pos, *row))
            if made:
                cols = [pa.array(c, t) for c, t in zip(zip(*made), arrow)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cols], names=out.names)

    return rows.mapInArrow(run, out)
