"""Noise in text from scanned pages: furniture, broken words, misread words.

Pages are sorted by document and page with one range partitioning and numbered along it, so a
book of any length is never held as a group. Blocks of ``BLOCK`` pages in a row, with the
``AROUND`` pages before and after them whole, are then spread over the tasks; every page is
judged with the same pages around it, whatever the partitions.

* *Furniture.* A line at a page's edge is judged together with the lines at the same place
  of the pages around it by a boosted line-pair classifier, from the edge inwards until one
  is body text.
* *Joins.* A second line-pair classifier tells whether a word goes on in the next body line.
* *Misread words.* Distinct unknown words meet the word list in an inverted join on their
  rarest character q-grams; a boosted ranking over edit and shape features picks the
  replacement.

All three classifiers are trained here, on pages and misreadings generated from the word
list (``TRAIN_PAGES`` pages and ``TRAIN_WORDS`` words, fixed seeds), so no labels are needed.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.boosting import Booster
from corpusloom.plans.lineage import cut

#: Bounds of the generated training data.
TRAIN_PAGES, TRAIN_WORDS = 900, 6000
#: Words a list may have to be held by every worker; of a longer one each page gets its own.
MAX_WORDS = 2_000_000
#: Pages of a block, and pages it sees before and after it.
BLOCK, AROUND = 64, 4
Q = 2
# Marks that a word broken at the end of a line carries.
HYPHENS = "-¬\xad‐‑"
# Letters that scanners take for others, with what they are read as.
MISREADINGS = {
    "d": ("cl",), "m": ("rn", "in"), "w": ("vv",), "h": ("b", "li"), "n": ("ri",), "u": ("ii",), "e": ("c",), "l": ("1", "i"), "i": ("l", "1"),
    "s": ("5",), "o": ("0",), "g": ("9", "q"), "b": ("6", "h"), "t": ("f",), "c": ("e",), "a": ("o",), "z": ("2",), "q": ("g",), "rn": ("m",), "in": ("m",), "ri": ("n",), "li": ("h",), "cl": ("d",), "ii": ("u",), "vv": ("w",), "f": ("t",),
    "ti": ("ü",), "ü": ("ii", "u"), "ä": ("a",), "ö": ("6", "o"), "ß": ("b",), "é": ("e",), "ï": ("i",), "ë": ("e",), "ç": ("c",), "nn": ("rm",), "ni": ("m",), "y": ("v",), "v": ("y",), "r": ("n",), "k": ("lc",),
}
# Words that stand with a page's number.
PAGE_WORDS = ("page", "pages", "seite", "blatt", "folio", "página", "p", "pg", "pag", "s")
TOTAL_WORDS = ("of", "von", "de", "aus")
EDGE = 3  # lines at each edge that are judged at once


# --- lines ---------------------------------------------------------------------------


def bare_word(token: str) -> str:
    """Lower case without punctuation around it."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", token).lower()


def roman(s: str) -> int:
    """The value of a well-formed roman numeral, else 0."""
    if not re.fullmatch(r"(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", s):
        return 0
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [v[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def _number(s: str) -> int:
    s = s.lower()
    if re.fullmatch(r"\d{1,5}", s):
        return int(s)
    read = s.translate(str.maketrans("loisgb", "101596"))
    return int(read) if re.search(r"\d", s) and re.fullmatch(r"\d{1,4}", read) else roman(s)


def page_number_of(line: str) -> int:
    """The number of a line that holds nothing but it (with a page word, marks, a total), else 0."""
    words = [w for w in re.split(r"[^\w]+|_", line.lower()) if w]
    if not 0 < len(words) <= 4:
        return 0
    if not re.search(r"\d", words[0]) and not roman(words[0]) and any(SequenceMatcher(None, words[0], p).ratio() >= (0.74 if len(p) > 2 else 1) for p in PAGE_WORDS):
        words = words[1:]
    if len(words) == 3 and (words[1] in TOTAL_WORDS or any(SequenceMatcher(None, words[1], p).ratio() > 0.6 for p in TOTAL_WORDS)):
        words = words[:1] if _number(words[2]) else []
    if len(words) == 2 and "/" in line and _number(words[1]):
        words = words[:1]
    return _number(words[0]) if len(words) == 1 else 0


def _without_number(line: str) -> tuple[str, int]:
    """A line without the number at its end or, failing that, its beginning, and that number."""
    s = line.strip()
    if m := re.search(r"(?:\s{2,}|\s*[|–—·•]\s*|\s)(\w{1,7})$", s):
        if n := _number(m[1]):
            return s[: m.start()], n
    if m := re.match(r"(\w{1,7})(?:\s{2,}|\s*[|–—·•]\s*)", s):
        if n := _number(m[1]):
            return s[m.end() :], n
    return s, 0


class Page:
    """Lines of a page and its edge slots (index of the line, from the top or the bottom)."""

    __slots__ = ("doc", "chunk", "lines", "full", "top", "bottom", "width", "seen")

    def __init__(self, doc: str, chunk: str, lines: list[str]) -> None:
        self.doc, self.chunk, self.lines = doc, chunk, lines
        self.full = [i for i, s in enumerate(lines) if s.strip()]
        self.top = self.full
        self.bottom = self.full[::-1]
        inner = sorted(len(lines[i].rstrip()) for i in (self.full[2:-2] or self.full))
        self.width = inner[int(0.95 * (len(inner) - 1))] if inner else 0
        self.seen: dict[int, tuple] = {}

    def slot(self, i: int) -> tuple[str, int, int, frozenset[str]]:
        """A line stripped, its number, its number if it is alone, and the q-grams of the rest."""
        if i not in self.seen:
            core, num = _without_number(self.lines[i])
            alone = page_number_of(self.lines[i])
            low = core.lower()
            self.seen[i] = (self.lines[i].strip(), num, alone, frozenset(low[j : j + 2] for j in range(len(low) - 1)))
        return self.seen[i]


def _alike(a: frozenset[str], b: frozenset[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def edge_features(page: Page, side: str, k: int, around: dict[int, Page]) -> list[float]:
    """Features of the k-th line from an edge, beside the lines there on the pages around."""
    slots = getattr(page, side)
    i = slots[k]
    line = page.lines[i]
    s, num, alone, core = page.slot(i)
    step = 1 if side == "top" else -1
    inner = page.lines[slots[k + 1]] if k + 1 < len(slots) else ""
    gap = 0 <= i + step < len(page.lines) and not page.lines[i + step].strip()
    outer_blank = (i if side == "top" else len(page.lines) - 1 - i) > 0
    alike, counts, titles = [], [], []
    for d in (-2, -1, 1, 2):
        if (p := around.get(d)) is None:
            continue
        other = getattr(p, side)
        best, count = 0.0, 0
        for j in {k, max(0, k - 1), k + 1}:
            if j >= len(other):
                continue
            t, n2, a2, c2 = p.slot(other[j])
            if alone and a2:
                count = max(count, 2 if a2 - alone == d else 1)
            elif not alone and not a2:
                best = max(best, _alike(core, c2))
                if num and n2 and n2 - num == d:
                    count = max(count, 2)
            if j == k:
                titles.append(float(bool(t) and t[-1] not in ".,;:?!-" and len(t) < 0.85 * max(p.width, 1)))
        alike.append(best)
        counts.append(count)
    first = bare_word(inner.split()[0]) if side == "top" and inner.split() else ""
    far = len(line) - len(line.lstrip()) > 8  # set to the middle or the right
    used = len(s) if far else len(line.rstrip())
    room = page.width - used - 1 - len(inner.split()[0] if inner.split() else "")
    if side == "bottom":
        nxt = around.get(1)
        words = nxt.lines[nxt.top[0]].split() if nxt and nxt.top else []
        room = page.width - used - 1 - len(words[0] if words else "xxxxxxx")
    letters = [c for c in s if c.isalpha()]
    prev = page.lines[slots[k + 1]].rstrip() if side == "bottom" and k + 1 < len(slots) else ""
    return [
        float(side == "top"), float(k), float(gap), float(outer_blank), float(alone > 0), float(num > 0),
        max(alike, default=0.0), sorted(alike)[-2] if len(alike) > 1 else 0.0, float(max(counts, default=0)), float(len(alike)),
        float(s[-1:] in tuple(".?!")), float(s[-1:] in tuple(HYPHENS + ",;:")), float(s[:1].islower()), float(s[:1].isdigit()),
        float(room), len(s) / max(1, page.width), float(bool(letters) and all(c.isupper() for c in letters)), float(len(line) - len(line.lstrip())),
        float("|" in s or bool(re.search(r"\S\s{3,}\S", s))), float(np.mean(titles)) if titles else 0.0, float(len(s.split())), float(bool(re.match(r"\d{1,3}\.? [^\W\d_]", s))),
        float(prev[-1:] in tuple(".?!")), float(prev[-1:] in tuple(HYPHENS)), float(first[:1].islower()), float(far), float(bool(re.search(r"[^\W\d][.?!] [^\W\d]", s))), float(len(page.full)),
    ]


def furniture(page: Page, around: dict[int, Page], model: Booster) -> dict[int, str]:
    """Line index to defect for the furniture of a page, from its edges inwards."""
    out: dict[int, str] = {}
    open_ = ["top", "bottom"] if page.full else []
    k = 0
    while open_:  # EDGE lines of each side at once; most pages need no more
        n = range(k, min(k + EDGE, len(page.full)))
        every = model.predict(np.array([edge_features(page, side, i, around) for side in open_ for i in n]))
        still = []
        for at, side in enumerate(open_):
            p = every[at * len(n) : (at + 1) * len(n)]
            own = next((i for i, x in enumerate(p) if x < 0.5), len(n))
            for i in getattr(page, side)[k : k + own]:
                out[i] = "page_number" if page_number_of(page.lines[i]) else "running_line"
            if own == len(n) and k + EDGE < len(page.full):
                still.append(side)
        open_, k = still, k + EDGE
    return out


def join_features(left: str, right: str, words: frozenset[str]) -> list[float]:
    """Features of a line's last and the next body line's first word."""
    a, b = bare_word(left), bare_word(right)
    mark = left[-1:] in HYPHENS
    own = f"{a}-{b}"
    return [float(mark), float(a + b in words), float(own in words), float(a in words), float(b in words), float(right[:1].islower()), float(len(a)), float(len(b)), float(bool(re.search(r"\d", a + b)))]


# --- training data -------------------------------------------------------------------


def misread(word: str, r: random.Random, times: int) -> str:
    """A word with some characters misrecognised."""
    for _ in range(times):
        at = [(i, k) for k in MISREADINGS for i in range(len(word)) if word.startswith(k, i)]
        if not at:
            break
        i, k = r.choice(at)
        word = word[:i] + r.choice(MISREADINGS[k]) + word[i + len(k) :]
    return word


def _to_roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def generated_book(words: list[str], r: random.Random) -> tuple[list[Page], list[set[int]], list[dict[int, str]]]:
    """Pages in one of many layouts, the furniture of each, and the words broken at line ends."""
    width, pages = r.randint(48, 78), r.choice((1, 2, 3, 4, 6, 8))
    indent, blank = r.choice(((4, False), (0, True), (2, False))), r.random() < 0.5
    noise = lambda s: " ".join(misread(w, r, 1) if r.random() < 0.03 else w for w in s.split(" "))
    title = " ".join(r.sample(words, r.randint(2, 6))).capitalize()
    title = r.choice((title, title, title.upper(), title.title()))
    section = lambda: f"{sec}{r.choice(('', '.'))} " + " ".join(r.sample(words, r.randint(2, 4))).capitalize()
    sec, number, total = r.randint(1, 9), r.randint(1, 130), r.randint(10, 60)
    dotted = r.random() < 0.5
    form = r.choice(("{n}", "- {n} -", "— {n} —", "-{n}-", "[{n}]", "Page {n} of {m}", "Page {n}", "Seite {n}", "Seite {n} von {m}", "{r}", "({n})", "{n}/{m}", "~ {n} ~"))
    layout = r.choice(("none", "none", "num", "num", "title", "title_num", "num_title_alt", "title_bottom_num", "two_top", "two_top_num", "num_top_title_bottom", "sections", "sections_bottom"))
    centred, right, nouns = r.random() < 0.4, r.random() < 0.3, r.random() < 0.4
    mark = r.choice("----¬\xad‐")
    out, labels, broken = [], [], []
    body: list[str] = []
    name = section()
    for p in range(pages):
        if r.random() < 0.4:
            sec, name = sec + 1, section()
        n = number + p
        num = form.format(n=n, m=total + number, r=_to_roman(n))
        if centred:
            num = " " * (width - len(num) if right else width // 2) + num
        top: list[str] = []
        bottom: list[str] = []
        if layout == "num":
            (top if dotted else bottom).append(num)
        elif layout == "title":
            (top if dotted else bottom).append(title)
        elif layout == "title_num":
            (top if dotted else bottom).append(f"{title} | {n}" if centred else f"{title}{' ' * 6}{n}")
        elif layout == "num_title_alt":
            top.append(f"{n}      {title}" if p % 2 else f"{name}          {n}")
        elif layout == "title_bottom_num":
            top.append(title if p % 2 or dotted else name)
            bottom.append(num)
        elif layout == "two_top":
            top += [title, name]
        elif layout == "two_top_num":
            top += [title, name]
            bottom.append(num)
        elif layout == "num_top_title_bottom":
            top.append(num)
            bottom.append(title)
        elif layout == "sections":
            top.append(f"{name}, {title}" if centred else name)
            if dotted:
                bottom.append(num)
        elif layout == "sections_bottom":
            bottom.append(f"{name}, {title}")
            top.append(num)
        lines: list[str] = []
        split: dict[int, str] = {}
        room = r.randint(14, 26) if r.random() < 0.85 else r.randint(2, 10)
        while len(lines) < room:
            if not body:
                if lines and indent[1]:
                    lines.append("")
                for _ in range(r.randint(2, 5)):
                    s = [r.choice(words) if r.random() > 0.05 else str(r.randint(2, 99)) for _ in range(r.randint(6, 16))]
                    s[0] = s[0].capitalize()
                    if nouns:  # as German does
                        s = [w.capitalize() if r.random() < 0.35 else w for w in s]
                    elif r.random() < 0.3:
                        s = [w.capitalize() if 3 < j < 7 else w for j, w in enumerate(s)]
                    s[-1] += r.choice(("." * 1, ".", ".", "?"))
                    body += s
                line = " " * indent[0]
            else:
                line = ""
            while body:
                w = body[0]
                if len(line) + len(w) + (line.strip() != "") <= width:
                    line += (" " if line.strip() else "") + w
                    body.pop(0)
                    continue
                space = width - len(line) - 2
                if space >= 3 and len(w) > space and len(w) >= 6 and w.isalpha() and r.random() < 0.7:
                    c = min(space, len(w) - 2)
                    line += " " + w[:c] + mark
                    split[len(lines)] = w.lower()
                    body[0] = w[c:]
                break
            lines.append(line)
            if not body and r.random() < 0.03:
                lines.append(str(r.randint(1, 999)))
        head = top + ([""] if top and blank and r.random() < 0.7 else [])
        foot = ([""] if bottom and r.random() < 0.5 else []) + bottom
        if r.random() < 0.12:
            head = []
        if r.random() < 0.08:
            foot = []
        every = [noise(s) for s in head + lines + foot]
        out.append(Page("d", str(p), every))
        labels.append({i for i in range(len(every)) if every[i].strip() and (i < len(head) or i >= len(head) + len(lines))})
        broken.append({i + len(head): w for i, w in split.items()})
    return out, labels, broken


@lru_cache(2)
def models(words: frozenset[str]) -> tuple[Booster, Booster, Booster]:
    """Classifiers of furniture and joins, and the ranking of replacements."""
    r = random.Random(20240301)
    listed = sorted(words) or ["word"]
    fx, fy, jx, jy = [], [], [], []
    made = 0
    while made < TRAIN_PAGES:
        pages, labels, broken = generated_book(listed, r)
        made += len(pages)
        for n, (p, own, split) in enumerate(zip(pages, labels, broken)):
            around = {d: pages[n + d] for d in (-2, -1, 1, 2) if 0 <= n + d < len(pages)}
            for side in ("top", "bottom"):
                slots = getattr(p, side)
                for k, i in enumerate(slots):
                    fx.append(edge_features(p, side, k, around))
                    fy.append(i in own)
                    if i not in own:
                        break
            inner = [i for i in p.full if i not in own]
            for a, b in zip(inner, inner[1:]):
                left, right = p.lines[a].split()[-1], p.lines[b].split()[0]
                if a in split or left[-1] in HYPHENS or r.random() < 0.1:
                    jx.append(join_features(left, right, words))
                    jy.append(a in split)
                if r.random() < 0.02:  # a dash at the end of a line breaks no word
                    jx.append(join_features(left + " -" if r.random() < 0.5 else "-", right, words))
                    jy.append(False)
                if r.random() < 0.05 and (own_hyphen := [w for w in r.sample(listed, min(40, len(listed))) if "-" in w]):
                    x, y = own_hyphen[0].split("-", 1)
                    jx.append(join_features(x + r.choice(HYPHENS), y, words))
                    jy.append(True)
    index: dict[str, list[str]] = {}
    for w in listed:
        for g in qgrams(w):
            index.setdefault(g, []).append(w)
    rx, ry = [], []
    for _ in range(TRAIN_WORDS):
        w = r.choice(listed)
        x = misread(w, r, r.choice((1, 1, 1, 2)))
        if r.random() < 0.2:  # at the end, where inflected forms compete
            end = max((k for k in MISREADINGS if w.endswith(k)), key=len, default="")
            x = w[: len(w) - len(end)] + r.choice(MISREADINGS[end]) if end else x
        if x in words or len(w) < 2:
            continue
        hits: dict[str, int] = {}
        for g in qgrams(x):
            for c in index.get(g, ()):
                hits[c] = hits.get(c, 0) + 1
        for c, n in sorted(hits.items(), key=lambda h: (-h[1], h[0]))[:8] + [(w, hits.get(w, 0))]:
            if enough(n, len(x), len(c)):
                rx.append(rank_features(x, c, n))
                ry.append(c == w)
        for c in r.sample(listed, min(4, len(listed))):  # words in the list's neighbourhood that are no misreading
            y = c[::-1]
            for z, n in ((z, len(set(qgrams(y)) & set(qgrams(z)))) for z in r.sample(listed, min(8, len(listed)))):
                if y not in words and enough(n, len(y), len(z)):
                    rx.append(rank_features(y, z, n))
                    ry.append(False)
    return (
        Booster(trees=80, depth=4).fit(np.array(fx), np.array(fy)),
        Booster(trees=30, depth=3).fit(np.array(jx), np.array(jy)),
        Booster(trees=60, depth=4).fit(np.array(rx or [[0.0] * 9]), np.array(ry or [0])),
    )


# --- candidates and ranking ----------------------------------------------------------


def qgrams(word: str) -> list[str]:
    """Distinct padded character q-grams."""
    s = f"^{word}$"
    return sorted({s[i : i + Q] for i in range(len(s) - Q + 1)})


def enough(shared: int, a: int, b: int) -> bool:
    """Whether shared q-grams make a candidate: about half of the shorter side's at least."""
    return 2 * shared >= min(a, b) and abs(a - b) <= 3


_READ_AS = {(k, v) for k, vs in MISREADINGS.items() for v in vs}


def misreading_cost(read: str, word: str) -> float:
    """Edit distance from ``word`` to ``read`` in which a known misreading costs 0.2."""
    n, m = len(word), len(read)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 1e9
            if i:
                best = d[i - 1][j] + 1
            if j:
                best = min(best, d[i][j - 1] + 1)
            if i and j:
                best = min(best, d[i - 1][j - 1] + (word[i - 1] != read[j - 1]))
                for a, b in ((1, 1), (1, 2), (2, 1)):
                    if i >= a and j >= b and (word[i - a : i], read[j - b : j]) in _READ_AS:
                        best = min(best, d[i - a][j - b] + 0.2)
            d[i][j] = best
    return d[n][m]


def rank_features(read: str, word: str, shared: int) -> list[float]:
    cost = misreading_cost(read, word)
    pre = next((i for i, (a, b) in enumerate(zip(read, word)) if a != b), min(len(read), len(word)))
    suf = next((i for i, (a, b) in enumerate(zip(read[::-1], word[::-1])) if a != b), min(len(read), len(word)))
    return [cost, cost / max(1, len(word)), 2 * shared / (len(read) + len(word) + 2), float(len(read) - len(word)), float(pre), float(suf), float(len(word)), float(sum(c.isdigit() for c in read)), float(("-" in read) == ("-" in word))]


def corrections(unknown: DataFrame, wordlist: DataFrame, fitted: Booster) -> DataFrame:
    """(read, word): the replacement of each distinct unknown word ranked first, if one is likely.

    Candidates come from an inverted join on q-grams. Words that are alike share about half of
    the shorter one's q-grams, so they share one of their rarest (rare in the word list) half
    or so: only those are joined, and long postings are left alone. Shared q-grams are then
    counted, and what has ``enough`` is scored.
    """
    right = wordlist.select("word", F.explode(_grams("word")).alias("g"))
    often = right.groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def rarest(rows: DataFrame, word: str) -> DataFrame:
        g = rows.select(word, F.explode(_grams(word)).alias("g")).join(often, "g", "left")
        held = g.groupBy(word).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "g"))).alias("s"))
        # a partner is up to three characters shorter; so many grams are shared at least
        least = F.greatest(F.lit(1), F.ceil((F.length(word) - 3) / 2)).cast("int")
        return held.select(word, F.explode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("x")).select(word, F.col("x.g").alias("g"))

    met = rarest(unknown, "read").join(rarest(wordlist, "word"), "g").where(F.abs(F.length("read") - F.length("word")) <= 3).select("read", "word").distinct()
    near = met.withColumn("shared", F.size(F.array_intersect(_grams("read"), _grams("word"))))
    near = near.where(2 * F.col("shared") >= F.least(F.length("read"), F.length("word")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([rank_features(*t) for t in zip(*(b.column(i).to_pylist() for i in range(3)))])
                p, cost = fitted.predict(x), x[:, 0]
                keep = pa.array((p >= 0.5) & (cost <= 2.2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array(-cost)], names=["read", "word", "p", "near"]).filter(keep)

    ranked = near.mapInArrow(score, "read string, word string, p double, near double")
    return ranked.groupBy("read").agg(F.max_by("word", F.struct("p", "near", "word")).alias("word"))


def _grams(col: str):
    """Distinct padded q-grams as a column expression; the same as ``qgrams``."""
    s = F.concat(F.lit("^"), F.col(col), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - Q + 1), lambda i: F.substring(s, i, F.lit(Q))))


# --- pages in order ------------------------------------------------------------------


def pages_in_order(chunks: DataFrame) -> DataFrame:
    """Checkpointed OCR pages (doc, chunk, text) sorted by document and chunk id."""
    rows = chunks.where("description_source = 'ocr' and chunk_id is not null").select(F.coalesce("document_name", F.lit("")).alias("doc"), F.col("chunk_id").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(rows.repartitionByRange("doc", "chunk").sortWithinPartitions("doc", "chunk"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without the ones whose document and page stand before them already."""
    last = None
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        keep = [k != p for k, p in zip(keys, [last, *keys])]
        last = keys[-1] if keys else last
        yield b if all(keep) else b.filter(pa.array(keep, pa.bool_()))


def numbered(pages: DataFrame) -> DataFrame:
    """(g, doc, chunk, text): pages once each, numbered in order over all partitions.

    One number of each partition, its pages, comes to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in _once(batches))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], names=["pid", "n"])

    first, total = {}, 0
    for pid, n in sorted(tuple(r) for r in pages.select("doc", "chunk").mapInArrow(counted, "pid bigint, n bigint").collect()):
        first[pid] = total
        total += n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = first[TaskContext.get().partitionId()]
        for b in _once(batches):
            yield pa.RecordBatch.from_arrays([pa.array(range(g, g + b.num_rows), pa.int64()), *b.columns], names=["g", "doc", "chunk", "text"])
            g += b.num_rows

    return pages.mapInArrow(number, "g bigint, doc string, chunk string, text string")


def blocks(pages: DataFrame, size: int = BLOCK) -> DataFrame:
    """Numbered pages in blocks: (block, g, doc, chunk, text, known), sorted within partitions.

    A page near the end of a block goes to the next one too. ``known`` holds the listed words
    a page asks for, or is null where all words are held by the workers.
    """
    own = lambda d: F.floor((F.col("g") + d) / size)
    of = F.filter(F.array_distinct(F.array(own(-AROUND), own(0), own(AROUND))), lambda b: b >= 0)
    known = F.col("known") if "known" in pages.columns else F.lit(None).cast("array<string>")
    return pages.select(F.explode(of).alias("block"), "g", "doc", "chunk", "text", known.alias("known")).repartition("block").sortWithinPartitions("block", "g")


def windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[Page | None], list[str] | None]]:
    """(g, pages, known) for every page of the blocks: it and the four before and after it.

    Pages of other documents are None.
    """
    empty = [None] * (2 * AROUND)
    buf: deque = deque(empty, maxlen=2 * AROUND + 1)
    block = None

    def pushed(entry: tuple | None) -> Iterator[tuple[int, list[Page | None], list[str] | None]]:
        buf.append(entry)
        mid = buf[AROUND] if len(buf) > 2 * AROUND else None
        if mid and mid[0] // size == block:
            yield mid[0], [e[1] if e and e[1].doc == mid[1].doc else None for e in buf], mid[2]

    for b in batches:
        for k, g, d, c, x, known in zip(*(b.column(i).to_pylist() for i in range(6))):
            if k != block:
                for _ in range(AROUND):
                    yield from pushed(None)
                buf.clear()
                buf.extend(empty)
                block = k
            yield from pushed((g, Page(d, c, x.split("\n")), known))
    for _ in range(AROUND):
        yield from pushed(None)


class Reader:
    """Judges the pages of a window."""

    def __init__(self, words: frozenset[str], fitted: tuple[Booster, Booster, Booster]) -> None:
        self.words = words
        self.edges, self.joins, _ = fitted
        self.known: dict[tuple, bool] = {}
        self.cache: dict[tuple[str, str], dict[int, str]] = {}

    def furniture(self, w: list[Page | None], i: int) -> dict[int, str]:
        key = w[i].doc, w[i].chunk
        if key not in self.cache:
            if len(self.cache) > 32:
                self.cache.clear()
            self.cache[key] = furniture(w[i], {d: w[i + d] for d in (-2, -1, 1, 2) if w[i + d]}, self.edges)
        return self.cache[key]

    def following(self, w: list[Page | None]) -> str | None:
        """The first body line of the following pages."""
        for k in (AROUND + 1, AROUND + 2):
            if w[k] is None:
                break
            f = self.furniture(w, k)
            rest = [j for j in w[k].full if j not in f]
            if rest:
                return w[k].lines[rest[0]]
        return None

    def asks(self, w: list[Page | None]) -> set[str]:
        """All words that reading the page may look up in the list."""
        page, out = w[AROUND], set()
        own = self.furniture(w, AROUND)
        body = [page.lines[i] for i in page.full if i not in own]
        before = []
        for k in (AROUND - 1, AROUND - 2):
            if w[k] is not None:
                f = self.furniture(w, k)
                before = [w[k].lines[j] for j in w[k].full if j not in f][-1:]
                if before:
                    break
        for line in body:
            out.update(map(bare_word, line.split()))
        ends = [*before, *body]
        for a, b in zip(ends, [*ends[1:], self.following(w)]):
            if b:
                x, y = bare_word(a.split()[-1]), bare_word(b.split()[0])
                out |= {x, y, x + y, f"{x}-{y}"}
        return out - {""}

    def goes_on(self, left: str, right: str) -> bool:
        """Whether the word ``left`` ends a line with goes on as ``right``."""
        if left[-1] not in HYPHENS:
            return False
        f = tuple(join_features(left, right, self.words))
        if f not in self.known:
            self.known[f] = bool(self.joins.predict(np.array([f]))[0] >= 0.5)
        return self.known[f]

    def read(self, w: list[Page | None]) -> list[tuple[int, str, str, str]]:
        """(line number, defect, repaired, unknown) of the page in the middle of the window.

        ``repaired`` is empty where ``unknown`` must be looked up first.
        """
        page = w[AROUND]
        own = self.furniture(w, AROUND)
        out = [(i + 1, d, "", "") for i, d in own.items()]
        body = [i for i in page.full if i not in own]
        nxt = self.following(w)
        skip_first = self._joined_before(w, own)
        if skip_first:
            out.append((0, "joined", "", ""))
        if body and not page.lines[body[0]][:1].isspace() and (skip_first or not self._ended_before(w)):
            out.append((0, "continues", "", ""))
        pairs = []
        for a, i in enumerate(body):
            tokens = page.lines[i].split()
            follow = page.lines[body[a + 1]] if a + 1 < len(body) else nxt
            last = tokens[-1]
            joined = False
            if follow:
                right = follow.split()[0]
                joined = self.goes_on(last, right)
                if joined:
                    x, y = bare_word(last), bare_word(right)
                    whole = x + y if x + y in self.words else f"{x}-{y}" if f"{x}-{y}" in self.words else ""
                    out.append((i + 1, "split_word", whole, "" if whole else x + y))
            inner = tokens[(1 if skip_first else 0) : (-1 if joined else None)]
            skip_first = joined
            for t in inner:
                z = bare_word(t)
                if z and z not in self.words and not re.fullmatch(r"[\d.,:/%-]+", z) and any(c.isalpha() for c in z):
                    pairs.append((i + 1, "misread_word", "", z))
        return out + pairs

    def _ended_before(self, w: list[Page | None]) -> bool:
        """Whether a paragraph ended on the page before."""
        before = w[AROUND - 1]
        if before is None:
            return True
        f = self.furniture(w, AROUND - 1)
        rest = [j for j in before.full if j not in f]
        if not rest:
            return True
        last = before.lines[rest[-1]].rstrip()
        return last[-1] in ".?!:" and len(last) < 0.85 * before.width

    def _joined_before(self, w: list[Page | None], own: dict[int, str]) -> bool:
        """Whether the page begins with the rest of a word."""
        for k in (AROUND - 1, AROUND - 2):
            if w[k] is None:
                return False
            f = self.furniture(w, k)
            rest = [j for j in w[k].full if j not in f]
            if rest:
                last = w[k].lines[rest[-1]].split()[-1]
                body = [i for i in w[AROUND].full if i not in own]
                return bool(body) and self.goes_on(last, w[AROUND].lines[body[0]].split()[0])
        return False


def listed(wordlist: DataFrame) -> DataFrame:
    """Distinct lower-case words of a list."""
    return wordlist.select(F.lower("word").alias("word")).where("word <> ''").distinct()


def word_set(words: DataFrame, most: int = MAX_WORDS) -> tuple[frozenset[str], bool]:
    """The words, and True; or ``most`` of a longer list by their hash, to train on, and False."""
    got = words.limit(most + 1).collect()
    if len(got) <= most:
        return frozenset(r.word for r in got), True
    return frozenset(r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(most).collect()), False


def _suspects(pages: DataFrame, words: DataFrame, fitted: tuple[Booster, Booster, Booster], held: frozenset[str] | None, size: int) -> DataFrame:
    """What the reader sees on numbered pages; a list that isn't held is joined page by page."""
    if held is None:

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(frozenset(), fitted)
            for g, w, _ in windows(batches, size):
                own = sorted(reader.asks(w))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array(own, pa.string())], names=["g", "word"])

        known = blocks(pages, size).mapInArrow(asked, "g bigint, word string").join(words, "word")
        pages = cut(pages.join(known.groupBy("g").agg(F.collect_set("word").alias("known")), "g", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))))
    shared = pages.sparkSession.sparkContext.broadcast((held or frozenset(), fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = Reader(*shared.value), []
        for _, w, known in windows(batches, size):
            if known is not None:
                reader.words = frozenset(known)
            page = w[AROUND]
            rows += [(page.doc, page.chunk, *r) for r in reader.read(w)]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return blocks(pages, size).mapInArrow(run, "doc string, chunk_id string, line_no bigint, defect string, repaired string, unknown string")


_NAMES = ["doc", "chunk_id", "line_no", "defect", "repaired", "unknown"]
_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())


def _read(chunks: DataFrame, wordlist: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered pages, what was seen on them, and the replacements of unknown words."""
    words = listed(wordlist)
    sample, whole = word_set(words, most)
    fitted = models(sample)  # trained once, on the driver; a few kilobytes go to the workers
    pages = numbered(pages_in_order(chunks))
    seen = cut(_suspects(pages, words, fitted, sample if whole else None, size))
    unknown = seen.where("unknown <> ''").select(F.col("unknown").alias("read")).distinct()
    return pages, seen, corrections(unknown, words, fitted[2])


def defects(chunks: DataFrame, wordlist: DataFrame, size: int = BLOCK, most: int = MAX_WORDS) -> DataFrame:
    """(chunk_id, line_no, defect, repaired) of scanned pages, as TESTDATA.md's p2_found.

    A page delivered twice counts once; a null text has no line, a null id no page, and
    pages without a document name are read as one document. Without words in the list only
    furniture is found. An empty table gives an empty result. ``size`` (pages of a block)
    changes nothing; of a list of more than ``most`` words so many are trained on.
    """
    _, seen, fixed = _read(chunks, wordlist, size, most)
    looked = seen.where("unknown <> ''").join(fixed, F.col("unknown") == F.col("read")).select("chunk_id", "line_no", "defect", F.col("word").alias("repaired"))
    return seen.where("unknown = '' and line_no > 0").select("chunk_id", "line_no", "defect", "repaired").unionByName(looked).distinct()


def assemble(text: str, marks: list[dict]) -> tuple[bool, list[str]]:
    """(continues, paragraphs) of a page from its text and what was found in it."""
    lines = text.split("\n")
    gone = {m["line_no"] - 1 for m in marks if m["defect"] in ("page_number", "running_line")}
    whole = {m["line_no"] - 1: m["word"] for m in marks if m["defect"] == "split_word"}
    words: dict[int, dict[str, str]] = {}
    for m in marks:
        if m["defect"] == "misread_word":
            words.setdefault(m["line_no"] - 1, {})[m["unknown"]] = m["word"]
    skip = any(m["defect"] == "joined" for m in marks)
    out: list[list[str]] = []
    blank = True
    for i, line in enumerate(lines):
        if i in gone:
            continue
        tokens = line.split()
        if not tokens:
            blank = True
            continue
        if blank and not (out and skip) or line[:1].isspace() and not skip:
            out.append([])
        blank = False
        if skip:
            tokens = tokens[1:]
        skip = False
        own = words.get(i, {})
        for k, t in enumerate(tokens):
            z = bare_word(t)
            if k == len(tokens) - 1 and i in whole:
                tokens[k] = _cased(t, whole[i])
                skip = True
            elif z in own:
                at = t.lower().find(z)
                tokens[k] = t[:at] + _cased(t[at:], own[z]) + t[at + len(z) :] if at >= 0 else t
        # the rest of a broken word brought its punctuation along
        out[-1] += tokens
        if skip and (n := next((x for x in lines[i + 1 :] if x.strip()), None)):
            tail = re.search(r"[.,;:?!)]+$", n.split()[0])
            if tail:
                out[-1][-1] += tail[0]
    return any(m["defect"] == "continues" for m in marks), [" ".join(p) for p in out if p]


def _cased(like: str, word: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters[:1] and letters[0].isupper() else word


def paragraphs(chunks: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(document_name, chunk_id, paragraph_no, text): continuous paragraphs of scanned pages.

    A paragraph that runs over pages is one row, under the page it begins on. Misread words
    are replaced in their case, broken words whole, furniture is gone. See ``defects`` for
    nulls and repeats.
    """
    pages, seen, fixed = _read(chunks, wordlist, BLOCK, MAX_WORDS)
    looked = seen.join(fixed, F.col("unknown") == F.col("read"), "left").withColumn("word", F.when(F.col("unknown") == "", F.col("repaired")).otherwise(F.coalesce("word", "unknown")))
    marks = looked.groupBy("doc", F.col("chunk_id").alias("chunk")).agg(F.collect_list(F.struct("line_no", "defect", "unknown", "word")).alias("marks"))
    both = pages.join(marks, ["doc", "chunk"], "left").select("doc", "chunk", "text", "marks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [assemble(x, m or []) for x, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in made], pa.bool_()), pa.array([p for _, p in made], pa.list_(pa.string()))], names=["doc", "chunk", "continues", "parts"])

    done = both.mapInArrow(build, "doc string, chunk string, continues boolean, parts array<string>").where(F.size("parts") > 0)
    done = cut(done.repartitionByRange("doc", "chunk").sortWithinPartitions("doc", "chunk"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The document the partition ends in and the page its last paragraph begins on."""
        doc = key = None
        for b in batches:
            for d, c, on, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), pa.compute.list_value_length(b.column(3)).to_pylist()):
                if d != doc:
                    doc, key = d, None
                if n > 1 or not on:
                    key = (c, n - 1)
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([doc]), pa.array([key and key[0]], pa.string()), pa.array([key and key[1]], pa.int64())], names=["pid", "doc", "chunk", "n"])

    import pyarrow.compute  # noqa: F401

    open_: dict[int, tuple[str, tuple[str, int] | None]] = {}  # one row of each partition
    last: tuple[str, tuple[str, int] | None] = ("", None)
    for r in sorted(done.mapInArrow(starts, "pid bigint, doc string, chunk string, n bigint").collect()):
        open_[r.pid] = last
        last = (r.doc, (r.chunk, r.n) if r.chunk is not None else (last[1] if last[0] == r.doc else None))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, key = open_.get(TaskContext.get().partitionId(), ("", None))
        for b in batches:
            rows = []
            for d, c, on, parts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if d != doc:
                    doc, key = d, None
                for n, x in enumerate(parts):
                    if n or not on or key is None:
                        key = (c, n)
                    rows.append((d, key[0], key[1], c, x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["doc", "start", "n", "chunk", "text"])

    pieces = done.mapInArrow(keyed, "doc string, start string, n bigint, chunk string, text string")
    joined = pieces.groupBy("doc", "start", "n").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("p"))
    return joined.select(F.col("doc").alias("document_name"), F.col("start").alias("chunk_id"), F.col("n").alias("paragraph_no"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))

