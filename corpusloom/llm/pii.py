"""Personal information inside free text: anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs and their written-out forms,
schemes (mailto:, tel:), number shapes (every digit is read as 9), kinds of streets, parts of
known names, and words that stand beside a person's name. A deterministic local parser then
expands each anchor within a window that holds several of the text's longest words, finds
where the value begins and ends, and validates it (check digits where a kind has them). Text
without anchors is never parsed.

Everything runs per Arrow batch without a shuffle. The dictionary of name parts comes from a
roster. Up to ``MAX_PARTS`` parts are held by the workers at once; a larger dictionary is cut
into shards of that size, each shard reads the texts once, and what the shards find in a text
is put together before overlaps are settled. Names beyond the roster are found beside one
known part or by a cue.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

#: Distinct name parts of a shard of the dictionary, which every worker holds.
MAX_PARTS = 500_000
#: Characters around an anchor that its parser looks at, in texts of ordinary words.
BEFORE, AFTER = 90, 110
KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: Found and redacted too: numbers of accounts and cards that pass their check.
ACCOUNT = "account_number"

# The last word of an English street, in full and abbreviated.
EN_STREETS = "Street Avenue Lane Road Way Close Drive Terrace Crescent Row Court Place Square Boulevard Hill Grove Gardens Walk Parade Mews".split()
EN_SHORT = "Sq Blvd Rd Dr Ln Ct Pl Cres Ter".split()  # written without a point
EN_POINT = "St Ave".split()  # written with one
# The ending of a German street.
DE_STREETS = "straße strasse str. weg allee ufer hof gasse platz ring steig damm wall markt graben stieg pfad chaussee".split()
# The first word of a Spanish street.
ES_STREETS = "Calle C/ Paseo Plaza Camino Ronda Avda. Avenida Travesía Cuesta Glorieta Carretera".split()
# The last characters of a Chinese street.
ZH_STREETS = "胡同 大道 大街 路 街 巷 弄".split()
# Number shapes that an identity or phone number holds.
NUMBER_SHAPES = "99-99-9999|99 99 9999|9-999-9999|) 999-9999|9.999.9999|9 999 9999|+99999999|99 9999 9999|9)9999 999|99999 999999|99 99 99 99|9-99999999|）9999-9999|99999-999|99999 999|/99999999|) 99999999|999999999|999999 99999999|99 999 999 999|999999|99 99 99 |9999-9999-9".split("|")
# Words that label a person, before a colon, an equals sign or a point.
LABELS = (
    "name user tutor teacher student pupil reviewer author editor recipient sender owner assignee contact attn attention signed duty ship_to bill_to "
    "supervisor instructor lecturer applicant patient client customer from to cc nombre alumno alumna profesor profesora autor autora firmado destinatario "
    "remitente contacto kontakt ansprechpartner ansprechpartnerin betreuer betreuerin verfasser verfasserin empfänger absender schüler schülerin"
).split()
# What one does to or with a person.
ADDRESSES = "ask tell thank contact email call phone meet remind invite join help congratulate welcome dear hello hi reviewer fragen grüßen treffen frag preguntar llamar avisar".split()
# What goes to, comes from or is done by a person, before a preposition.
RELATES = (
    "thanks message messages letter letters mail parcel note notes call reply regards greetings question questions group team go goes sent send submitted written "
    "signed reviewed graded marked approved prepared taught presented dank fragen grüße brief nachricht eingereicht geschrieben geprüft bewertet unterschrieben gruppe "
    "gracias saludos carta mensaje dudas escribir enviado enviar firmado revisado escrito grupo"
).split()
PREPOSITIONS = "to for from of by with an von für por a al de con".split()
# Days on which somebody did something.
DAYS = "yesterday today tomorrow gestern heute ayer hoy".split()
# Closings of a letter, before a name on a line of its own.
CLOSINGS = "regards sincerely cheers best grüße grüßen saludos atentamente".split()
# What people do, after their name.
SPEAKS = "replied said asked wrote answered explained showed noted added zeigte sagte schrieb antwortete mostró dijo escribió respondió preguntó".split()
# Chinese words that stand before a person's name, and characters that follow one.
ZH_CUES = "昨天 今天 助教 老师 同学 学员 学生 批改人 感谢 联系 收件人 寄件人 姓名 作者".split()
ZH_AFTER = "在的说问和与及是把被给对，。；：、！？（）"
# Titles, which are no part of a name.
TITLES = "Dr Prof Ms Mr Mrs Miss Mx Frau Herr Sra Sr Srta Don Doña Señor Señora".split()
# Words that begin a sentence or stand before a name with a capital.
NO_NAMES = set(
    "the a an and or in on at by for from to of see with without under over between because despite suppose note once each every how what when where who why which if it its no not "
    "neither nor we you they he she this that these those there then thus also most some many all any both after before yesterday today tomorrow thanks thank questions submitted "
    "reviewer tutor user contact name regards parcels please mail left group tel fax call use values run lane sections unit room task student teacher dear "
    "der die das den dem ein eine und oder im am an von zu mit ohne nach aus bei gestern heute dank fragen eingereicht formular antrag viele grüße zuerst sobald weder "
    "el la los las un una y o en de del con sin para por ayer hoy alumno alumna dudas firmado enviar si tras primero compared recall measured students yet upper lower old north south east west new port".split()
)

# Chinese runs on without spaces, so edges of values are told by Latin letters and digits only
_L = "A-Za-z0-9_À-ɏ"
_W = r"[A-ZÄÖÜÉ](?:[a-zäöüßéèëïñáíóú]+|[A-ZÄÖÜÉ]+)"
_GIVEN = rf"{_W}(?:-{_W})?"
_FAMILY = rf"(?:(?:van|von|de|der|den|del|la|VAN|VON|DE|DER|DEN|DEL|LA) ){{0,2}}(?:[dDO]['’])?{_W}(?:-{_W})?"
_INITIAL = r"[A-ZÄÖÜ]\."
_EDGE = rf"(?<![{_L}'’.@+-])"
FORWARD = re.compile(rf"{_EDGE}(?:({_GIVEN})|({_INITIAL})) (?:{_INITIAL} )?({_FAMILY})(?![{_L}@])(?!['’]\w)")
BACKWARD = re.compile(rf"{_EDGE}({_FAMILY}), ({_GIVEN})(?: {_INITIAL})?(?![{_L}@])(?!['’]\w)")
_TITLED = rf"(?:(?:{'|'.join(TITLES)})\.? )*"
_TURNED = rf"{_FAMILY}, {_GIVEN}(?: {_INITIAL})?"
_STRAIGHT = rf"{_GIVEN} (?:{_INITIAL} )?{_FAMILY}|{_INITIAL} {_FAMILY}"
# a name isn't part of a longer run of words with capitals, and runs on into no other word
_DONE = rf"(?![{_L}@-])(?!['’]\w)(?! [A-ZÄÖÜ][{_L}])"
_NAME = rf"{_TITLED}({_STRAIGHT}|{_TURNED}){_DONE}"
#: What follows a cue up to and with the name, by the kind of cue.
AFTER_CUE = {
    "label": re.compile(rf"(?:[:=]|\.(?= ))[ \t]*\r?\n?{_NAME}"),
    "address": re.compile(rf" {_TITLED}({_STRAIGHT}){_DONE}"),
    "relate": re.compile(rf" (?:[a-zäöüßáéíóúñ]+ )??(?:{'|'.join(PREPOSITIONS)}) (?:la |el |den |die |der )??{_NAME}"),
    "day": re.compile(rf" (?:[a-zäöüßáéíóúñ]+ ){{0,2}}?{_NAME}"),
    "closing": re.compile(rf",?[ \t]*\r?\n[ \t]*{_NAME}[ \t]*(?=$|[\r\n,.;])"),
    "sign": re.compile(rf" ?{_NAME}"),
    "title": re.compile(rf"\.? {_NAME}"),
    "zh_cue": re.compile(rf"[：:]? ?{_NAME}"),
}
SPEAKER = re.compile(rf"(?<![{_L}'’.@+-])(?:{_STRAIGHT})$")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"{_LOCAL}(?:(?:@| ?[\[(](?:at|AT)[\])] ?){_LABEL}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?){_LABEL})*(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z]{{2,}}(?![A-Za-z0-9])"
    rf"| (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL})* (?:dot|DOT) [A-Za-z]{{2,}}(?![A-Za-z0-9]))"
)
_NO = rf"(?<![{_L}.+/(（-])(?<!\d )"
_END = rf"(?![{_L}])(?![-/.]\d)(?! ?\d)"
PHONE = re.compile(
    _NO + r"(?:\+\d{1,3}(?: ?\(0\))?(?:[ -]?\d{1,5}){2,5}|\+\d{9,14}|00\d{2} ?\(\d{1,4}\) ?\d{6,9}|1-\d{3}-\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\(\d{3}\) \d{3}-\d{4}|"
    r"（0\d{2,3}）\d{3,4}-\d{4}|0\d{2,3}-\d{7,8}|0\d{1,3}/\d{6,9}|0\d{1,3} \d{4,6}-\d{2,4}|0\d{4} \d{6}|0\d(?: \d{2}){4})" + _END
)
IDENTITY = re.compile(
    rf"(?<![{_L}.+/-])(?<!\d )" + r"(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2}(?: ?\d{2}){3} ?[A-D]|\d{6}( ?)\d{8}\2\d{3}[\dXx]|\d{2} \d{3} \d{3} \d{3}|\d{11})" + r"(?![A-Za-z0-9])(?![-/.]\d)(?! ?\d)"
)
ACCOUNTS = re.compile(rf"(?<![{_L}+/-])(?:[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?|\d{{4}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{4}}|\d{{4}} ?\d{{6}} ?\d{{5}})(?![{_L}])(?![-/.]\d)")
# What announces the number of a person.
ID_CUE = re.compile(r"(?i)steuer|idnr|id-nr|identi|tax|\btin\b|\bid\b|\bssn\b|\bnr\.|\bno\.|证|\bdni\b|\bnif\b|\bnie\b")
# Weights and signs of the check of 18-digit identity numbers (ISO 7064, MOD 11-2).
_WEIGHTS, _SIGNS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
_ONE = r"(?:[A-ZÄÖÜ][\w'’-]*)"
STREETS = (
    re.compile(rf"(?<![{_L}.,/-])\d{{1,4}}[A-Za-z]? (?:{_ONE} ){{1,3}}(?:(?:{'|'.join(EN_POINT)}|{'|'.join(x.upper() for x in EN_POINT)})\.|(?:{'|'.join([*EN_STREETS, *EN_SHORT, *EN_POINT])}|{'|'.join(x.upper() for x in [*EN_STREETS, *EN_SHORT, *EN_POINT])})(?![\w-]))"),
    re.compile(rf"(?<![{_L}])(?:(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem) )?(?:(?:Alte|Neue|Unter|Ober|Hinter|Vorder|Groß|Klein|Lang|Kurz)\w* )?)[A-ZÄÖÜ][\w-]*(?:{'|'.join(re.escape(x) for x in DE_STREETS)}) ?\d{{1,4}} ?(?:[a-z](?![\w]))?(?!\w)"),
    re.compile(rf"(?<![{_L}])(?:{'|'.join(re.escape(x) for x in ES_STREETS)}) (?:(?:de|del|la|las|los|el) ){{0,3}}(?:[A-ZÁÉÍÓÚÑ][\w]*,? ){{1,4}}(?:n\.º ?|nº ?|núm\. ?)?\d{{1,4}}(?: ?[A-Za-z](?!\w))?(?!\w)"),
    re.compile(rf"[一-鿿]{{1,8}}(?:{'|'.join(ZH_STREETS)}) ?\d{{1,4}} ?号"),
)
# Verbs and prepositions that lead to a Chinese address, which has no space before it.
_ZH_LEAD = re.compile("[到至是在于住址](?=[一-鿿]{2})")


_PLACES = {x.rstrip("./") for x in ES_STREETS} | set(EN_STREETS)


def identity_passes(value: str, before: str) -> bool:
    """Whether a number can be a person's: its check, or for want of one its parts or a cue.

    18 digits must pass MOD 11-2; groups of 3, 2 and 4 have no group of zeros; 11 digits pass
    MOD 11, 10 or stand after a cue. Letters with six digits have no check, only a form.
    """
    d = [c for c in value.upper() if c.isdigit() or c == "X"]
    if len(d) == 18:
        return _SIGNS[sum(int(a) * b for a, b in zip(d, _WEIGHTS)) % 11] == d[17]
    if len(d) == 9:
        return "".join(d[:3]) != "000" and "".join(d[3:5]) != "00" and "".join(d[5:]) != "0000"
    if len(d) == 11:
        p = 10
        for c in d[:10]:
            p = ((int(c) + p) % 10 or 10) * 2 % 11
        return (11 - p) % 10 == int(d[10]) or bool(ID_CUE.search(before))
    return True


def account_passes(value: str) -> bool:
    """MOD 97-10 of an account (IBAN), the Luhn sum of a card."""
    v = re.sub("[ -]", "", value)
    if v[:1].isalpha():
        return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    d = [int(c) for c in reversed(v)]
    return len(set(v)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


# runs of what values are made of that are longer than ordinary words
_LONG = re.compile(r"[A-Za-z0-9À-ɏ._%+'’-]{30,}")


class Finder:
    """The automaton and the parsers for a dictionary of names."""

    def __init__(self, given: frozenset[str], family: frozenset[str], zh_family: frozenset[str], zh_given: frozenset[str], names_only: bool = False) -> None:
        import ahocorasick

        both = lambda s: s | {x.upper() for x in s}
        self.given, self.family = both(given), both(family)
        first = f"[{''.join(sorted(zh_family))}]"
        self.zh = re.compile(f"{first}(?:{'|'.join(sorted(zh_given))})") if zh_family and zh_given else None
        # after a cue a known family name is enough, before a character that ends a name
        self.zh_cued = re.compile(f"[：:]? ?({first}[一-鿿]{{1,2}}?)(?=$|[{ZH_AFTER}]|[^一-鿿])") if zh_family else None
        a = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}

        def add(kind: str, *words: str) -> None:
            for w in words:
                if w:
                    anchors.setdefault(w, set()).add(kind)

        cases = lambda words: (x for w in words for x in (w, w[0].upper() + w[1:], w.upper()))
        if not names_only:
            add("@", "@", "(at)", "[at]", "(AT)", "[AT]", " AT ", " at ", "mailto:")
            add("#", "tel:", *NUMBER_SHAPES)
            for w in (*EN_STREETS, *EN_SHORT, *EN_POINT):
                add("en", f" {w}", f" {w.upper()}")
            add("de", *(f"{w} 9" for w in DE_STREETS))
            add("es", *(f"{w} " for w in ES_STREETS))
            add("zh", *(f"{w}9" for w in ZH_STREETS), *(f"{w} 9" for w in ZH_STREETS))
            add("label", *cases(LABELS))
            add("address", *cases(ADDRESSES))
            add("relate", *cases(RELATES))
            add("day", *cases(DAYS))
            add("closing", *cases(CLOSINGS))
            add("sign", "—")
            add("title", *TITLES)
            add("speaks", *(f" {w}" for w in SPEAKS))
        add("zh_cue", *ZH_CUES)
        add("name", *(x.split(" ")[-1] for x in self.given | self.family))
        add("zh_name", *zh_given)
        for w, kinds in anchors.items():
            a.add_word(w, (len(w), tuple(kinds)))
        if anchors:
            a.make_automaton()
        self.anchors = a
        self.shape = str.maketrans("0123456789", "9" * 10)

    def known(self, given: str, family: str) -> bool:
        """One part is in the dictionary, and the other isn't an ordinary word."""
        g, f = given.replace("’", "'"), family.replace("’", "'")
        if g in self.given:
            return f in self.family or f.split(" ")[-1].split("-")[0].lower() not in NO_NAMES
        return f in self.family and g.rstrip(".").lower() not in NO_NAMES and g not in TITLES

    def names(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        for m in FORWARD.finditer(text, lo, hi):
            given, initial, family = m.groups()
            if (self.known(given, family) if given else family in self.family):
                yield m.span()
        for m in BACKWARD.finditer(text, lo, hi):
            if self.known(m[2], m[1]) and (m[2] in self.given or self._listed_name(text, m)):
                yield m.span()

    @staticmethod
    def _listed_name(text: str, m: re.Match[str]) -> bool:
        """An unknown word after "Surname, " is a name unless another list item begins there."""
        before, after = text[max(0, m.start() - 25) : m.start()], text[m.end() : m.end() + 8]
        item = m[2] in _PLACES or re.match(r"\.|[ ]?(?:\d|\w+ \d)", after)
        return not item and not re.search(r"(?<!\w)[A-ZÄÖÜ][\w'’.-]* $", before)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) without overlaps, in order."""
        return settled(self.spans(text))

    def spans(self, text: str) -> set[tuple[int, int, str]]:
        """Spans (start, end, kind) of all parsers."""
        spans: set[tuple[int, int, str]] = set()
        done: dict[str, int] = {}
        n = len(text)
        wide = 8 * max(map(len, _LONG.findall(text)), default=0)  # no value has more than eight words
        before, after = BEFORE + wide, AFTER + wide
        for end, (size, kinds) in self.anchors.iter(text.translate(self.shape)):
            at = end - size + 1
            for kind in kinds:
                if kind in AFTER_CUE:
                    spans.update(self._cued(text, at, end + 1, min(n, end + after), kind))
                    continue
                if at < done.get(kind, 0):
                    continue  # a window that has been parsed covers this anchor
                if kind == "speaks":
                    if not text[end + 1 : end + 2].isalnum() and (m := SPEAKER.search(text, max(0, at - before), at)) and self._plausible(m[0]):
                        spans.add((*m.span(), "person_name"))
                    continue
                lo, hi = max(0, at - before), min(n, end + after)
                # windows begin and end where no value runs on
                while lo > 0 and text[lo - 1].isalnum() and at - lo < 2 * before:
                    lo -= 1
                while hi < n and text[hi].isalnum() and hi - end < 2 * after:
                    hi += 1
                done[kind] = hi - before
                if kind == "@":
                    spans.update((*m.span(), "email") for m in EMAIL.finditer(text, lo, hi))
                elif kind == "#":
                    for m in IDENTITY.finditer(text, lo, hi):
                        if identity_passes(m[0], text[max(0, m.start() - 40) : m.start()]):
                            spans.add((*m.span(), "identity_number"))
                    for m in PHONE.finditer(text, lo, hi):
                        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                            spans.add((*m.span(), "phone"))
                    for m in ACCOUNTS.finditer(text, lo, hi):
                        if account_passes(m[0]):
                            spans.add((*m.span(), ACCOUNT))
                elif kind == "name":
                    spans.update((*s, "person_name") for s in self.names(text, lo, hi))
                elif kind == "zh_name":
                    if self.zh:
                        spans.update((*m.span(), "person_name") for m in self.zh.finditer(text, lo, hi))
                else:
                    rx = STREETS[("en", "de", "es", "zh").index(kind)]
                    for m in rx.finditer(text, lo, hi):
                        skip = max((x.end() for x in _ZH_LEAD.finditer(m[0])), default=0) if kind == "zh" else 0
                        spans.add((m.start() + skip, m.end(), "street_address"))
        return spans

    def _cued(self, text: str, at: int, end: int, hi: int, kind: str) -> Iterator[tuple[int, int, str]]:
        """The name that a cue in text[at:end] announces, if one follows."""
        if kind == "zh_cue":
            if self.zh_cued and (m := self.zh_cued.match(text, end, hi)):
                yield (*m.span(1), "person_name")
        elif kind != "sign" and at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
            return  # the end of another word
        if (m := AFTER_CUE[kind].match(text, end, hi)) and self._plausible(m[1]):
            yield (*m.span(1), "person_name")

    def _plausible(self, name: str) -> bool:
        words = re.split(r"[ ,]+", name)
        return all(w.lower() not in NO_NAMES or w in ("de", "del", "la", "van", "von", "der", "den") for w in words) and not any(w in TITLES for w in words)


def settled(spans: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlaps, in order: the longest wins, then the first."""
    out: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2] == ACCOUNT, s[2])):
        i = bisect_left(out, s)
        if (not i or out[i - 1][1] <= s[0]) and (i == len(out) or out[i][0] >= s[1]):
            insort(out, s)
    return out


class Parts(NamedTuple):
    """Given and family names, and Chinese family and given names."""

    given: frozenset[str]
    family: frozenset[str]
    zh_family: frozenset[str]
    zh_given: frozenset[str]
    names_only: bool


@lru_cache(2)
def finder(parts: Parts) -> Finder:
    return Finder(*parts)


def name_parts(roster: DataFrame, name: str = "display_name", most: int = MAX_PARTS) -> list[Parts]:
    """The distinct name parts of a roster, in shards of ``most`` at most.

    Chinese family names, of which there are no more than characters, are in every shard; the
    first shard finds everything, the others names only. One shard at least, also if empty.
    """
    n = F.trim(F.col(name))
    zh = n.rlike(r"^[\x{4E00}-\x{9FFF}]{2,4}$")
    latin = n.rlike("^[^ ]+ .+$")
    rows = roster.select(F.when(latin, F.split(n, " ", 2)[0]).when(zh, F.substring(n, 2, 3)).alias("given"), F.when(latin, F.split(n, " ", 2)[1]).when(zh, F.substring(n, 1, 1)).alias("family"), zh.alias("zh"))
    parts = rows.select(F.explode(F.array(F.struct(F.lit("g").alias("p"), F.col("given").alias("w"), "zh"), F.struct(F.lit("f").alias("p"), F.col("family").alias("w"), "zh"))).alias("s")).select("s.*").where("w <> ''").distinct()
    every = "p = 'f' and zh"
    shared = frozenset(r.w for r in parts.where(every).collect())
    rest = cut(parts.where(f"not ({every})"))
    shards = max(1, -(-rest.count() // most))
    out = []
    for k in range(shards):  # one shard at a time is at the driver
        got = rest.where(F.pmod(F.xxhash64("p", "w", "zh"), F.lit(shards)) == k).collect()
        pick = lambda p, z: frozenset(r.w for r in got if r.p == p and bool(r.zh) == z)  # noqa: B023, E731
        out.append(Parts(pick("g", False), pick("f", False), shared, pick("g", True), k > 0))
    return out


_FOUND = "kind string, value string, start bigint, end bigint"


def _batches(shared, column: int, resolve: bool):  # noqa: ANN001, ANN202
    """Rows of Arrow batches to those of the spans in a text column, beside the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(shared.value)
        for b in batches:
            row, kind, value, start, end = [], [], [], [], []
            for i, x in enumerate(b.column(column).to_pylist()):
                for s, e, k in (f.find(x) if resolve else sorted(f.spans(x))) if x else ():
                    row.append(i)
                    kind.append(k)
                    value.append(x[s:e])
                    start.append(s)
                    end.append(e)
            if row:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(kind), pa.array(value), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "kind", "value", "start", "end"])

    return run


def _settled_rows(rows: DataFrame, parts: list[Parts]) -> DataFrame:
    """(key, spans) of checkpointed (key, text): what all shards find, without overlaps."""
    sc = rows.sparkSession.sparkContext
    raw = None
    for p in parts:
        one = rows.mapInArrow(_batches(sc.broadcast(p), 1, False), f"key bigint, {_FOUND}")
        raw = one if raw is None else raw.unionByName(one)
    held = raw.groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("s"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"start": s, "end": e, "kind": k} for s, e, k in settled({(x["start"], x["end"], x["kind"]) for x in own})] for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=["key", "s"])

    return held.mapInArrow(settle, "key bigint, s array<struct<start:bigint,end:bigint,kind:string>>")


def find_personal(docs: DataFrame, roster: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_PARTS) -> DataFrame:
    """One row (key, kind, value, start, end) for each piece of personal information.

    ``kind`` is one of ``KINDS`` or ``ACCOUNT``; ``value`` is the exact text, start and end its
    place in code points. Null and empty texts give none; repeated rows repeat; a null key
    stays null; other columns are ignored. ``most`` bounds the shards of the dictionary.
    """
    parts = name_parts(roster, most=most)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if len(parts) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(parts[0])
        return rows.mapInArrow(_batches(shared, 1, True), f"key {kind}, {_FOUND}").withColumnRenamed("key", key)
    held = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    got = _settled_rows(held.select(F.col("row").alias("key"), "text"), parts).select(F.col("key").alias("row"), F.explode("s").alias("s"))
    value = F.substring("text", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    return held.join(got, "row").select(F.col("key").alias(key), "s.kind", value.alias("value"), "s.start", "s.end")


def _redacted(x: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not x:
        return x
    out, pos = [], 0
    for s, e, k in spans:
        out += [x[pos:s], f"[{k.upper()}]"]
        pos = e
    return "".join([*out, x[pos:]])


def redact(docs: DataFrame, roster: DataFrame, text: str = "text", most: int = MAX_PARTS) -> DataFrame:
    """``docs`` with a typed placeholder such as [EMAIL] for each value in ``text``.

    All other characters and columns stay as they are; null texts stay null.
    """
    parts = name_parts(roster, most=most)
    names = docs.columns
    at = names.index(text)

    def replaced(b: pa.RecordBatch, new: list[str | None]) -> pa.RecordBatch:
        cols = list(b.columns[: len(names)])
        cols[at] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=names)

    if len(parts) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(parts[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = finder(shared.value)
            for b in batches:
                yield replaced(b, [_redacted(x, f.find(x)) if x else x for x in b.column(at).to_pylist()])

        return docs.mapInArrow(run, docs.schema)
    free = "_row" + "_" * max(map(len, names))
    held = cut(docs.withColumn(free, F.monotonically_increasing_id()))
    got = _settled_rows(held.select(F.col(free).alias("key"), F.col(f"`{text}`").alias("text")), parts).select(F.col("key").alias(free), F.col("s").alias(f"{free}s"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.num_columns - 1).to_pylist()
            yield replaced(b, [_redacted(x, [(y["start"], y["end"], y["kind"]) for y in s or ()]) for x, s in zip(b.column(at).to_pylist(), own)])

    both = held.join(got, free, "left")
    return both.select(*[F.col(f"`{c}`") for c in names], f"{free}s").mapInArrow(put, docs.schema)
