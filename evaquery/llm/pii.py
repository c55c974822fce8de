"""Personal data: identifiers found as written, and found again behind disguises.

The base pass matches e-mail addresses, IPv4 addresses, payment cards and phone
numbers on the text itself. The second pass runs finite-state rewrites over the text
(look-alike characters, spelled digits, at/dot disguises), each keeping for every
character it writes the source span it came from, detects on the rewritten text and
maps what it finds back to code points of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame

from .common import arrow_map, texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Cyrillic and Greek letters that look like a Latin one.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕѵԁԛԝҺһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABEKMHOPCTXaeopcyxijsvdqwHhABEZHIKMNOPTYXoavp"))
#: Other signs that stand for the ones identifiers are written with.
SIGNS = {"﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "·": ".", "−": "-", "﹣": "-", "﹘": "-", "⁻": "-", "﹢": "+", "⁺": "+"}
#: Code points that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits spelled in four languages.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
}
#: The numbers from ten on that are one word, and the tens that a unit may follow.
TEENS = {
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "zehn": 10, "elf": 11, "zwölf": 12, "dreizehn": 13, "vierzehn": 14, "fünfzehn": 15, "sechzehn": 16, "siebzehn": 17, "achtzehn": 18, "neunzehn": 19,
    "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15,
    "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
}
TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "zwanzig": 20, "dreißig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90,
    "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60,
}
#: Words for the sign in the middle of an address and for the dot, in the four languages.
AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
#: Endings that make "name at host.ending" an address, and words before "at" that do not name anyone.
ENDINGS = "com org net edu gov mil int info biz name io co ai app dev me tv eu de at ch fr es it nl be pt pl uk ie us ca mx ar br cl au nz in jp cn ru se no dk fi example test".split()
NOT_NAMES = (
    "a an the this that these those it its he she they we you i us them him her and or but is are was were be been am do does did has had have look looks looked looking see seen available "
    "found find hosted live lives lived meet met meeting visit visits online site website page pages home here there more read learn about out up down now not only also still even just back "
    "get got go went come work works worked working stay start started starting end arrive arrived held aimed order buy sold sale shop price priced all one once both others people team support"
).split()
#: Fewer spelled or written digits than this in a row are ordinary prose.
LEAST_DIGITS = 4

_alternatives = lambda words: "|".join(sorted(words, key=len, reverse=True))
_UNIT, _TEEN, _TEN = _alternatives(w for w, d in SPELLED.items() if d), _alternatives(TEENS), _alternatives(TENS)
_GERMAN = {u + "und" + t: TENS[t] + d for t in list(TENS)[8:16] for u, d in (("ein", 1), ("zwei", 2), ("drei", 3), ("vier", 4), ("fünf", 5), ("sechs", 6), ("sieben", 7), ("acht", 8), ("neun", 9))}
_NUMBER = {**SPELLED, **TEENS, **TENS, **_GERMAN}
_WORDS = rf"(?:{_TEN})(?:[\s-]{{1,2}}(?:(?:y|et)[\s-]{{1,2}})?(?:{_UNIT})\b)?|{_alternatives([*_GERMAN, *TEENS, *SPELLED])}"
_APART = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))
#: Words that call for a closer look; "un" is too common to, and never stands alone in a number.
_SIGNALS = frozenset(w.encode() for w in (*_NUMBER, *DOT_WORDS, "arroba", "arobase", "klammeraffe") if w != "un")
_GAP = r"[\s,-]{1,3}"
_RUN = re.compile(rf"\b(?:(?:plus|más){_GAP})?(?:{_WORDS}|[0-9]{{1,19}})(?:{_GAP}(?:{_WORDS}|{_alternatives(DOT_WORDS)}|[0-9]{{1,19}}))+\b", re.I)
_PART = re.compile(rf"plus|más|{_alternatives(DOT_WORDS)}|{_WORDS}|[0-9]+", re.I)
_AT_MARK = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_alternatives(AT_WORDS)}|@)\s{{0,3}}[\])}}>]\s{{0,3}}"
_AT_SURE = rf"(?:{_AT_MARK}|\s{{1,3}}(?:arroba|arobase|klammeraffe)\s{{1,3}})"
_DOT_MARK = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_alternatives(DOT_WORDS)}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}"
_DOT = rf"(?:{_DOT_MARK}|\s{{1,3}}dot\s{{1,3}})"
_DOT_ANY = rf"(?:{_DOT_MARK}|\s{{1,3}}(?:{_alternatives(DOT_WORDS)})\s{{1,3}})"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_LOCAL_PART = r"[A-Za-z0-9._%+-]{1,64}"
_ENDING = rf"(?:{_alternatives(ENDINGS)})(?![A-Za-z0-9-]|\.[A-Za-z0-9])"
_MARKED = re.compile(rf"{_AT_MARK}|{_DOT_MARK}", re.I)
#: A bare "at" before a host that is written plainly.
_BARE = re.compile(rf"\sat\s{{1,3}}(?:{_LABEL}\.){{1,9}}{_ENDING}", re.I)
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?:"
    rf"{_LOCAL_PART}(?:{_DOT_ANY}{_LOCAL_PART}){{0,4}}{_AT_SURE}{_LABEL}(?:(?:{_DOT_ANY}|\.){_LABEL})+"
    rf"|{_LOCAL_PART}(?:{_DOT}{_LOCAL_PART}){{0,4}}(?:\s{{1,3}}at\s{{1,3}}|@){_LABEL}(?:\.{_LABEL}){{0,9}}(?:{_DOT}{_LABEL})+"
    rf"|(?!(?:{_alternatives(NOT_NAMES)})\s){_LOCAL_PART}\s{{1,3}}at\s{{1,3}}(?:{_LABEL}\.){{1,9}}{_ENDING})",
    re.I,
)
_NUMBERS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT_ANY}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_MARKS = re.compile(rf"(?P<at>{_AT_SURE}|\s{{1,3}}at\s{{1,3}})|(?P<dot>{_DOT_ANY})", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """A local part is the run of its characters before an @, so each @ is looked at once."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", last if m else at + 1)
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of identifiers as written, by start then kind.

    Leftmost and non-overlapping for each kind; a match that fails its kind's test is
    consumed and dropped.
    """
    found = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


@cache
def character_table() -> dict[int, str]:
    """What single characters are rewritten to: digits of any script, full-width and
    mathematical letters by Unicode's own compatibility mapping, look-alikes and signs."""
    table = {ord(c): x for c, x in {**LOOK_ALIKES, **SIGNS}.items()}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469)):
        if (plain := unicodedata.normalize("NFKC", chr(code))).isascii() and len(plain) == 1:
            table[code] = plain
    for code in (*range(0x2010, 0x2016), *range(0x2000, 0x200B), 0xA0, 0x202F, 0x205F, 0x3000):
        table[code] = "-" if 0x2010 <= code <= 0x2015 else " "
    for code in range(0x80, 0x20000):
        if (digit := unicodedata.decimal(chr(code), -1)) >= 0:
            table[code] = str(digit)
    return table


@cache
def _odd_characters() -> re.Pattern[str]:
    return re.compile("[" + re.escape("".join(map(chr, character_table())) + INVISIBLE) + "]")


@cache
def _odd_set() -> tuple[frozenset[str], str]:
    odd = frozenset(map(chr, character_table())) | frozenset(INVISIBLE)
    return odd, "".join(sorted(c for c in odd if ord(c) < 256))


def has_odd_characters(text: str) -> bool:
    """Whether a character of the table occurs; texts within Latin-1 are told by a few byte searches."""
    if text.isascii():
        return False
    odd, narrow = _odd_set()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not odd.isdisjoint(text)
    return any(c in text for c in narrow)


def has_signals(text: str) -> bool:
    """Whether a bracketed at or dot, a spelled number, a word for at or dot, or a bare at before a host occurs."""
    if any(c in text for c in "[({<") and _MARKED.search(text):
        return True
    if _BARE.search(text):
        return True
    lower = text if text.isascii() else text.lower()
    return not _SIGNALS.isdisjoint(lower.encode("utf-8", "surrogatepass").lower().translate(_APART).split())


class Mapped:
    """A rewritten text in which every character knows the source span it came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start, self.end = array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern[str], to) -> None:
        """Puts ``to(match)`` for each match (None: as it is); its characters map to the whole match."""
        out, start, end, last = [], array("q"), array("q"), 0
        for m in pattern.finditer(self.text):
            if (new := to(m)) is None:
                continue
            i, j = m.span()
            out += (self.text[last:i], new)
            start += self.start[last:i] + array("q", [self.start[i]] * len(new))
            end += self.end[last:i] + array("q", [self.end[j - 1]] * len(new))
            last = j
        if last:
            self.text = "".join(out) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]

    def rewrite_within(self, outer: re.Pattern[str], inner: re.Pattern[str], to) -> None:
        """``rewrite`` for the matches of ``inner`` that lie in a match of ``outer``."""
        spans = [m.span() for m in outer.finditer(self.text)]
        inside = iter(spans)
        at = next(inside, None)

        def only(m: re.Match[str]) -> str | None:
            nonlocal at
            while at and at[1] <= m.start():
                at = next(inside, None)
            return to(m) if at and at[0] <= m.start() and m.end() <= at[1] else None

        if spans:
            self.rewrite(inner, only)

    def source(self, i: int, j: int) -> tuple[int, int]:
        return self.start[i], self.end[j - 1]


def _number(words: str) -> str:
    """The digits of a written or spelled number, of ten and a unit as well."""
    if words.isdigit():
        return words
    parts = [w for w in re.split(r"[\s-]+", words) if w not in ("y", "et")]
    return str(sum(_NUMBER[w] for w in parts))


def _digits(m: re.Match[str]) -> str | None:
    parts = [p.lower() for p in _PART.findall(m.group())]
    signs = {"plus": "+", "más": "+", **dict.fromkeys(DOT_WORDS, ".")}
    made = "".join(signs.get(p) or _number(p) for p in parts)
    spelled = any(p not in signs and not p.isdigit() for p in parts)
    return made if spelled and sum(c.isdigit() for c in made) >= LEAST_DIGITS else None


def undisguised(text: str) -> Mapped | None:
    """``text`` after the three rewrites, or None if they leave it as it is."""
    odd = has_odd_characters(text)
    if not odd and not has_signals(text):
        return None
    out = Mapped(text)
    if odd:
        table = character_table()
        out.rewrite(_odd_characters(), lambda m: table.get(ord(m.group()), ""))
    out.rewrite(_RUN, _digits)
    sign = lambda m: "@" if m["at"] else "."
    out.rewrite_within(_ADDRESS, _MARKS, sign)
    out.rewrite_within(_NUMBERS, _MARKS, sign)
    return None if out.text == text else out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the rewrites add), each by start then kind.

    A span found behind a disguise is added unless a base span of its kind covers it.
    """
    base = detect(text)
    out = undisguised(text)
    if out is None:
        return base, []
    starts, ends = ([[b[i] for b in base if b[2] == k] for k in range(len(KINDS))] for i in (0, 1))

    def covered(i: int, j: int, k: int) -> bool:
        """Base spans of a kind are in order and do not overlap, so only the last to start at or before ``i`` can."""
        at = bisect_right(starts[k], i) - 1
        return at >= 0 and j <= ends[k][at]

    seen = {(*out.source(i, j), k) for i, j, k in detect(out.text)}
    return base, sorted((s for s in seen if not covered(*s)), key=lambda s: (s[0], s[2], s[1]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, j, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts and digest of base spans, and all spans.

    n_email, n_ip, n_card and n_phone count the base spans; spans lists base and added
    ones as kind:start:end in code points; n_added counts the latter. A null text counts
    as empty and gives zeros, the digest of nothing and an empty list. Repeated rows
    repeat; a null doc_id stays null; an empty table gives no rows. Work is per row and
    linear in the text, so nothing is shuffled.
    """

    def rows(x: dict[str, list]) -> dict[str, list]:
        out = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in x["text"]:
            base, added = find(text)
            kinds = [k for _, _, k in base]
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + added))
            out["n_added"].append(len(added))
        return {"doc_id": x["doc_id"], **out}

    return arrow_map(texts(docs, id_col, text_col), rows, SCHEMA)


def masked(text: str, mask: str = "[{}]") -> str:
    """``text`` with every span, base or added, replaced by its kind; overlaps go together."""
    out, last = [], 0
    for i, j, k in sorted((s for part in find(text) for s in part), key=lambda s: (s[0], -s[1])):
        if i >= last:
            out += (text[last:i], mask.format(KINDS[k].upper()))
        last = max(last, j)
    return "".join(out) + text[last:]
