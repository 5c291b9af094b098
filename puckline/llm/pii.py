"""Operator 2, PII: offset-preserving deobfuscation.

Identifiers (email, ip, card, phone) are found in the text as it stands; these
are the base spans.  Two transducers then rewrite the text: one folds
homoglyphs and drops invisible characters, the other writes spelled digits and
at/dot/plus disguises as the characters they stand for.  Each keeps its edits,
so that identifiers found in the text after each of them are mapped back to the
characters of the source; those that overlap no earlier span of their kind are
added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import ship

KINDS = ("email", "ip", "card", "phone")

# Each pattern matches exactly what the plain one does (see the tests); runs
# are taken whole, so that a long run is not tried again from each character.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, end, index of the kind


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def find_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    found: list[Span] = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "Cyrillic": "аa вB еe кk мM нH оo рp сc тT уy хx АA ВB ЕE КK МM НH ОO РP СC ТT ХX ѕs іi јj ԁd һh ԛq ԝw ӏl ЅS ІI ЈJ",
    "Greek": "αa οo νv ρp τt υu χx ιi κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "other": "ⅼl ℓl ․. 。. ｡. ‧. ‐- ‑- ‒- –- —- −- ﹣- ﹫@ ➕+ ﬁfi",
}
# Characters that show nothing.
_INVISIBLE = "­​‌‍‎‏⁠﻿"


@cache
def _homoglyphs() -> dict[str, str]:
    """Character -> ASCII text it stands for.  Beyond the look-alikes above:
    compatibility forms of one ASCII character (full-width, mathematical,
    circled, spaces) and decimal digits of any script."""
    table = {}
    for c in map(chr, range(0x80, 0x20000)):
        flat = unicodedata.normalize("NFKC", c)
        if len(flat) == 1 and " " <= flat <= "~":
            table[c] = flat
        elif (d := unicodedata.decimal(c, None)) is not None:
            table[c] = str(d)
    for pairs in _LOOKALIKES.values():
        table.update((p[0], p[1:]) for p in pairs.split())
    table.update(dict.fromkeys(_INVISIBLE, ""))
    return table


@cache
def _homoglyph_run() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(_homoglyphs()))) + "]")


# The digits' names by language.
_DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGITS = {name: str(i) for names in _DIGIT_NAMES.values() for i, name in enumerate(names.split())}
_DIGITS |= {"oh": "0", "une": "1", "ein": "1", "zwo": "2"}
_NAME = "|".join(sorted(_DIGITS, key=len, reverse=True))
_REPEAT = {"double": 2, "triple": 3}
_ITEM = rf"(?:(?:double|triple)\s{{1,3}})?(?:{_NAME})"
#: Between two spelled digits.
_GAP = r"[\s,;/_-]{1,3}"
_OPEN, _CLOSE = r"\s{0,4}[\(\[\{<]\s{0,4}", r"\s{0,4}[\)\]\}>]\s{0,4}"
_DOT_NAME, _AT_NAME = "dot|punkt|point|punto|period", "at|arroba|arobase|ät"
_DOT_BRACKETED = rf"{_OPEN}(?:{_DOT_NAME}|\.){_CLOSE}"
_DOT_BARE = r"\s{1,4}(?:dot|punkt|punto)\s{1,4}"
_DOT_IN = rf"(?:{_DOT_BRACKETED}|{_DOT_BARE})"
# Top-level domains that are no common words; only they make "x at y dot z" and "[at] y . z" an address.
_TOP = ("com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|tv|eu|de|fr|es|uk|ca|ch|nl|se|dk|fi|pl|pt|cz|hu|gr|ie|br|mx|ar|cl|jp|cn|"
        "kr|ru|ua|au|nz|za|tr|example|test|invalid")
_ENDS = rf"(?:{_TOP})(?![A-Za-z0-9-])"

_SPELLED = re.compile(rf"(?<!\w){_ITEM}(?:{_GAP}{_ITEM})*(?!\w)", re.I)
_ITEMS = re.compile(_ITEM, re.I)
_DOT = re.compile(rf"{_DOT_IN}(?=[A-Za-z0-9])", re.I)
_AT = re.compile(
    rf"{_OPEN}(?:{_AT_NAME}|@){_CLOSE}(?=[A-Za-z0-9])"
    rf"|\s{{1,4}}(?:at|arroba)\s{{1,4}}(?=[A-Za-z0-9-]+(?:{_DOT_BARE}[A-Za-z0-9-]+)*(?:{_DOT_BRACKETED}[A-Za-z]|{_DOT_BARE}{_ENDS}))"
    r"|\s{0,4}@\s{0,4}(?=[A-Za-z0-9])", re.I)
_AT_BRACKETED = re.compile(rf"{_OPEN}(?:{_AT_NAME}|@){_CLOSE}(?=[A-Za-z0-9])", re.I)
_SPACED_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:\s{{0,4}}\.\s{{0,4}}[A-Za-z0-9-]+)*\s{{0,4}}\.\s{{0,4}}{_ENDS}", re.I)
_SPACED_DOT = re.compile(r"\s+\.\s*|\.\s+")
_PLUS = re.compile(rf"(?<!\w)plus\s{{1,3}}(?=[0-9]|\(|(?:{_NAME})(?!\w))", re.I)
# What a disguise but a spelled digit cannot do without, for a quick look.
_BRACKETED = re.compile(rf"[(\[{{<]\s{{0,4}}(?:{_AT_NAME}|@|{_DOT_NAME}|\.)\s{{0,4}}[)\]}}>]", re.I)
_NAMED = re.compile(r"(?<!\w)(?:dot|punkt|punto|plus)(?!\w)", re.I)
_SPACED_AT = re.compile(r"@\s|(?<=\s)@")


def _has_disguise(text: str) -> bool:
    """Whether anything that ``_undisguise`` rewrites can be in the text: a spelled
    digit, be it a single one, or what one of the other patterns cannot do without."""
    if _SPELLED.search(text):
        return True
    if any(c in text for c in "([{<") and _BRACKETED.search(text):
        return True
    low = text.lower().replace("ſ", "s")
    if any(w in low for w in ("dot", "punkt", "punto", "plus")) and _NAMED.search(text):
        return True
    return "@" in text and _SPACED_AT.search(text) is not None


def _plain(name: str) -> str:
    """The lower-cased name of a digit, with letters that re.I takes for i and s."""
    return name.lower().replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


class Tape:
    """A rewritten text with the edits that lead back to its source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        out, done, size = [], 0, 0
        self.at: list[int] = []  # where each edit's replacement starts in the new text
        self.edits: list[tuple[int, int, int]] = []  # source start, source end, replacement's length
        for start, end, new in edits:
            out += [source[done:start], new]
            size += start - done
            self.at.append(size)
            self.edits.append((start, end, len(new)))
            size += len(new)
            done = end
        self.text = "".join([*out, source[done:]])

    def _origin(self, position: int) -> tuple[int, int]:
        """Source characters that one new character stands for."""
        i = bisect_right(self.at, position) - 1
        while i >= 0:
            start, end, length = self.edits[i]
            past = position - self.at[i] - length
            if past >= 0:
                return end + past, end + past + 1
            if position >= self.at[i] and length:
                return start, end
            i -= 1
        return position, position + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._origin(start)[0], self._origin(end - 1)[1]


def _fold_homoglyphs(text: str) -> Tape | None:
    table = _homoglyphs()
    if text.isascii() or table.keys().isdisjoint(text):
        return None
    edits = [(m.start(), m.end(), table[m[0]]) for m in _homoglyph_run().finditer(text)]
    return Tape(text, edits) if edits else None


def _undisguise(text: str) -> Tape | None:
    """Spelled digits, at, dot and plus; edits that overlap an earlier one are left out."""
    if not _has_disguise(text):
        return None
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED.finditer(text):
        items = [(x.start(), x.end(), _plain(x[0])) for x in _ITEMS.finditer(text, m.start(), m.end())]
        before, after = text[:m.start()][-8:], text[m.end():m.end() + 8]
        if len(items) < 2 and not (re.search(r"[0-9.+)\]>-]\s*$|dot\s*$|plus\s*$", before, re.I)
                                   or re.match(r"\s*[0-9.([<-]|\s*dot\b", after, re.I)):
            continue
        last = None
        for start, end, name in items:
            if last is not None:
                edits.append((last, start, ""))
            *times, digit = name.split()
            edits.append((start, end, _DIGITS[digit] * (_REPEAT[times[0]] if times else 1)))
            last = end
    for pattern, new in ((_PLUS, "+"), (_AT, "@"), (_DOT, ".")):
        edits += [(m.start(), m.end(), new) for m in pattern.finditer(text) if m[0] != new]
    for m in _AT_BRACKETED.finditer(text):  # a domain that is spelled with spaces around its dots
        domain = _SPACED_DOMAIN.match(text, m.end())
        if domain:
            edits += [(x.start(), x.end(), ".") for x in _SPACED_DOT.finditer(text, domain.start(), domain.end())]
    kept: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return Tape(text, kept) if kept else None


def detect(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, both by start, then kind.

    Spans are code points, end exclusive.  A null or empty text has none.
    """
    if not text:
        return [], []
    base = find_spans(text)
    tapes: list[Tape] = []
    for rewrite in (_fold_homoglyphs, _undisguise):
        tape = rewrite(tapes[-1].text if tapes else text)
        if tape:
            tapes.append(tape)
    if not tapes:
        return base, base
    taken = [sorted((s[0], s[1]) for s in base if s[2] == k) for k in range(len(KINDS))]
    found = list(base)
    # What an earlier tape shows stays, whatever a later one makes of its characters.
    for n in range(len(tapes)):
        added = []
        for start, end, kind in find_spans(tapes[n].text):
            for tape in reversed(tapes[:n + 1]):
                start, end = tape.back(start, end)
            i = bisect_right(taken[kind], (start, end))
            if all(end <= a or start >= b for a, b in taken[kind][max(0, i - 1):i + 1]):
                added.append((start, end, kind))
        for start, end, kind in added:
            taken[kind].append((start, end))
        for spans in taken:
            spans.sort()
        found += added
    return base, sorted(set(found), key=lambda s: (s[0], s[2], s[1]))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spelled, base_counts = [], [], []
        for text in batch.column("text"):
            base, spans = detect(text.as_py())
            for kind, column in enumerate(counts):
                column.append(sum(s[2] == kind for s in spans))
            digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
            spelled.append(spell(spans))
            base_counts.append(len(base))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
             pa.array(spelled, pa.string()), pa.array(base_counts, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Identifiers of every row of ``docs`` (doc_id, text).

    Returns doc_id, the number of spans of each kind (base and added ones),
    base_sha256 (of the base spans alone), spans (all, as kind:start:end) and
    n_base (the number of base spans).  A null text is an empty one; repeated
    rows and null ids give a row each; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, f"doc_id long, {counts}, base_sha256 string, spans string, n_base long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind]}>"]
            done = end
    return "".join([*out, text[done:]])
