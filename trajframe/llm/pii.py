"""Personal data in whole texts, plain and disguised, with offsets into the source.

Plain identifiers are found by fixed patterns. For disguised ones a text passes through transducers,
each on the output of the one before: look-alike letters and full-width forms become ASCII one for one, ``(at)`` and
``[dot]`` become signs, spelled digits become digits (``dot`` between them a dot), and `` at `` ... `` dot `` become signs.
Each rewriting is recorded, so that what the same patterns find in the last text maps back through all of them to source
characters. Added spans never replace or overlap plain ones of their kind.

Nulls: null text counts as empty. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТУХасеорухіјѕԁһԛԝ", "ABEKMHOPCTYXaceopyxijsdhqw", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABEZHIKMNOPTYXoavp", strict=True))
#: Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_LETTERS = str.maketrans(LOOK_ALIKE | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
_ODD = re.compile("[" + "".join(LOOK_ALIKE) + "！-～]")
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELLED_RUN = re.compile(rf"(?i)\b(?:plus[ -]+)?{_DIGIT_WORD}(?:(?: dot |[ ,.-]{{1,3}}){_DIGIT_WORD}){{3,}}\b")
_SPELLED_TOKEN = re.compile(rf"(?i)(plus)[ -]+|({_DIGIT_WORD})|( dot )|[ ,.-]{{2,3}}|[,.]")
#: Groups of spelled digits or of one to three digits with dots between; four of them are an address.
_GROUP = rf"(?:{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD})*|[0-9]{{1,3}})"
_DOTTED_RUN = re.compile(rf"(?i)\b(plus[ -]+)?{_GROUP}(?:(?: dot |\.){_GROUP})+\b")
_DOTTED_TOKEN = re.compile(rf"(?i)({_DIGIT_WORD})|( dot )|[ -]")
_DOT = re.compile(r"(?i) dot |\.")
_BRACKETED = re.compile(r"(?i) ?[\[({<] ?(at|@|dot|\.) ?[\])}>] ?")
_AT = re.compile(r"(?i) at |@")
_BARE_DOMAIN = re.compile(r"(?i)[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+")
_BARE_IP = re.compile(r"(?i)(?<![A-Za-z0-9])[0-9]{1,3}(?:(?: dot |\.)[0-9]{1,3}){3}(?![0-9])")
_BARE_SIGN = re.compile(r"(?i) (at|dot) ")
_HINT = re.compile(r"(?i) dot |[\[({<] ?(?:at|@|dot|\.) ?[\])}>]")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from within as well, and a match ends where a run ends.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @: every start that fails for an @ fails for all later starts before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def identifiers(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the plain patterns; matches that fail their check are dropped."""
    found = {"email": emails(text)}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text) if m.end() - m.start() >= 16)
    found["card"] = [s for s, digits in cards if 16 <= len(digits) <= 19 and luhn(digits)]
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []
    return found


Edit = tuple[int, int, str]


def _sign(m: re.Match) -> str:
    return "@" if m[1].lower() in ("at", "@") else "."


def _bracketed(t: str) -> list[Edit]:
    return [(*m.span(), _sign(m)) for m in _BRACKETED.finditer(t)]


def _spelled(t: str) -> list[Edit]:
    """Spelled digits; in addresses of four groups nothing stays between the digits of a group."""
    out, taken = [], []
    for run in _DOTTED_RUN.finditer(t):
        if not run[1] and len(_DOT.findall(run[0])) == 3:
            edits = [(*m.span(), SPELLED[m[1].lower()] if m[1] else "." if m[2] else "") for m in _DOTTED_TOKEN.finditer(t, *run.span())]
            if any(new.isdigit() for *_, new in edits):
                out += edits
                taken.append(run.span())
    for run in _SPELLED_RUN.finditer(t):
        if not any(a < run.end() and run.start() < b for a, b in taken):
            out += [(*m.span(), "+" if m[1] else SPELLED[m[2].lower()] if m[2] else "." if m[3] else " ") for m in _SPELLED_TOKEN.finditer(t, *run.span())]
    return sorted(out)


def _bare(t: str) -> list[Edit]:
    """`` at `` and `` dot `` in what reads as an address; dots of the local part count as well.

    A bare `` at `` is a sign only next to a bare `` dot ``: in "meet at example.com" it is a word.
    """
    out, end = [], 0
    for m in _AT.finditer(t):
        domain = _BARE_DOMAIN.match(t, m.end()) if m.start() >= end else None
        start = m.start()
        while domain:
            at = start
            while at > end and t[at - 1] in _LOCAL:
                at -= 1
            if at == start:
                start = at + 5 if start < m.start() else start  # nothing stands before this dot
                break
            start = at
            if at - 5 < end or t[at - 5 : at].lower() != " dot ":
                break
            start = at - 5
        if domain and start < m.start():
            signs = list(_BARE_SIGN.finditer(t, start, domain.end()))
            if any(x[1].lower() == "dot" for x in signs):
                out += [(*x.span(), _sign(x)) for x in signs]
                end = domain.end()
    taken = [e[0] for e in out]
    for run in _BARE_IP.finditer(t):
        k = bisect_right(taken, run.start() - 1)
        if k == len(taken) or taken[k] >= run.end():
            out += [(*m.span(), _sign(m)) for m in _BARE_SIGN.finditer(t, *run.span())]
    return sorted(out)


class Layer:
    """A text under edits, with a way back: pieces are (start in it, start before, length before, own length)."""

    def __init__(self, text: str, edits: list[Edit]):
        self.pieces, parts, at, own = [], [], 0, 0
        for start, end, new in edits:
            for piece, before in ((text[at:start], start - at), (new, end - start)):
                self.pieces.append((own, at, before, len(piece)))
                parts.append(piece)
                own, at = own + len(piece), at + before
        self.pieces.append((own, at, len(text) - at, len(text) - at))
        self.text = "".join([*parts, text[at:]])
        self.starts = [p[0] for p in self.pieces]

    def back(self, span: Span) -> Span:
        """Characters before the edits of a span; a rewritten piece counts whole."""
        ends = []
        for at, last in ((span[0], False), (span[1] - 1, True)):
            own, before, n, size = self.pieces[bisect_right(self.starts, at) - 1]
            ends.append(before + (at - own) + last if n == size else before + n * last)
        return ends[0], ends[1]


class Normalised:
    """A text under all rewritings, one after the other; ``changed`` are the source characters where one begins."""

    def __init__(self, text: str):
        self.text = text.translate(_LETTERS) if _ODD.search(text) else text
        self.changed = [m.start() for m in _ODD.finditer(text)]
        self.layers: list[Layer] = []
        for stage in (_bracketed, _spelled, _bare):
            edits = stage(self.text)
            if edits:
                self.changed += [self.back((start, end))[0] for start, end, _ in edits]
                self.layers.append(Layer(self.text, edits))
                self.text = self.layers[-1].text
        self.changed.sort()

    def back(self, span: Span) -> Span:
        """Source characters of a span."""
        for layer in reversed(self.layers):
            span = layer.back(span)
        return span


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added ones, by kind."""
    base, added = identifiers(text), {k: [] for k in KINDS}
    if not (_HINT.search(text) or (not text.isascii() and _ODD.search(text)) or _SPELLED_RUN.search(text) or any(len(_DOT.findall(m[0])) == 3 for m in _DOTTED_RUN.finditer(text))):
        return base, added
    norm = Normalised(text)
    for kind, spans in identifiers(norm.text).items():
        for start, end in map(norm.back, spans):
            k = bisect_right(norm.changed, start - 1)
            touched = k < len(norm.changed) and norm.changed[k] < end
            if touched and not any(a < end and start < b for a, b in base[kind]):
                added[kind].append((start, end))
    return base, added


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> and base_sha256 of plain spans, spans of all, n_added) for every document."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = find(text)
                both = {k: base[k] + added[k] for k in KINDS}
                out.append((doc_id, *(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(map(len, added.values()))))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (5, 6) else pa.int64()) for k, c in enumerate(cols)], [x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
