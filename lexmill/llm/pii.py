"""Personal data in texts, also where it is disguised, as spans of the source text.

A transducer rewrites a text into a plain form and keeps, for every character written,
the source span it came from: look-alike letters become ASCII, invisible characters go,
spelled digits become digits, and "(at)" or "dot" become the sign. The same detectors run
on the source and on the plain form; a hit there is mapped back through the spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always starts where a run of digits starts, so a run is never tried twice.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like ASCII ones.
LOOKALIKES = dict(
    zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһАΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABESIJKMHOPCTYXaesijopcyxdqwhAABEZHIKMNOPTYXoavp", strict=True)
)
INVISIBLE = "­​‌‍⁠﻿"
# Digits spelled in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        ("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for w in words.split()
}
# Words of prose that are endings of "name at host dot it" only where no further word follows.
PROSE = "a an and are as at be but by can do for from had has have he her his how if in into is it its me my no not of off on or our she so than that the their then there they this to up was we were what when where which who will with you"

# Words that stand before "at" in prose and are no names, and words before "one dot two" that make it no address.
BEFORE_AT = frozenset(
    f"{PROSE} look looks looked looking work works worked working sit sits sat stay stays stayed live lives lived living see sees saw seen meet meets met start starts started arrive arrives arrived stop stops stopped stand stands stood aim aims aimed laugh laughs laughed smile smiles smiled shout point points pointed good best bad better worst now here home all only even just still not least most first last once again day night time place shop buy bought found find call called wait waits waited study studies studied play plays played stare stared bei um au aux chez en".split()
)
BEFORE_OCTETS = frozenset("version versions release releases build update section sections chapter chapters article clause step point paragraph figure table kapitel abschnitt fassung versión capítulo sección artículo chapitre".split())

_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"\s{0,3}[\(\[\{<]\s{0,3}", r"\s{0,3}[\)\]\}>]\s{0,3}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPELLED_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\s{{1,3}}dot\s{{1,3}})"
_DOT = rf"(?:\.|{_OPEN}(?:dot|\.){_CLOSE}|\s{{1,3}}dot\s{{1,3}})"
_ENDING = rf"(?:(?!(?:{PROSE.replace(' ', '|')})\b)[A-Za-z]{{2,63}}\b|[A-Za-z]{{2}}\b(?!\s+\w))"
#: Up to three digits of an address, spelled or not, and the spelled dot between such.
_OCTET = rf"(?:{_DIGIT}|[0-9]{{1,3}})(?:[\s,-]{{1,3}}(?:{_DIGIT}|[0-9])){{0,2}}"
_DOT_WORD = rf"(?:{_OPEN}dot{_CLOSE}|\s{{1,3}}dot\s{{1,3}})"
#: The characters that a rewrite changes.
_CHARS = re.compile(rf"[{INVISIBLE}{''.join(LOOKALIKES)}！-～\U0001d400-\U0001d7ff]")
_SIGNS = re.compile(
    rf"\b(?P<octets>{_OCTET}(?:{_DOT_WORD}{_OCTET}){{3}})\b"
    rf"|(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9._%+-])\s{{1,3}}(?:at|@)\s{{1,3}}(?={_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}{_ENDING}))"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|(?<=[A-Za-z0-9-])\s{{1,3}}dot\s{{1,3}}(?={_ENDING}|[0-9]{{1,3}}\b|{_LABEL}\s{{1,3}}dot\s{{1,3}}|{_LABEL}(?:\s{{1,3}}at\s{{1,3}}|{_OPEN}at{_CLOSE}|@)))"
    rf"|(?P<plus>\bplus\s{{1,3}}(?=[0-9]|(?:{_DIGIT})\b))"
    rf"|\b(?P<digits>(?:{_DIGIT}|[0-9]+)(?:[\s,-]{{1,3}}(?:{_DIGIT}|[0-9]+)){{3,}})\b",
    re.IGNORECASE,
)
_ITEM = re.compile(rf"{_DIGIT}|[0-9]+", re.IGNORECASE)
_SPELLED_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_SPELLED_DOT}{_ENDING}", re.IGNORECASE)
_NAME_MARK = re.compile(r"[0-9._%+-]")
#: For the quick look, on folded text: signs in brackets, a spelled dot, and "at" before a label with a dot after it; "plus" before a digit.
_PLUS = re.compile(rf"plus\s{{1,3}}(?:[0-9]|(?:{_DIGIT.casefold()})\b)")
_CUE = re.compile(r"[\(\[\{<]\s{0,3}(?:at|dot|@|\.)|\sdot\s|\s(?:at|@)\s{1,3}[a-z0-9-]{1,63}(?:\.|\s{0,3}[\(\[\{<])")
_WORDS, _SPELLED = re.compile(r"[^\W_]+"), frozenset(w.casefold() for w in DIGIT_WORDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: every match holds one @, and its local part is the run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The identifiers of each kind in a text, as code point ranges."""
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return {"email": _emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones}


@cache
def _plain_char(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
        flat = unicodedata.normalize("NFKC", c)
        return flat if len(flat) == 1 and flat.isascii() else c
    return c


class Rewritten:
    """A text under rewriting, with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of ordered ranges; all characters of one get the range's source span."""
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[a]] * len(new) if new else self.start[at:a]
            end += self.end[at:a] + [self.end[b - 1]] * len(new) if new else self.end[at:a]
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def _spelled(digits: str) -> bool:
    return any(c in DIGIT_WORDS for c in re.findall(r"[^\W\d_]+", digits.lower()))


def _may_hold_signs(text: str) -> bool:
    """A quick look that passes whatever `_SIGNS` would change: a spelled sign before what must follow it, or a spelled digit beside another."""
    folded = text.casefold()
    if _CUE.search(folded) or "plus" in folded and _PLUS.search(folded):
        return True
    words = _WORDS.findall(folded)
    if _SPELLED.isdisjoint(words):
        return False
    item = [w in _SPELLED or w.isdigit() for w in words]
    return any(a and b and c for a, b, c in zip(item, item[1:], item[2:], strict=False))


def changes(text: str) -> bool:
    """Whether a rewrite can show anything: one of its characters or signs is there, or a spelled digit in a run of them."""
    if _CHARS.search(text):
        return True
    return _may_hold_signs(text) and any(m.lastgroup != "digits" or _spelled(m[0]) for m in _SIGNS.finditer(text))


def _is_prose(text: str, m: re.Match) -> bool:
    """Whether a bare "at", or spelled octets, are prose rather than a disguise.

    A bare "at" is a sign if the host's last dot is spelled too, or if the name before it
    has a mark or digit inside, and if that name is no common word.
    """
    if m.lastgroup == "at" and m[0].strip().lower() == "at":
        before = text[max(0, m.start() - 64) : m.start()].split()
        name = before[-1] if before else ""
        return name.lower() in BEFORE_AT or not (_NAME_MARK.search(name[1:]) or _SPELLED_HOST.match(text, m.end()))
    if m.lastgroup == "octets":
        before = text[max(0, m.start() - 32) : m.start()].split()
        return bool(before) and before[-1].lower().strip(".,:;(") in BEFORE_OCTETS
    return False


def rewrite(text: str) -> Rewritten:
    """Letters first, then signs and spelled digits."""
    out = Rewritten(text)
    out.replace([(k, k + 1, "" if c in INVISIBLE else _plain_char(c)) for k, c in enumerate(text) if not c.isascii() and (c in INVISIBLE or _plain_char(c) != c)])
    edits = []
    for m in _SIGNS.finditer(out.text):
        kind = m.lastgroup
        if _is_prose(out.text, m):
            continue
        if kind == "digits":
            spelled = _spelled(m[0])
            for item in _ITEM.finditer(m[0]):
                word = item[0].lower()
                a, b = m.start() + item.start(), m.start() + item.end()
                if item.end() < len(m[0]):  # up to the next item: the run becomes one number
                    b = m.start() + _ITEM.search(m[0], item.end()).start() if spelled else b
                edits.append((a, b, DIGIT_WORDS.get(word, word)))
        elif kind == "octets":
            parts = [_ITEM.findall(part) for part in re.split(_DOT_WORD, m[0], flags=re.IGNORECASE)]
            edits.append((m.start(), m.end(), ".".join("".join(DIGIT_WORDS.get(i.lower(), i) for i in items) for items in parts)))
        else:
            edits.append((m.start(), m.end(), {"at": "@", "dot": ".", "plus": "+"}[kind]))
    out.replace(edits)
    return out


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans found only in the plain form: those that meet no base span of their kind."""
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not changes(text):
        return added
    plain = rewrite(text)
    for kind, spans in find(plain.text).items():
        taken = base[kind]
        starts = [s for s, _ in taken]
        for a, b in spans:
            span = plain.start[a], plain.end[b - 1]
            k = bisect_left(starts, span[1])
            if not (k and taken[k - 1][1] > span[0]):
                added[kind].append(span)
    return added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of emails, IP addresses, card and phone numbers of every whole text.

    Returns doc_id, base and added: arrays of (kind, start, end) by kind, then start, in
    code points with an exclusive end. `added` holds what only the plain form shows. Null
    and empty texts have no spans, repeated rows repeat, a null id stays null, an empty
    table gives an empty result and further columns are ignored. Work is linear in a text.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, added = [], []
                for text in part.column(1).to_pylist():
                    found = find(text or "")
                    more = disguised(text or "", found)
                    for out, spans in ((base, found), (added, more)):
                        out.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in sorted(spans[k])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], names=["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per kind of the base spans, their digest, and all spans as one string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind, spans):
        return F.filter(spans, lambda s: s["kind"] == kind)

    everything = F.concat(*(F.array_sort(F.concat(of(k, F.col("base")), of(k, F.col("added")))) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(of(k, F.col("base"))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
        *(F.size(of(k, F.col("added"))).cast("long").alias(f"n_added_{k}") for k in KINDS),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span, plain or disguised, replaced by its kind in angle brackets.

    Spans of different kinds that overlap are replaced as one, by the kind of the first. A
    null text stays null and an empty one empty; repeated rows repeat, null ids stay, an
    empty table gives an empty result, and further columns stay as they are.
    """

    def masked(text: str) -> str:
        base = find(text)
        more = disguised(text, base)
        spans = sorted((a, b, k) for found in (base, more) for k, own in found.items() for a, b in own)
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = pa.array([None if t is None else masked(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), new)

    return docs.mapInArrow(run, docs.schema)
