"""Cleaning and text scalars."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lexmill.config import SPACES

# Letters that a wrong decoding has split in two, and what they were.
MOJIBAKE = (
    ("Ã¡", "á"), ("Ã¢", "â"), ("Ã£", "ã"), ("Ã©", "é"), ("Ãª", "ê"), ("Ã­", "í"), ("Ã³", "ó"),
    ("Ã´", "ô"), ("Ãµ", "õ"), ("Ãº", "ú"), ("Ã§", "ç"), ("Ã‡", "Ç"), ("Ã‰", "É"),
)

# The cleaning steps in their order, as (name, pattern, replacement).
CLEANING = (
    ("normalizar_quebras", r"\r\n?", "\n"),
    ("remover_caracteres_invalidos", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]", ""),
    ("normalizar_aspas_duplas", "[“”«»„]", '"'),
    ("normalizar_aspas_simples", "[‘’‚]", "'"),
    ("normalizar_hifens", "[‐‑‒]", "-"),
    ("remover_hifenizacao_quebra", r"(\p{L})-\n(\p{Ll})", "$1$2"),
    ("normalizar_espacos_especiais", r"[\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]", " "),
    ("remover_espacos_extras", r"[ \t]{2,}", " "),
    ("trim_fim_linhas", r"(?md)[ \t]+$", ""),
    ("trim_inicio_linhas", r"(?md)^[ \t]+", ""),
    ("remover_linhas_vazias_consecutivas", r"\n{3,}", "\n\n"),
)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")


@F.pandas_udf(StringType())
def _fold_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _folded(t))


#: The letters of Latin-1 that fold to another, in lower case.
_ACCENTED = "".join(c for c in map(chr, range(0xDF, 0x100)) if len(_folded(c)) == 1 and _folded(c) != c)


def fold(text: Column | str) -> Column:
    """Lower case without accents (U+0300 to U+036F of the decomposed text). Only texts with characters past Latin-1 travel to Python."""
    c = F.col(text) if isinstance(text, str) else text
    native = F.translate(F.lower(c), _ACCENTED, _folded(_ACCENTED))
    return F.coalesce(_fold_any(F.when(c.rlike(r"[^\x{00}-\x{FF}]"), c)), native)


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


#: Steps that put one character, or none, for every single character they match: a translation tells both.
_SINGLE = {
    "remover_caracteres_invalidos": ("".join(map(chr, [*range(9), 11, 12, *range(14, 32), 127, 0xFFFD])), ""),
    "normalizar_aspas_duplas": ("“”«»„", '"'),
    "normalizar_aspas_simples": ("‘’‚", "'"),
    "normalizar_hifens": ("‐‑‒", "-"),
    "normalizar_espacos_especiais": ("".join(map(chr, [0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000])), " "),
}


def _step(name: str, pattern: str, new: str, text: Column) -> tuple[Column, Column]:
    """(text after a cleaning step, number of its matches), with as few looks at the text as the step allows."""
    shrunk = lambda after: (F.length(text) - F.length(after)).cast("long")
    if name in _SINGLE:
        chars, one = _SINGLE[name]
        return F.translate(text, chars, one * len(chars)), shrunk(F.translate(text, chars, ""))
    if name == "normalizar_quebras":  # a return for each match
        return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, pattern, new)).otherwise(text), shrunk(F.replace(text, F.lit("\r"), F.lit("")))
    if name == "remover_hifenizacao_quebra":  # two characters less for each match
        after = F.when(F.contains(text, F.lit("-\n")), F.regexp_replace(text, pattern, new)).otherwise(text)
        return after, F.floor(shrunk(after) / 2).cast("long")
    cue = {"remover_espacos_extras": text.rlike("[ \t][ \t]"), "remover_linhas_vazias_consecutivas": F.contains(text, F.lit("\n\n\n"))}.get(name, text.rlike(pattern))
    return F.when(cue, F.regexp_replace(text, pattern, new)).otherwise(text), F.when(cue, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds cleaned text and its statistics: every step's matches are counted on the text as that step finds it."""
    # Below U+0300 every text is composed already: only the others travel to Python.
    given = F.col(text_col)
    df = docs.withColumn("__n", F.coalesce(nfc(F.when(given.rlike(r"[^\x{0000}-\x{02FF}]"), given)), given))
    repaired = F.col("__n")
    for wrong, right in MOJIBAKE:
        repaired = F.replace(repaired, F.lit(wrong), F.lit(right))
    df = df.withColumn("__t0", F.when(F.contains("__n", F.lit("Ã")), repaired).otherwise(F.col("__n")))
    counts = {"n_corrigir_encoding": F.when(given == F.col("__t0"), 0).otherwise(1).cast("long")}
    for k, (name, pattern, new) in enumerate(CLEANING):
        after, n = _step(name, pattern, new, F.col(f"__t{k}"))
        df = df.withColumn(f"__t{k + 1}", after)
        counts[f"n_{name}"] = n
    df = df.withColumn("cleaned", trim(F.col(f"__t{len(CLEANING)}")))
    lines = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    df = df.withColumns(counts | {"chars_before": F.length(text_col).cast("long"), "chars_after": F.length("cleaned").cast("long"), "lines_before": lines(given), "lines_after": lines(F.col("cleaned"))})
    return df.drop("__n", *(f"__t{k}" for k in range(len(CLEANING) + 1)))


def cleaning_totals(cleaned: DataFrame) -> DataFrame:
    """(operation, total) over the corpus, of operations that did something."""
    names = ["corrigir_encoding", *(n for n, _, _ in CLEANING)]
    sums = cleaned.agg(*(F.sum(f"n_{n}").alias(n) for n in names))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("operation", "total")).where("total > 0")


def count_tokens(text: Column) -> Column:
    """Default token count: runs of letters, runs of digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def token_counter(factory: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A counter of texts to use in place of `count_tokens`; the factory builds the tokenizer's own count once a task."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        one = _once(factory)
        return texts.map(lambda t: None if t is None else one(t))

    return count


def unit_counter(factory: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """The same for arrays of texts: an array of counts."""

    @F.pandas_udf(ArrayType(LongType()))
    def count(units: pd.Series) -> pd.Series:
        one = _once(factory)
        return units.map(lambda u: None if u is None else [one(t) for t in u])

    return count


_built: dict = {}


def _once(factory):
    if factory not in _built:
        _built[factory] = factory()
    return _built[factory]


#: Lists of lines further apart than so many edits are halved first; columns of a comparison are worked through in blocks of so many bits.
DIRECT_EDITS, BLOCK_BITS = 400, 4_096


def _common_lengths(x: list, y: list) -> np.ndarray:
    """The length of a longest common subsequence of x and each beginning of y, 0 to all of it.

    A row of the table is one integer whose unset bits are its steps up, so that a line of x
    costs a few operations on integers; blocks of columns hand their carries on, a bit a line.
    Lines that the other list lacks add nothing, nor does a line to a block without it that
    gets no carry: both are passed over.
    """
    shared = set(x) & set(y)
    columns, grows = np.array([k for k, line in enumerate(y) if line in shared], dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    met_at: dict = {}
    for k, line in enumerate(x):
        if line in shared:
            met_at.setdefault(line, []).append(k)
    carried: list[int] = []
    for at in range(0, len(columns), BLOCK_BITS):
        own = columns[at : at + BLOCK_BITS]
        full, places = (1 << len(own)) - 1, {}
        for k, column in enumerate(own):
            places[y[column]] = places.get(y[column], 0) | 1 << k
        bits_of = {k: bits for line, bits in places.items() for k in met_at[line]}
        carries, row, after = set(carried), full, []
        for k in sorted(carries | bits_of.keys()):
            met = row & bits_of.get(k, 0)
            total = row + met + (k in carries)
            if total >> len(own):
                after.append(k)
            row = (total & full) | (row - met)
        bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(own) // 8), "little"), dtype=np.uint8), bitorder="little")
        grows[own] = 1 - bits[: len(own)]
        carried = after
    return np.concatenate([[0], grows]).cumsum()


def _edit_path(x: list, y: list, most: int) -> list[tuple[str, str]]:
    """A shortest edit of x into y, `most` edits long, found by the furthest end on each diagonal for a growing number of edits."""
    far, ends = [0] * (2 * most + 3), []

    def from_above(d, k, known, zero):
        return k == -d or (k != d and known[zero + k - 1] < known[zero + k + 1])

    zero = most + 1
    for d in range(most + 1):
        ends.append(array("i", far[zero - d - 1 : zero + d + 2]))
        for k in range(-d, d + 1, 2):
            i = far[zero + k + 1] if from_above(d, k, far, zero) else far[zero + k - 1] + 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            far[zero + k] = i
            if i >= len(x) and i - k >= len(y):
                break
        else:
            continue
        break
    out, i, j = [], len(x), len(y)
    for d in range(len(ends) - 1, 0, -1):
        known, k = ends[d], i - j
        above = from_above(d, k, known, d + 1)
        bi = known[d + 1 + (k + 1 if above else k - 1)]
        bj = bi - (k + 1 if above else k - 1)
        while i > bi + (not above) and j > bj + above:
            i, j = i - 1, j - 1
            out.append(("=", x[i]))
        if above:
            j -= 1
            out.append(("+", y[j]))
        else:
            i -= 1
            out.append(("-", x[i]))
    out += [("=", t) for t in x[:i][::-1]]
    return out[::-1]


def _shortest_edit(x: list, y: list) -> list[tuple[str, str]]:
    """A shortest edit of x into y in space linear in both: two halves of x meet two parts of y where their common lengths add up to the most.

    Lists a few edits apart are compared at once; between unchanged lines, removals come first.
    """
    if not x or not y:
        return [*(("-", t) for t in x), *(("+", t) for t in y)]
    edits = len(x) + len(y) - 2 * int(_common_lengths(x, y)[-1])
    if edits <= DIRECT_EDITS:
        return _edit_path(x, y, edits)
    if len(x) == 1:
        at = y.index(x[0]) if x[0] in y else None
        return [("-", x[0]), *(("+", t) for t in y)] if at is None else [*(("+", t) for t in y[:at]), ("=", x[0]), *(("+", t) for t in y[at + 1 :])]
    half = len(x) // 2
    cut = int((_common_lengths(x[:half], y) + _common_lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
    out: list[tuple[str, str]] = []
    for unchanged, run in groupby(_shortest_edit(x[:half], y[:cut]) + _shortest_edit(x[half:], y[cut:]), lambda edit: edit[0] == "="):
        out += run if unchanged else sorted(run, key=lambda edit: edit[0], reverse=True)
    return out


def _diff_lines(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, line): "-" from a, "+" from b, "=" from both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _shortest_edit(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*(("=", t) for t in a[:head]), *middle, *(("=", t) for t in a[len(a) - tail :])]


def _diff_runs(a: str | None, b: str | None) -> list[tuple[str, str]]:
    lines = [t.split("\n") if t is not None else [] for t in (a, b)]
    return [(op, "\n".join(line for _, line in own)) for op, own in groupby(_diff_lines(*lines), lambda edit: edit[0])]


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Runs of removed, added and unchanged lines that turn one text into the other; a null text has no lines."""
    return pd.Series([[{"op": op, "text": t} for op, t in _diff_runs(a, b)] for a, b in zip(before, after, strict=True)], dtype=object)


def line_diffs(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, pos from 0, op, text): the runs of `line_diff` as rows. A task holds the runs of one pair at a time, however many it gets."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                runs = _diff_runs(*(batch.column(c)[n].as_py() for c in (1, 2)))
                keys = batch.column(0).take(pa.array([n] * len(runs), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(runs)), pa.int32()), *(pa.array([r[c] for r in runs], pa.string()) for c in (0, 1))], names=[key, "pos", "op", "text"])

    return pairs.select(key, before, after).mapInArrow(run, f"`{key}` {kind}, pos int, op string, text string")


def line_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, added, removed): lines that one text of a pair holds more often than the other, without regard to order."""
    side = lambda c, sign: pairs.select(key, F.explode(F.split(c, "\n")).alias("line"), F.lit(sign).alias("sign"))
    per = side(after, 1).unionByName(side(before, -1)).groupBy(key, "line").agg(F.sum("sign").alias("n"))
    more = per.groupBy(key).agg(F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))
    return pairs.select(key).join(more, key, "left").na.fill(0, ["added", "removed"])


def truncate(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd of (model, tokens_in, tokens_out) calls by a price list (model, usd_in, usd_out per million); an unknown model costs 0."""
    cost = (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6
    return calls.join(prices, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("usd_in", "usd_out")
