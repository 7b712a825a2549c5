"""Quality rules on DataFrame functions alone: base counts, and divergence from a language's own histograms.

Every text has a histogram of character classes and one of its language's common words.
The reference of a language is the mean histogram of its texts that pass the base rules
and the length guard, over the whole corpus. A text whose Jensen-Shannon distance to its
reference is too large in either histogram is not kept; texts below the guard are too
short to tell and pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch

SPACE = r"[\x20\x09-\x0D]+"
# Common words of the languages with a reference of their own; all others share one.
COMMON_WORDS = {
    "en": "the of and to in a is that for with".split(),
    "de": "der die und in den von zu das mit ist".split(),
    "fr": "de la le et les des en un une est".split(),
    "es": "de la que el en y a los las un".split(),
    "other": "the de la in a en un der die que".split(),
}
# Classes of characters; the rest of a text is the class of its own.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:!?", "quote": r"'\"()\[\]\-", "symbol": r"#*$%&|<>@=+/\\^_~`{}", "latin": r"\x{00A0}-\x{024F}"}
#: Below so many words a histogram says too little.
GUARD_WORDS = 100
#: Largest distances (0 to 1) at which a text is kept, and what sampling adds to them: that over the root of n_words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, NOISE = 0.22, 0.20, 0.6
#: Bits that hold a word's position beside the hash of its window; longer texts are compared word by word.
POSITION_BITS = 24


def _count_of(text: Column, characters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _covered(positions: Column) -> Column:
    """Number of words in the union of the 3-word windows at these ascending positions."""
    own = F.transform(positions, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(positions, k + 1) - p), F.lit(3)))
    return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that occur twice or more in the text.

    Windows are sorted as numbers of a 40-bit hash and a 24-bit position, so equal ones
    stand side by side. Neighbours with one hash are compared by their words; should two
    differ, or the positions not fit, that text is sorted by the words themselves.
    """
    low = (1 << POSITION_BITS) - 1
    words, sorted_, near = F.col("words"), F.col("sorted"), F.col("near")
    same = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    window = lambda i: F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    n = F.col("n_words").cast("int")
    starts = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    coded = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    behind = F.filter(sorted_, lambda x, k: F.coalesce(same(x, F.get(sorted_, k - 1)), F.lit(False)))
    near_by = F.filter(sorted_, lambda x, k: F.coalesce(same(x, F.get(sorted_, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_, k + 1)), F.lit(False)))
    clash = F.exists(F.transform(near, lambda x, k: same(x, F.get(near, k - 1)) & (window(place(x)) != window(place(F.get(near, k - 1))))), lambda x: F.coalesce(x, F.lit(False)))
    by_words = F.sort_array(F.transform(starts, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.cast("int").alias("i"))))
    slow = F.col("by_words")
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    slow_near = F.filter(slow, lambda x, k: equal(x, F.get(slow, k - 1)) | equal(x, F.get(slow, k + 1)))
    fits = (n <= low) & ~F.col("clash")
    # Each array that a lambda looks into is a column of its own: else it would be built anew for every element.
    return (
        df.withColumn("sorted", F.sort_array(coded))
        .withColumn("behind", F.size(behind))  # most texts repeat no window and need no second look
        .withColumn("near", F.when(F.col("behind") > 0, near_by).otherwise(F.slice("sorted", 1, 0)))
        .withColumn("clash", clash)
        .withColumn("by_words", F.when(~fits, by_words))
        .withColumn("at", F.sort_array(F.when(fits, F.transform(near, place)).otherwise(F.transform(slow_near, lambda x: x["i"]))))
        .withColumn("n_repeat_words", _covered(F.col("at")))
        .drop("sorted", "behind", "near", "clash", "by_words", "at")
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms of every whole text, without a shuffle."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("other"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(lang.isin(*COMMON_WORDS), lang).otherwise("other").alias("lang"),
        text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "rest": F.regexp_replace("text", "[a-z]+", ""),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")
    # Each class is counted by taking it out, so the next one sees only what is left.
    df = df.withColumn("__lower", F.length("text") - F.length("rest"))
    for name in sorted((n for n in CLASSES if n != "lower"), key=lambda n: n != "space"):
        left = F.regexp_replace("rest", f"[{CLASSES[name]}]+", "")
        df = df.withColumn("left", left).withColumn(f"__{name}", F.length("rest") - F.length("left")).withColumn("rest", F.col("left"))
        if name == "space":
            df = df.withColumn("n_symbols", _count_of(F.col("rest"), "#*$%&|<>").cast("long"))
    df = df.withColumn("word_chars", (F.length("text") - F.col("__space")).cast("long")).drop("left")
    df = _with_repeats(df)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    classes = [F.col(f"__{name}").cast("double") for name in CLASSES]
    df = df.withColumn("classes", F.array(*classes, F.length("text").cast("double")))
    df = df.withColumn("spaced", F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))).drop("text", "words", "rest", *(f"__{name}" for name in CLASSES))
    common = [F.lit(None).cast("string")] * 10
    for name, listed in COMMON_WORDS.items():
        common = [F.when(F.col("lang") == name, f" {w} ").otherwise(c) for w, c in zip(listed, common, strict=True)]
    hits = [(F.length("spaced") - F.length(F.replace(F.col("spaced"), c, F.lit("")))) / F.length(c) for c in common]
    return df.withColumn("common", F.array(*hits, F.col("n_words").cast("double"))).drop("spaced")


def _shares(counts: Column, n: int) -> list[Column]:
    """A histogram of n counts and their total as shares; the last share is the rest."""
    total = F.greatest(F.get(counts, F.lit(n)), F.lit(1.0))
    own = [F.get(counts, F.lit(k)) / total for k in range(n)]
    return [*own, F.greatest(F.lit(0.0), 1 - sum(own))]


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """The square root of the Jensen-Shannon divergence in bits: 0 (equal) to 1."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    parts = [half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(parts) / 2)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The base counts, base_failed, both distances and kept, one row per input row.

    Null and empty texts have no words and fail the base rules; a null or other language is
    held against the shared reference; where no text of a language passes the guard, the
    distances are 0. Repeated rows repeat, a null id stays null, an empty
    table gives an empty result, further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    df = scratch.save(measure(docs, id_col, text_col, lang_col), "measured")
    n_classes, n_words = len(CLASSES), 10
    p = [s.alias(f"p{k}") for k, s in enumerate([*_shares(F.col("classes"), n_classes), *_shares(F.col("common"), n_words)])]
    shares = df.select("*", *p)
    names = [f"p{k}" for k in range(len(p))]
    guarded = (F.col("n_words") >= GUARD_WORDS) & ~F.col("base_failed")
    # One row a language, of which there are five at most.
    reference = shares.where(guarded).groupBy("lang").agg(*(F.avg(c).alias(f"r{c}") for c in names))
    both = shares.join(F.broadcast(reference), "lang", "left")
    cut = n_classes + 1
    p, q = [F.col(c) for c in names], [F.col(f"r{c}") for c in names]
    known = F.col("rp0").isNotNull()
    judged = both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(known, js_distance(p[:cut], q[:cut])).otherwise(0.0).alias("class_distance"),
        F.when(known, js_distance(p[cut:], q[cut:])).otherwise(0.0).alias("word_distance"),
    )
    noise = NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    close = (F.col("n_words") < GUARD_WORDS) | ((F.col("class_distance") <= max_class + noise) & (F.col("word_distance") <= max_word + noise))
    return judged.withColumn("kept", ~F.col("base_failed") & close)
