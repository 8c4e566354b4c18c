"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself: punctuation, navigation and
boilerplate rules. Lines that fail are taken out, and a document that loses
too much of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.common import WORD, let, words

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# fixed values: what a line may end with
TERMINAL = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
# fixed values: marks between the entries of menus and tables
SEPARATORS = r"[|»›•·¦]"
# fixed values: phrases of page furniture and licence lines, in lower case
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "click here",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "released under the",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
]


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule (a line without words breaks none).

    Punctuation: no terminal mark in a line of 5 words or more, an exclamation
    mark for every other word, or capitals for most letters of 5 words or more.
    Navigation: a separator for every third word, or a symbol for every other.
    Boilerplate: a phrase of the fixed list.
    """
    n = F.regexp_count(line, F.lit(WORD))

    def shape(n: Column) -> Column:
        unended = (n >= 5) & ~line.rlike(TERMINAL)
        excited = (n >= 3) & (2 * F.regexp_count(line, F.lit("!")) >= n)
        shouted = (n >= 5) & (2 * F.regexp_count(line, F.lit(r"\p{Lu}")) > F.regexp_count(line, F.lit(r"\p{L}")))
        menu = (n >= 3) & (3 * F.regexp_count(line, F.lit(SEPARATORS)) >= n)
        symbols = 2 * F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) > n
        stock = (n <= 30) & line.rlike("(?i)" + "|".join(BOILERPLATE))
        return (n > 0) & (unended | excited | symbols | menu | stock | shouted)

    return let(n, shape)


def repeated_words(found: Column) -> Column:
    """Words of an array that lie in an 8-word window which occurs twice or
    more in the array, first occurrences included."""

    def covered(grams: Column) -> Column:
        by_gram = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < last) & (F.get(s, k + 1)["g"] == x["g"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT_WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(by_gram, places), total))

    n = F.size(found) - REPEAT_WINDOW + 1
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(found, i, REPEAT_WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return let(grams, covered)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and lost_words (words of the lines that fail); null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))

    def of_lines(kept: Column) -> Column:
        lost = F.filter(kept, line_fails)
        return F.struct(
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("dups"),
            F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(WORD))).alias("lost"),
        )

    def of_words(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), repeated_words(found).alias("repeats"))

    def both(w: Column, x: Column) -> Column:
        return F.struct(
            w["n"].alias("n_words"),
            F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["dups"].alias("n_dup_lines"),
            w["repeats"].alias("n_repeat_words"),
            x["lost"].alias("lost_words"),
        )

    return let(let(words(text), of_words), lambda w: let(let(lines, of_lines), lambda x: both(w, x)))


def cleaned_text(text: Column) -> Column:
    """The text without the lines that fail; null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x)), "\n")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality``: the measures, base_failed
    (under 20 words, or over 30 % of them in repeated 8-word windows) and kept
    (not base_failed, and at most 30 % of the words lost with failing lines).

    One row in, one row out, without a shuffle; null and empty texts have zero
    words and fail. Other columns pass through, one named ``quality`` is
    replaced.
    """
    q = F.col("quality")
    base = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    kept = 100 * q["lost_words"] <= MAX_LOST_PERCENT * q["n_words"]
    # explode computes the measures once for each row
    measured = docs.drop("quality").select("*", F.explode(F.array(measures(F.col(text).cast("string")))).alias("quality"))
    return measured.withColumn("quality", q.withField("base_failed", base).withField("kept", ~base & kept))
