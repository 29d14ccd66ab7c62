"""Quality rules, lines first (operator 10).

Each line is judged by rules on punctuation, navigation and boilerplate; lines
that fail are removed; a document that loses too much of its text is rejected.
Before that, two rules hold for the document as a whole: enough words, and not
mostly repeated three-word windows.

Everything is an expression on the row: no shuffle, no Python.  Columns used more than once are
projections of their own, so the optimizer computes them once.

Null and empty texts have no words and fail.  Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.session import write_table

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a document's word characters, in percent, that must stand in good lines.
LEAST_KEPT = 60
#: Fixed phrases of pages' furniture.
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept cookies|enable javascript|"
    r"sign in|log in|subscribe to our|click here|read more|share this|skip to content|back to top)\b"
)


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _octets_of(text: Column, pattern: str) -> Column:
    """Number of one-byte characters in matches of the pattern."""
    return F.octet_length(text) - F.octet_length(_without(text, pattern))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def good_line(line: Column) -> Column:
    """Whether a line is prose: no navigation or symbol noise, no shouting, no stutter, no page furniture, and punctuated unless it is short."""

    def judge(w: Column) -> Column:
        n = F.size(w)
        stutter = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(w, i) == F.get(w, i - 1)))
        return (
            F.when(n == 0, True)
            # Navigation and symbol noise: one symbol for every three words is more than prose holds.
            .when(3 * _octets_of(line, SYMBOLS) > n, False)
            # Shouting: more capitals than other characters, or every other word with two exclamation marks.
            .when((n >= 3) & (2 * F.regexp_count(line, F.lit(r"\p{Lu}")) > F.char_length(line)), False)
            .when(2 * F.regexp_count(line, F.lit("!!")) > n, False)
            .when((n >= 4) & (3 * stutter > n), False)
            .when((n <= 12) & line.rlike(BOILERPLATE), False)
            # Long prose ends in, or at least holds, a mark that ends a sentence or a clause.
            .otherwise((n < 40) | line.rlike(r"[.!?,;:…。！？]"))
        )

    return F.transform(F.array(_words(line)), judge)[0]


def measure(docs: DataFrame, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and good_lines (array<string>)."""
    source = docs.select(F.struct(*keep).alias("kept_columns"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    split = source.select("kept_columns", "t", _words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashed = split.select(
        "kept_columns", "t", "lines", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.size("w") >= 3, three).otherwise(F.expr("cast(array() AS array<bigint>)")).alias("h"),
    )
    # Only texts with some window twice are sorted; equal windows then stand side by side.
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    sorted_ = hashed.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(F.expr("cast(array() AS array<struct<h: bigint, i: int>>)")).alias("p")).drop("h")
    twice = F.filter("p", lambda x, i: (x["h"] == F.get("p", i - 1)["h"]) | (x["h"] == F.get("p", i + 1)["h"]))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    counted = sorted_.select(
        "kept_columns", "lines", "n_words", "word_chars",
        _octets_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("p") > 0, repeated).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = counted.select("*", failed.alias("base_failed"), F.when(failed, F.expr("cast(array() AS array<string>)")).otherwise(F.filter("lines", good_line)).alias("good_lines")).drop("lines")
    left = F.char_length(_without(F.array_join("good_lines", ""), BLANK))
    return judged.select(
        "kept_columns.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * left >= LEAST_KEPT * F.col("word_chars"))).alias("kept"), "good_lines",
    )


def report(docs: DataFrame) -> DataFrame:
    """The counts and the verdict on each row."""
    return measure(docs, ["doc_id"]).drop("good_lines")


def clean(docs: DataFrame) -> DataFrame:
    """Rows of docs that pass, their texts without the lines that failed; other columns are unchanged.

    Verdicts are written before rows are dropped: a filter right on them would make the optimizer repeat
    every expression for each mention of the verdict.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = write_table(measure(docs, [row]).select("row", "kept", "good_lines"), "judged").where("kept")
    return judged.select(*[F.array_join("good_lines", "\n").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
