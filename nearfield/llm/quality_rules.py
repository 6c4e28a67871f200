"""Quality rules: a threshold table compiled into one Spark projection.

Measures come from native array functions, row by row and without a shuffle; the rules are data
(``RULES``), and ``verdict`` turns the table into one boolean expression.

Defined results: a null text is an empty one; it has no words and fails the base rule. Repeated
rows are judged one by one. Extra columns, whatever their names, neither matter nor come back.
Windows are compared by a 64-bit hash of their eight words within one text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent words of the four languages; fixed values.
STOP_WORDS = (
    "the of and to in is that for it was on are as with his they at be this from or by an not but have "
    "der die und das von den mit ist im für auf ein eine nicht sich dem des zu auch als "
    "le la les de et des un une du en que qui dans est pour sur pas par au avec ce "
    "el los las y que en del se por con una para su al lo como más es o"
).split()


class Rule(NamedTuple):
    """Keep a text while ``low * base <= measure <= high * base``; None leaves a side open."""

    measure: str
    base: str | None
    low: float | None
    high: float | None


RULES = (
    Rule("n_words", None, 20, None),
    Rule("word_chars", "n_words", 2, 15),
    Rule("n_symbols", "n_words", None, 0.3),
    Rule("n_stop_words", "n_words", 0.02, None),
    Rule("n_dup_lines", "n_lines", None, 0.5),
)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measures that ``RULES`` and the base rule use, as longs.

    Each array is used more than once by the step after it, which keeps Spark from folding the
    steps into one another and evaluating an array per element.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        words(F.col(text)).alias("w"),
        F.filter(F.split(body, "\n"), has_word).alias("l"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
    last = F.size("w") - WINDOW
    hashed = split.select(
        "doc_id",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.length(F.array_join("w", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.size(F.filter("w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window)).alias("h"),
    )
    # Only a text with a repeated window pays for ordering its windows.
    again = F.size("h") > F.size(F.array_distinct("h"))
    keyed = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("o", F.when(again, F.sort_array(keyed)))
    twice = lambda x, i: F.coalesce(x["h"] == F.get("o", i - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get("o", i + 1)["h"], F.lit(False)
    )
    starts = ordered.withColumn("p", F.sort_array(F.transform(F.filter("o", twice), lambda x: x["i"])))
    fresh = F.transform("p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - p, F.lit(WINDOW))).cast("long"))
    covered = F.coalesce(F.aggregate(fresh, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).cast("long")
    return starts.withColumn("n_repeat_words", covered).drop("h", "o", "p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one expression; ratios are compared as products, so zero bases are safe."""
    kept = F.lit(True)
    for rule in rules:
        base = F.col(rule.base) if rule.base else F.lit(1)
        if rule.low is not None:
            kept = kept & (F.col(rule.measure) >= F.lit(float(rule.low)) * base)
        if rule.high is not None:
            kept = kept & (F.col(rule.measure) <= F.lit(float(rule.high)) * base)
    return kept


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every document."""
    return measures(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))
