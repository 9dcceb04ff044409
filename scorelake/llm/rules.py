"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The counts behind the rules come from one projection over the words of a text. The rules after them form a CASE: the
first rule that rejects a text ends its evaluation, so the order of the rules decides what a text costs. The order
comes from a bounded sample: rejections per second of evaluation, largest first. It never changes a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` may read the text column and the counts of ``text_counts``."""

    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more; ``hashes`` holds the hash of the window at each place."""

    def marked(sorted_pairs: Column) -> Column:
        # (hash, place), in order of the hash: equal windows are neighbours
        same = F.filter(
            sorted_pairs,
            lambda x, i: (F.get(sorted_pairs, i - 1)["h"] == x["h"]) | (F.get(sorted_pairs, i + 1)["h"] == x["h"]),
        )
        places = F.array_sort(F.transform(same, lambda x: x["p"]))
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, marked))


def text_counts(text: Column) -> Column:
    """A struct of counts of one whole text (null: empty), each a long.

    ``n_words``, ``word_chars`` (characters in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_lines`` (lines with a word),
    ``n_dup_lines`` (of these, equal to an earlier one) and ``n_repeat_words`` (words in windows of eight words that
    occur twice or more in the text, the first occurrence included).
    """
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        hashes = F.when(
            n > WINDOW,
            F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _let(hashes, _covered_words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.cast("long").alias("s"))


def with_counts(page_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``page_texts`` with the counts as columns and ``base_failed``: under 20 words, or over 30 % of them repeated."""
    c = "__counts"
    names = {
        "n_words": "w.n_words",
        "word_chars": "w.word_chars",
        "n_symbols": "s",
        "n_lines": "l.n_lines",
        "n_dup_lines": "l.n_dup_lines",
        "n_repeat_words": "w.n_repeat_words",
    }
    return (
        page_texts.drop(*names, "base_failed")
        .withColumn(c, text_counts(F.col(text_col)))
        .withColumns({name: F.col(f"{c}.{at}") for name, at in names.items()})
        .drop(c)
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def default_rules(text_col: str = "text") -> list[Rule]:
    """What marks a page that recognition has garbled, in any language."""
    text, words = F.col(text_col), F.col("n_words")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    shouts = F.length(text) - F.length(F.translate(text, "!", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("repeated_lines", (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("capitals", 2 * capitals > F.col("word_chars")),
        Rule("shouts", 5 * shouts > words),
    ]


def order_rules(counted: DataFrame, rules: list[Rule], sample_pages: int = 200, longest: int = 100_000, repeats: int = 10) -> list[Rule]:
    """``rules`` by rejections per second, largest first, measured on at most ``sample_pages`` texts of ``counted``.

    The sample only orders the rules. Texts of over ``longest`` characters stay out of it, which bounds its size.
    """
    texts = [f.name for f in counted.schema.fields if f.dataType.typeName() == "string"]
    small = counted
    for name in texts:
        small = small.filter(F.coalesce(F.length(name), F.lit(0)) <= longest)
    rows = small.take(sample_pages)
    if not rows:
        return list(rules)
    spark = counted.sparkSession
    sample = spark.createDataFrame(rows, counted.schema).coalesce(1).withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def measured(value: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.coalesce(F.sum(value.cast("int")), F.lit(0))).first()[0]
        return time.perf_counter() - start, hits

    measured(F.lit(True))
    idle = measured(F.lit(True))[0]
    score = {}
    for rule in rules:
        seconds, hits = measured(rule.rejects)
        score[rule.name] = hits / max(seconds - idle, 1e-4)
    return sorted(rules, key=lambda r: -score[r.name])


def screen_texts(
    page_texts: DataFrame,
    rules: list[Rule] | None = None,
    sample_pages: int = 200,
    page_col: str = "page_id",
    text_col: str = "text",
) -> DataFrame:
    """Judge the recognised text of every page.

    ``page_texts``: (``page_id``, ``text``), one row per page; other columns are dropped. Returns (page_id, the counts
    of ``text_counts``, base_failed, failed_rule, kept). ``failed_rule`` is the first rule of the cascade that rejects
    the text (which one comes first depends on the measured order), null where none does or where ``base_failed``.
    ``kept`` is false if ``base_failed`` or a rule rejects; a rule that gives null doesn't reject.

    A null text counts as empty; empty texts fail the base rule. Repeated rows are judged each for itself. An empty
    table gives an empty result. Hashes of 64 bits stand for the windows of one text.
    """
    rules = default_rules("text") if rules is None else rules
    counted = with_counts(page_texts.select(F.col(page_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rules = order_rules(counted, rules, sample_pages)
    verdict = F.when(F.col("base_failed"), F.lit(None))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    judged = counted.withColumn("failed_rule", verdict.cast("string"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("text")
