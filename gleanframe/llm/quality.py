"""Quality rules: a table of thresholds compiled into one projection.

``METRICS`` names what can be measured of a text; a rule bounds one metric from below, above or
both. ``judge`` measures every whole text once, as one struct column of built-in expressions, and
compiles the rules to one boolean over it. There is no shuffle, no join and no user function; a row
never leaves its task. Repeated 3-word windows are found by sorting the windows of a text, so a text
of n words takes n log n steps.

Defined results: a null text counts as empty. A text without words has all ratios 0 and fails the
base rule. Texts of one or two words have no windows. Lines are split at ``\\n`` and count only if
they hold a word. Bounds are inclusive: a value equal to a bound passes. Rows are judged one by one,
so repeated rows and null ids give a row each; other columns pass through unless they bear the name
of an added one, which replaces them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.common import let, words_of


class Rule(NamedTuple):
    """``low <= metric <= high``; a bound that is ``None`` does not apply."""

    name: str
    metric: str
    low: float | None
    high: float | None


# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "als auch auf das dem den der des die ein eine es für im in ist mit nicht sich und von war zu "
    "au avec ce dans de des du elle en est et il la le les pas par plus pour que qui sur un une "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

# The symbols that count as mark-up residue.
SYMBOLS = "#*$%&|<>"

#: Rules of the registered query: loose enough for any prose, in any of the four languages.
RULES = (
    Rule("word length", "mean_word_length", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop words", "stop_word_ratio", 0.1, None),
    Rule("repeated lines", "dup_line_ratio", None, 0.5),
    Rule("bullet lines", "bullet_line_ratio", None, 0.9),
    Rule("unfinished lines", "ellipsis_line_ratio", None, 0.5),
)
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("window"), i.alias("at")
                ),
            )
        ),
    )

    def covered(ranked: Column) -> Column:
        repeats = F.filter(
            ranked,
            lambda x, k: (F.get(ranked, k - 1)["window"] == x["window"])
            | (F.get(ranked, k + 1)["window"] == x["window"]),
        )
        total = F.aggregate(
            F.sort_array(F.transform(repeats, lambda x: x["at"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda done, at: F.struct(
                at.alias("last"), (done["n"] + F.least(F.lit(3), at - done["last"])).alias("n")
            ),
        )
        return total["n"]

    return F.coalesce(let(windows, covered), F.lit(0).cast("long"))


def _share(count: Column, whole: Column) -> Column:
    return F.when(whole > 0, count / whole).otherwise(F.lit(0.0))


def measured(text: Column) -> Column:
    """All metrics of a text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    kept_lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def metrics(words: Column, lines: Column) -> Column:
        n, n_lines = F.size(words), F.size(lines)
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda sum_, w: sum_ + F.length(w))
        symbols = F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long")
        stops = F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS)))
        dup_lines = (n_lines - F.size(F.array_distinct(lines))).cast("long")
        bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-•●▪◦]")))
        ellipses = F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _share(chars, n).alias("mean_word_length"),
            _share(symbols, n).alias("symbols_per_word"),
            _share(stops, n).alias("stop_word_ratio"),
            _share(dup_lines, n_lines).alias("dup_line_ratio"),
            _share(bullets, n_lines).alias("bullet_line_ratio"),
            _share(ellipses, n_lines).alias("ellipsis_line_ratio"),
        )

    return let(words_of(text), lambda words: let(kept_lines, lambda lines: metrics(words, lines)))


def passes(metrics: Column, rules=RULES) -> Column:
    """The rules as one condition over a struct of metrics."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (metrics[rule.metric] >= rule.low)
        if rule.high is not None:
            verdict = verdict & (metrics[rule.metric] <= rule.high)
    return verdict


def failed_rules(metrics: Column, rules=RULES) -> Column:
    """Names of the rules that a text breaks."""
    return F.array_compact(
        F.array(*[F.when(~passes(metrics, (rule,)), F.lit(rule.name)) for rule in rules])
    )


def judge(documents: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``documents`` with ``metrics``, ``failed`` (rule names), ``base_failed`` and ``kept``."""
    m = F.col("metrics")
    return (
        documents.withColumn("metrics", measured(documents[text]))
        .withColumn(
            "base_failed",
            (m["n_words"] < MIN_WORDS)
            | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"]),
        )
        .withColumn("failed", failed_rules(m, rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )
