"""URL filter: host-suffix and path-prefix expressions looked up by hash prefix.

Every URL is expanded into the expressions ``host suffix + path prefix`` that a rule could name.
Only shapes (labels of the host, length of the path) that some rule has are made, so the number of
expressions of a URL follows the distinct shapes of the rules and not the length of the URL. The
expressions meet the rules in an equi-join on a short prefix of their SHA-256 digest; the full
digest confirms, and the longest rule wins.

Everything is a DataFrame expression. Spark decides by the size of the rules whether it broadcasts
them; nothing is broadcast by a hint. Distinct (host, path) pairs are judged once, so a URL that
fills a third of all rows is one row in the join, and the verdicts return to the rows by a join on
(host, path), whose hot keys Spark splits.

Defined results: a null URL, and one without ``://``, has empty host and path and gets the default
verdict; so has a URL no rule fits. Equal rules with different verdicts: ``block`` wins. Rules with
null or empty host never fit. Repeated rows each get their row. Other columns of the input pass
through; the columns this operator adds replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest on which the equi-join runs.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules ``(verdict, host, path)`` given in code as a DataFrame."""
    rows = [
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        for v, h, p in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``.
    """
    usable = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
    )
    hashed = (
        usable.select("verdict", F.concat("rule_host", "rule_path").alias("rule"))
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # One row for each distinct (labels, length) of the rules: bounded by the longest rule.
    shapes = (
        usable.select(
            _labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("length")
        )
        .distinct()
        .collect()
    )
    added = ("host", "path", "rule", "verdict")
    located = pages.select(
        *[c for c in pages.columns if c not in added or c == url],
        url_host(pages[url]).alias("host"),
        url_path(pages[url]).alias("path"),
    )
    if not shapes:
        return located.withColumns(
            {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
        )
    pairs = located.select("host", "path").distinct().where("host != ''")
    labels = _labels(F.col("host"))
    expressions = F.array_compact(
        F.array(
            *[
                F.when(
                    (labels >= s["labels"]) & (F.length("path") >= s["length"]),
                    F.concat(
                        F.substring_index("host", ".", -s["labels"]),
                        F.substring("path", 1, s["length"]),
                    ),
                )
                for s in shapes
            ]
        )
    )
    found = (
        pairs.select("host", "path", F.explode(expressions).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
        .join(hashed, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict_of_rule"))
    )
    return (
        located.join(found, ["host", "path"], "left")
        .withColumn("verdict", F.coalesce("verdict_of_rule", F.lit(default)))
        .drop("verdict_of_rule")
    )


#: Fixed values of the query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
