"""An index of substrings: the values of a column that hold a text, without scanning them all.

Every distinct value is stored once, with how often it occurs; posting lists tell for each run of three characters
(in lower case) which values hold it. A search intersects the lists of its text's runs and compares what is left
itself, so the result is exact. A text of fewer than three characters is compared with all distinct values.
Suited to names, codes and addresses; a long text has about as many runs as characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.functions.columns import col
from gleanframe.operators.value_counts import digest, value_counts
from gleanframe.session import stored

GRAM = 3
#: Folders over which the posting lists are spread; a search reads those of its runs.
BUCKETS = 64


def _grams(text: Column) -> Column:
    """Distinct runs of three characters of a lower-case text."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, runs)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SubstringIndex:
    """Stored ``values (id, value, count)`` and ``postings (gram, id)`` of one column."""

    column: str
    text: Column
    values: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, df: DataFrame, column: str, text: Column | None = None) -> SubstringIndex:
        """Index the texts of a column, or ``text`` made of it; nulls hold nothing."""
        text = col(column).cast("string") if text is None else text
        counts = value_counts(df.where(text.isNotNull()), text)
        values = stored(counts.select(digest(F.col("v")).alias("id"), F.col("v").alias("value"), F.col("n").alias("count")), "values")
        gram = F.explode(_grams(F.lower("value"))).alias("gram")
        lists = values.select("id", gram).withColumn("bucket", _bucket(F.col("gram")))
        # a common run's list may be long: its folder holds as many files as tasks wrote to it
        return cls(column, text, values, stored(lists.sortWithinPartitions("bucket", "gram"), "postings", "bucket"))

    def search(self, text: str) -> DataFrame:
        """``(value, count)`` of the values that hold ``text``, whatever the case of letters."""
        needle = F.lower(F.lit(text))
        holds = F.contains(F.lower("value"), needle)
        if len(text.lower()) < GRAM:
            return self.values.where(holds).select("value", "count")
        runs = self.values.sparkSession.range(1).select(F.explode(_grams(needle)).alias("gram"))
        wanted = [(r.gram, r.bucket) for r in runs.withColumn("bucket", _bucket(F.col("gram"))).collect()]
        lists = self.postings.where(F.col("bucket").isin(sorted({b for _, b in wanted})) & F.col("gram").isin([g for g, _ in wanted]))
        hits = lists.groupBy("id").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") == len(wanted))
        return self.values.join(hits, "id").where(holds).select("value", "count")

    def suggest(self, text: str, limit: int) -> DataFrame:
        """The most frequent of them, as value suggestions."""
        return self.search(text).orderBy(F.desc("count"), "value").limit(limit)

    def filter(self, df: DataFrame, text: str) -> DataFrame:
        """The rows of ``df`` whose value holds ``text``: those that have one of the values found."""
        found = self.search(text).select(F.col("value").alias("_value"))
        return df.join(found, self.text == F.col("_value"), "left_semi")
