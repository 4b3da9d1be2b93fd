"""Column profiles over all rows.

What concerns single values (lengths, patterns, rates) is aggregated over the rows; what needs
distinct values is read from the column's value counts, which one shuffle builds and all facets of a
query share, for texts by digest. Those of a number are stored as a rank index, from which its quantiles,
sums and tails are read. First-pass results of texts (mean length) reach the second pass
as scalar subqueries, so nothing is joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanframe.apptypes import ROWID, app_type, field_map
from gleanframe.functions import text
from gleanframe.functions.columns import as_text, col, display_text
from gleanframe.functions.numbers import finite, pct, round_to, rounded_to, share
from gleanframe.operators.exact_sums import exact_mean, exact_sum, rounded as to_double
from gleanframe.operators.ranks import RankIndex, quantiles, sample_rows
from gleanframe.operators.value_counts import digest, ranked, top_texts, value_counts

# Thresholds and sizes of the profile.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
HISTOGRAM_BINS = 20
TOP_VALUES, TAIL_VALUES, EXAMPLES, EXAMPLE_CHARS = 10, 5, 5, 80
HIGH_CARDINALITY_PCT, MEDIUM_CARDINALITY_PCT, POSSIBLE_KEY_PCT = 80, 20, 98
LOW_TAIL_PCT, MEDIUM_TAIL_PCT = 70, 40


@dataclass(frozen=True)
class Profile:
    """Profile of one column. Facets are DataFrames; quantiles and sums of numbers are looked up at once.

    ``max_rows`` profiles a deterministic sample when the table is larger.
    """

    table: DataFrame
    column: str
    max_rows: int | None = None

    def __post_init__(self):
        if self.column not in field_map(self.table):
            raise ValueError(f"Column not found: {self.column}")

    @cached_property
    def type(self) -> str:
        return app_type(self._field.dataType)

    @cached_property
    def total_rows(self) -> int:
        return self.table.count()

    @property
    def sampled(self) -> bool:
        return self.max_rows is not None and self.total_rows > self.max_rows

    @cached_property
    def _field(self) -> T.StructField:
        return field_map(self.table)[self.column]

    @cached_property
    def _rows(self) -> DataFrame:
        """The profiled rows as one column ``v``; strings and nested values as text."""
        source = self.table
        if self.sampled:
            if ROWID not in source.columns:
                raise ValueError(f"sampling needs the row identity column {ROWID}")
            source = sample_rows(source, self.max_rows, ROWID, self.total_rows)
        c = col(self.column)
        if self.type == "string":
            c = as_text(c, self._field.dataType)
        return source.select(c.alias("v"))

    @cached_property
    def _value_type(self) -> T.DataType:
        return T.StringType() if self.type == "string" else self._field.dataType

    @cached_property
    def _counted(self) -> DataFrame:
        return value_counts(self._rows.where(F.col("v").isNotNull()), F.col("v"))

    @property
    def _present(self) -> DataFrame:
        """Value counts without the nulls: the stored ones once there are any. All uses share one shuffle."""
        return self._index.rows.select("v", "n") if "_index" in self.__dict__ else self._counted

    @cached_property
    def _digests(self) -> DataFrame:
        return value_counts(self._rows.where(F.col("v").isNotNull()), digest(F.col("v")))

    @property
    def _keys(self) -> DataFrame:
        """Value counts ``(v, n)`` without the nulls; texts stand as a 16-byte digest, so that counting
        long ones shuffles no text."""
        return self._digests if self.type == "string" else self._present

    @cached_property
    def _distinct(self) -> Column:
        totals = self._keys.agg(F.struct(F.count("v").alias("values"), F.sum("n").alias("rows")))
        return F.coalesce(totals.scalar()["values"], F.lit(0)).cast("bigint")

    def _require(self, *types: str) -> None:
        if self.type not in types:
            raise ValueError(f"Column '{self.column}' is {self.type}, not {' or '.join(types)}")

    # ---- every type -------------------------------------------------------------------------

    def universal(self) -> DataFrame:
        """Counts, coverage, cardinality, key hint and the dominant value: one row."""
        v, n = F.col("v"), F.col("n")
        counted = self._rows.agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.count(v).alias("non_null_count"),
            F.count_if(v.isNull()).alias("null_count"),
        )
        # A text is looked up by its digest, once the most frequent one is known.
        shown = F.lit(None).cast("string") if self.type == "string" else display_text(v, self._value_type)
        leaders = ranked(self._keys, 2).agg(
            F.array_sort(
                F.collect_list(F.struct((-n).alias("order"), v, shown.alias("text")))
            ).alias("top")
        )
        rows, filled, nulls, unique = (
            F.col(c) for c in ("sample_size", "non_null_count", "null_count", "unique_count")
        )
        cardinality = pct(unique, filled)
        band = (
            F.when(cardinality >= HIGH_CARDINALITY_PCT, "high")
            .when(cardinality >= MEDIUM_CARDINALITY_PCT, "medium")
            .otherwise("low")
        )
        key = (
            F.when((filled == rows) & (unique == rows), "strong")
            .when((nulls == 0) & (cardinality >= POSSIBLE_KEY_PCT), "possible")
            .otherwise("unlikely")
        )
        top = F.col("top")
        first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
        tie = F.coalesce(first["order"] == second["order"], F.lit(False))
        top_count = -first["order"]
        value = first["text"]
        if self.type == "string":
            leader = F.get(leaders.scalar(), F.lit(0))["v"]
            value = self._rows.where(digest(v) == leader).agg(F.min("v")).scalar()
        return counted.select(
            "*", self._distinct.alias("unique_count"), leaders.scalar().alias("top")
        ).select(
            "sample_size",
            "non_null_count",
            "null_count",
            "unique_count",
            pct(filled, rows).alias("coverage_pct"),
            cardinality.alias("cardinality_pct"),
            band.alias("cardinality_band"),
            key.alias("key_hint"),
            F.when(tie, "none").otherwise(value).alias("dominant_value"),
            top_count.alias("dominant_count"),
            F.when(~tie & top_count.isNotNull(), pct(top_count, filled)).alias("dominant_share_pct"),
        )

    # ---- numbers ----------------------------------------------------------------------------

    @cached_property
    def _numbers(self) -> DataFrame:
        self._require("integer", "float")
        return self._rows.where(F.col("v").isNotNull())

    @cached_property
    def _index(self) -> RankIndex:
        """The value counts in stored ranges."""
        self._require("integer", "float")
        return RankIndex.build(self._counted, [F.asc("v")], weighted=True)

    @cached_property
    def _quantiles(self) -> list[float | None]:
        """The quantiles, rounded to 4 decimals as all thresholds are; null where there is no finite one."""
        found = quantiles(self._index, "v", QUANTILES) or [None] * len(QUANTILES)
        return [None if q is None or not math.isfinite(q) else rounded_to(q, 4) for q in found]

    def numeric_stats(self) -> DataFrame:
        """Moments, quantiles, uniqueness, zero/negative rates, outliers and tails: one row."""
        at = lambda i: F.lit(self._quantiles[i]).cast("double")
        p5, p25, p75, p95 = at(0), at(1), at(3), at(4)
        x = F.col("v").cast("double")
        filled, total = exact_sum(self._present.select("v", "n"))
        literal = lambda x: F.lit(x).cast("double")
        spread = p75 - p25
        outside = (x < p25 - 1.5 * spread) | (x > p75 + 1.5 * spread)
        distinct = self._distinct
        rows = F.count(F.lit(1))
        raw = self._numbers.agg(
            rows.alias("rows"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.stddev_samp(x).alias("stddev"),
            F.count_if(x == 0).alias("zeros"),
            F.count_if(x < 0).alias("negatives"),
            F.count_if(outside).alias("outlier_count"),
            F.count_if(x < p5).alias("low_tail_count"),
            F.count_if(x > p95).alias("high_tail_count"),
        ).select(
            "*",
            distinct.alias("distinct_count"),
            literal(to_double(total) if filled else None).alias("sum"),
            literal(exact_mean(filled, total)).alias("mean"),
        )
        n = F.col("rows")
        unique_pct = pct(F.col("distinct_count"), n)
        rate = lambda c: F.when(n > 0, pct(F.col(c), n))
        rounded = lambda c: finite(round_to(F.col(c), 4)).alias(c)
        return raw.select(
            finite(F.col("min")).alias("min"),
            finite(F.col("max")).alias("max"),
            rounded("sum"),
            rounded("mean"),
            at(2).alias("median"),
            rounded("stddev"),
            p5.alias("p5"),
            p25.alias("p25"),
            p75.alias("p75"),
            p95.alias("p95"),
            at(5).alias("p99"),
            spread.alias("iqr"),
            "distinct_count",
            F.when(n > 0, unique_pct).alias("uniqueness_rate_pct"),
            F.when(n > 0, round_to(F.lit(100.0) - unique_pct, 2)).alias("duplicate_rate_pct"),
            rate("zeros").alias("zero_rate_pct"),
            rate("negatives").alias("negative_rate_pct"),
            "outlier_count",
            rate("outlier_count").alias("outlier_rate_pct"),
            "low_tail_count",
            rate("low_tail_count").alias("low_tail_rate_pct"),
            "high_tail_count",
            rate("high_tail_count").alias("high_tail_rate_pct"),
        )

    def tail_values(self) -> DataFrame:
        """``(tail, value, count)``: the 5 most frequent values below p5 and above p95."""
        self._require("integer", "float")
        p5, p95 = (F.lit(self._quantiles[i]).cast("double") for i in (0, 4))
        x = F.col("v").cast("double")
        parts = [
            ranked(self._present.where(kept), TAIL_VALUES).select(
                F.lit(tail).alias("tail"), self._shown().alias("value"), F.col("n").alias("count")
            )
            for tail, kept in (("low", x < p5), ("high", x > p95))
        ]
        return parts[0].unionAll(parts[1])

    def _shown(self) -> Column:
        return display_text(F.col("v"), self._value_type)

    def histogram(self) -> DataFrame:
        """``(bin, low, high, count)`` over 20 equal-width bins; non-empty bins only.

        NaN and infinities are left out. The bounds need no shuffle and the bins at most 20 rows.
        """
        x = F.col("v").cast("double")
        kept = self._numbers.where(~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("x"))
        bounds = kept.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
        low, high = F.col("b.lo"), F.col("b.hi")
        width = (high - low) / HISTOGRAM_BINS
        at = F.least(F.floor((F.col("x") - low) / width).cast("int"), F.lit(HISTOGRAM_BINS - 1))
        bins = (
            kept.select("x", bounds.alias("b"))
            .select(F.when(low < high, at).alias("bin"))
            .groupBy("bin")
            .agg(F.count(F.lit(1)).alias("count"))
            .where(F.when(F.col("count") > 0, F.col("bin").isNotNull()))
        )
        edge = low + F.col("bin") * width
        return bins.select("*", bounds.alias("b")).select(
            "bin",
            round_to(edge, 4).alias("low"),
            round_to(edge + width, 4).alias("high"),
            "count",
        )

    # ---- strings ----------------------------------------------------------------------------

    def top_values(self, rows: int = TOP_VALUES) -> DataFrame:
        """``(value, count, share_pct)``: most frequent values, their share with one decimal."""
        if self.type == "string":
            top = top_texts(self._texts, F.count(F.lit(1)), rows).withColumnRenamed("score", "n")
        else:
            top = ranked(self._present, rows)
        filled = self._rows.agg(F.count("v")).scalar()
        # the subquery is planned once, as a column
        return top.select("v", "n", filled.alias("filled")).select(
            self._shown().alias("value"),
            F.col("n").alias("count"),
            pct(F.col("n"), F.col("filled"), 1).alias("share_pct"),
        )

    @cached_property
    def _texts(self) -> DataFrame:
        self._require("string")
        return self._rows.where(F.col("v").isNotNull())

    @cached_property
    def _measured(self) -> DataFrame:
        """The texts with ``m``, the mean and population standard deviation of their length, from
        exact integer sums."""
        size = F.length("v").cast("decimal(10,0)")
        sums = self._texts.agg(
            F.count("v").alias("rows"), F.sum(size).alias("s1"), F.sum((size * size).cast("decimal(28,0)")).alias("s2")
        )
        rows, s1 = F.col("rows").cast("double"), F.col("s1").cast("double")
        mean = s1 / rows
        spread = F.greatest(F.col("s2").cast("double") / rows - mean * mean, F.lit(0.0))
        lengths = sums.select(
            F.when(rows > 0, F.struct(mean.alias("mean"), F.sqrt(spread).alias("stddev")))
        ).scalar()
        return self._texts.select("v", lengths.alias("m"))

    def _length_outlier(self) -> Column:
        off = F.abs(F.length("v") - F.col("m.mean"))
        return (F.col("m.stddev") > 0) & (off > 2 * F.col("m.stddev"))

    def string_stats(self) -> DataFrame:
        """Lengths, blanks, sentinels, length outliers, shapes and top-10 coverage: one row."""
        self._require("string")
        v = F.col("v")
        raw = self._measured.agg(
            F.count(v).alias("rows"),
            F.min(F.length(v)).alias("min_length"),
            F.max(F.length(v)).alias("max_length"),
            F.count_if(text.is_blank(v)).alias("blank_count"),
            F.count(text.sentinel_token(v)).alias("sentinel_count"),
            F.count_if(self._length_outlier()).alias("outlier_length_count"),
        )
        raw = raw.select("*", self._median_length().alias("median_length"))
        shapes = value_counts(self._stripped(), digest(text.shape(v))).agg(F.count(F.lit(1))).scalar()
        top = ranked(self._keys, TOP_VALUES).agg(F.sum("n")).scalar()
        rows, covered = F.col("rows"), F.coalesce(F.col("top"), F.lit(0))
        coverage = share(covered, rows)
        tail = (
            F.when(coverage >= LOW_TAIL_PCT, "low")
            .when(coverage >= MEDIUM_TAIL_PCT, "medium")
            .otherwise("high")
        )
        return raw.select("*", shapes.alias("distinct_pattern_count"), top.alias("top")).select(
            "min_length",
            "max_length",
            "median_length",
            "blank_count",
            pct(F.col("blank_count"), rows).alias("blank_pct"),
            "sentinel_count",
            "outlier_length_count",
            pct(F.col("outlier_length_count"), rows).alias("outlier_length_pct"),
            "distinct_pattern_count",
            round_to(coverage, 2).alias("top10_coverage_pct"),
            tail.alias("tail_profile"),
        )

    def _median_length(self) -> Column:
        """From one row for each length that occurs: the lengths of a column, not its texts, are put in order."""
        lengths = value_counts(self._texts, F.length("v").cast("double"))
        upto = F.sum("n").over(W.orderBy("v"))
        running = lengths.select("v", "n", upto.alias("upto"), F.sum("n").over(W.partitionBy()).alias("rows"))
        middle = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
        lower, upper = middle(F.floor((F.col("rows") - 1) / 2)), middle(F.floor(F.col("rows") / 2))
        return running.agg((lower / 2 + upper / 2).alias("median")).scalar()

    def _stripped(self) -> DataFrame:
        filled = self._texts.where(~text.is_blank(F.col("v")))
        return filled.select(text.strip(F.col("v")).alias("v"))

    def sentinel_tokens(self) -> DataFrame:
        """``(token, count)`` of texts that stand for a missing value."""
        tokens = self._texts.select(text.sentinel_token(F.col("v")).alias("token"))
        return (
            tokens.where("token IS NOT NULL")
            .groupBy("token")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("token"))
        )

    def length_outliers(self) -> DataFrame:
        """``(example, length, distance)``: the 5 values furthest from the mean length, cut for display."""
        self._require("string")
        off = F.abs(F.length("v") - F.col("m.mean"))
        outliers = self._measured.where(self._length_outlier()).select("v", off.alias("off"))
        return top_texts(outliers, F.max("off"), EXAMPLES).select(
            F.substring("v", 1, EXAMPLE_CHARS).alias("example"),
            F.length("v").alias("length"),
            round_to(F.col("score"), 4).alias("distance"),
        )

    def pattern_classes(self) -> DataFrame:
        """``(label, count, share_pct)`` of uuid, email, numeric-only, code-like, free-text."""
        self._require("string")
        classes = (
            self._stripped()
            .groupBy(text.pattern_class(F.col("v")).alias("label"))
            .agg(F.count(F.lit(1)).alias("count"))
        )
        total = classes.agg(F.sum("count").alias("n")).scalar()
        return (
            classes.select("*", total.alias("total"))
            .select("label", "count", pct(F.col("count"), F.col("total")).alias("share_pct"))
            .orderBy(F.desc("count"), F.asc("label"))
        )

    # ---- dates ------------------------------------------------------------------------------

    @cached_property
    def _days(self) -> DataFrame:
        """Rows per calendar day: at most one row for each day of the calendar."""
        self._require("date")
        present = self._rows.where(F.col("v").isNotNull())
        return present.groupBy(F.to_date("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))

    def date_stats(self) -> DataFrame:
        """``(min, max, missing_period_days, largest_gap_days)``: one row."""
        # unpartitioned, but over calendar days only
        gap = F.datediff("d", F.lag("d").over(W.orderBy("d"))) - 1
        spans = self._days.select("d", gap.alias("gap")).agg(
            F.struct(
                F.greatest(F.datediff(F.max("d"), F.min("d")) + 1 - F.count("d"), F.lit(0)).alias("missing"),
                F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.lit(0)).alias("gap"),
            )
        ).scalar()
        ends = self._rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        filled = F.col("lo").isNotNull()
        return ends.select(
            display_text(F.col("lo"), self._value_type).alias("min"),
            display_text(F.col("hi"), self._value_type).alias("max"),
            F.when(filled, spans["missing"]).cast("bigint").alias("missing_period_days"),
            F.when(filled, spans["gap"]).cast("bigint").alias("largest_gap_days"),
        )

    def month_histogram(self) -> DataFrame:
        """``(label, count)`` per month, label ``YYYY-MM``, ascending."""
        return (
            self._days.groupBy(F.date_format("d", "yyyy-MM").alias("label"))
            .agg(F.sum("n").alias("count"))
            .orderBy("label")
        )

    # ---- booleans ---------------------------------------------------------------------------

    def boolean_stats(self) -> DataFrame:
        """True, false and null counts with their shares of all profiled rows: one row."""
        self._require("boolean")
        v = F.col("v")
        counts = self._rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(v).alias("true_count"),
            F.count_if(~v).alias("false_count"),
            F.count_if(v.isNull()).alias("null_count"),
        )
        names = ("true", "false", "null")
        return counts.select(
            *[f"{k}_count" for k in names],
            *[pct(F.col(f"{k}_count"), F.col("rows")).alias(f"{k}_share_pct") for k in names],
        )

    # ---- everything at once -----------------------------------------------------------------

    def summary(self) -> DataFrame:
        """The whole profile as one row with nested facets, computed in one query."""
        row, rows = _nested, _listed
        count_then = lambda name: ((-F.col("count")), F.col(name))
        facets: list[Column] = []
        if self.type in ("integer", "float"):
            facets = [
                row(self.numeric_stats()).alias("stats"),
                rows(self.histogram(), F.col("bin")).alias("histogram"),
                rows(self.tail_values(), F.col("tail"), *count_then("value")).alias("tail_values"),
            ]
        elif self.type == "string":
            facets = [
                row(self.string_stats()).alias("stats"),
                rows(self.top_values(), *count_then("value")).alias("top_values"),
                rows(self.sentinel_tokens(), *count_then("token")).alias("sentinel_tokens"),
                rows(self.length_outliers(), -F.col("distance"), F.col("example")).alias("length_outliers"),
                rows(self.pattern_classes(), *count_then("label")).alias("pattern_classes"),
            ]
        elif self.type == "date":
            facets = [
                row(self.date_stats()).alias("stats"),
                rows(self.month_histogram(), F.col("label")).alias("histogram"),
            ]
        else:
            facets = [row(self.boolean_stats()).alias("stats")]
        return self.universal().select(
            F.lit(self.column).alias("column"),
            F.lit(self.type).alias("type"),
            F.lit(self.total_rows).cast("bigint").alias("total_rows"),
            F.lit(self.sampled).alias("sampled"),
            "*",
            *facets,
        )


def _nested(frame: DataFrame) -> Column:
    """A one-row facet as a struct."""
    return frame.select(F.struct("*")).scalar()


def _listed(frame: DataFrame, *by: Column) -> Column:
    """A short facet (top-k, bins, months) as a sorted array of structs."""
    order = F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)]).alias("order")
    pairs = frame.select(F.struct(order, F.struct("*").alias("item")).alias("p"))
    return pairs.agg(
        F.transform(F.array_sort(F.collect_list("p")), lambda p: p["item"]).alias("items")
    ).scalar()


def profile(df: DataFrame, column: str, max_rows: int | None = None) -> DataFrame:
    """One row: the full profile of a column (see :class:`Profile` for single facets)."""
    return Profile(df, column, max_rows).summary()
