"""Ranks, quantiles, exact sums and samples against numpy and exact fractions, with skew and ties."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe import ROWID, Profile
from gleanframe.operators.exact_sums import exact_mean, exact_sum, rounded
from gleanframe.operators.ranks import RankIndex, sample_rows


@pytest.fixture
def many_ranges(spark):
    """Keep ranges apart that are too small to be worth a task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)


SHAPES = {
    "normal": lambda rng, n: rng.normal(size=n),
    "hot": lambda rng, n: np.where(rng.random(n) < 0.4, 7.0, rng.normal(5, 3, n)),
    "few": lambda rng, n: rng.integers(0, 5, n).astype(float),
    "constant": lambda rng, n: np.full(n, 2.5),
    "huge_range": lambda rng, n: 10.0 ** rng.uniform(-300, 300, n),
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_values_at_ranks(spark, many_ranges, shape):
    n = 4000
    values = SHAPES[shape](np.random.default_rng(3), n)
    counts = _frame(spark, values).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    index = RankIndex.build(counts, [F.asc("v")], weighted=True)
    ranks = [0, 1, 200, 1999, 2000, 3800, n - 2, n - 1]
    assert index.total == n
    assert index.at(ranks, "v") == {r: np.sort(values)[r] for r in ranks}


def test_slices_and_beginnings_by_text_and_row(spark, many_ranges):
    rows = [("hot" if i % 3 else f"t{i % 50:02d}" if i % 7 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "t string, r bigint").repartition(4)
    for descending in (False, True):
        order = [F.desc_nulls_last("t"), F.desc("r")] if descending else [F.asc_nulls_last("t"), F.asc("r")]
        want = sorted((r for r in rows if r[0] is not None), reverse=descending)
        want += sorted((r for r in rows if r[0] is None), reverse=descending)
        index = RankIndex.build(df, order)
        assert len(index.ranges) > 1
        for rank, count in ((0, 1), (0, 10), (5, 900), (1500, 1), (2990, 50), (2999, 1), (3000, 5)):
            got = sorted((r["_rank"], r["t"], r["r"]) for r in index.slice(rank, count).collect())
            assert [g[1:] for g in got] == want[rank : rank + count]
            assert [g[0] for g in got] == list(range(rank, min(rank + count, 3000)))
        for count in (1, 7, 1400, 2999, 3000, 9999):
            kept = {tuple(r) for r in index.first(count).collect()}
            assert kept == set(want[:count])


def test_one_value_in_most_rows_is_one_key(spark):
    counts = spark.createDataFrame([(1.0, 10**12), (2.0, 1), (3.0, 10**11)], "v double, n bigint")
    index = RankIndex.build(counts, [F.asc("v")], weighted=True)
    assert index.at([0, 10**12 - 1, 10**12, 10**12 + 1], "v") == {0: 1.0, 10**12 - 1: 1.0, 10**12: 2.0, 10**12 + 1: 3.0}


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1777])
def test_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(100, 40, n), 2)
    want = [round(float(q), 4) for q in np.quantile(values, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])]
    df = _frame(spark, values)
    assert Profile(df, "v")._quantiles == pytest.approx(want, abs=1.01e-4)


def _summed(spark, values, partitions=3, kind="double"):
    df = spark.createDataFrame([(v, k) for v, k in values], f"v {kind}, n bigint").repartition(partitions)
    return exact_sum(df)


def test_sums_do_not_depend_on_the_order(spark):
    for order in ([1e16, 1.0, -1e16, 1.0], [1.0, 1.0, 1e16, -1e16], [-1e16, 1e16, 1.0, 1.0]):
        rows, total = _summed(spark, [(v, 1) for v in order], 1)
        assert (rows, rounded(total), exact_mean(rows, total)) == (4, 2.0, 0.5)


def test_sums_are_exact_over_the_whole_range_of_doubles(spark):
    rng = np.random.default_rng(5)
    values = [float(m * 2.0**e) for m, e in zip(rng.uniform(-1, 1, 3000), rng.integers(-1074, 1000, 3000))]
    values += [5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, -0.0, 2.0**32, 2.0**-32, -(2.0**64), np.nextafter(2.0**32, 0), 1.0, np.nextafter(1.0, 0)]
    pairs = [(float(v), int(k)) for v, k in zip(values, rng.integers(1, 10**6, len(values)))]
    want = sum(Fraction(v) * k for v, k in pairs)
    for partitions in (1, 7):
        rows, total = _summed(spark, pairs, partitions)
        assert rows == sum(k for _, k in pairs) and total == want
        assert rounded(total) == rounded(want)


def test_sums_of_other_numbers(spark):
    assert _summed(spark, [(float("nan"), 1), (1.0, 2)])[0] == 3
    assert math.isnan(_summed(spark, [(float("nan"), 1), (1.0, 2)])[1])
    assert math.isnan(_summed(spark, [(float("inf"), 1), (float("-inf"), 2)])[1])
    assert _summed(spark, [(float("-inf"), 1), (1.0, 2)])[1] == -math.inf
    assert rounded(_summed(spark, [(1.7e308, 9)])[1]) == math.inf
    assert _summed(spark, []) == (0, 0) and exact_mean(0, Fraction(0)) is None
    assert _summed(spark, [(2**62, 8), (-1, 1)], kind="bigint")[1] == 8 * 2**62 - 1


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", ROWID)
    one = sample_rows(df, 700, ROWID, 5000)
    ids = sorted(r[0] for r in one.collect())
    assert len(set(ids)) == 700
    again = sample_rows(df.repartition(7), 700, ROWID, 5000)
    assert sorted(r[0] for r in again.collect()) == ids
    other = sample_rows(df, 700, ROWID, 5000, seed=1)
    assert sorted(r[0] for r in other.collect()) != ids
    assert sample_rows(df, 5000, ROWID, 5000) is df
    # spread over the table, not its beginning
    assert 1500 < sum(ids) / 700 < 3500
