"""Column profiles: universal, numeric, string, date and boolean facets, and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe import ROWID, Profile, profile
from gleanframe.functions.columns import display_text
from gleanframe.operators.ranks import sample_rows
from gleanframe.functions.text import CODE, DIGITS, EMAIL, UUID
from suite.common import JUDGED_SQL, identified, judged, table

# ---- sources ------------------------------------------------------------------------------------

_MISSING = """CASE o_orderpriority WHEN '1-URGENT' THEN 'N/A' WHEN '2-HIGH' THEN ' none '
  WHEN '3-MEDIUM' THEN '   ' WHEN '4-NOT SPECIFIED' THEN o_orderpriority ELSE '-' END"""
_MISSING_SQL = f"(SELECT {_MISSING} AS token FROM orders)"

_KINDS = """CASE WHEN c_nationkey < 5 THEN lower(replace(c_name, '#', '.')) || '@example.com'
  WHEN c_nationkey < 9 THEN '000' || CAST(c_custkey AS VARCHAR(20))
  WHEN c_nationkey < 13 THEN replace(c_name, '#', '-')
  WHEN c_nationkey < 17 THEN ' ' || substring(md5(c_name), 1, 8) || '-' || substring(md5(c_name), 9, 4)
    || '-4' || substring(md5(c_name), 14, 3) || '-a' || substring(md5(c_name), 18, 3)
    || '-' || substring(md5(c_name), 21, 12)
  WHEN c_nationkey < 18 THEN ' ' ELSE c_name END"""
_KINDS_SQL = f"(SELECT {_KINDS} AS mixed FROM customer)"


def _missing(spark, folder):
    return table(spark, folder, "orders").selectExpr(f"{_MISSING} AS token")


def _kinds(spark, folder):
    return table(spark, folder, "customer").selectExpr(f"{_KINDS} AS mixed")


def _of(source, column, facet, **options):
    def run(spark, folder):
        df = source(spark, folder) if callable(source) else table(spark, folder, source)
        return getattr(Profile(df, column, **options), facet)()

    return run


# ---- oracle SQL ---------------------------------------------------------------------------------


def _pct(part, whole, digits=2):
    return f"round(({part})::DOUBLE / ({whole})::DOUBLE * 100.0, {digits})"


def _counts(source, c):
    return f"(SELECT {c} AS v, count(*) AS n FROM {source} t WHERE {c} IS NOT NULL GROUP BY 1)"


def _universal(source, c):
    return f"""WITH b AS (SELECT count(*) AS sample_size, count({c}) AS non_null_count,
    count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM {source} t),
  c AS {_counts(source, c)},
  r AS (SELECT min(v) AS v, any_value(n) AS top, count(*) AS leaders FROM c
    WHERE n = (SELECT max(n) FROM c))
SELECT sample_size, non_null_count, null_count, unique_count,
  {_pct('non_null_count', 'sample_size')} AS coverage_pct,
  {_pct('unique_count', 'non_null_count')} AS cardinality_pct,
  CASE WHEN {_pct('unique_count', 'non_null_count')} >= 80 THEN 'high'
       WHEN {_pct('unique_count', 'non_null_count')} >= 20 THEN 'medium' ELSE 'low' END AS cardinality_band,
  CASE WHEN non_null_count = sample_size AND unique_count = sample_size THEN 'strong'
       WHEN null_count = 0 AND {_pct('unique_count', 'non_null_count')} >= 98 THEN 'possible'
       ELSE 'unlikely' END AS key_hint,
  CASE WHEN leaders > 1 THEN 'none' ELSE v::VARCHAR END AS dominant_value,
  top AS dominant_count,
  CASE WHEN leaders = 1 THEN {_pct('top', 'non_null_count')} END AS dominant_share_pct
FROM b, r"""


def _quantile(c, p):
    return f"round(quantile_cont({c}, {p})::DOUBLE, 4)"


def _numeric(source, c):
    return f"""WITH s AS (SELECT count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
    round(sum({c})::DOUBLE, 4) AS sum, round(avg({c})::DOUBLE, 4) AS mean,
    {_quantile(c, 0.5)} AS median, round(stddev_samp({c})::DOUBLE, 4) AS stddev,
    {_quantile(c, 0.05)} AS p5, {_quantile(c, 0.25)} AS p25, {_quantile(c, 0.75)} AS p75,
    {_quantile(c, 0.95)} AS p95, {_quantile(c, 0.99)} AS p99,
    count(DISTINCT {c}) AS d FROM {source} t),
  k AS (SELECT count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives,
    count(*) FILTER ({c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS outliers,
    count(*) FILTER ({c} < p5) AS low, count(*) FILTER ({c} > p95) AS high FROM {source} t, s)
SELECT min, max, sum, mean, median, stddev, p5, p25, p75, p95, p99, p75 - p25 AS iqr,
  d AS distinct_count, {_pct('d', 'n')} AS uniqueness_rate_pct,
  round(100.0::DOUBLE - {_pct('d', 'n')}, 2) AS duplicate_rate_pct,
  {_pct('zeros', 'n')} AS zero_rate_pct, {_pct('negatives', 'n')} AS negative_rate_pct,
  outliers AS outlier_count, {_pct('outliers', 'n')} AS outlier_rate_pct,
  low AS low_tail_count, {_pct('low', 'n')} AS low_tail_rate_pct,
  high AS high_tail_count, {_pct('high', 'n')} AS high_tail_rate_pct FROM s, k"""


def _tails(source, c):
    tail = lambda name, p, side: (
        f"(SELECT '{name}' AS tail, v::VARCHAR AS value, n AS count FROM {_counts(source, c)} "
        f"WHERE v {side} (SELECT {_quantile(c, p)} FROM {source} t) ORDER BY n DESC, v LIMIT 5)"
    )
    return f"{tail('low', 0.05, '<')} UNION ALL {tail('high', 0.95, '>')}"


def _histogram(source, c):
    return f"""WITH b AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
    (max({c})::DOUBLE - min({c})::DOUBLE) / 20.0::DOUBLE AS w FROM {source} t)
SELECT bin::INTEGER AS bin, round(any_value(lo) + bin * any_value(w), 4) AS low,
  round(any_value(lo) + bin * any_value(w) + any_value(w), 4) AS high, count(*) AS count
FROM (SELECT least(floor(({c}::DOUBLE - lo) / w)::INTEGER, 19) AS bin, lo, w
  FROM {source} t, b WHERE {c} IS NOT NULL AND lo < hi) GROUP BY bin"""


def _top(source, c, rows=10):
    return f"""SELECT v AS value, n AS count, {_pct('n', f'(SELECT count({c}) FROM {source} t)', 1)} AS share_pct
FROM {_counts(source, c)} ORDER BY n DESC, v LIMIT {rows}"""


_SPACE = "E'\\t\\n\\x0b\\f\\r ' || chr(160) || chr(5760) || " + " || ".join(
    f"chr({n})" for n in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)


def _trimmed(c):
    return f"trim({c}, {_SPACE})"


def _token(c):
    return f"""CASE WHEN length({c}) = 0 THEN '(empty)' WHEN length({_trimmed(c)}) = 0 THEN '(whitespace)'
  WHEN lower({_trimmed(c)}) IN ('na', 'n/a', 'null', 'none', '-') THEN lower({_trimmed(c)}) END"""


def _string(source, c):
    shape = f"regexp_replace(regexp_replace({_trimmed(c)}, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g')"
    return f"""WITH m AS (SELECT avg(length({c}))::DOUBLE AS mean, stddev_pop(length({c}))::DOUBLE AS sd,
    count({c}) AS n FROM {source} t),
  s AS (SELECT min(length({c})) AS min_length, max(length({c})) AS max_length,
    median(length({c}))::DOUBLE AS median_length,
    count(*) FILTER (length({_trimmed(c)}) = 0) AS blank_count,
    count({_token(c)}) AS sentinel_count,
    count(*) FILTER (sd > 0 AND abs(length({c}) - mean) > 2 * sd) AS outlier_length_count,
    count(DISTINCT {shape}) FILTER (length({_trimmed(c)}) > 0) AS distinct_pattern_count
    FROM {source} t, m WHERE {c} IS NOT NULL),
  k AS (SELECT sum(n)::DOUBLE AS top FROM (SELECT n FROM {_counts(source, c)} ORDER BY n DESC LIMIT 10))
SELECT min_length::INTEGER AS min_length, max_length::INTEGER AS max_length, median_length, blank_count,
  {_pct('blank_count', 'n')} AS blank_pct, sentinel_count, outlier_length_count,
  {_pct('outlier_length_count', 'n')} AS outlier_length_pct, distinct_pattern_count,
  {_pct('top', 'n')} AS top10_coverage_pct,
  CASE WHEN top / n::DOUBLE * 100.0 >= 70 THEN 'low' WHEN top / n::DOUBLE * 100.0 >= 40 THEN 'medium'
       ELSE 'high' END AS tail_profile
FROM s, m, k"""


def _sentinels(source, c):
    return f"""SELECT token, count(*) AS count FROM (SELECT {_token(c)} AS token FROM {source} t)
WHERE token IS NOT NULL GROUP BY token"""


def _outlier_lengths(source, c):
    return f"""WITH m AS (SELECT avg(length({c}))::DOUBLE AS mean, stddev_pop(length({c}))::DOUBLE AS sd FROM {source} t)
SELECT substring(v, 1, 80) AS example, length(v)::INTEGER AS length,
  round(abs(length(v) - mean), 4) AS distance
FROM (SELECT DISTINCT {c} AS v FROM {source} t), m WHERE abs(length(v) - mean) > 2 * sd
ORDER BY abs(length(v) - mean) DESC, v LIMIT 5"""


def _patterns(source, c):
    return f"""WITH x AS (SELECT {_trimmed(c)} AS v FROM {source} t WHERE length({_trimmed(c)}) > 0),
  y AS (SELECT CASE WHEN regexp_matches(lower(v), '{UUID}') THEN 'uuid'
    WHEN regexp_matches(v, '{EMAIL}') THEN 'email' WHEN regexp_matches(v, '{DIGITS}') THEN 'numeric-only'
    WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '{CODE}')
    THEN 'code-like' ELSE 'free-text' END AS label FROM x)
SELECT label, count(*) AS count, {_pct('count(*)', '(SELECT count(*) FROM y)')} AS share_pct
FROM y GROUP BY label"""


def _dates(source, c):
    return f"""SELECT min({c})::VARCHAR AS min, max({c})::VARCHAR AS max,
  greatest(0, datediff('day', min({c})::DATE, max({c})::DATE) + 1 - count(DISTINCT {c}::DATE))::BIGINT
    AS missing_period_days,
  (SELECT coalesce(max(g), 0) FROM (SELECT datediff('day', lag(d) OVER (ORDER BY d), d) - 1 AS g
    FROM (SELECT DISTINCT {c}::DATE AS d FROM {source} t WHERE {c} IS NOT NULL)))::BIGINT
    AS largest_gap_days
FROM {source} t"""


def _months(source, c):
    return f"""SELECT strftime(date_trunc('month', {c}), '%Y-%m') AS label, count(*) AS count
FROM {source} t WHERE {c} IS NOT NULL GROUP BY 1"""


def _boolean(source, c):
    return f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER ({c}) AS true_count,
  count(*) FILTER (NOT {c}) AS false_count, count(*) FILTER ({c} IS NULL) AS null_count FROM {source} t)
SELECT true_count, false_count, null_count, {_pct('true_count', 'n')} AS true_share_pct,
  {_pct('false_count', 'n')} AS false_share_pct, {_pct('null_count', 'n')} AS null_share_pct FROM s"""


def _sparse_days(spark, folder):
    """The day each customer first ordered: many days have none."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate"))


_SPARSE_SQL = "(SELECT o_custkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey)"


def _sample(spark, folder):
    """A sample has the exact size, distinct rows of the table, and is the same every time."""
    orders = identified(spark, folder, "orders").select(ROWID, "o_totalprice")
    total = orders.count()
    one = sample_rows(orders, 5000, ROWID, total)
    two = sample_rows(orders, 5000, ROWID, total)
    both = one.select(ROWID).intersect(two.select(ROWID)).agg(F.count(F.lit(1))).scalar()
    known = one.join(orders, ROWID, "left_semi").agg(F.count(F.lit(1))).scalar()
    return one.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(ROWID).alias("distinct_rows")
    ).select("*", both.alias("same_again"), known.alias("from_table"))


def _sums_in_any_order(spark, folder):
    """Sum and mean of prices, dealt out two ways: equal to the last bit, and right to 4 decimals."""
    prices = table(spark, folder, "lineitem").select("l_extendedprice")
    one, two = (
        Profile(prices.repartition(n, by), "l_extendedprice").numeric_stats().select("sum", "mean", F.lit(n).alias("n"))
        for n, by in ((3, "l_extendedprice"), (7, F.hash("l_extendedprice") % 5))
    )
    # Not intersect(): the values are constants of the plan, so Spark would make it a join without a key.
    both = one.unionByName(two).groupBy("sum", "mean").agg(F.count_distinct("n").alias("ways"))
    return both.where("ways = 2").drop("ways")


def _sampled_profile(spark, folder):
    orders = identified(spark, folder, "orders")
    return profile(orders, "o_totalprice", max_rows=4000).select(
        "type", "sampled", "sample_size", "non_null_count", "total_rows"
    )


#: Nested facets of a profile and the columns their items have; all values are compared as text.
_LISTED = {
    "histogram": ("bin", "low", "high", "count"),
    "tail_values": ("tail", "value", "count"),
    "top_values": ("value", "count", "share_pct"),
    "sentinel_tokens": ("token", "count"),
    "length_outliers": ("example", "length", "distance"),
    "pattern_classes": ("label", "count", "share_pct"),
}
_MONTHS = {"histogram": ("label", "count")}


def _line(name, fields, types):
    def item(x):
        texts = [_text(x[f], types[f].dataType) for f in fields]
        return F.struct(F.lit(name).alias("facet"), F.concat_ws("|", *texts).alias("item"))

    return item


def _whole(source, column, lists):
    """The nested one-row profile as long rows ``(facet, item)``: every fact of every facet."""

    def run(spark, folder):
        df = source(spark, folder) if callable(source) else table(spark, folder, source)
        whole = profile(df, column)
        single = [f for f in whole.columns if f not in lists and f not in ("column", "sampled", "stats")]
        facts = [(f, whole.schema[f].dataType) for f in single]
        facts += [(f"stats.{f.name}", f.dataType) for f in whole.schema["stats"].dataType]
        items = [F.array(F.struct(F.lit(n).alias("facet"), _text(F.col(n), t).alias("item"))) for n, t in facts]
        for name, fields in lists.items():
            items.append(F.transform(name, _line(name, fields, whole.schema[name].dataType.elementType)))
        return whole.select(F.inline(F.concat(*items)))

    return run


def _text(c, data_type):
    """Numbers in one form in both engines: a whole double as an integer."""
    return F.regexp_replace(F.coalesce(display_text(c, data_type), F.lit("none")), r"\.0$", "")


def _text_sql(c):
    return rf"""regexp_replace(coalesce(({c})::VARCHAR, 'none'), '\.0$', '')"""


def _whole_sql(source, c, kind, stats, stat_names, lists):
    def unpivoted(prefix, names, sql):
        return [f"""SELECT '{prefix}{n}' AS facet, {_text_sql(f'"{n}"')} AS item FROM ({sql})""" for n in names]

    universal = (
        "non_null_count null_count unique_count coverage_pct cardinality_pct cardinality_band key_hint "
        "dominant_value dominant_count dominant_share_pct sample_size"
    ).split()
    parts = [
        f"SELECT 'type' AS facet, '{kind}' AS item",
        f"SELECT 'total_rows' AS facet, count(*)::VARCHAR AS item FROM {source} t",
        *unpivoted("", universal, _universal(source, c)),
        *unpivoted("stats.", stat_names, stats(source, c)),
    ]
    for name, (fields, sql) in lists.items():
        line = " || '|' || ".join(_text_sql(f'"{f}"') for f in fields)
        parts.append(f"SELECT '{name}' AS facet, {line} AS item FROM ({sql})")
    return " UNION ALL ".join(f"({p})" for p in parts)


_NUMERIC_STATS = (
    "min max sum mean median stddev p5 p25 p75 p95 p99 iqr distinct_count uniqueness_rate_pct duplicate_rate_pct "
    "zero_rate_pct negative_rate_pct outlier_count outlier_rate_pct low_tail_count low_tail_rate_pct "
    "high_tail_count high_tail_rate_pct"
).split()
_STRING_STATS = (
    "min_length max_length median_length blank_count blank_pct sentinel_count outlier_length_count "
    "outlier_length_pct distinct_pattern_count top10_coverage_pct tail_profile"
).split()
_DATE_STATS = "min max missing_period_days largest_gap_days".split()
_BOOLEAN_STATS = [f"{k}_{what}" for what in ("count", "share_pct") for k in ("true", "false", "null")]


def _lists(*names):
    return {n: _LISTED[n] for n in names}


def _of_lists(source, c, **sqls):
    return {n: ((_MONTHS if n == "histogram" and sql is _months else _LISTED)[n], sql(source, c)) for n, sql in sqls.items()}


QUERIES = {
    "profile_universal_key": (_of("orders", "o_orderkey", "universal"), _universal("orders", "o_orderkey")),
    "profile_universal_price": (
        _of("lineitem", "l_extendedprice", "universal"),
        _universal("lineitem", "l_extendedprice"),
    ),
    "profile_universal_text": (_of("documents", "text", "universal"), _universal("documents", "text")),
    "profile_universal_nulls": (_of(judged, "quality", "universal"), _universal(JUDGED_SQL, "quality")),
    "profile_universal_boolean": (_of(judged, "good", "universal"), _universal(JUDGED_SQL, "good")),
    "profile_universal_date": (
        _of("lineitem", "l_shipdate", "universal"),
        _universal("lineitem", "l_shipdate"),
    ),
    "profile_numeric_price": (
        _of("lineitem", "l_extendedprice", "numeric_stats"),
        _numeric("lineitem", "l_extendedprice"),
    ),
    "profile_numeric_discount": (
        _of("lineitem", "l_discount", "numeric_stats"),
        _numeric("lineitem", "l_discount"),
    ),
    "profile_numeric_negatives": (
        _of("customer", "c_acctbal", "numeric_stats"),
        _numeric("customer", "c_acctbal"),
    ),
    "profile_numeric_events": (_of("events", "value", "numeric_stats"), _numeric("events", "value")),
    "profile_numeric_integers": (
        _of("documents", "n_chars", "numeric_stats"),
        _numeric("documents", "n_chars"),
    ),
    "profile_numeric_nulls": (_of(judged, "quality", "numeric_stats"), _numeric(JUDGED_SQL, "quality")),
    "profile_numeric_rank_select": (
        _of("lineitem", "l_extendedprice", "numeric_stats"),
        _numeric("lineitem", "l_extendedprice"),
    ),
    "profile_tail_values": (
        _of("lineitem", "l_quantity", "tail_values"),
        _tails("lineitem", "l_quantity"),
    ),
    "profile_tail_values_events": (_of("events", "value", "tail_values"), _tails("events", "value")),
    "profile_histogram_price": (
        _of("lineitem", "l_extendedprice", "histogram"),
        _histogram("lineitem", "l_extendedprice"),
    ),
    "profile_histogram_events": (_of("events", "value", "histogram"), _histogram("events", "value")),
    "profile_string_documents": (_of("documents", "text", "string_stats"), _string("documents", "text")),
    "profile_string_urls": (_of("pages", "url", "string_stats"), _string("pages", "url")),
    "profile_string_names": (_of("part", "p_name", "string_stats"), _string("part", "p_name")),
    "profile_string_missing": (_of(_missing, "token", "string_stats"), _string(_MISSING_SQL, "token")),
    "profile_top_values": (_of("documents", "source", "top_values"), _top("documents", "source")),
    "profile_top_texts": (_of("documents", "text", "top_values"), _top("documents", "text")),
    "profile_sentinels": (
        _of(_missing, "token", "sentinel_tokens"),
        _sentinels(_MISSING_SQL, "token"),
    ),
    "profile_length_outliers": (
        _of("documents", "text", "length_outliers"),
        _outlier_lengths("documents", "text"),
    ),
    "profile_pattern_classes": (_of(_kinds, "mixed", "pattern_classes"), _patterns(_KINDS_SQL, "mixed")),
    "profile_pattern_urls": (_of("pages", "url", "pattern_classes"), _patterns("pages", "url")),
    "profile_dates_shipped": (
        _of("lineitem", "l_shipdate", "date_stats"),
        _dates("lineitem", "l_shipdate"),
    ),
    "profile_dates_events": (_of("events", "ts", "date_stats"), _dates("events", "ts")),
    "profile_dates_sparse": (
        _of(_sparse_days, "o_orderdate", "date_stats"),
        _dates(_SPARSE_SQL, "o_orderdate"),
    ),
    "profile_months": (
        _of("lineitem", "l_shipdate", "month_histogram"),
        _months("lineitem", "l_shipdate"),
    ),
    "profile_boolean": (_of(judged, "good", "boolean_stats"), _boolean(JUDGED_SQL, "good")),
    "profile_whole_numeric": (
        _whole("orders", "o_custkey", _lists("histogram", "tail_values")),
        _whole_sql(
            "orders", "o_custkey", "integer", _numeric, _NUMERIC_STATS,
            _of_lists("orders", "o_custkey", histogram=_histogram, tail_values=_tails),
        ),
    ),
    "profile_whole_string": (
        _whole(
            "conversations", "text",
            _lists("top_values", "sentinel_tokens", "length_outliers", "pattern_classes"),
        ),
        _whole_sql(
            "conversations", "text", "string", _string, _STRING_STATS,
            _of_lists(
                "conversations", "text", top_values=_top, sentinel_tokens=_sentinels,
                length_outliers=_outlier_lengths, pattern_classes=_patterns,
            ),
        ),
    ),
    "profile_whole_date": (
        _whole("orders", "o_orderdate", _MONTHS),
        _whole_sql("orders", "o_orderdate", "date", _dates, _DATE_STATS, _of_lists("orders", "o_orderdate", histogram=_months)),
    ),
    "profile_whole_boolean": (
        _whole(judged, "good", {}),
        _whole_sql(JUDGED_SQL, "good", "boolean", _boolean, _BOOLEAN_STATS, {}),
    ),
    "profile_sums_in_any_order": (
        _sums_in_any_order,
        "SELECT round(sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE, 4) AS sum, "
        "round(sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE / count(*), 4) AS mean FROM lineitem",
    ),
    "profile_sample": (
        _sample,
        "SELECT least(count(*), 5000) AS rows, least(count(*), 5000) AS distinct_rows, "
        "least(count(*), 5000) AS same_again, least(count(*), 5000) AS from_table FROM orders",
    ),
    "profile_of_sample": (
        _sampled_profile,
        "SELECT 'float' AS type, count(*) > 4000 AS sampled, least(count(*), 4000) AS sample_size, "
        "least(count(*), 4000) AS non_null_count, count(*) AS total_rows FROM orders",
    ),
}
