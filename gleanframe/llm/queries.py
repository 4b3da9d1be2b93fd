"""Registered queries of the operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.llm import collocations, decontaminate, extraction, licenses, mixing, packing, quality, repeats, simhash, token_files, toxicity, url_filter, whitening
from gleanframe.llm.common import table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("metrics")
    return quality.judge(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )


def _rule_sql(rule: quality.Rule) -> str:
    bounds = [f"{rule.metric} >= {rule.low}"] * (rule.low is not None)
    return " AND ".join(bounds + [f"{rule.metric} <= {rule.high}"] * (rule.high is not None))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
spot AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, s FROM spot GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM spot JOIN rep USING (doc_id, s) CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    greatest(len(w), 1)::DOUBLE AS one_w, greatest(len(l), 1)::DOUBLE AS one_l,
    len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))}))) AS stops,
    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-•●▪◦]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS ellipses
  FROM d LEFT JOIN cov USING (doc_id)),
r AS (
  SELECT *, word_chars / one_w AS mean_word_length, n_symbols / one_w AS symbols_per_word,
    stops / one_w AS stop_word_ratio, n_dup_lines / one_l AS dup_line_ratio,
    bullets / one_l AS bullet_line_ratio, ellipses / one_l AS ellipsis_line_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule_sql(x) for x in quality.RULES)} AS kept
FROM r"""


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.report(table(spark, folder, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_pairs(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents").select("doc_id", "source", "text"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    return url_filter.filter_urls(pages, rules).drop("url")


OP8_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(str(x) for x in url_filter.RULES)}),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS won
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(won, 'allow') AS verdict
FROM p LEFT JOIN fits USING (host, path)"""


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), '\\p{{N}}+', '0', 'g')"
_PAIRS = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
# Runs of possible lines are made with the vocabulary; the score is taken against every template.
OP9_SQL = f"""
WITH t AS (
  SELECT i, license, {_PAIRS} AS g FROM (
    SELECT i, license, list_filter(string_split(replace({_NORMAL.format("text")}, chr(10), ' '), ' '), lambda x: x <> '') AS w
    FROM (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(x)})" for i, (n, x) in enumerate(licenses.TEMPLATES))}) v(i, license, text))),
v AS (SELECT [{", ".join(_quoted(x) for x in licenses.vocabulary())}] AS ws),
l AS (
  SELECT doc_id, list_filter(list_transform(string_split({_NORMAL.format("coalesce(text, '')")}, chr(10)),
    lambda x: list_filter(string_split(x, ' '), lambda y: y <> '')), lambda x: len(x) > 0) AS ws FROM documents),
n AS (SELECT doc_id, line, ws[line + 1] AS w FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS line FROM l)),
ok AS (
  SELECT doc_id, line, w FROM n, v
  WHERE len(w) > 1 AND len(list_filter(w, lambda x: list_contains(ws, x))) >= {licenses.LEAST / (2 - licenses.LEAST)} * (len(w) - 1) - 1e-9),
runs AS (
  SELECT doc_id, min(line) AS first_line, max(line) AS last_line, flatten(list(w ORDER BY line)) AS w
  FROM (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM ok) GROUP BY doc_id, run HAVING count(*) > 1),
units AS (SELECT doc_id, line AS first_line, line AS last_line, {_PAIRS} AS g FROM ok
  UNION ALL SELECT doc_id, first_line, last_line, {_PAIRS} AS g FROM runs),
scored AS (
  SELECT doc_id, first_line, last_line, license, max(2 * len(list_intersect(units.g, t.g)) / (len(units.g) + len(t.g))) AS dice
  FROM units CROSS JOIN t GROUP BY ALL)
SELECT doc_id, first_line, last_line, license, dice FROM scored WHERE dice >= {licenses.LEAST}"""


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, table(spark, folder, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits"
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))


def _cut_sql(words: int) -> str:
    """Phrases of ``words`` words with their first k words and the rest, one row per cut."""
    return f"""SELECT lang, p, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS first, array_to_string(list_slice(ws, k + 1, {words}), ' ') AS rest
  FROM (SELECT *, unnest(range(1, {words})) AS k FROM known WHERE words = {words})"""


_WORDS = range(1, collocations.LONGEST + 1)
OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS ({" UNION ALL ".join(f"SELECT lang, {k} AS words, unnest([array_to_string(list_slice(w, i, i + {k - 1}), ' ') for i in range(1, len(w) - {k - 2})]) AS p FROM pieces" for k in _WORDS)}),
known AS (SELECT lang, words, p, string_split(p, ' ') AS ws, count(*) AS a FROM grams GROUP BY lang, words, p HAVING count(*) >= {collocations.LEAST}),
cuts AS ({" UNION ALL ".join(_cut_sql(k) for k in _WORDS[1:])}),
scored AS (
  SELECT cuts.lang, cuts.p, cuts.a, k, f.a AS l, r.a AS r, n, (1000::HUGEINT * cuts.a * n) // (f.a::HUGEINT * r.a) AS score
  FROM cuts JOIN known f ON f.lang = cuts.lang AND f.p = cuts.first JOIN known r ON r.lang = cuts.lang AND r.p = cuts.rest
  JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT x.lang, x.p FROM known x JOIN known y
  ON x.lang = y.lang AND x.words > 1 AND y.words > x.words AND y.a >= x.a AND contains(' ' || y.p || ' ', ' ' || x.p || ' ')),
kept AS (SELECT * FROM weakest ANTI JOIN held USING (lang, p))
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) WHERE rank <= {collocations.TOP}"""


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_simhash_near_duplicates": (op4_simhash_near_duplicates, None),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, None),
    "op6_source_mixing": (op6_source_mixing, None),
    "op7_token_files": (op7_token_files, None),
    "op8_url_filter": (op8_url_filter, OP8_SQL),
    "op9_license_scan": (op9_license_scan, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_phrase_collocations": (op12_phrase_collocations, OP12_SQL),
    "op13_best_fit_packing": (op13_best_fit_packing, None),
}
