"""One declarative text for two engines: names in @ signs stand for what the engines spell differently."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import lists
from ..operators import words
from .analyses import ARTICLES

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
# article metrics in lists: a sorted word is the first of its type where the one before it differs
_FIRST, _SYLLABLES = "x.b IS NULL OR x.b <> x.t", "CAST(greatest(1, @vowel_groups@ - CASE WHEN x LIKE '%e' AND @vowel_groups@ > 1 THEN 1 ELSE 0 END) AS BIGINT)"
_COUNTED = f"""words AS (SELECT article_id, year, corpus, article_type, word_count, @alpha@ AS k, @sentences@ AS ss FROM a WHERE length(trim(text)) >= 10
), by_type AS (SELECT *, @by_type@ AS s0 FROM words
), sorted AS (SELECT article_id, year, corpus, article_type, word_count, k, CAST(@len@(k) AS BIGINT) AS n, @places@ AS s, @transform@(ss, @arrow@ CAST(@runs_in_x@ AS BIGINT)) AS sl, @transform@(k, @arrow@ {_SYLLABLES}) AS sy FROM by_type
), counted AS (
  SELECT article_id, year, corpus, article_type, word_count, n, CAST(@len@(sl) AS BIGINT) AS sents, @sum_a@(sl@sum_b@ AS sent_tokens, CASE WHEN @len@(sl) > 0 THEN @list_median@ ELSE 0e0 END AS sent_median,
    CAST(@len@(@filter@(s, @arrow@ {_FIRST})) AS BIGINT) AS types, CAST(@len@(@filter@(s, @arrow@ ({_FIRST}) AND (x.a IS NULL OR x.a <> x.t))) AS BIGINT) AS hapaxes,
    @sum_a@(@transform@(s, @arrow@ CAST(CASE WHEN n < 100 THEN CASE WHEN {_FIRST} THEN 1 ELSE 0 END ELSE greatest(0, least(x.p, n - 100) - greatest(CASE WHEN {_FIRST} THEN 0 ELSE x.bp + 1 END, x.p - 99, 0) + 1) END AS BIGINT))@sum_b@ AS windowed,
    CAST(@len@(@filter@(k, @arrow@ x IN (@function_words@))) AS BIGINT) AS functions, @sum_a@(@transform@(k, @arrow@ CAST(length(x) AS BIGINT))@sum_b@ AS letters, @sum_a@(sy@sum_b@ AS syllables, CAST(@len@(@filter@(sy, @arrow@ x >= 3)) AS BIGINT) AS polysyllables
  FROM sorted"""
_FREQ = """content AS (SELECT year, tok FROM tokens WHERE tok NOT IN (@stopwords@)
), per AS (SELECT year, tok AS word, count(*) AS n FROM content GROUP BY year, tok
), totals AS (SELECT year, sum(n) AS total FROM per GROUP BY year
), ranked AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, word) AS r FROM per
), freq AS (SELECT ranked.year, word, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM ranked JOIN totals ON ranked.year = totals.year WHERE r <= 600"""
_GRAMS = """lists AS (SELECT article_id, date, year, @tokens@ AS k FROM a
), inner_lists AS (SELECT year, @grams@ AS k FROM lists
), edges AS (SELECT article_id, date, year, @edge_tokens@ AS k FROM lists
), edge_tokens AS (SELECT article_id, date, year, @pos@ AS pos, tok FROM edges @unnest@
), stream AS (
  SELECT year, article_id AS a1, tok AS w1, lead(article_id, 1) OVER s AS a2, lead(tok, 1) OVER s AS w2, lead(article_id, 2) OVER s AS a3, lead(tok, 2) OVER s AS w3
  FROM edge_tokens WINDOW s AS (PARTITION BY year ORDER BY date, article_id, pos)
), grams AS (
  SELECT year, tok AS ngram FROM inner_lists @unnest@
  UNION ALL SELECT year, concat(w1, ' ', w2) AS ngram FROM stream WHERE w2 IS NOT NULL AND a1 <> a2
  UNION ALL SELECT year, concat(w1, ' ', w2, ' ', w3) AS ngram FROM stream WHERE w3 IS NOT NULL AND a1 <> a3
), counts AS (SELECT year, ngram, count(*) AS c FROM grams GROUP BY year, ngram
), counted AS (SELECT year, CASE WHEN split_part(ngram, ' ', 3) = '' THEN 2 ELSE 3 END AS n, ngram, c, split_part(ngram, ' ', 1) AS p, split_part(ngram, ' ', 2) AS q,
    CASE WHEN split_part(ngram, ' ', 3) = '' THEN split_part(ngram, ' ', 2) ELSE split_part(ngram, ' ', 3) END AS z FROM counts
), gram_totals AS (SELECT year, n, sum(c) AS total FROM counted GROUP BY year, n
), sizes AS (SELECT year FROM gram_totals WHERE n = 2 AND total >= 99
), good AS (
  SELECT *, row_number() OVER (PARTITION BY year, n ORDER BY c DESC, ngram) AS r FROM counted
  WHERE p NOT IN (@stopwords@) AND z NOT IN (@stopwords@) AND (length(p) > 3 OR length(z) > 3 OR (q NOT IN (@stopwords@) AND length(q) > 3))
), ng AS (
  SELECT good.year, CAST(good.n AS INT) AS n, ngram, CAST(c AS BIGINT) AS c, CAST(total AS BIGINT) AS total
  FROM good JOIN gram_totals t ON good.year = t.year AND good.n = t.n JOIN sizes ON good.year = sizes.year WHERE r <= 100"""
# For Spark the words are counted a block at a time.  A row without word or n-gram has the sum of all; it is ranked first,
# so that what is ranked, what is summed and both periods come from one pass.
_SPARK_FREQ = """per AS (SELECT year, word, sum(n) AS n FROM $word_counts GROUP BY year, word
), ranked AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY CASE WHEN word IS NULL THEN 0 ELSE 1 END, n DESC, word) AS r FROM per
), summed AS (SELECT year, word, n, max(CASE WHEN word IS NULL THEN n END) OVER (PARTITION BY year) AS total FROM ranked WHERE r <= 601
), freq AS (SELECT year, word, n, total FROM summed WHERE word IS NOT NULL"""
_ACROSS = """WITH stream AS (
  SELECT year, article_id AS a1, tok AS w1, lead(article_id, 1) OVER s AS a2, lead(tok, 1) OVER s AS w2, lead(article_id, 2) OVER s AS a3, lead(tok, 2) OVER s AS w3
  FROM $edge_words WINDOW s AS (PARTITION BY year ORDER BY date, article_id, pos)
), across AS (
  SELECT year, n, ngram, good FROM stream LATERAL VIEW inline(array(
    struct(2 AS n, CASE WHEN w2 IS NOT NULL AND a1 <> a2 THEN concat(w1, ' ', w2) END AS ngram, w1 NOT IN (@stopwords@) AND w2 NOT IN (@stopwords@) AND (length(w1) > 3 OR length(w2) > 3) AS good),
    struct(3 AS n, CASE WHEN w3 IS NOT NULL AND a1 <> a3 THEN concat(w1, ' ', w2, ' ', w3) END AS ngram, w1 NOT IN (@stopwords@) AND w3 NOT IN (@stopwords@) AND (length(w1) > 3 OR length(w3) > 3 OR (w2 NOT IN (@stopwords@) AND length(w2) > 3)) AS good))) g AS n, ngram, good
  WHERE ngram IS NOT NULL
) SELECT year, n, own AS ngram, count(*) AS c FROM across LATERAL VIEW explode(CASE WHEN good THEN array(ngram, NULL) ELSE array(CAST(NULL AS STRING)) END) o AS own GROUP BY year, n, own"""
_SPARK_GRAMS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY year, n ORDER BY CASE WHEN ngram IS NULL THEN 0 ELSE 1 END, c DESC, ngram) AS r FROM $gram_top
), summed AS (SELECT year, n, ngram, c, max(CASE WHEN ngram IS NULL THEN c END) OVER (PARTITION BY year, n) AS total, max(CASE WHEN ngram IS NULL AND n = 2 THEN c END) OVER (PARTITION BY year) AS pairs FROM ranked WHERE r <= 101
), ng AS (SELECT year, n, ngram, c, total FROM summed WHERE ngram IS NOT NULL AND pairs >= 99"""
_PRE, _POST = "year BETWEEN 2015 AND 2019", "year BETWEEN 2023 AND 2026"


def _periods(source: str, keys: str, count: str) -> str:
    """Mean frequencies in two periods of years, as ``pre`` and ``post`` in one row of the keys."""
    mean = lambda years: f"sum(CASE WHEN {years} THEN 1e6 * {count} / total END) / nullif(count(CASE WHEN {years} THEN 1 END), 0)"
    return f"means AS (SELECT {keys}, {mean(_PRE)} AS m0, {mean(_POST)} AS m1 FROM {source} WHERE {_PRE} OR {_POST} GROUP BY {keys}), periods AS (SELECT struct({keys}, m0 AS m) AS pre, struct({keys}, m1 AS m) AS post FROM means)"


_COMMON = {"stopwords": _quoted(lists.STOPWORDS), "function_words": _quoted(lists.FUNCTION_WORDS), "tracked": _quoted(lists.TRACKED_VOCABULARY)}

SPARK = _COMMON | {
    "freq": _SPARK_FREQ, "word_means": _periods("freq", "word", "n"), "word_periods": "periods WHERE pre.m IS NOT NULL AND post.m IS NOT NULL",
    "ng": _SPARK_GRAMS, "gram_means": _periods("ng", "n, ngram", "c"), "gram_periods": "periods",
    "counted": "counted AS (\n  SELECT article_id, year, corpus, article_type, word_count, c.* FROM (SELECT article_id, year, corpus, article_type, word_count, article_counts(text) AS c FROM a WHERE length(trim(text)) >= 10) x",
    "tokens": r"filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0), x -> x rlike '^[a-z]{2,}$')",
    "wide_tokens": r"filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0), x -> NOT x IN (@stopwords@))",
    "word_count": r"regexp_count(text, '[^ \\t\\n\\r\\f\\u000B]+')",
    "sha256": "sha2(text, 256)", "len": "size", "date0": "date_add(DATE '2015-01-01', CAST(({n}) AS INT))",
    "unnest": "LATERAL VIEW posexplode(k) u AS pos, tok", "pos": "CAST(pos AS BIGINT)",
    "median": "percentile({x}, 0.5)", "transform": "transform", "filter": "filter", "arrow": "x ->",
    "url_date": r"concat_ws('-', regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 1), regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 2), regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 3))",
    "terms": "explode(array(" + _quoted(lists.TRACKED_VOCABULARY) + "))", "range_bps": "explode(sequence(2021, 2024))", "range_wide": "explode(sequence(lo + 2, hi - 1))",
    "edges": "percentile(x, array(0.2, 0.4, 0.6, 0.8))", "edge": "q[{i}]", 
    "ints": "transform(embedding, x -> CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT))", "unnest_e": "LATERAL VIEW posexplode(e) u AS pos, x",
    "dot_int": "aggregate(zip_with(a.e, b.e, (x, y) -> x * y), 0L, (s, x) -> s + x)", "json": "get_json_object(props, '$.{k}')",
    # the years of a metric in one row: all that refer to the series then need the same columns, and share its exchange
    "held": "SELECT metric, p.year, p.y FROM (SELECT metric, collect_list(struct(year, y)) AS ys FROM ({x}) GROUP BY metric) LATERAL VIEW explode(ys) e AS p",
    "anti": "LEFT ANTI JOIN",
    "slope": "regr_slope(y, CAST(year AS DOUBLE))", "rho": "coalesce(CAST(n * xy - x * y AS DOUBLE) / nullif(sqrt(CAST(n * xx - x * x AS DOUBLE) * CAST(n * yy - y * y AS DOUBLE)), 0e0), CAST('NaN' AS DOUBLE))", "intercept": "regr_intercept(y, CAST(year AS DOUBLE))", "r2": "regr_r2(y, CAST(year AS DOUBLE))",
    "url_found": r"u rlike '/(\\d{4})/(\\d{2})/(\\d{2})/'", "labels": "transform(array(source, lang, CASE doc_id % 8 WHEN 0 THEN 'Letters' WHEN 1 THEN 'Op-Ed' WHEN 2 THEN 'Columnists' WHEN 3 THEN 'OPINION' WHEN 4 THEN 'Editorial' WHEN 5 THEN 'World' END, CASE WHEN doc_id % 16 = 3 THEN 'community' END), x -> lower(x))",
    "has": "coalesce(array_contains(labels, '{x}'), FALSE)", "part": "split_part(metric, ':', {x})", "edges_words": "percentile(CAST(word_count AS DOUBLE), array(0.2, 0.4, 0.6, 0.8))",
    "try_date": "try_to_date({x}, 'yyyy-MM-dd')", "tenth": "percentile({x}, 0.1)", "ninetieth": "percentile({x}, 0.9)", "norm": "sqrt(aggregate(embedding, 0e0, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))",
    "unpivot": "LATERAL VIEW inline(array(" + ", ".join(f"struct('{m}' AS metric, CAST({m} AS DOUBLE) AS v)" for m in lists.MEASURES) + ")) u AS metric, v",
    "three": "format_string('%.3f', {x})",
}
DUCK = _COMMON | {
    "freq": _FREQ, "word_means": "pre AS (SELECT word, sum(1000000.0 * n / total) / count(*) AS m FROM freq WHERE year BETWEEN 2015 AND 2019 GROUP BY word), post AS (SELECT word, sum(1000000.0 * n / total) / count(*) AS m FROM freq WHERE year BETWEEN 2023 AND 2026 GROUP BY word)", "word_periods": "pre JOIN post ON pre.word = post.word",
    "ng": _GRAMS, "gram_means": "pre AS (SELECT n, ngram, sum(1000000.0 * c / total) / count(*) AS m FROM ng WHERE year BETWEEN 2015 AND 2019 GROUP BY n, ngram), post AS (SELECT n, ngram, sum(1000000.0 * c / total) / count(*) AS m FROM ng WHERE year BETWEEN 2023 AND 2026 GROUP BY n, ngram)", "gram_periods": "pre FULL OUTER JOIN post ON pre.n = post.n AND pre.ngram = post.ngram",
    "counted": _COUNTED,
    "tokens": r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,}'))",
    "alpha": r"regexp_extract_all(lower(text), '\p{L}+')",
    "sentences": r"list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_matches(x, '\p{L}'))",
    "runs_in_x": r"len(regexp_extract_all(x, '\p{L}+|[^\p{L}\s]'))",
    "vowel_groups": r"len(regexp_extract_all(x, '[aeiouy]+'))",
    "wide_tokens": r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN (@stopwords@))",
    "word_count": r"len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))",
    "sha256": "sha256(text)", "len": "len", "date0": "(DATE '2015-01-01' + CAST(({n}) AS INTEGER))",
    "unnest": ", (SELECT unnest(k) AS tok, generate_subscripts(k, 1) - 1 AS pos) u", "pos": "CAST(pos AS BIGINT)",
    "median": "quantile_cont({x}, 0.5)", "transform": "list_transform", "filter": "list_filter", "arrow": "lambda x:",
    "url_date": r"concat_ws('-', regexp_extract(u, '/(\d{4})/(\d{2})/(\d{2})/', 1), regexp_extract(u, '/(\d{4})/(\d{2})/(\d{2})/', 2), regexp_extract(u, '/(\d{4})/(\d{2})/(\d{2})/', 3))",
    "terms": "unnest([" + _quoted(lists.TRACKED_VOCABULARY) + "])", "range_bps": "unnest(range(2021, 2025))", "range_wide": "unnest(range(lo + 2, hi))",
    "edges": "quantile_cont(x, [0.2, 0.4, 0.6, 0.8])", "edge": "q[{i} + 1]", 
    "ints": "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT))", "unnest_e": ", (SELECT unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos) u",
    "dot_int": "CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT)", "json": "json_extract_string(props, '$.{k}')",
    "held": "{x}", "anti": "ANTI JOIN",
    "grams": "list_concat(list_transform(list_filter(list_zip(k, k[2:]), lambda z: z[2] IS NOT NULL), lambda z: concat(z[1], ' ', z[2])), list_transform(list_filter(list_zip(k, k[2:], k[3:]), lambda z: z[3] IS NOT NULL), lambda z: concat(z[1], ' ', z[2], ' ', z[3])))",
    "edge_tokens": "CASE WHEN len(k) <= 4 THEN k ELSE list_concat(k[1:2], k[-2:]) END",
    "by_type": "list_sort(list_transform(k, lambda x, i: {'t': x, 'p': i - 1}))",
    "places": "list_transform(list_filter(list_zip(s0, list_concat([NULL], s0[1:len(s0) - 1]), list_concat(s0[2:], [NULL])), lambda z: z[1] IS NOT NULL), lambda z: {'t': z[1].t, 'p': z[1].p, 'b': z[2].t, 'bp': z[2].p, 'a': z[3].t})", "sum_a": "coalesce(CAST(list_sum", "sum_b": ") AS BIGINT), 0)",
    "list_median": "list_aggregate(sl, 'median')",
    "slope": "regr_slope(y, CAST(year AS DOUBLE))", "rho": "CAST(n * xy - x * y AS DOUBLE) / sqrt(CAST(n * xx - x * x AS DOUBLE) * CAST(n * yy - y * y AS DOUBLE))", "intercept": "regr_intercept(y, CAST(year AS DOUBLE))", "r2": "regr_r2(y, CAST(year AS DOUBLE))",
    "url_found": r"regexp_matches(u, '/(\d{4})/(\d{2})/(\d{2})/')", "labels": "list_transform([source, lang, CASE doc_id % 8 WHEN 0 THEN 'Letters' WHEN 1 THEN 'Op-Ed' WHEN 2 THEN 'Columnists' WHEN 3 THEN 'OPINION' WHEN 4 THEN 'Editorial' WHEN 5 THEN 'World' END, CASE WHEN doc_id % 16 = 3 THEN 'community' END], lambda x: lower(x))",
    "has": "coalesce(list_contains(labels, '{x}'), FALSE)", "part": "split_part(metric, ':', {x})", "edges_words": "quantile_cont(CAST(word_count AS DOUBLE), [0.2, 0.4, 0.6, 0.8])",
    "try_date": "TRY_CAST({x} AS DATE)", "tenth": "quantile_cont({x}, 0.1)", "ninetieth": "quantile_cont({x}, 0.9)", "norm": "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))",
    "unpivot": ", (SELECT unnest([" + _quoted(lists.MEASURES) + "]) AS metric, unnest([" + ", ".join(f"CAST({m} AS DOUBLE)" for m in lists.MEASURES) + "]) AS v) u",
    "three": "printf('%.3f', {x})",
}


def spell(text: str, spelled: dict[str, str]) -> str:
    """``@name@`` and ``@name(argument)@`` replaced, inner ones first."""

    def one(m: re.Match) -> str:
        found = spelled[m[1]]
        return re.sub(r"\{\w\}", lambda _: m[2], found, count=0) if m[2] is not None else found

    while "@" in text:
        text = re.sub(r"@(\w+)(?:\[([^@]*?)\])?@", one, text)
    if spelled is SPARK:
        text = _rounded(text)
        if "article_counts(" in text and (spark := SparkSession.getActiveSession()):
            words.register(spark)
    return text


def _rounded(text: str) -> str:
    """``round(x, n)`` as DuckDB works it out: to the whole number of units nearest to the double x * 10^n.

    Spark rounds the shortest decimal that tells the double, which differs next to a half.
    """
    while m := re.search(r"\bround\(", text):
        depth, i, comma = 1, m.end(), 0
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            comma = i if depth == 1 and text[i] == "," else comma
            i += 1
        unit = f"1e{int(text[comma + 1 : i - 1])}"
        text = f"{text[: m.start()]}(ROUND(({text[m.end() : comma]}) * {unit}, 0) / {unit}){text[i:]}"
    return text


def _sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    return spark.sql(re.sub(r"\$(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}")), **views)


def plan(text: str, tables: tuple[str, ...]):
    """A query function over views of the tables that ``text`` names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        words.register(spark)
        own = spell(text, SPARK)
        articles = lambda columns: _sql(spark, spell(f"WITH {ARTICLES} SELECT {columns} FROM a WHERE year IS NOT NULL", SPARK), documents=views["documents"])
        if "$word_counts" in own:
            views["word_counts"] = words.word_counts(articles("year, text"))
        if "$gram_top" in own:
            across = _sql(spark, spell(_ACROSS, SPARK), edge_words=words.edge_words(articles("article_id, date, year, text")))
            views["gram_top"] = words.gram_top(articles("year, text"), across)
        return _sql(spark, own, **views)

    return run


def oracle(text: str) -> str:
    return re.sub(r"\$(\w+)", r"\1", spell(text, DUCK))
