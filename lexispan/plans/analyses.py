"""Analyses over the article view, each as one declarative text.

``$documents`` and other names in dollar signs are tables.  Ties are broken by term or id.
Ratios stay ratios of exact integers and are not rounded.
"""

ARTICLES = """articles AS (
  SELECT doc_id AS article_id, @date0[(doc_id * 37) % 4240]@ AS date,
         CASE WHEN lang = 'en' THEN 'opinions' ELSE 'news' END AS corpus,
         CAST(substr(source, 4) AS BIGINT) AS author_id,
         CASE doc_id % 5 WHEN 0 THEN 'column' WHEN 1 THEN 'opinion' WHEN 2 THEN 'op-ed' WHEN 3 THEN 'editorial' ELSE 'letter' END AS article_type,
         concat('http://x/', CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END) AS url,
         text, lang, CAST(@word_count@ AS BIGINT) AS word_count
  FROM $documents
), a AS (
  SELECT *, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter FROM articles
)"""
TOKENS = ARTICLES + """, lists AS (SELECT article_id, date, year, corpus, @tokens@ AS k FROM a
), tokens AS (SELECT article_id, date, year, corpus, @pos@ AS pos, tok FROM lists @unnest@
)"""
DEDUP = ARTICLES + """, h AS (SELECT article_id, date, year, corpus, article_type, author_id, url, @sha256@ AS text_hash, word_count FROM a
), d1 AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY date, article_id) AS r1 FROM h
), d2 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date, article_id) AS r2 FROM d1 WHERE r1 = 1
), d3 AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY date, article_id) AS r3 FROM d2 WHERE r2 = 1
)"""
# word frequencies without stopwords; the 600 commonest of each year
FREQ = TOKENS + """, @freq@
)"""
# a year is one stream of tokens: grams straddle articles.  Those within an article are made in its row; for
# the others the first and last two tokens of each article are put in order.
GRAMS = ARTICLES + """, @ng@
)"""
# Metrics of each article, made within its row: alphabetic tokens of any script, sorted with their places, tell
# types, hapaxes and the windows of 100 tokens in which a place is the first of its type.
METRICS = ARTICLES + """, @counted@
), metrics AS (
  SELECT article_id, year, corpus, article_type, word_count, n AS token_count, sents AS sentence_count, coalesce(CAST(sent_tokens AS DOUBLE) / nullif(sents, 0), 0e0) AS avg_sentence_len, sent_median AS med_sentence_len, types AS unique_word_count,
    coalesce(CAST(types AS DOUBLE) / nullif(n, 0), 0e0) AS ttr, coalesce(types / nullif(sqrt(CAST(n AS DOUBLE)), 0e0), 0e0) AS root_ttr, coalesce(CAST(windowed AS DOUBLE) / CASE WHEN n >= 100 THEN 100 * (n - 99) ELSE nullif(n, 0) END, 0e0) AS mattr,
    coalesce(CAST(hapaxes AS DOUBLE) / nullif(types, 0), 0e0) AS hapax_ratio, coalesce(CAST(functions AS DOUBLE) / nullif(n, 0), 0e0) AS func_word_ratio,
    CASE WHEN n > 0 AND sents > 0 THEN CAST(round(206.835e0 - 1.015e0 * n / sents - 84.6e0 * syllables / n, 6) AS DOUBLE) END AS flesch_reading_ease, CASE WHEN n > 0 AND sents > 0 THEN CAST(round(0.39e0 * n / sents + 11.8e0 * syllables / n - 15.59e0, 6) AS DOUBLE) END AS flesch_kincaid_grade,
    CASE WHEN n > 0 AND sents > 0 THEN CAST(round(4.71e0 * letters / n + 0.5e0 * n / sents - 21.43e0, 6) AS DOUBLE) END AS automated_readability_index, CASE WHEN sents > 0 THEN CAST(round(1.043e0 * sqrt(30.0e0 * polysyllables / sents) + 3.1291e0, 6) AS DOUBLE) END AS smog_index
  FROM counted
)"""
LONG = METRICS + ", long AS (SELECT article_id, year, corpus, article_type, word_count, metric, v FROM metrics @unpivot@ WHERE v IS NOT NULL)"
# numeric series by year: medians of the article metrics
SERIES = LONG + """, series AS (@held[SELECT metric, year, CAST(round(@median[v]@, 9) AS DOUBLE) AS y FROM long GROUP BY metric, year]@
)"""
STUDENTS = LONG + """, series AS (@held[SELECT metric, year, CAST(round(@median[v]@, 9) AS DOUBLE) AS y FROM long WHERE article_type <> 'letter' GROUP BY metric, year]@
)"""
CORPORA = LONG + """, series AS (@held[SELECT concat(corpus, ':', metric) AS metric, year, CAST(round(@median[v]@, 9) AS DOUBLE) AS y FROM long GROUP BY corpus, metric, year]@
)"""


def _segmented(bps: str, series: str = SERIES, least_years: int = 0) -> str:
    """Two lines before and from each breakpoint on: joint R2; ``line``: one line over all years.  Years count from 2000."""
    return series + f""", ends AS (SELECT metric, min(year) AS lo, max(year) AS hi FROM series GROUP BY metric HAVING count(*) >= {least_years}
), bps AS (SELECT metric, lo, hi, CAST(bp AS INT) AS bp FROM (SELECT metric, lo, hi, {bps} AS bp FROM ends) x
), sides AS (
  SELECT s.metric, bp, CASE WHEN year < bp THEN 0 ELSE 1 END AS side, CAST(count(*) AS DOUBLE) AS n, avg(CAST(year - 2000 AS DOUBLE)) AS mx, avg(y) AS my,
         sum(CAST(year - 2000 AS DOUBLE) * (year - 2000)) AS sxx, sum((year - 2000) * y) AS sxy, sum(y * y) AS syy
  FROM series s JOIN bps ON s.metric = bps.metric WHERE bp > lo AND bp <= hi GROUP BY s.metric, bp, CASE WHEN year < bp THEN 0 ELSE 1 END
), fits AS (SELECT metric, bp, side, n, my, sxx - n * mx * mx AS vx, sxy - n * mx * my AS cxy, syy - n * my * my AS vy, syy FROM sides
), joint AS (
  SELECT metric, bp, sum(n) AS n, sum(n * my) AS sy, sum(syy) AS syy, sum(greatest(0e0, vy - CASE WHEN vx > 0 THEN cxy * cxy / vx ELSE 0e0 END)) AS rest,
         sum(CASE WHEN side = 0 THEN cxy / nullif(vx, 0e0) END) AS slope_before, sum(CASE WHEN side = 1 THEN cxy / nullif(vx, 0e0) END) AS slope_after
  FROM fits GROUP BY metric, bp HAVING count(*) = 2 AND min(n) >= 2
), r2 AS (
  SELECT metric, bp, CAST(round(CASE WHEN syy - sy * sy / n <= 1e-12 * syy THEN 0e0 ELSE 1 - rest / (syy - sy * sy / n) END, 4) AS DOUBLE) AS r2, CAST(round(slope_before, 9) AS DOUBLE) AS slope_before, CAST(round(slope_after, 9) AS DOUBLE) AS slope_after FROM joint
), line AS (
  SELECT metric, count(*) AS n_years, CAST(round(@slope@, 9) AS DOUBLE) AS linear_slope, CAST(round(coalesce(@r2@, 0e0), 4) AS DOUBLE) AS linear_r2 FROM series GROUP BY metric
), ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY r2 DESC, bp) AS r FROM r2
)"""


# Mann-Whitney over two groups of (metric, g, v): U of group 0 doubled, exact
def _mann_whitney(values: str) -> str:
    return f"""vals AS ({values}
), c AS (SELECT metric, v, CAST(sum(1 - g) AS BIGINT) AS na, CAST(sum(g) AS BIGINT) AS nb FROM vals GROUP BY metric, v
), w AS (SELECT metric, v, na, nb, coalesce(sum(nb) OVER (PARTITION BY metric ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c
), u AS (SELECT metric, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, CAST(sum(na * (2 * below + nb)) AS BIGINT) AS u2, CAST(sum((na + nb) * (na + nb) * (na + nb) - (na + nb)) AS BIGINT) AS ties FROM w GROUP BY metric
)"""


_METRIC_VALUES = """SELECT 'n_chars' AS metric, quality AS g, n_chars AS v FROM $documents d JOIN $labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'n_words' AS metric, quality AS g, CAST(@word_count@ AS BIGINT) AS v FROM $documents d JOIN $labels l ON d.doc_id = l.doc_id"""
_PERIODS = "year BETWEEN 2015 AND 2019 OR year BETWEEN 2024 AND 2026"
_POST = "CASE WHEN year >= 2024 THEN 1 ELSE 0 END"
# metric, g (0 before, 1 after) and v of all measures, with a stratum in front of the metric's name
_strata = lambda key, where="1 = 1", source="long": LONG + f", strata AS (SELECT {key} AS stratum, metric, {_POST} AS g, v FROM {source} WHERE ({_PERIODS}) AND {where}), " + _mann_whitney("SELECT concat(stratum, ':', metric) AS metric, g, v FROM strata")
_EFFECT = "n_a, n_b, u2 / 2.0e0 AS u, ties, 1 - u2 / (CAST(n_a AS DOUBLE) * n_b) AS effect_size"
GUEST = ARTICLES + """, named AS (SELECT article_id, year, corpus, author_id, CASE WHEN article_type = 'letter' THEN 'Letter to the editor' ELSE 'Piece' END AS title FROM a
), shares AS (SELECT author_id, count(*) AS own FROM named WHERE author_id IS NOT NULL GROUP BY author_id
), everyone AS (SELECT count(author_id) AS total FROM named
), g AS (
  SELECT article_id, year, corpus,
         CASE WHEN lower(title) LIKE 'from the community%' OR lower(title) LIKE 'letter to the editor%' OR lower(title) LIKE 'letter from%' OR lower(title) LIKE 'op-ed:%' OR lower(title) LIKE 'guest column%' THEN 1 ELSE 0 END AS by_title,
         CASE WHEN own * 100 > total * 15 THEN 1 ELSE 0 END AS by_volume
  FROM named LEFT JOIN shares ON named.author_id = shares.author_id CROSS JOIN everyone
)"""
_VECTORS = "v AS (SELECT vec_id, label, @ints@ AS e FROM $embeddings)"
_W = "WITH "

_WIDENED = " SELECT b.metric, b.bp AS best_breakpoint, b.r2 AS best_r2, s.bp AS runner_up_breakpoint, s.r2 AS runner_up_r2, CAST(round(b.r2 - s.r2, 4) AS DOUBLE) AS r2_gap, b.bp BETWEEN 2021 AND 2024 AS in_window FROM ranked b LEFT JOIN ranked s ON b.metric = s.metric AND s.r = 2 WHERE b.r = 1"

TEXTS: dict[str, str] = {
    "articles_view": _W + ARTICLES + " SELECT article_id, date, year, month, quarter, corpus, author_id, article_type, word_count, @sha256@ AS text_hash FROM a",
    "length_filter": _W + ARTICLES + " SELECT article_id, word_count FROM a WHERE word_count BETWEEN 50 AND 15000",
    "missing_summary": _W + ARTICLES + " SELECT count(*) AS n, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_text, CAST(sum(CASE WHEN author_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_author, CAST(sum(CASE WHEN url IS NULL OR url = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_url FROM a",
    "length_summary": _W + ARTICLES + " SELECT CAST(sum(CASE WHEN word_count < 50 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN word_count > 15000 THEN 1 ELSE 0 END) AS BIGINT) AS long, CAST(@median[word_count]@ AS DOUBLE) AS median_words, CAST(sum(word_count) AS DOUBLE) / count(*) AS mean_words FROM a",
    "dedup_kept": _W + DEDUP + " SELECT article_id FROM d3 WHERE r3 = 1",
    "dedup_removed": _W + DEDUP + " SELECT article_id, 'duplicate_article_id' AS removal_reason FROM d1 WHERE r1 > 1 UNION ALL SELECT article_id, 'duplicate_url' AS removal_reason FROM d2 WHERE r2 > 1 UNION ALL SELECT article_id, 'duplicate_text' AS removal_reason FROM d3 WHERE r3 > 1",
    "yearly_stats": _W + ARTICLES + " SELECT year, count(*) AS n_articles, CAST(sum(CASE WHEN corpus = 'opinions' THEN 1 ELSE 0 END) AS BIGINT) AS n_opinions, CAST(sum(CASE WHEN corpus = 'news' THEN 1 ELSE 0 END) AS BIGINT) AS n_news, count(DISTINCT author_id) AS n_authors, CAST(sum(word_count) AS DOUBLE) / count(*) AS mean_words, CAST(@median[word_count]@ AS DOUBLE) AS median_words, CAST(sum(word_count) AS BIGINT) AS total_words FROM a GROUP BY year",
    "category_stats": _W + ARTICLES + " SELECT corpus, article_type, count(*) AS n_articles FROM a GROUP BY corpus, article_type",
    "author_stats": _W + ARTICLES + ", s AS (SELECT author_id, count(*) AS n_articles, CAST(sum(word_count) AS DOUBLE) / count(*) AS mean_words, concat(CAST(min(year) AS STRING), '–', CAST(max(year) AS STRING)) AS years_active FROM a WHERE author_id IS NOT NULL GROUP BY author_id) SELECT * FROM s ORDER BY n_articles DESC, author_id LIMIT 50",
    "tokens_per_doc": _W + TOKENS + ", c AS (SELECT article_id, CAST(@len@(k) AS BIGINT) AS n_tokens, CAST(@len@(@filter@(k, @arrow@ x NOT IN (@stopwords@))) AS BIGINT) AS n_content_tokens FROM lists) SELECT * FROM c",
    "word_freq_by_year": _W + FREQ + " SELECT year, word, n AS count, total AS total_words FROM freq",
    "vocab_changes": _W + FREQ + ", @word_means@ SELECT pre.word, CAST(round(pre.m, 3) AS DOUBLE) AS pre_freq, CAST(round(post.m, 3) AS DOUBLE) AS post_freq FROM @word_periods@",
    "ai_vocab_by_year": _W + TOKENS + ", terms AS (SELECT @terms@ AS word), years AS (SELECT year, count(*) AS total FROM tokens GROUP BY year), hits AS (SELECT year, tok AS word, count(*) AS n FROM tokens JOIN terms ON tok = word GROUP BY year, tok) SELECT years.year, terms.word, CAST(coalesce(n, 0) AS BIGINT) AS count, CAST(total AS BIGINT) AS total_words, 1000000.0 * coalesce(n, 0) / CAST(total AS DOUBLE) AS freq_per_million FROM years CROSS JOIN terms LEFT JOIN hits ON hits.year = years.year AND hits.word = terms.word",
    "ai_vocab_by_corpus": _W + TOKENS + ", terms AS (SELECT @terms@ AS word) SELECT corpus, year, count(DISTINCT article_id) AS n_articles, count(*) AS total_words, count(word) AS hits FROM tokens LEFT JOIN terms ON tok = word GROUP BY corpus, year",
    "ngrams_by_year": _W + GRAMS + " SELECT year, n, ngram, c AS count, total AS total_ngrams FROM ng",
    "ngram_changes": _W + GRAMS + ", @gram_means@ SELECT coalesce(pre.n, post.n) AS n, coalesce(pre.ngram, post.ngram) AS ngram, CAST(round(coalesce(pre.m, 0), 3) AS DOUBLE) AS pre_freq, CAST(round(coalesce(post.m, 0), 3) AS DOUBLE) AS post_freq FROM @gram_periods@",
    "tfidf_by_year": _W + ARTICLES + """, lists AS (SELECT year, @wide_tokens@ AS k FROM a), t AS (SELECT year, tok AS term FROM lists @unnest@), tf AS (SELECT year, term, count(*) AS n FROM t GROUP BY year, term
), terms AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term), vocab AS (SELECT term, df FROM terms ORDER BY total DESC, term LIMIT 1000), docs AS (SELECT count(DISTINCT year) AS nd FROM a
), w AS (SELECT year, tf.term, (1 + ln(n)) * (ln((1.0 + nd) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab ON tf.term = vocab.term CROSS JOIN docs), norms AS (SELECT year, sqrt(sum(w * w)) AS nm FROM w GROUP BY year
), s AS (SELECT w.year, term, round(w / nm, 9) AS score FROM w JOIN norms ON w.year = norms.year), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, term) AS r FROM s) SELECT year, term, CAST(r AS INT) AS rank FROM r WHERE r <= 200""",
    "mattr": _W + METRICS + " SELECT article_id, mattr FROM metrics",
    "ttr_metrics": _W + METRICS + " SELECT article_id, token_count, unique_word_count, ttr, root_ttr, hapax_ratio FROM metrics",
    "func_words": _W + METRICS + " SELECT article_id, func_word_ratio FROM metrics",
    "sentence_stats": _W + METRICS + " SELECT article_id, sentence_count, avg_sentence_len, med_sentence_len FROM metrics",
    "readability": _W + METRICS + " SELECT article_id, flesch_reading_ease, flesch_kincaid_grade, automated_readability_index, smog_index FROM metrics",
    "yearly_metrics": _W + LONG + " SELECT year, metric, count(*) AS n, CAST(round(@median[v]@, 9) AS DOUBLE) AS median, CAST(round(avg(v), 6) AS DOUBLE) AS mean, CAST(round(stddev_samp(v), 6) AS DOUBLE) AS std FROM long GROUP BY year, metric",
    "resume_anti_join": "SELECT d.doc_id, d.n_chars FROM $documents d @anti@ $labels l ON d.doc_id = l.doc_id",
    "author_lookup": "SELECT d.doc_id, coalesce(n_name, 'unknown') AS author_name FROM $documents d LEFT JOIN $nation n ON CAST(substr(source, 4) AS BIGINT) = n_nationkey",
    "category_resolve": "SELECT o_orderkey, n_name AS category FROM $orders JOIN $customer ON o_custkey = c_custkey JOIN $nation ON c_nationkey = n_nationkey",
    "article_type": "SELECT doc_id, CASE WHEN @has[letters]@ OR @has[letter]@ OR @has[community]@ THEN 'letter' WHEN @has[editorial]@ OR @has[editorials]@ THEN 'editorial' WHEN @has[op-ed]@ OR @has[op-eds]@ OR @has[oped]@ THEN 'op-ed' WHEN @has[column]@ OR @has[columnists]@ OR @has[columnist]@ THEN 'column' WHEN @has[opinion]@ OR @has[opinions]@ THEN 'opinion' WHEN @has[news]@ OR @has[university]@ OR @has[local]@ OR @has[national]@ OR @has[world]@ THEN 'news' ELSE 'other' END AS article_type FROM (SELECT doc_id, @labels@ AS labels FROM $documents) t",
    "api_records": "SELECT event_id, coalesce(@json[k]@, '') AS k, event_type FROM $events",
    "url_dates": "SELECT doc_id, CASE WHEN @url_found@ THEN @url_date@ END AS date, coalesce(CASE WHEN @url_found@ THEN @url_date@ END BETWEEN '2012-01-01' AND '2020-12-31', FALSE) AS in_range FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN concat('http://x/about/', CAST(doc_id AS STRING)) ELSE concat('http://x/20', CAST(10 + doc_id % 17 AS STRING), '/0', CAST(1 + doc_id % 9 AS STRING), '/1', CAST(doc_id % 9 AS STRING), '/a') END AS u FROM $documents) t",
    "period_labels": _W + ARTICLES + " SELECT article_id, CASE WHEN year <= 2019 THEN '2015-2019' WHEN year <= 2022 THEN '2020-2022' WHEN year = 2023 THEN '2023' ELSE '2024-2026' END AS period FROM a",
    "text_hashes": "SELECT doc_id, @sha256@ AS text_hash, substr(text, 1, 4096) AS head FROM $documents",
    "composition": _W + ARTICLES + ", c AS (SELECT year, sum(CASE WHEN corpus = 'opinions' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN corpus = 'news' THEN 1 ELSE 0 END) AS n FROM a GROUP BY year) SELECT year, CAST(o AS BIGINT) AS n_opinions, CAST(n AS BIGINT) AS n_news, CAST(o + n AS BIGINT) AS n_total, CAST(o AS DOUBLE) / CAST(o + n AS DOUBLE) AS opinions_share FROM c",
    "genre_mix": _W + ARTICLES + " SELECT year, count(*) AS n_total, " + ", ".join(f"CAST(sum(CASE WHEN article_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t.replace('-', '_')}" for t in ("column", "editorial", "op-ed", "opinion", "letter")) + " FROM a GROUP BY year",
    "guest_flag": _W + GUEST + " SELECT article_id, by_title = 1 OR by_volume = 1 AS is_guest, CASE WHEN by_title = 1 AND by_volume = 1 THEN 'title|volume' WHEN by_title = 1 THEN 'title' WHEN by_volume = 1 THEN 'volume' ELSE '' END AS guest_signal FROM g",
    "guest_share": _W + GUEST + " SELECT year, count(*) AS n_total, CAST(sum(greatest(by_title, by_volume)) AS BIGINT) AS n_guest, CAST(count(*) - sum(greatest(by_title, by_volume)) AS BIGINT) AS n_student, CAST(sum(greatest(by_title, by_volume)) AS DOUBLE) / count(*) AS guest_share FROM g GROUP BY year",
    "author_concentration": _W + ARTICLES + ", p AS (SELECT year, author_id, count(*) AS n FROM a WHERE author_id IS NOT NULL GROUP BY year, author_id), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, author_id) AS r FROM p) SELECT year, CAST(sum(n) AS BIGINT) AS n_articles, count(*) AS n_authors, CAST(sum(CASE WHEN r <= 1 THEN n ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) AS BIGINT) AS top5, CAST(sum(CASE WHEN r <= 10 THEN n ELSE 0 END) AS BIGINT) AS top10, CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS hhi FROM r GROUP BY year",
    "drop_top_authors": _W + ARTICLES + ", p AS (SELECT author_id, count(*) AS n FROM a WHERE author_id IS NOT NULL GROUP BY author_id), top AS (SELECT author_id FROM p ORDER BY n DESC, author_id LIMIT 10) SELECT article_id, a.author_id FROM a @anti@ top ON a.author_id = top.author_id",
    "author_means": _W + ARTICLES + " SELECT author_id, count(*) AS n, CAST(sum(word_count) AS DOUBLE) / count(*) AS mean_words FROM a WHERE author_id IS NOT NULL GROUP BY author_id",
    "length_trends": _W + ARTICLES + " SELECT corpus, year, count(*) AS n, CAST(@median[word_count]@ AS DOUBLE) AS median_words, CAST(sum(word_count) AS DOUBLE) / count(*) AS mean_words FROM a GROUP BY corpus, year",
    "mann_whitney": _W + _mann_whitney(_METRIC_VALUES) + " SELECT metric, n_a, n_b, u2 / 2.0e0 AS u, ties, 1 - u2 / (CAST(n_a AS DOUBLE) * n_b) AS effect_size FROM u",
    "within_corpus_tests": _W + _strata("corpus") + f" SELECT @part[1]@ AS corpus, @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 5 AND n_b >= 5",
    "genre_stratified_tests": _W + _strata("article_type") + f" SELECT @part[1]@ AS article_type, @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 20 AND n_b >= 20",
    "fdr_bh": _W + "p AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 997 + 1) / 1000.0e0 AS p FROM $supplier), n AS (SELECT count(*) AS m FROM p), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS r, m FROM p CROSS JOIN n) SELECT id, p, least(1.0e0, min(p * m / r) OVER (ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_corrected FROM r",
    "segmented_fit": _W + _segmented("@range_bps@") + " SELECT metric, bp AS breakpoint, r2, slope_before, slope_after FROM r2",
    "changepoint": _W + _segmented("@range_bps@", SERIES, 6) + " SELECT b.metric, b.bp AS breakpoint, n_years, b.r2, slope_before, slope_after, linear_slope, linear_r2, CAST(round(b.r2 - linear_r2, 4) AS DOUBLE) AS r2_improvement FROM ranked b JOIN line ON b.metric = line.metric WHERE b.r = 1",
    "widened_changepoint": _W + _segmented("@range_wide@", CORPORA, 6) + _WIDENED,
    "ols_trend": _W + SERIES + " SELECT metric, count(*) AS n_years, CAST(round(@slope@, 9) AS DOUBLE) AS slope, CAST(round(@intercept@, 4) AS DOUBLE) AS intercept, CAST(round(@r2@, 6) AS DOUBLE) AS r2 FROM series GROUP BY metric",
    "spearman_trend": _W + SERIES + ", r AS (SELECT metric, 2 * rank() OVER (PARTITION BY metric ORDER BY year) + count(*) OVER (PARTITION BY metric, year) - 1 AS rx, 2 * rank() OVER (PARTITION BY metric ORDER BY y) + count(*) OVER (PARTITION BY metric, y) - 1 AS ry FROM series), s AS (SELECT metric, count(*) AS n, CAST(sum(rx) AS BIGINT) AS x, CAST(sum(ry) AS BIGINT) AS y, CAST(sum(rx * ry) AS BIGINT) AS xy, CAST(sum(rx * rx) AS BIGINT) AS xx, CAST(sum(ry * ry) AS BIGINT) AS yy FROM r GROUP BY metric) SELECT metric, n AS n_years, @rho@ AS rho FROM s WHERE n >= 4",
    "kendall_trend": _W + SERIES + " SELECT a.metric, CAST(sum(sign(b.y - a.y)) AS BIGINT) AS concordance, count(*) AS n_pairs FROM series a JOIN series b ON a.metric = b.metric AND a.year < b.year GROUP BY a.metric",
    "length_bins": _W + "v AS (SELECT l.quality AS g, CAST(n_chars AS DOUBLE) AS x FROM $documents d JOIN $labels l ON d.doc_id = l.doc_id), e AS (SELECT @edges@ AS q FROM v WHERE g = 0), b AS (SELECT g, 1 + CASE WHEN x > @edge[0]@ THEN 1 ELSE 0 END + CASE WHEN x > @edge[1]@ THEN 1 ELSE 0 END + CASE WHEN x > @edge[2]@ THEN 1 ELSE 0 END + CASE WHEN x > @edge[3]@ THEN 1 ELSE 0 END AS bin FROM v CROSS JOIN e) SELECT CAST(bin AS INT) AS length_bin, CAST(sum(1 - g) AS BIGINT) AS n_pre, CAST(sum(g) AS BIGINT) AS n_post FROM b GROUP BY bin",
    "within_group_similarity": _W + _VECTORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS STRING))), vec_id) AS r FROM v), s AS (SELECT * FROM r WHERE r <= 300), p AS (SELECT a.label, @dot_int@ AS d FROM s a JOIN s b ON a.label = b.label AND a.r < b.r) SELECT label, count(*) AS n_pairs, CAST(sum(d) AS BIGINT) AS total, CAST(@median[d]@ AS DOUBLE) AS median_sim FROM p GROUP BY label",
    "between_group_similarity": _W + _VECTORS + ", e AS (SELECT label, pos, x FROM v @unnest_e@), s AS (SELECT label, pos, CAST(sum(x) AS BIGINT) AS x FROM e GROUP BY label, pos), c AS (SELECT label, count(*) AS n FROM v GROUP BY label) SELECT a.label AS label_a, b.label AS label_b, CAST(sum(a.x * b.x) AS DOUBLE) / (CAST(min(ca.n) AS DOUBLE) * min(cb.n)) AS mean_cross FROM s a JOIN s b ON a.pos = b.pos AND a.label < b.label JOIN c ca ON a.label = ca.label JOIN c cb ON b.label = cb.label GROUP BY a.label, b.label",
    "mean_pairwise_similarity": _W + _VECTORS + ", e AS (SELECT label, pos, x FROM v @unnest_e@), s AS (SELECT label, pos, CAST(sum(x) AS BIGINT) AS x, CAST(sum(x * x) AS BIGINT) AS q FROM e GROUP BY label, pos), c AS (SELECT label, count(*) AS n FROM v GROUP BY label) SELECT s.label, CAST(sum(s.x * s.x - s.q) AS DOUBLE) / (CAST(min(n) AS DOUBLE) * (min(n) - 1)) AS mean_sim FROM s JOIN c ON s.label = c.label GROUP BY s.label HAVING min(n) >= 2",
    "concentration_by_user": _W + "p AS (SELECT user_id, count(*) AS n FROM $events GROUP BY user_id) SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_events, CAST(max(n) AS BIGINT) AS top1, CAST(sum(n * n) AS BIGINT) AS squares FROM p",
    "article_metrics": _W + METRICS + " SELECT * FROM metrics",
    "period_tests": _W + _strata("'all'") + f" SELECT @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 5 AND n_b >= 5",
    "period_medians": _W + LONG + f" SELECT metric, {_POST} AS g, count(*) AS n, CAST(round(@median[v]@, 9) AS DOUBLE) AS median FROM long WHERE {_PERIODS} GROUP BY metric, {_POST}",
    "student_tests": _W + _strata("'student'", "article_type <> 'letter'") + f" SELECT @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 15 AND n_b >= 15",
    "guest_vs_student": _W + LONG + f", strata AS (SELECT {_POST} AS stratum, metric, CASE WHEN article_type = 'letter' THEN 0 ELSE 1 END AS g, v FROM long WHERE {_PERIODS}), " + _mann_whitney("SELECT concat(CAST(stratum AS STRING), ':', metric) AS metric, g, v FROM strata") + f" SELECT CASE WHEN @part[1]@ = '0' THEN '2015-2019' ELSE '2024-2026' END AS period, @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 15 AND n_b >= 15",
    "length_stratified_tests": _W + LONG + f", span AS (SELECT * FROM long WHERE {_PERIODS}), cuts AS (SELECT @edges_words@ AS q FROM metrics WHERE year BETWEEN 2015 AND 2019), strata AS (SELECT 1 + CASE WHEN word_count > @edge[0]@ THEN 1 ELSE 0 END + CASE WHEN word_count > @edge[1]@ THEN 1 ELSE 0 END + CASE WHEN word_count > @edge[2]@ THEN 1 ELSE 0 END + CASE WHEN word_count > @edge[3]@ THEN 1 ELSE 0 END AS stratum, metric, {_POST} AS g, v FROM span CROSS JOIN cuts), " + _mann_whitney("SELECT concat(CAST(stratum AS STRING), ':', metric) AS metric, g, v FROM strata") + f", e AS (SELECT @part[1]@ AS length_bin, @part[2]@ AS metric, {_EFFECT} FROM u WHERE n_a >= 20 AND n_b >= 20) SELECT length_bin, metric, n_a, n_b, CAST(round(effect_size, 9) AS DOUBLE) AS effect_size FROM e UNION ALL SELECT 'POOLED' AS length_bin, metric, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b, CAST(round(sum(effect_size * least(n_a, n_b)) / sum(least(n_a, n_b)), 9) AS DOUBLE) AS effect_size FROM e GROUP BY metric",
    "author_level_tests": _W + METRICS + f", named AS (SELECT metrics.article_id, a.author_id, metrics.year, mattr FROM metrics JOIN a ON metrics.article_id = a.article_id WHERE a.author_id IS NOT NULL AND (metrics.{_PERIODS.replace('OR year', 'OR metrics.year')})), means AS (SELECT author_id, {_POST} AS g, CAST(round(avg(mattr), 9) AS DOUBLE) AS v FROM named GROUP BY author_id, {_POST}), " + _mann_whitney("SELECT 'mattr' AS metric, g, v FROM means") + f" SELECT metric, {_EFFECT} FROM u",
    "student_changepoint": _W + _segmented("@range_wide@", STUDENTS, 6) + _WIDENED,
    "student_yearly": _W + STUDENTS + " SELECT metric, year, y AS median FROM series",
    "author_concentration_students": _W + ARTICLES + ", p AS (SELECT author_id, count(*) AS n FROM a WHERE author_id IS NOT NULL AND article_type <> 'letter' GROUP BY author_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, author_id) AS r FROM p) SELECT count(*) AS n_authors, CAST(sum(n) AS BIGINT) AS n_articles, CAST(sum(CASE WHEN r <= 10 THEN n ELSE 0 END) AS BIGINT) AS top10 FROM r",
    "genre_shares": _W + ARTICLES + ", c AS (SELECT year, article_type, count(*) AS n FROM a GROUP BY year, article_type), t AS (SELECT year, sum(n) AS total FROM c GROUP BY year) SELECT c.year, article_type, n, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM c JOIN t ON c.year = t.year",
    "safe_division": "SELECT l_orderkey, l_linenumber, coalesce(CAST(l_quantity AS DOUBLE) / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0e0), 0e0) AS ratio FROM $lineitem",
    "batches": "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 64) AS BIGINT) AS batch FROM $supplier",
    "category_ids": "SELECT n_nationkey AS id FROM $nation WHERE lower(n_name) IN ('france', 'nation_3', 'japan') OR lower(n_name) LIKE 'nation_1%'",
    "parsed_dates": "SELECT doc_id, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter FROM (SELECT doc_id, @try_date[substr(t, 1, 10)]@ AS d FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2019-03-31T10:00:00' WHEN 1 THEN '2026-10-01' WHEN 2 THEN 'not-a-date' ELSE '' END AS t FROM $documents) x) y",
    "clean_rows": _W + ARTICLES + " SELECT article_id, year, quarter, coalesce(nullif(article_type, ''), corpus) AS category, word_count, CAST(length(text) AS BIGINT) AS char_count, @sha256@ AS text_hash FROM a WHERE word_count BETWEEN 50 AND 15000",
    "similarity_spread": _W + _VECTORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS STRING))), vec_id) AS r FROM v), s AS (SELECT * FROM r WHERE r <= 300), p AS (SELECT a.label, CAST(@dot_int@ AS DOUBLE) / 16777216 AS d FROM s a JOIN s b ON a.label = b.label AND a.r < b.r) SELECT label, count(*) AS n_pairs, CAST(round(avg(d), 5) AS DOUBLE) AS mean, CAST(round(@median[d]@, 5) AS DOUBLE) AS median, CAST(round(stddev_pop(d), 5) AS DOUBLE) AS std, CAST(round(@tenth[d]@, 5) AS DOUBLE) AS p10, CAST(round(@ninetieth[d]@, 5) AS DOUBLE) AS p90 FROM p GROUP BY label HAVING count(*) >= 1",
    "unit_norms": "SELECT vec_id, abs(n - 1) <= 0.001 AS is_unit FROM (SELECT vec_id, @norm@ AS n FROM $embeddings) t",
    "similarity_groups": _W + _VECTORS + ", groups AS (SELECT 'all' AS grp, e FROM v UNION ALL SELECT 'even' AS grp, e FROM v WHERE vec_id % 2 = 0 UNION ALL SELECT concat('label ', CAST(label AS STRING)) AS grp, e FROM v), e AS (SELECT grp, pos, x FROM groups @unnest_e@), s AS (SELECT grp, pos, CAST(sum(x) AS BIGINT) AS x, CAST(sum(x * x) AS BIGINT) AS q, count(*) AS n FROM e GROUP BY grp, pos) SELECT grp, min(n) AS n_used, CASE WHEN min(n) >= 10 THEN CAST(sum(CAST(x AS DOUBLE) * x - q) AS DOUBLE) / (CAST(min(n) AS DOUBLE) * (min(n) - 1)) END AS mean_sim FROM s GROUP BY grp",
    "chart_mattr": _W + METRICS + " SELECT year, CAST(round(@median[mattr]@, 9) AS DOUBLE) AS median_mattr, CAST(round(avg(mattr), 6) AS DOUBLE) AS mean_mattr, CAST(round(avg(mattr) - stddev_samp(mattr), 6) AS DOUBLE) AS band_low, CAST(round(avg(mattr) + stddev_samp(mattr), 6) AS DOUBLE) AS band_high FROM metrics GROUP BY year",
    "chart_mattr_by_period": _W + METRICS + ", p AS (SELECT CASE WHEN year <= 2019 THEN '2015-2019' WHEN year <= 2022 THEN '2020-2022' WHEN year = 2023 THEN '2023' ELSE '2024-2026' END AS period, mattr FROM metrics) SELECT period, count(*) AS n, CAST(round(@tenth[mattr]@, 9) AS DOUBLE) AS p10, CAST(round(@median[mattr]@, 9) AS DOUBLE) AS median, CAST(round(@ninetieth[mattr]@, 9) AS DOUBLE) AS p90 FROM p GROUP BY period",
    "chart_sentences": _W + METRICS + " SELECT year, CAST(round(@median[avg_sentence_len]@, 9) AS DOUBLE) AS median_sentence_len, CAST(round(@median[flesch_reading_ease]@, 9) AS DOUBLE) AS median_reading_ease FROM metrics GROUP BY year",
    "chart_vocabulary_total": _W + TOKENS + " SELECT year, CAST(sum(CASE WHEN tok IN (@tracked@) THEN 1 ELSE 0 END) AS BIGINT) AS hits, 1000000.0e0 * sum(CASE WHEN tok IN (@tracked@) THEN 1 ELSE 0 END) / count(*) AS per_million FROM tokens GROUP BY year",
    "chart_top_words": _W + FREQ + ", m AS (SELECT word, round(sum(1000000.0e0 * n / total), 6) AS f FROM freq GROUP BY word), top AS (SELECT word FROM m ORDER BY f DESC, word LIMIT 8) SELECT freq.year, freq.word, n AS count, total AS total_words FROM freq JOIN top ON freq.word = top.word",
    "chart_composition_change": _W + ARTICLES + ", c AS (SELECT year, CAST(sum(CASE WHEN corpus = 'opinions' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share FROM a GROUP BY year), r AS (SELECT *, row_number() OVER (ORDER BY year) AS f, row_number() OVER (ORDER BY year DESC) AS l FROM c) SELECT max(CASE WHEN f = 1 THEN share END) AS first_share, max(CASE WHEN l = 1 THEN share END) AS last_share, max(CASE WHEN l = 1 THEN share END) - max(CASE WHEN f = 1 THEN share END) AS change FROM r",
    "chart_vocabulary_ends": _W + FREQ + ", @word_means@, d AS (SELECT pre.word, CAST(round(post.m - pre.m, 3) AS DOUBLE) AS change, CAST(round(100 * (post.m - pre.m) / pre.m, 1) AS DOUBLE) AS percent FROM @word_periods@), r AS (SELECT *, row_number() OVER (ORDER BY change DESC, word) AS t, row_number() OVER (ORDER BY change, word) AS b FROM d) SELECT word, change, percent FROM r WHERE t <= 15 OR b <= 15",
    "peak_year": _W + SERIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY y DESC, year) AS r, row_number() OVER (PARTITION BY metric ORDER BY y, year) AS l FROM series) SELECT metric, max(CASE WHEN r = 1 THEN year END) AS peak_year, max(CASE WHEN l = 1 THEN year END) AS trough_year FROM r GROUP BY metric",
    "p_labels": _W + "p AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 1e-20 WHEN 1 THEN 0.0004e0 WHEN 2 THEN 0.25e0 END AS p FROM $supplier) SELECT id, CASE WHEN p IS NULL THEN '' WHEN p < 1e-16 THEN '<1e-16' WHEN p < 0.001e0 THEN '<0.001' ELSE @three[p]@ END AS label FROM p",
}
