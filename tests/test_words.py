"""Queries over made-up documents, by Spark and by DuckDB."""

import collections
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexispan.operators import topics, words
from lexispan.plans.registry import ORACLE_SQL, QUERIES


def both(spark, folder, name, texts, ids=None, lang=None):
    ids = ids or list(range(len(texts)))
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(lang or ["en"] * len(texts)), "source": pa.array([f"src{i % 3}" for i in ids]), "n_chars": pa.array([len(t or "") for t in texts])}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    other = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in other.description]
    plain = lambda rows: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    return plain(map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect())), plain(other.fetchall())


def test_rank_correlation_of_a_constant_series(spark, tmp_path):
    mine, other = both(spark, tmp_path, "spearman_trend", ["one and the same text. Again."] * 300)
    assert mine == other and len(mine) == 14 and {r[2] for r in mine} == {"nan"}


def test_metrics_next_to_a_half_are_rounded_alike(spark, tmp_path):
    words = ["baba"] * 237 + ["ba"] * 147  # 32 sentences, 621 syllables: a grade level of 8.1728125
    texts = [" ".join(" ".join(words[i : i + 12]) + "." for i in range(0, 384, 12))] * 40
    mine, other = both(spark, tmp_path, "article_metrics", texts)
    assert mine == other and len(mine) == 40
    mine, other = both(spark, tmp_path, "period_medians", texts + [t.replace("baba", "ba", i) for i, t in enumerate(texts)])
    assert mine == other


def test_counts_of_odd_texts(spark, tmp_path):
    odd = ["... !?", "a\u000bb c d. 1 2 3 x", "İstanbul ΟΔΟΣ Ǆ éte ﬁn. Ⅳ ⓐ _x_ 9a", "\U00010400\U00020000 straße K Å", "e ee me the able queue. yyy!" * 9, None, " " * 30, "", "⺿\U0002ebf0\U0002ee5d 漢字 かな", "x" * 3000 + " é" * 120 + ". " + "ab cd " * 99]
    long = [" ".join(f"{'abcdefghij'[(i * i + j) % 10]}{'klm'[j % 3]}" + (".", "", " !?")[j % 3] for j in range(i * 7)) for i in range(60)]
    mine, other = both(spark, tmp_path, "article_metrics", odd + long)
    assert mine == other and len(mine) > 60


def test_texts_are_counted_once(spark, tmp_path):
    both(spark, tmp_path, "changepoint", ["some words. Of a text, a few"] * 30)
    frame = QUERIES["changepoint"](spark, str(tmp_path))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("article_counts") == 1, plan


def gram_texts():
    draw = random.Random(5)
    pool = ["ab", "cd", "efgh", "ijkl", "the", "of", "mnop", "a", "é", "x9", "İo", "_"]
    return [None, "", "...", "the", *(" ".join(draw.choices(pool, k=draw.choice([0, 1, 1, 2, 3, 4, 5, 9, 40]))) for _ in range(600))]


@pytest.mark.parametrize("name", ["ngrams_by_year", "ngram_changes", "word_freq_by_year", "vocab_changes", "chart_vocabulary_ends", "chart_top_words"])
def test_words_and_grams_by_year(spark, tmp_path, name):
    ids = [*range(604)]
    ids[-1] = 4239 + 4240 * 37  # a late day of its own
    mine, other = both(spark, tmp_path, name, gram_texts(), ids)
    assert mine == other and len(mine) > 5


def test_years_of_few_words_have_no_grams(spark, tmp_path):
    mine, other = both(spark, tmp_path, "ngrams_by_year", ["efgh ijkl mnop"] * 100, [i // 3 for i in range(100)][:-1] + [2000])
    assert mine == other


def test_grams_of_many_words(monkeypatch):
    block = pa.RecordBatch.from_pydict({"year": [2015 + i % 3 for i in range(604)], "text": gram_texts()})
    found = lambda: sorted(map(str, (r for part in words._grams_of(block) for r in zip(*(pa.array(part[k]).to_pylist() for k in ("year", "n", "ngram", "c"))))))
    plain = found()
    monkeypatch.setattr(words, "WIDE", 0)
    assert found() == plain and len(plain) > 100


def test_grams_are_made_once(spark, tmp_path):
    both(spark, tmp_path, "ngram_changes", gram_texts())
    frame = QUERIES["ngram_changes"](spark, str(tmp_path))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 2, plan


@pytest.mark.parametrize("features", [3, 12, 60, 5000])
def test_vocabulary_by_brute_force(spark, features):
    draw = random.Random(9)
    pool = ["ab", "Cd", "efgh", "ijkl", "the", "é1", "x", "straße", *(f"rare{i}" for i in range(30))]
    texts = [" ".join(draw.choices(pool, [9, 8, 7, 6, 9, 5, 5, 4, *[0.4] * 30], k=draw.choice([0, 1, 3, 9, 30]))) for _ in range(200)] + [None, "only once"]
    split = [[w for w in (t or "").lower().split() if w not in ("the", "x", "only", "once")] for t in texts]
    split[-1] = ["once"]
    grams = [w + [" ".join(p) for p in zip(w, w[1:])] for w in split]
    df = collections.Counter(t for g in grams for t in set(g))
    total = collections.Counter(t for g in grams for t in g)
    fit = sorted((t for t in df if 5 <= df[t] <= 0.5 * len(texts)), key=lambda t: (-total[t], t))[:features]
    terms, idf = topics.vocabulary(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), features, 5, 0.5)
    assert terms == sorted(fit) and idf == pytest.approx([math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in sorted(fit)])


def test_pairs_of_rare_words_are_not_counted():
    block = pa.RecordBatch.from_pydict({"text": ["aa bb cc aa bb", None, "bb aa the bb"]})
    found = [dict(zip(part, r)) for part in topics._pairs_of(block, pa.array(["aa", "bb"], pa.large_string())) for r in zip(*(pa.array(v).to_pylist() for v in part.values()))]
    assert found == [{"term": "aa bb", "df": 2, "total": 3}, {"term": "bb aa", "df": 1, "total": 1}]


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_commonest_grams_of_parts(most):
    draw, wanted, best = random.Random(4), collections.Counter(), {}
    rows = []
    for _ in range(40):
        counts = collections.Counter((draw.choice([2015, 2016]), draw.choice([2, 3]), draw.choice([None, "a b", *(f"g{i} h" for i in range(60))])) for _ in range(50))
        wanted.update(counts)
        rows += [r for found in words._packed({"year": [k[0] for k in counts], "n": [k[1] for k in counts], "ngram": [k[2] for k in counts], "c": [*counts.values()]}) for r in zip(found["part"].tolist(), *(found[k].to_pylist() for k in ("keys", "sizes", "counts", "grams")))]
    for part in sorted({r[0] for r in rows}):
        words._raise(best, [r[1:] for r in rows if r[0] == part], most)
    for kind, held in best.items():
        own = sorted(((k[2] is not None, -c, k[2] or "") for k, c in wanted.items() if (k[0], k[1]) == (kind // 4, kind % 4)))
        assert [x for x in held if x[0]][:most] == [x for x in own if x[0]][:most] and held[0] == own[0] and not held[0][0]
