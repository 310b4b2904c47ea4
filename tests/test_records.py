import datetime
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispan.operators import html, records
from lexispan.plans import analyses, dialect
from lexispan.sources import files


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    assert files.load_jsonl(spark, path, "id long").count() == 0 and files.existing_ids(spark, path).count() == 0
    files.append_jsonl(spark.createDataFrame([(1, "Café"), (2, "b")], "id long, title string"), path)
    files.append_jsonl(spark.createDataFrame([(2, "again")], "id long, title string"), path)
    with open(f"{path}/x.json", "w") as f:
        f.write('\n{broken\n{"id": 7, "title": "x"}\n{"title": "no id"}\n')
    assert sorted(r.title for r in files.load_jsonl(spark, path, "id long, title string").collect()) == ["Café", "again", "b", "no id", "x"]
    assert sorted(r.id for r in files.existing_ids(spark, path).collect()) == [1, 2, 7]
    files.append_failures(spark.createDataFrame([("http://a",)], "url string"), f"{tmp_path}/failed", "404")
    assert [(r.url, r.reason) for r in spark.read.json(f"{tmp_path}/failed").collect()] == [("http://a", "404")]


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.optional_table(spark, path) is None
    files.write_table(spark.range(5), path)
    files.write_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in files.optional_table(spark, path).collect()) == [3, 4]
    files.write_csv(spark.createDataFrame([(1, None), (2, 'a "b", c')], "n int, s string"), f"{tmp_path}/c")
    assert sorted((r.n, r.s) for r in files.load_csv(spark, f"{tmp_path}/c", "n int, s string").collect()) == [(1, None), (2, 'a "b", c')]
    (tmp_path / "cat.json").write_text('[{"id": 1, "slug": "news", "name": "News"}, {"id": 2, "slug": "op"}]')
    assert {r.id: r.slug for r in files.category_map(spark, f"{tmp_path}/cat.json").collect()} == {1: "news", 2: "op"}
    assert files.category_map(spark, f"{tmp_path}/none.json").count() == 0


def test_scalars(spark):
    urls = ["http://x/2019/03/31/a", "http://x/about", None]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(records.url_date(F.col("u")).alias("d"), records.url_id(F.col("u")).alias("i")).collect()
    assert [r.d for r in found] == ["2019-03-31", None, None]
    assert [r.i for r in found] == [int(hashlib.md5(u.encode()).hexdigest(), 16) % 10**10 if u else None for u in urls]
    dates = spark.createDataFrame([("2015-01-01",), ("2026-12-31T10:00:00",), ("not-a-date",), ("",), (None,)], "t string")
    assert [r[0] for r in dates.select(records.parsed_date(F.col("t"))).collect()] == [datetime.date(2015, 1, 1), datetime.date(2026, 12, 31), None, None, None]
    with pytest.raises(Exception, match="Cannot parse date"):
        dates.select(records.parsed_date(F.col("t"), strict=True)).collect()
    pairs = spark.createDataFrame([(10, 2), (5, 0)], "n int, d int")
    assert [r[0] for r in pairs.select(records.safe_div(F.col("n"), F.col("d"))).collect()] == [5, 0]
    labels = spark.createDataFrame([(["News", "LETTERS"],), (["Op-Ed", "Columnist"],), (["x"],), (None,), ([],)], "l array<string>")
    assert [r[0] for r in labels.select(records.article_type(F.col("l"))).collect()] == ["letter", "op-ed", "other", "other", "other"]
    assert spark.createDataFrame([(" a \n b ",)], "t string").select(records.normalized(F.col("t"))).first()[0] == "a b"
    assert html.text_of("<article><p></p>Hello there</article>") == "Hello there"


def test_rows(spark):
    text = "<p>" + "word " * 60 + "</p>"
    raw = [(1, " T ", "2020-05-01T00:00:00", [1, 2], None, text, "news"), (2, None, "bad", [1], None, text, "news"), (3, "s", "2020-01-01", None, None, "<p>short</p>", "news"), (4, "n", "2021-01-01", [9], ["Opinions"], text, "opinions"), (5, "c", "2021-01-01", None, None, text, None)]
    table = spark.createDataFrame(raw, "id long, title string, date string, category_ids array<long>, category_names array<string>, content_html string, corpus string").selectExpr("*", "1L AS author_id", "'a' AS author_name", "'u' AS url", "'api' AS collection_method")
    found = {r.article_id: r for r in records.build_rows(table, spark.createDataFrame([(1, "editorials"), (2, "news")], "id long, slug string")).collect()}
    assert set(found) == {1, 4, 5} and found[1].word_count == 60 and (found[1].title, found[1].quarter) == ("T", 2)
    assert {i: (r.category, r.article_type) for i, r in found.items()} == {1: ("editorials, news", "editorial"), 4: ("Opinions", "opinion"), 5: ("unknown", "other")}


def test_new_articles_are_encoded_once(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(i, 2020, "news", "news", f"text {i} of words") for i in range(a, b)], "article_id long, year int, corpus string, article_type string, text string")
    path = f"{tmp_path}/e"
    assert [records.encode_new(rows(1, 11), path), records.encode_new(rows(1, 11), path), records.encode_new(rows(1, 16), path)] == [10, 0, 5]
    vectors = [r.embedding for r in spark.read.parquet(path).collect()]
    assert len(vectors) == 15 and all(len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors)


def metrics_of(spark, texts):
    table = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    import re

    text = dialect.spell("WITH " + analyses.METRICS + " SELECT * FROM metrics", dialect.SPARK).replace("{", "{{").replace("}", "}}")
    return {r.article_id: r for r in spark.sql(re.sub(r"\$(\w+)", r"{\1}", text), documents=table).collect()}


def test_article_metrics(spark):
    texts = ["a b c c d d d", "the a is on the mat it", "The cat sat. THE CAT SAT. the cat sat.", "short", None, "Café é über straße niño " * 3, "w " * 150, " ".join(f"{chr(97 + i % 23)}x" for i in range(400)) + " é" * 50]
    found = metrics_of(spark, texts)
    assert set(found) == {0, 1, 2, 5, 6, 7}
    assert found[0].hapax_ratio == 0.5 and found[0].ttr == 4 / 7 == found[0].mattr
    assert found[1].func_word_ratio == 6 / 7 and found[2].unique_word_count == 3 and found[2].sentence_count == 3 and found[2].med_sentence_len == 4
    assert found[5].token_count == 15 and found[5].unique_word_count == 5 and found[6].mattr == 0.01
    words = texts[7].split()
    windows = [len(set(words[i : i + 100])) / 100 for i in range(len(words) - 99)]
    assert found[7].mattr == pytest.approx(sum(windows) / len(windows))


def test_grams_by_brute_force():
    """The oracle's n-grams of a year's stream of tokens, counted here token by token."""
    import collections
    import random
    import re

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(["ab", "cd", "efgh", "ijkl", "the"], k=draw.choice([0, 1, 1, 2, 3, 4, 5, 9])))) for i in range(120)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src1')", rows)
    found = con.execute(re.sub(r"\$(\w+)", r"\1", dialect.spell("WITH " + analyses.GRAMS + " SELECT year, ngram, c FROM counts", dialect.DUCK))).fetchall()
    dates = dict(con.execute(re.sub(r"\$(\w+)", r"\1", dialect.spell("WITH " + analyses.ARTICLES + " SELECT article_id, date FROM a", dialect.DUCK))).fetchall())
    streams = collections.defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (dates[r[0]], r[0])):
        streams[dates[i].year] += t.split()
    wanted = collections.Counter((y, " ".join(s[i : i + n])) for y, s in streams.items() for n in (2, 3) for i in range(len(s) - n + 1))
    assert {(y, g): c for y, g, c in found} == dict(wanted)
