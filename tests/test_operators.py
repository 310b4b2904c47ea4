import numpy as np

from lexispan.operators import html, inference, topics
from lexispan.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_html_text():
    assert html.text_of(None) == html.text_of("   ") == ""
    assert html.text_of("<p>Hello <strong><em>World</em></strong></p>") == "Hello World"
    assert html.text_of("<script>var t='</p>';</script><style>p{}</style><p>Kept</p>") == "Kept"
    assert html.text_of("<nav>x</nav><article><p>One<p>Two</article>") == "One Two"
    assert html.text_of("<article><div class='ad'>no</div><div class='my-share-box'>no</div><p>Café</p></article>") == "Café"
    assert html.text_of("<li><p>twice</p></li>") == "twice twice"
    assert html.text_of("plain") == "plain"


def test_u_statistic_by_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 40).astype(float), rng.integers(0, 9, 30).astype(float)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert inference.u_statistic(a, b) == u
    assert 0 < inference.p_value(a, b, u) <= 1


def test_python_queries(spark):
    assert QUERIES["html_clean"](spark, DATA).count() == 50
    rows = QUERIES["bootstrap_ci"](spark, DATA).collect()
    assert rows and all(r.effect_ci_low is None or r.effect_ci_low <= r.effect_ci_high for r in rows)
    assert QUERIES["pca_2d"](spark, DATA).count() == 500


def test_bootstrap_draws_2000_resamples():
    import pandas as pd

    v = np.random.default_rng(2).integers(0, 9, 40).astype(float)
    frame = pd.DataFrame({"metric": "x", "g": np.arange(40) % 2, "id": np.arange(40), "v": v})
    a, b, rng = v[::2], v[1::2], np.random.default_rng(42)
    effects = [1 - 2 * inference.u_statistic(rng.choice(a, 20), rng.choice(b, 20)) / 400 for _ in range(2000)]
    row = inference.compare(frame).iloc[0]
    assert [row.effect_ci_low, row.effect_ci_high] == list(np.percentile(effects, [2.5, 97.5]))


def test_topics_of_words_and_pairs(spark):
    rng = np.random.default_rng(8)
    kinds = [[f"w{k}{a}{b}" for a in "abcdefghij" for b in "abcdefghij"] for k in range(3)]
    texts = []
    for i in range(120):
        own = list(rng.choice(kinds[i % 3], 60))
        texts.append(" ".join([*own, f"Red{i % 3}", "the", f"fox{i % 3}", *rng.choice(kinds[i % 3], 60)]))
    texts += [None, "", "the"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    terms, h = topics.factorise(docs.repartition(3), topics=3)
    assert {"red0 fox0", "red1 fox1", "red2 fox2"} <= set(terms) and h.shape == (3, len(terms))
    # by brute force
    split = [[w for w in (t or "").lower().split() if w != "the"] for t in texts]
    grams = [w + [" ".join(p) for p in zip(w, w[1:])] for w in split]
    df = {t: sum(t in set(g) for g in grams) for g in grams for t in g}
    assert terms == sorted(t for t, n in df.items() if 5 <= n <= 0.95 * len(texts))
    x = np.array([[(1 + np.log(g.count(t))) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) if t in g else 0 for t in terms] for g in grams])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    w, own = np.full((len(x), 3), 0.5), np.array(h)

    def lower(own, w, rounds):
        for _ in range(rounds):
            w = w * (x @ own.T) / np.maximum(w @ (own @ own.T), 1e-12)
        return w

    w = lower(own, w, 2000)
    reached = ((x - w @ own) ** 2).sum()
    for _ in range(300):  # more rounds by another method find no better place
        own = own * (w.T @ x) / np.maximum(w.T @ w @ own, 1e-12)
        w = lower(own, w, 5)
    assert reached <= ((x - w @ own) ** 2).sum() * 1.002
    assert {int(np.argmax([row[terms.index(f"red{k} fox{k}")] for k in range(3)])) for row in h} == {0, 1, 2}
