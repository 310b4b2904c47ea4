"""Operators against brute force, round trips, and the cases that every operator must stand."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexispan.llm import bpe, graph, jaccard, language, licenses, mixing, nearest, shingles, substrings, suffixes, token_files, topk, warc

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, score double"
random.seed(5)
WORDS = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def edited(text, share):
    words = text.split(" ")
    for i in random.sample(range(len(words)), int(share * len(words))):
        words[i] = random.choice(WORDS)
    return " ".join(words)


BASE, PASSAGE = prose(120), prose(70)
TEXTS = [None, "", " \n\t ", "one", "One two  three", "a b c d e", "A b C d E", BASE, BASE, edited(BASE, 0.01), edited(BASE, 0.02), edited(BASE, 0.3), prose(80) + "\n" + PASSAGE + " " + prose(40), prose(90) + "\n" + PASSAGE + " " + prose(20), "é漢 🎉 <|endoftext|>\x1c x", "ab" * 400, prose(9000), *(prose(random.randint(5, 90)) for _ in range(20))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src0", "src1", "é"][i % 4] if i > 8 else "src0", len(t or ""), "x", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_mix(docs, none):
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(3)).collect()}
    assert found == again and len(found) == len(TEXTS)
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in docs.collect():
        m = found[r.doc_id]
        assert m.size == sizes[r.doc_id] and m.taken <= 2 * m.size
        by[r.source] = [by[r.source][0] + m.size, by[r.source][1] + m.taken, m.target]
        assert m.source_size == sum(s for s, x in zip(sizes, docs.collect()) if x.source == r.source)
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(sizes))
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = dict(zip(order, [3, 1, 2] * 9))
    open_, left, target = set(order), 1.5 * sum(sizes), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * by[s][0]}
        for s in full or open_:
            target[s] = 2 * by[s][0] if full else rate * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    for s in order:
        assert by[s][2] == pytest.approx(target[s])
        largest = max((sizes[r.doc_id] for r in docs.collect() if r.source == s), default=0)
        assert by[s][2] - max(60, largest) <= by[s][1] <= by[s][2] + 1
    assert mixing.mix(none).count() == 0


def test_subset_counts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.choice(np.arange(1, 60), rng.integers(1, 12), replace=False)
        counts = rng.integers(1, 9, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        taken = mixing.subset_counts(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (sizes * taken).sum() <= budget
        if counts.min() > 4 and 1 in sizes:
            assert (sizes * taken).sum() == budget


def test_subset_counts_of_many_sizes():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = rng.choice(np.arange(1, rng.choice([900, 20000])) * rng.choice([1, 2]), rng.integers(280, 800), replace=False)
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum()))
        taken = mixing.subset_counts(sizes, counts, budget)
        gap = budget - (sizes * taken).sum()
        assert (taken >= 0).all() and (taken <= counts).all() and 0 <= gap < sizes[taken < counts].min()


def test_language(spark, none):
    rows = [(i, "the cat and the dog of it" if i % 2 else "der hund und die katze ist", "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(90, None, "en", "x"), (91, "", "de", "x"), (92, "123 !", None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(table)
    found = {r.doc_id: r for r in language.predict(table, model).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < found[i].score <= 1 for i in range(40))
    assert {found[i].lang_pred for i in (90, 91, 92)} == {"und"}
    # unseen words fall back to their n-grams
    assert model.predict("dogs")[0] == "en" and model.predict("hunde")[0] == "de"
    assert language.fit(none).langs == [] and language.predict(none, language.fit(none)).count() == 0


def test_language_of_few_documents_keeps_its_words(spark):
    names = ["".join(x) for x in itertools.product("abcde", repeat=3)]
    rows = [(i, " ".join(names), "en") for i in range(30)] + [(90 + i, "zuv zuv wyx wyx", "de") for i in range(2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=20, grams=15)
    assert {"zuv", "wyx"} <= set(model.words.place) and len(model.words.place) == 22
    assert {" zuv ", " wyx "} <= set(model.grams[5].place) and {" zuv", "zuv "} <= set(model.grams[4].place)
    assert model.predict("zuv")[0] == "de" and model.predict("abc")[0] == "en"


def test_language_scores_by_brute_force():
    """Backoff over dense tables of counts, word by word."""
    draw = random.Random(11)
    langs = ["aa", "bb", "cc", "dd"]
    words = {w: {x: draw.randint(1, 9) for x in draw.sample(langs, draw.randint(1, 4))} for w in WORDS[:60]}
    grams = {n: collections.defaultdict(dict) for n in language.LENGTHS}
    for w in WORDS[60:90]:
        for n in grams:
            for i in range(len(w) + 3 - n):
                grams[n][f" {w} "[i : i + n]][draw.choice(langs)] = draw.randint(1, 5)
    model = language.LanguageModel.counted(langs, words, grams)

    def logs(counts, item, lang):
        total = sum(c.get(lang, 0) for c in counts.values())
        return np.log((counts[item].get(lang, 0) + language.SMOOTH) / (total + language.SMOOTH * (len(counts) + 1)))

    def score(word, lang):
        if word in words:
            return logs(words, word, lang)
        for n in language.LENGTHS:
            held = [g for i in range(len(word) + 3 - n) if (g := f" {word} "[i : i + n]) in grams[n]]
            if held:
                return np.mean([logs(grams[n], g, lang) for g in held]) * max(1, -(-len(held) // n))
        return 0.0

    for _ in range(60):
        text = draw.choices(WORDS[:140], k=draw.randint(1, 12))
        sums = np.array([sum(score(w, x) for w in text) for x in langs])
        p = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
        lang, found = model.predict(" ".join(text).title())
        assert lang == langs[int(p.argmax())] and found == pytest.approx(p.max(), rel=1e-4)


def test_language_query(spark):
    """The registered query: its split by crc32, and its accuracy on what it has not learned from."""
    table = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").collect()}
    found = language.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(table) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    asked = [r for r in found if r.held_out and table[r.doc_id].lang and r.lang_pred != "und"]
    assert len(asked) > 100 and np.mean([r.lang_pred == table[r.doc_id].lang for r in asked]) > 0.97


def test_licenses(spark, docs, none):
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 3.0.": "CC-BY-3.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0"}
    rows = [(i, f"{prose(30)}\n{line}\n{prose(5)}") for i, line in enumerate(lines)] + [(8, prose(400) + " Licensed under the Apache License, Version 2.0. " + prose(400)), (9, "a license to speak of, no more"), (10, None)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: found[i].license for i in found} == dict(enumerate(lines.values())) | {8: "Apache-2.0"}
    for i, t in rows[:-2]:
        assert t[found[i].start : found[i].start + found[i].length] == found[i].wording and found[i].n_differences == 0
    assert licenses.scan_licenses(docs).count() == 0 == licenses.scan_licenses(none).count()


def test_license_wordings_alone_on_a_line(spark):
    wanted = licenses.templates() + [("all-rights-reserved", "", "All rights reserved."), ("CC-BY-4.0", "", "CC BY 4.0"), ("CC-BY-SA-3.0", "", "Creative Commons Attribution-ShareAlike 3.0 International")]
    rows = [(i, f"{prose(20)}\n{wording}\n{prose(20)}") for i, (_, _, wording) in enumerate(wanted)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (found[i].license, found[i].n_differences) for i in found} == {i: (name, 0) for i, (name, _, _) in enumerate(wanted)}


def test_licenses_wrapped_in_long_lines_and_side_by_side(spark):
    def wrapped(text, width):
        out = [""]
        for w in text.split(" "):
            out.append(w) if len(out[-1]) + len(w) > width else out.append(f"{out.pop()} {w}".strip())
        return "\n".join(f" * {x}" for x in out)

    wanted = [x for x in licenses.templates() if len(x[2].split()) > 2]
    rows, names = [], []
    for name, _, wording in wanted:
        rows += [wrapped(wording, 30), wrapped(wording.upper(), 60)]
        names += [[name]] * 2
    long_one = next(x for x in wanted if x[0] == "GPL-3-or-later")
    for n in range(0, 200, 10):  # statements at all places of a long line
        rows.append(f"{prose(n)} {long_one[2]} {prose(60)} {wanted[0][2]} {prose(200 - n)}")
        names.append([long_one[0], "MIT"])
    rows.append("This work is licensed under the GNU General Public License, version 1. Parts are licensed under the MIT License.")
    names.append(["MIT"])
    rows.append("\n".join(f"{prose(2)} {w}" for _, _, w in wanted))
    names.append([x for x, _, _ in wanted])
    found = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id", "start").collect():
        found[r.doc_id].append(r.license)
        assert rows[r.doc_id][r.start : r.start + r.length] == r.wording and r.n_differences == 0
    assert dict(found) == dict(enumerate(names))


def test_license_candidates_come_from_compression(monkeypatch):
    """Every wording saves bytes beside its template, and what saves none is no statement, also if it stands there whole."""
    scanner, wordings = licenses.Scanner(), [[w for w, _, _ in licenses._words(x)] for _, _, x in licenses.templates()]
    assert min(scanner.saved(w, i) for i, w in enumerate(wordings)) >= licenses.LEAST_SAVING
    for i, w in enumerate(wordings):
        text = prose(30).split() + w + prose(30).split()
        cue = 30 + w.index(licenses.templates()[i][1].split()[0])
        assert i in [entry[0] for entry in scanner.ranked(text, cue, 0, len(text))]
    text = "Licensed under CC BY 4.0. All rights reserved."
    assert [x[0] for x in scanner.statements(text)] == ["CC-BY-4.0", "all-rights-reserved"]
    monkeypatch.setattr(scanner, "saved", lambda words, template: 0)
    assert scanner.statements(text) == []


def test_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_column(docs, path, P.PATTERN).collect():
        ids = np.array(library.encode_ordinary(TEXTS[r.doc_id] or ""), "<u4").tobytes()
        assert (r.ids, r.n_tokens) == (ids, len(ids) // 4) and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_column(none, path, P.PATTERN).count() == 0
    coder = bpe.replayer(path, P.PATTERN)
    alphabet = [*map(chr, range(0x20)), *" \x7f\x85\xa0᠎ 　aAb'sé漢\U0001f389١²", "̀", "'ll", " the", "aaaa", "ing"]
    odd = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(2000)]
    assert coder.encode_texts(odd) == [np.array(library.encode_ordinary(s), "<u4").tobytes() for s in odd]


def test_idle_workers_hold_no_replayer(spark, docs):
    """After a task a worker process keeps neither ranks nor encoded parts."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode_column(docs, path, P.PATTERN).count() == len(TEXTS)
    bpe.encode_column(docs, path, P.PATTERN).write.format("noop").mode("overwrite").save()

    def left(batches):
        import gc

        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ in ("MergeReplay", "PartEncoder") for x in gc.get_objects())]})

    assert {r.n for r in docs.select("doc_id").repartition(8).mapInArrow(left, "n long").collect()} == {0}


def test_token_files(spark, docs, none, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, folder = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/a"
    manifest = token_files.write_token_files(docs.repartition(3), path, 2, folder)
    found = token_files.read_token_files(spark, folder, manifest).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(path), 0
    library.encode_special_tokens = True
    for i, r in enumerate(found):
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(found) == len(TEXTS)
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(none, path, 2, f"file://{tmp_path}/b")).count() == 0
    rng = np.random.default_rng(2)
    for high in (1, 2, 300, 1 << 32):
        ids = rng.integers(0, high, rng.integers(1, 9000)).astype(np.uint32)
        ids[rng.integers(0, len(ids), 5)] = 0xFFFFFFFF
        back, used = token_files.unpack_block(block := token_files.pack_block(ids))
        assert (back == ids).all() and used == len(block)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def test_top_k_and_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 12)).round(1)
    v[17] = v[18] = v[50]
    rows = [(i, x.tolist(), 0.0) for i, x in enumerate(v)] + [(400, None, 0.0), (450, [1.0, None], 0.0), (451, [float("nan")] * 12, 0.0), (500, [0.0] * 12, 0.0)]
    table = vectors(spark, rows)
    exact = {i: np.floor(256 * np.float32(x).astype(float)) for i, x, _ in rows[:400] + rows[-1:]}
    found = collections.defaultdict(list)
    for r in topk.top_k(table, 5, 50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in exact if i % 50 == 0}
    for q in found:
        assert found[q] == sorted(((i, int(exact[q] @ x)) for i, x in exact.items() if i != q), key=lambda p: (-p[1], p[0]))[:5]
    near = collections.defaultdict(list)
    for r in nearest.nearest(table, 20, 20).orderBy("query_id", "rank").collect():
        near[r.query_id].append(r.vec_id)
    plain = {i: np.float32(x).astype(float) for i, x, _ in rows[:400]}
    hits = [len(set(near[q]) & set(sorted((i for i in plain if i != q), key=lambda i: (-(plain[q] @ plain[i]), i))[:20])) / 20 for q in plain if q % 20 == 0]
    assert set(near) == {i for i in plain if i % 20 == 0} and np.mean(hits) >= 0.9
    few = vectors(spark, rows[:3])
    assert topk.top_k(few, 5, 50).count() == 2 and nearest.nearest(few, 20, 20).count() == 2
    assert topk.top_k(vectors(spark, []), 5, 50).count() == 0 == nearest.nearest(vectors(spark, []), 20, 20).count()


def test_searches_over_shards_and_blocks(spark, monkeypatch):
    """Several shards, groups of queries and blocks of postings; repeated ids and ties."""
    from lexispan.llm import vectors as v

    rng = np.random.default_rng(9)
    rows = [(int(i), x.tolist(), 0.0) for i, x in zip([*range(500), 50, 60, 7], rng.standard_normal((503, 10)).round(1))]
    exact = [(i, np.floor(256 * np.float32(x).astype(float))) for i, x, _ in rows]
    wanted = collections.Counter()
    for q, x in exact:
        if q % 50 == 0:
            best = sorted(((i, int(x @ y)) for i, y in exact if i != q), key=lambda p: (-p[1], p[0]))[:5]
            wanted.update((q, i, s) for i, s in best)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "PROBES", 2)
    index = topk.Postings(np.array([i for i, _ in exact]), np.array([x for _, x in exact]), 5)
    for q, x in exact[:120]:
        ids, scores = index.best(q, x)
        assert list(zip(ids.tolist(), scores.tolist())) == sorted(((i, int(x @ y)) for i, y in exact if i != q), key=lambda p: (-p[1], p[0]))[:5]
    monkeypatch.setattr(v, "SHARD_ROWS", 90)
    once = {(q, i, s) for q, i, s in wanted if q != 50}
    assert {(r.query_id, r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), 5, 50).collect() if r.query_id != 50} == once
    first = nearest.nearest(vectors(spark, rows), 20, 20).collect()
    assert sorted(first) == sorted(nearest.nearest(vectors(spark, rows).repartition(5), 20, 20).collect())


def test_nearest_recall_and_verified_share():
    """On a whole table: recall of 0.95 and more, and most rows never verified."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, v = np.array(table["vec_id"]), np.array(table["embedding"], dtype=float)
    index = nearest.ShardIndex(v, float(np.sqrt((v * v).sum(axis=1)).max()), 42)
    recall, share = [], []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[i]
        scores[i] = -9
        places, found = index.candidates(v[i], 20, np.array([i]))
        best = places[np.argsort(-found, kind="stable")[:20]]
        recall.append(len(set(best) & set(np.argsort(-scores, kind="stable")[:20])) / 20)
        share.append(len(places) / len(v))
    assert np.mean(recall) >= 0.95 and np.mean(share) < 0.35


def test_nearest_counts_for_many_queries_in_few_rounds(monkeypatch):
    """Bitmaps give the counts of a loop over rows, over several blocks; the first radius is near the last."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 16))
    v[40:60] = v[7]
    norm = float(np.sqrt((v * v).sum(axis=1)).max())
    monkeypatch.setattr(nearest, "BLOCK", 1 << 10)
    index = nearest.ShardIndex(v, norm, 3, directions=48)
    asked, rounds = np.array([7, 300, 2999]), []
    at = rng.standard_normal((3, 48)) * norm
    low, high = index._window(at, np.array([0.5, 1.0, 9.0]) * norm)
    lifted = np.column_stack((v, np.sqrt(np.maximum(0, norm * norm - (v * v).sum(axis=1)))))
    edge = np.clip(np.ceil(index._edges(lifted @ index.axes.T)), 1, nearest.BUCKETS)
    found = np.unpackbits(index._colliding(low, high).view(np.uint8), axis=1, bitorder="little")[:, : len(v)]
    for i in range(3):
        assert (found[i] == (((edge > low[:, i]) & (edge <= high[:, i])).sum(axis=1) >= index.threshold)).all()
    assert found[2].all() and not found[0].all()
    count = index._colliding
    monkeypatch.setattr(index, "_colliding", lambda *x: rounds.append(x[0].shape[1]) or count(*x))
    for i, (places, scores) in zip(asked, index.candidates_of(v[asked], 20, [np.array([i]) for i in asked])):
        assert i not in places and len(set(places)) == len(places) and np.allclose(scores, v[places] @ v[i])
    assert sum(rounds) <= 12 and rounds[0] == 3


def test_suffix_arrays(monkeypatch):
    for group, groups in ((1024, 256), (3, 2), (8, 1000)):
        monkeypatch.setattr(suffixes, "GROUP", group)
        monkeypatch.setattr(suffixes, "GROUPS", groups)
        for _ in range(300):
            k = random.choice([1, 2, 3, 5, 40])
            t = [random.randint(1, k) for _ in range(random.randint(0, 80))]
            t = ((t[:5] * 20)[:70] if random.random() < 0.3 else t) + [0]
            assert suffixes.suffix_array(np.array(t), k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_large_alphabets():
    """Recursion goes on over thousands of names, also where a long string repeats."""
    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 4000, 9000), np.tile(rng.integers(1, 3000, 2500), 4), np.repeat(rng.integers(1, 900, 300), 30)):
        t = np.append(text, 0)
        raw = t.astype(">u2").tobytes()
        assert suffixes.suffix_array(t, 4001).tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i :])


def test_anchors_of_many_texts_at_once(monkeypatch):
    """Runs of a block of texts by brute force, in few steps however many texts there are."""
    texts = [prose(random.choice([3, 30, 60, 300])).encode() for _ in range(150)] + [b"", b"ab" * 300, b"x" * 199, b"x" * 200]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    steps, hashed = [], substrings.piece_hashes
    monkeypatch.setattr(substrings, "piece_hashes", lambda x: steps.append(len(x)) or hashed(x))
    block = pa.RecordBatch.from_pydict({"text": [x.decode() for x in texts]})
    list(substrings._anchors(200)(iter([block])))
    assert len(steps) <= len(data) // substrings.STEP + 2
    whole = [x.tolist() for x in substrings.contexts_of(data, bounds, 200)]
    wanted = []
    for k, x in enumerate(texts):
        hashes = hashed(np.frombuffer(x, np.uint8)).view(np.int64)
        order = hashes.view(np.uint64) >> substrings.PLACE_BITS
        at = [i + int(order[i : i + 161].argmin()) for i in range(len(x) - 199)]
        for a, run in itertools.groupby(range(len(at)), at.__getitem__):
            run = list(run)
            wanted.append((k, int(hashes[a]), a, run[0], run[-1]))
    assert list(zip(*whole)) == wanted
    monkeypatch.setattr(substrings, "STEP", 100)
    assert [x.tolist() for x in substrings.contexts_of(data, bounds, 200)] == whole
    monkeypatch.setattr(substrings, "SEGMENT", 3000)
    found = list(zip(*(x.tolist() for x in substrings.contexts_of(data, bounds, 200))))
    places = lambda runs: [(k, i, a, h) for k, h, a, first, last in runs for i in range(first, last + 1)]
    assert places(found) == places(wanted)


def brute_repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, bytes left) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(c for c, g in zip(d, gone) if not g)


def test_repeats_at_a_crowded_anchor(spark, monkeypatch):
    """One piece in very many different contexts, cut to parts and then to single strings; texts over several segments."""
    hot, passage = "HOTHOT " + prose(8), prose(60)
    texts = [prose(40) + hot + prose(50) for _ in range(60)]
    texts += [prose(30) + passage + prose(10) for _ in range(5)] + [texts[3], texts[3], texts[7][50:400], "x" * 3000, prose(2) + "é" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(5)
    wanted = list(brute_repeats(texts))
    for size in (2000, 300):
        monkeypatch.setattr(substrings, "SHARD_BYTES", size)
        found = {r.key: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(rows).collect()}
        assert [found[i] for i in range(len(texts))] == wanted
    monkeypatch.setattr(substrings, "SEGMENT", 130)
    whole = np.frombuffer("".join(texts).encode(), np.uint8)
    anchors, at, first, last = substrings.contexts(whole, 200)
    assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(whole) - 200
    assert (at >= last).all() and (at + substrings.PIECE <= first + 200).all() and (anchors == substrings.piece_hashes(whole)[at].view(np.int64)).all()


def test_repeats_of_null_and_repeated_keys(spark):
    text, other = prose(50), prose(60)
    rows = [(None, text), (None, text), (1, text), (1, other), (None, None), (2, "")]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "key long, text string").selectExpr("key", "text", "1 AS row", "2 AS spans")).collect()
    assert sorted((str(r.key), r.n_bytes, r.n_removed) for r in found) == sorted((str(k), len(t or ""), len(text) if t == text else 0) for k, t in rows)


def test_repeats(docs, none, spark):
    found = {r.key: r for r in substrings.remove_repeats(docs.withColumnRenamed("doc_id", "key")).collect()}
    data = [(t or "").encode() for t in TEXTS]
    for key, wanted in enumerate(brute_repeats(TEXTS)):
        r = found[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == wanted
    assert found[7].n_removed == len(data[7]) and found[15].n_removed == 800 and found[16].n_removed == 0
    assert substrings.remove_repeats(none.withColumnRenamed("doc_id", "key")).count() == 0


def test_jaccard(docs, none, spark):
    dense = [(1000 + i, edited(BASE, 0.015 * (i % 4)), None, None, 0, "", 0.0) for i in range(25)]
    both = docs.union(spark.createDataFrame(dense, DOCS))
    sets = {r.doc_id: shingle_set(r.text) for r in both.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for r in jaccard.jaccard_components(both).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_of_large_runs(spark, monkeypatch):
    """Families of near copies that share their frequent shingles, in runs compared cell by cell."""
    monkeypatch.setattr(jaccard, "CELL_ITEMS", 7)
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", 600)
    shared = prose(14)
    families = [shared + " " + prose(16) for _ in range(12)]
    texts = [" ".join(w if random.random() > 0.03 else random.choice(WORDS) for w in f.split(" ")) for f in families for _ in range(9)]
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == group


def test_jaccard_of_long_texts_by_brute_force(spark):
    rng = random.Random(5)
    shared = [f"common{i}" for i in range(300)]
    texts = []
    for k in range(12):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(rng.choice((700, 1020, 1030, 2500)))] + shared
        for share in (0, 0.005, 0.02, 0.028, 0.03, 0.1):
            texts.append(" ".join(w if rng.random() >= share else f"z{rng.randrange(10**9)}" for w in words[: len(words) - rng.randrange(60)]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert found == dict(enumerate(label)) and 12 < len(set(label)) < len(texts)
    held = shingles.shingle_sets(pa.array([texts[-1]]), 5)[0]
    assert jaccard._folded(jaccard._signature(held, 4096), 128).tobytes() == jaccard._signature(held, 1024)


def test_words_of_long_texts(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(500), None, "x" * 300 + " y", "", prose(90)])
    whole = shingles.words(texts)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, shingles.words(texts)))


def test_jaccard_null_id_first(spark):
    rows = [(None, BASE), (2, BASE), (1, BASE), (3, edited(BASE, 0.01)), (None, None)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found if r.doc_id) == [(1, 1), (2, 1), (3, 1)]
    assert [r.component_id for r in found if r.doc_id is None] == [None, None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (5, 5)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(31), 100]} | {200: 200, 201: 200}


def test_warc(spark, tmp_path):
    big = "x" * 300
    rows = [(5, "http://a", big), (2, None, big), (3, "u\r\nv", "<p>é</p>"), (4, "u", "<p>é</p>"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 99), (9, "u", "y" * 99)] + [(i, "u", prose(60)) for i in range(20, 420)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    names = warc.write_archives(pages, f"file://{tmp_path}/w")
    found = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w", names).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (found[i].record_type, found[i].refers_to) == (("revisit", 2) if i == 5 else ("response", None))
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e", empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    kinds = {"en": "the {} and of {} it", "de": "der {} und die {} ist"}
    rows = [(i, " ".join(kinds["en" if i % 2 else "de"].format(*random.choices(WORDS, k=2)) for _ in range(12)), "en" if i % 2 else "de", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "de", "src1", 0), (101, "12 34", "en", "src0", 0), (102, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, function in pipeline.STAGES:
        docs = pipeline.stage(function(spark, docs, str(tmp_path)), "t")
        kept.append((name, {r.doc_id for r in docs.collect()}))
        assert docs.columns == list(pipeline.COLUMNS) or name == pipeline.STAGES[-1][0]
    assert kept[0][1] == set(range(60)) | {100} and kept[1][1] == set(range(60))
    assert {r.doc_id: r.n_tokens > 0 for r in docs.collect()} and kept[3][1] == kept[4][1]


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline
    import public_tokenizers as P
    import tiktoken

    def bag(rows):
        return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)

    own = ["the {} and of {} it ".format(*random.choices(WORDS, k=2)) + prose(random.randint(8, 40)) for _ in range(30)]
    passage = prose(80)
    own += [f"{prose(40)} {passage} {prose(30)}", f"{prose(35)} {passage} {prose(45)}", edited(own[3], 0), own[5], own[5], own[6].upper()]
    ids = [*range(25), None, None, 7, 7, 8, 50, 51, 3, None, 5, None]
    rows = [(i, t, "en", f"src{k % 2}", len(t)) for k, (i, t) in enumerate(zip(ids, own))]
    docs = spark.createDataFrame(rows + rows[:1] + rows[25:26], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    given = pipeline.stage(docs, "t").collect()
    # near copies: of each linked group the smallest id, null last
    left = pipeline.stage(pipeline.near_copies(spark, docs, ""), "t")
    sets = [shingle_set(r.text) for r in given]
    group = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = [min(((r.doc_id is None, r.doc_id or 0) for r, g in zip(given, group) if g == x)) for x in dict.fromkeys(group)]
    kept = left.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(least) and bag(kept) <= bag(given)
    # repeated strings
    cut = pipeline.stage(pipeline.repeated_strings(spark, left, ""), "t")
    data = [r.text.encode() for r in kept]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    wanted = collections.Counter()
    for r, d in zip(kept, data):
        gone = {k for i in range(len(d) - 199) if seen[d[i : i + 200]] > 1 for k in range(i, i + 200)}
        text = bytes(c for k, c in enumerate(d) if k not in gone).decode("utf-8", "ignore")
        wanted[(r.doc_id, text, r.lang, r.source, len(text))] += 1 if text.split() else 0
    assert bag(cut.collect()) == +wanted
    # the mix of rows that repeat: each at most twice as often as it stands there, budgets met
    twice = pipeline.stage(cut.union(cut.limit(3)), "t")
    before, mixed = bag(twice.collect()), pipeline.stage(pipeline.mix_sources(spark, twice, ""), "t")
    after = bag(mixed.collect())
    assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items()) and any(x[0] is None for x in after)
    planned = mixing.mix(twice).collect()
    assert sum(len(x[1].split()) * n for x, n in after.items()) == sum(r.taken for r in planned)
    # token ids
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    tokens = collections.Counter((r.doc_id, bytes(r.ids)) for r in pipeline.token_ids(spark, mixed, "").collect())
    assert tokens == collections.Counter(x for k, n in after.items() for x in [(k[0], np.array(library.encode_ordinary(k[1]), "<u4").tobytes())] * n)


def test_shingles_and_words():
    import pyarrow as pa

    texts = ["A b\tc d e f", None, "", "a b", "a  b c d e f"]
    got = shingles.shingle_sets(pa.array(texts), 5)
    assert [len(x) for x in got] == [2, 0, 0, 1, 2] and (got[0] == got[4]).all()


def test_library_encoder_equals_library():
    """Parts encoded together give the ids of whole texts, whatever the white space, special tokens and characters."""
    import random

    import public_tokenizers as tokenizers
    from tokenizers import Tokenizer

    path, draw = tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    atoms = ["a", "foo", "Bar", "'s", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "é", "ñ", "漢字", "🙂", "12", "3.4", "...", "<|endoftext|>", "​", "\r\n", "x" * 250]
    texts = [None, "", *("".join(draw.choices(atoms, k=draw.randint(1, 25))) for _ in range(3000))]
    found = next(token_files.library_encoder(path).encode([texts]))
    assert found == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_near_copies_shuffle_few_texts_and_keep_wordless_rows_once(spark):
    import corpus_pipeline as pipeline

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    own = [" ".join(random.randbytes(40).hex() for _ in range(20)) for _ in range(400)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(own)]
    rows += [(1000 + i, own[i], "en", "b", len(own[i])) for i in range(20)] + rows[30:33]
    rows += [(2000, None, "en", "a", 0), (2000, None, "en", "a", 0), (2001, None, "en", "a", 0), (2002, " \n", "en", "a", 2), (2002, " \n", "en", "a", 2), (2002, " ", "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = pipeline.stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "t")
    before = shuffled()
    left = pipeline.stage(pipeline.near_copies(spark, docs, ""), "t")
    assert shuffled() - before < 0.5 * sum(len(t) for t in own)
    wanted = rows[:400] + [rows[i] for i in (423, 425, 426, 428, 429)]
    assert collections.Counter(map(tuple, left.collect())) == collections.Counter(wanted)


def test_texts_left_by_the_pipeline_pass_one_python_worker(spark):
    import corpus_pipeline as pipeline

    passage = "\u00e9" * 150
    texts = ["a" + passage + " end", "bb" + passage + "\u00fc more", passage[:40] + " short", None]
    docs = pipeline.stage(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), "t")
    left = pipeline.repeated_strings(spark, docs, "")
    assert "ArrowEvalPython" not in left._jdf.queryExecution().toString()
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    wanted = []
    for i, d in enumerate(data):
        gone = {k for j in range(len(d) - 199) if seen[d[j : j + 200]] > 1 for k in range(j, j + 200)}
        text = bytes(c for k, c in enumerate(d) if k not in gone).decode("utf-8", "ignore")
        wanted += [(i, text, "en", "a", len(text))] if text.split() else []
    assert sorted(map(tuple, left.collect())) == wanted
