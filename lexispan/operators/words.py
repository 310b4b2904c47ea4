"""Words of whole blocks of texts, cut and counted in numpy.

Letters, numbers and lower case are those of single code points, as the SQL's regular
expressions and ``lower`` have them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..functions.blocks import text_blocks
from ..functions.lists import FUNCTION_WORDS, STOPWORDS

LETTER, NUMBER, SPACE, END, VOWEL = 1, 2, 4, 8, 16
#: Bytes of text that are counted at once.
BLOCK = 2 << 20
#: Places beyond which no code point is a letter or number; letters that the SQL's tables (Unicode 15.0) do not have yet.
_MOST, _NEW = 0x32400, range(0x2EBF0, 0x2EE5E)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower case by code point; the last entry stands for all beyond."""
    kinds, lower = np.zeros(_MOST + 1, np.uint8), np.arange(_MOST + 1, dtype=np.uint32)
    for i in range(_MOST):
        c = chr(i)
        kinds[i] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], 0)
        if len(small := c.lower()) == 1:
            lower[i] = ord(small)
    kinds[_NEW.start : _NEW.stop] = 0
    lower[0x130] = ord("i")
    for chars, flag in (("_", NUMBER), ("\t\n\f\r ", SPACE), (".!?", END), ("aeiouy", VOWEL)):
        kinds[[ord(c) for c in chars]] |= flag
    return kinds, lower


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and where each text begins, with the end of all."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]])
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return _points(pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.large_string()))
    at = at - at[0]
    if len(text) < len(data):
        at = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))[at]
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


def _runs(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of ``inside``, and the places after them; no run goes on over a beginning."""
    on = inside[1:] & inside[:-1]
    cuts = begins[1:-1]
    on[cuts[(cuts > 0) & (cuts < len(inside))] - 1] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~on
    last[:-1] &= ~on
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _lexicon(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word, the distinct words as bytes, and where each of these begins; ``chars`` are those of all words."""
    at = np.concatenate(([0], np.cumsum(sizes * chars.itemsize)))
    found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(chars)]).dictionary_encode()
    own = found.dictionary
    places = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    return found.indices.to_numpy(), own, places // chars.itemsize


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring places."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[at]
    return total[1:] - total[:-1]


COUNTS = "n sents sent_tokens sent_median types hapaxes windowed functions letters syllables polysyllables".split()
_COUNT_TYPE = pa.struct([(c, pa.float64() if c == "sent_median" else pa.int64()) for c in COUNTS])


def _count(texts: pa.Array) -> pa.Array:
    points, begins = _points(texts)
    kinds, lower = _tables()
    kind, rows = kinds.take(points, mode="clip"), len(texts)
    letter = (kind & LETTER) > 0
    starts, ends = _runs(letter, begins)
    word_at = np.searchsorted(starts, begins)
    n = np.diff(word_at)
    row = np.repeat(np.arange(rows), n)
    codes, words, own = _lexicon(lower[points[letter]], ends - starts)
    out = {"n": n, "letters": _sums(ends - starts, word_at)}

    # of each distinct word
    chars = np.frombuffer(words.buffers()[2] or b"", np.uint32)[: own[-1]]
    vowel = (kinds.take(chars, mode="clip") & VOWEL) > 0
    groups = np.bincount(np.searchsorted(own, _runs(vowel, own)[0], "right") - 1, minlength=len(words))
    syllables = np.maximum(1, groups - ((groups > 1) & (chars[own[1:] - 1] == ord("e"))))
    function = pc.is_in(words, value_set=pa.array([w.encode("utf-32-le") for w in FUNCTION_WORDS], pa.large_binary())).to_numpy(zero_copy_only=False)
    out |= {"syllables": _sums(syllables[codes], word_at), "polysyllables": _sums((syllables >= 3)[codes], word_at), "functions": _sums(function[codes], word_at)}

    # places of a word in order: the first of a text, and the one before it
    bits = len(codes).bit_length()
    key = np.sort((codes.astype(np.int64) << bits) | np.arange(len(codes)))
    place, code = key & ((1 << bits) - 1), key >> bits
    r = row[place]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = (code[1:] == code[:-1]) & (r[1:] == r[:-1])
    first, once = ~again[:-1], ~again[:-1] & ~again[1:]
    out |= {"types": np.bincount(r[first], minlength=rows), "hapaxes": np.bincount(r[once], minlength=rows)}
    # windows of 100 words in which a place is the first of its type
    p, size = place - word_at[r], n[r]
    since = np.zeros(len(p), np.int64)
    since[1:] = np.where(first[1:], 0, p[:-1] + 1)
    windows = np.where(size < 100, first, np.maximum(0, np.minimum(p, size - 100) - np.maximum(since, p - 99) + 1))
    out["windowed"] = np.bincount(r, windows, rows).astype(np.int64)

    # a sentence begins at what follows a text's beginning or an end mark; its units are words and other marks
    end = (kind & END) > 0
    opens = np.concatenate(([True], end[:-1])) if len(points) else end
    opens[begins[:-1][begins[:-1] < len(points)]] = True
    at = np.flatnonzero(opens & ~end)
    s_row = np.searchsorted(begins, at, "right") - 1
    to = np.minimum(np.concatenate((at[1:], [len(points)])), begins[s_row + 1]) if len(at) else at
    unit = ~letter & ((kind & SPACE) == 0)
    unit[starts] = True
    total = np.concatenate(([0], np.cumsum(unit)))
    kept = np.searchsorted(starts, to) > np.searchsorted(starts, at)
    units, s_row = (total[to] - total[at])[kept], s_row[kept]
    sents = np.bincount(s_row, minlength=rows)
    out |= {"sents": sents, "sent_tokens": np.bincount(s_row, units, rows).astype(np.int64)}
    ordered = np.sort((s_row << 32) | units) & 0xFFFFFFFF
    before, some = np.cumsum(sents) - sents, sents > 0
    median = np.zeros(rows)
    median[some] = (ordered[(before + (sents - 1) // 2)[some]] + ordered[(before + sents // 2)[some]]) / 2
    out["sent_median"] = median
    return pa.StructArray.from_arrays([pa.array(out[c], t.type) for c, t in zip(COUNTS, _COUNT_TYPE)], fields=list(_COUNT_TYPE))


def article_counts(texts: pa.Array) -> pa.Array:
    """What the metrics of an article are made of, for each text."""
    found = [_count(b.column(0)) for b in text_blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=BLOCK)]
    return pa.concat_arrays(found) if found else pa.array([], _COUNT_TYPE)


def register(spark: SparkSession) -> None:
    """``article_counts`` as an SQL function of the session."""
    from pyspark.sql.functions import arrow_udf

    def counts(texts: pa.Array) -> pa.Array:
        return article_counts(texts)

    spark.udf.register("article_counts", arrow_udf(counts, "struct<" + ", ".join(f"{c}: {'double' if c == 'sent_median' else 'bigint'}" for c in COUNTS) + ">"))


#: Bytes of text whose words or n-grams are counted together before they leave a task.
COUNT_BLOCK = 8 << 20
#: Most that a year and three words make as one number.
WIDE = 1 << 62


def words_of(texts: pa.Array, least: int = 2) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Runs of ``least`` letters, numbers and underscores or more, in lower case: codes, the distinct ones, and where each text's begin."""
    points, begins = _points(texts)
    kinds, lower = _tables()
    inside = (kinds.take(points, mode="clip") & (LETTER | NUMBER)) > 0
    starts, ends = _runs(inside, begins)
    chars, sizes = lower[points[inside]], ends - starts
    kept = sizes >= least
    chars, sizes = chars[np.repeat(kept, sizes)], sizes[kept]
    at = np.concatenate(([0], np.cumsum(kept)))[np.searchsorted(starts, begins)]
    codes, words, own = _lexicon(chars, sizes)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint32)[: own[-1]]
    text = data.tobytes().decode("utf-32-le", "surrogatepass").encode(errors="surrogatepass")
    if len(text) > len(data):
        own = np.concatenate(([0], np.cumsum(1 + (data > 0x7F) + (data > 0x7FF) + (data > 0xFFFF), dtype=np.int64)))[own]
    return codes, pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(own), pa.py_buffer(text)]), at


def _plain(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of two letters a to z or more, which are whole runs of letters, numbers and underscores in lower case.

    Their codes, the distinct ones, and where each text's begin.
    """
    points, begins = _points(texts)
    kinds, lower = _tables()
    inside = (kinds.take(points, mode="clip") & (LETTER | NUMBER)) > 0
    starts, ends = _runs(inside, begins)
    chars, sizes = lower[points[inside]], ends - starts
    kept = (sizes >= 2) & (_sums((chars >= ord("a")) & (chars <= ord("z")), np.concatenate(([0], np.cumsum(sizes)))) == sizes)
    codes, words, _ = _lexicon(chars[np.repeat(kept, sizes)].astype(np.uint8), sizes[kept])
    return codes, words.cast(pa.large_string()), np.concatenate(([0], np.cumsum(kept)))[np.searchsorted(starts, begins)]


def stops(words: pa.Array) -> np.ndarray:
    return pc.is_in(words, value_set=pa.array(STOPWORDS, pa.large_string())).to_numpy(zero_copy_only=False)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True)


def _words_of(block: pa.RecordBatch) -> Iterator[dict]:
    codes, words, at = _plain(block.column("text"))
    years, y = np.unique(block.column("year").to_numpy(zero_copy_only=False), return_inverse=True)
    y, content = np.repeat(y, np.diff(at)), ~stops(words)[codes]
    key, n = _counted(y[content] * len(words) + codes[content])
    if len(key):
        yield {"year": years[key // len(words)], "word": words.take(pa.array(key % len(words))), "n": n}
        total = np.bincount(y[content], minlength=len(years))
        yield {"year": years[total > 0], "word": [None] * int((total > 0).sum()), "n": total[total > 0]}


def _grams_of(block: pa.RecordBatch) -> Iterator[dict]:
    codes, words, at = _plain(block.column("text"))
    years, y = np.unique(block.column("year").to_numpy(zero_copy_only=False), return_inverse=True)
    row, d = np.repeat(np.arange(block.num_rows), np.diff(at)), len(words)
    y, c = y[row], codes.astype(np.int64)
    stop, long = stops(words)[codes], (pc.binary_length(words).to_numpy(zero_copy_only=False) > 3)[codes]
    for n in (2, 3):
        first = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
        last = first + n - 1
        total = np.bincount(y[first], minlength=len(years))
        yield {"year": years[total > 0], "n": np.full((total > 0).sum(), n), "ngram": [None] * int((total > 0).sum()), "c": total[total > 0]}
        middle = first + 1
        good = ~stop[first] & ~stop[last] & (long[first] | long[last] | (~stop[middle] & long[middle]))
        first, middle, last = first[good], middle[good], last[good]
        pair, names = y[first] * d + c[first], None
        if n == 3:
            pair = pair * d + c[middle]
            if len(years) * d**3 >= WIDE:  # too many words for one number: pairs by rank
                names, pair = np.unique(pair, return_inverse=True)
        key, count = _counted(pair * d + c[last])
        if not len(key):
            continue
        head, parts = key // d, [words.take(pa.array(key % d))]
        head = head if names is None else names[head]
        for _ in range(n - 1):
            head, code = np.divmod(head, d)
            parts.insert(0, words.take(pa.array(code)))
        yield {"year": years[head], "n": np.full(len(key), n), "ngram": pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), "c": count}


def _edges_of(block: pa.RecordBatch) -> Iterator[dict]:
    codes, words, at = _plain(block.column("text"))
    n = np.diff(at)
    some = np.minimum(n, 4)
    row = np.repeat(np.arange(len(n)), some)
    place = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
    place += np.where((n[row] > 4) & (place >= 2), n[row] - 4, 0)
    if len(row):
        yield {k: block.column(k).take(pa.array(row)) for k in ("article_id", "date", "year")} | {"pos": place, "tok": words.take(pa.array(codes[at[row] + place]))}


@cache
def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, text.split(", "))])


def _batch(found: dict, schema: str) -> pa.RecordBatch:
    target = _schema(schema)
    arrays = [x if isinstance(x := found[f.name], pa.Array) else pa.array(x) for f in target]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)


def mapped(articles: DataFrame, of, schema: str) -> DataFrame:
    """What ``of`` tells of blocks of texts, as arrays by the names of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=COUNT_BLOCK):
            for found in of(block):
                yield _batch(found, schema)

    return articles.mapInArrow(run, schema)


def word_counts(articles: DataFrame) -> DataFrame:
    """Words (year, text) that are no stopwords, counted by year a block at a time; a row without word has their sum."""
    return mapped(articles, _words_of, "year int, word string, n long")


#: N-grams are dealt by their bytes to so many parts, which are counted one after another.
PARTS = 2048
_PACKED = "part int, keys binary, sizes binary, counts binary, grams binary"


def _packed(found: dict) -> Iterator[dict]:
    """Counted n-grams as one row a part of theirs, so that few rows are shuffled; sums of all are empty n-grams of part 0."""
    grams = pc.fill_null(pa.array(found["ngram"], pa.large_string()) if isinstance(found["ngram"], list) else found["ngram"].cast(pa.large_string()), "")
    if not len(grams):
        return
    at = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset : grams.offset + len(grams) + 1]
    data = np.frombuffer(grams.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    sizes, at = np.diff(at), at - at[0]
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(at[:-1], sizes)
        powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[place])))
        mixed = (mixed[at[1:]] - mixed[at[:-1]]) * np.uint64(0xD6E8FEB86659FD93)
    part = (mixed >> np.uint64(40)).astype(np.int64) % PARTS
    part[sizes == 0] = 0
    order = np.argsort(part.astype(np.int16), kind="stable")
    key = (np.asarray(found["year"], np.int32) * 4 + np.asarray(found["n"], np.int32))[order]
    grams = grams.take(pa.array(order))
    parts, begins = np.unique(part[order], return_index=True)
    begins = np.concatenate((begins, [len(order)]))
    text_at = np.frombuffer(grams.buffers()[1], np.int64)[: len(grams) + 1]

    def cut(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(begins * values.itemsize), pa.py_buffer(values)])

    text = pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(text_at[begins]), grams.buffers()[2] or pa.py_buffer(b"")])
    yield {"part": parts, "keys": cut(key), "sizes": cut(sizes[order].astype(np.int32)), "counts": cut(np.asarray(found["c"], np.int64)[order]), "grams": text}


def _raise(best: dict[int, list], rows: list[list], most: int) -> None:
    """Takes the n-grams of a part into the ``most`` commonest of each year and size, ties by n-gram, after the sums of all."""
    keys, sizes, counts = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((0, np.int32), (1, np.int32), (2, np.int64)))
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    grams = pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(b"".join(r[3] for r in rows))]).dictionary_encode()
    names, d = grams.dictionary, len(grams.dictionary)
    key = keys.astype(np.int64) * d + grams.indices.to_numpy()
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total, key = np.add.reduceat(counts[order], begins), key[begins]
    kind = key // d
    cuts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        held = best.setdefault(int(kind[a]), [])
        least = -held[most][1] if len(held) > most else 0
        if b - a > most + 1:
            least = max(least, np.partition(total[a:b], -most - 1)[-most - 1])
        own = a + np.flatnonzero(total[a:b] >= least)
        if len(own):
            held += [(g != "", -c, g) for c, g in zip(total[own].tolist(), names.take(pa.array(key[own] % d)).to_pylist())]
            held.sort()
            del held[most + 1 :]


def gram_top(articles: DataFrame, across: DataFrame, most: int = 100) -> DataFrame:
    """Candidates for the ``most`` commonest pairs and triples of words of each year: those of each task's parts, with their counts.

    They are those within the texts (year, text) and those ``across`` texts (year, n, ngram, c).  Only those that can be
    ranked are told; rows without ngram have the sums of all.
    """

    def within(block: pa.RecordBatch) -> Iterator[dict]:
        for found in _grams_of(block):
            yield from _packed(found)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _packed({k: batch.column(k) for k in ("year", "n", "ngram", "c")}):
                yield _batch(found, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, held = {}, None, []
        for batch in batches:
            for part, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part != now and held:
                    _raise(best, held, most)
                    held = []
                now = part
                held.append(row)
        if held:
            _raise(best, held, most)
        for kind, found in best.items():
            n = len(found)
            yield _batch({"year": np.full(n, kind // 4), "n": np.full(n, kind % 4), "ngram": [g or None for _, _, g in found], "c": [-c for _, c, _ in found]}, "year int, n int, ngram string, c long")

    dealt = mapped(articles, within, _PACKED).unionByName(across.mapInArrow(beside, _PACKED)).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "year int, n int, ngram string, c long")


def edge_words(articles: DataFrame) -> DataFrame:
    """The first and last two words of each text (article_id, date, year, text), with their places."""
    return mapped(articles, _edges_of, "article_id long, date date, year int, pos long, tok string")
