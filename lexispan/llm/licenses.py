"""License statements in texts, by conditional compression.

Every template has a cue, the first of the words that name its license.  Around each cue
in a text, lines joined, the words that a statement by a template could take are a
block, so blocks cross lines and overlap.  A block is compressed alone and with the
template as raw Zstandard dictionary; templates are ranked by how much smaller their blocks
get, and all that save bytes are confirmed, best first, by the exact differences of their
wording: it is aligned with the words on both sides of the cue; the words that name the
license must all stand there, and few others may differ.  Case, punctuation and line
breaks do not count.  What is aligned has to get smaller by the template, too.  Of
overlapping statements the best stays, and the others' cues are looked at again in the
words left free.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, tidy

#: Least saving of bytes; share of other words that may differ.
LEAST_SAVING, MOST_DIFFERENT = 4, 0.2
#: Compressed around every block, so that Zstandard does not store the short ones as they are; behind a template, since matches are not looked for in the last bytes.
CARRIER, TAIL = b" " * 64, b"\0" * 16

# Wordings of public licenses (name, words that name it with its cue first, wording).
_NOTICES = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "restriction granted deal", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "fee use copy modify distribute", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "cc0 1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "reserved rights", "All rights reserved."),
    ("all-rights-reserved", "reserved rights", "Copyright. All rights reserved."),
]
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def templates() -> list[tuple[str, str, str]]:
    """(license, words that name it, wording) of every template."""
    out = list(_NOTICES)
    for short, name in _GNU.items():
        key = name.lower()
        for version in ("2", "2.1", "3"):
            out.append((f"{short}-{version}", f"{key} {version}", f"This work is licensed under the {name}, version {version}."))
            out.append((f"{short}-{version}-or-later", f"{key} {version} later", f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
    for code, name in _CC.items():
        for version in ("3.0", "4.0"):
            out.append((f"CC-{code}-{version}", f"cc {code.lower()} {version}", f"Licensed under CC {code} {version}."))
            out.append((f"CC-{code}-{version}", f"cc {code.lower()} {version}", f"CC {code} {version}"))
            out.append((f"CC-{code}-{version}", f"commons creative {name.lower()} {version}", f"This work is licensed under a Creative Commons {name} {version} International License."))
            out.append((f"CC-{code}-{version}", f"commons creative {name.lower()} {version}", f"Creative Commons {name} {version} International"))
    return out + [(x, f"spdx-license-identifier {x.lower()}", f"SPDX-License-Identifier: {x}") for x in sorted({x for x, _, _ in out})]


#: "mit" is a common word elsewhere; the MIT sentences may differ in one word, so one of these stands in each.
_BESIDE = {"mit": r"the[\W_]+mit|mit[\W_]+license"}
#: The first naming words of all templates.  They must stand in a statement, so a text without any has none.
CUE = rf"(?i)(?<![a-z0-9])(?:{'|'.join(_BESIDE.get(w, re.escape(w)) for w in dict.fromkeys(key.split()[0] for _, key, _ in templates()))})(?![a-z0-9])"

_word = re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?").finditer


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _word(text)]


class Scanner:
    """Templates as compressors, and the alignment that confirms them."""

    def __init__(self, entries: list[tuple[str, str, str]] | None = None):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.entries, self.given, self.at_cue, self.reach = [], [], defaultdict(list), 0
        for name, key, wording in entries or templates():
            wanted, named = [w for w, _, _ in _words(wording)], key.split()
            most = int(MOST_DIFFERENT * len(wanted))
            place = wanted.index(named[0])
            # a naming word that stands twice has to be found at one of its places
            for places in product(*([k for k, w in enumerate(wanted) if w == x] for x in named[1:])):
                must = [k in places for k in range(len(wanted))]
                self.at_cue[named[0]].append((len(self.entries), set(named), most, (wanted[:place][::-1], must[:place][::-1]), (wanted[place + 1 :], must[place + 1 :])))
            self.entries.append((name, len(wanted)))
            self.given.append(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(wanted).encode() + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
            self.reach = max(self.reach, len(wanted) + most)

    def saved(self, words: list[str], template: int) -> int:
        """Bytes by which words get smaller beside a template."""
        data = CARRIER + " ".join(words).encode() + CARRIER
        return len(self.alone.compress(data)) - len(self.given[template].compress(data))

    @staticmethod
    def aligned(wanted: list[str], must: list[bool], have: list[str], most: int) -> tuple[int, int] | None:
        """(differing words, words of ``have`` used) of the best alignment of all of ``wanted`` with a beginning of ``have``; what must stand is never left out."""
        have = have[: len(wanted) + most]
        row = list(range(len(have) + 1))
        for w, needed in zip(wanted, must):
            drop = most + 1 if needed else 1
            new = [row[0] + drop]
            for i, x in enumerate(have):
                least = min(new[i], row[i + 1] + drop - 1) + 1
                new.append(row[i] if x == w and row[i] < least else least)
            row = new
            if min(row) > most:
                return None
        least = min(row)
        return (least, max(i for i, x in enumerate(row) if x == least)) if least <= most else None

    def ranked(self, have: list[str], i: int, low: int, high: int) -> list[tuple]:
        """Entries of the cue at word ``i`` whose block within ``low`` and ``high`` gets smaller by their template, by bytes saved."""
        around, out = set(have[low:high]), []
        for n, entry in enumerate(self.at_cue[have[i]]):
            template, named, most, left, right = entry
            if named <= around:
                block = have[max(low, i - len(left[0]) - most) : min(high, i + 1 + len(right[0]) + most)]
                if (saved := self.saved(block, template)) > 0:
                    out.append((-saved, n, entry))
        return [entry for _, _, entry in sorted(out)]

    def best(self, have: list[str], i: int, low: int, high: int) -> tuple[float, int, int, int, int, int, int] | None:
        """The statement around the cue at word ``i`` within ``low`` and ``high`` with fewest differences for its length, then the longest, then the one that saves most.

        (share of differing words, -words, -bytes saved, template, first word, end, differing words)
        """
        before, behind = have[low:i][::-1], have[i + 1 : high]
        out = []
        for template, _, most, left, right in self.ranked(have, i, low, high):
            if (a := self.aligned(*left, before, most)) and (b := self.aligned(*right, behind, most - a[0])):
                first, end, different = i - a[1], i + 1 + b[1], a[0] + b[0]
                if (saved := self.saved(have[first:end], template)) >= LEAST_SAVING:
                    out.append((different / self.entries[template][1], first - end, -saved, template, first, end, different))
        return min(out, default=None)

    def statements(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(license, start, end, bytes saved, differing words) of every statement in a text; of those that overlap, the best."""
        words = _words(text or "")
        have = [w for w, _, _ in words]
        starts, ends, heap = [], [], []  # words of what is found

        def free(i: int) -> tuple[int, int]:
            k = bisect_right(starts, i)
            return max(i - self.reach, ends[k - 1] if k else 0, 0), min(i + self.reach + 1, starts[k] if k < len(starts) else len(have))

        def look(i: int) -> None:
            bounds = free(i)
            if bounds[0] <= i and (found := self.best(have, i, *bounds)):
                heappush(heap, (found, i, bounds))

        for i, w in enumerate(have):
            if w in self.at_cue:
                look(i)
        out = []
        while heap:
            (_, _, saved, template, first, end, different), i, bounds = heappop(heap)
            if free(i) != bounds:
                look(i)
                continue
            insort(starts, first)
            insort(ends, end)
            out.append((self.entries[template][0], words[first][1], words[end - 1][2], -saved, different))
        return sorted(out, key=lambda x: x[1])


_SCHEMA = "doc_id long, license string, start long, length long, saved_bytes long, n_differences long, wording string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per license statement: doc_id, license, start and length (characters), saved_bytes, n_differences, wording.

    Texts without a cue word, null and empty texts have none.  Rows that repeat are each scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for block in text_blocks(batches):
            rows = [(i, n, s, e - s, v, d, t[s:e]) for i, t in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()) for n, s, e, v, d in scanner.statements(t)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUE)).mapInArrow(tidy(run), _SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """License statements of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
