"""Texts as sequences of parts that byte-level BPE encodes independently.

A single space between two characters that are not white space begins a new match
of the splitting pattern, whatever stands around it: only the class of white space
spans such a place, and it ends there.  So a text's ids are the ids of its head and
of each part (with its space) one after another, and each distinct part is encoded
once for each corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Parts whose ids a worker keeps between corpora.
CACHE_PARTS = 250_000

#: A text without these has no space beside another white-space character.
_UNEVEN = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_uneven = re.compile(r"\s | \s|^ | $").search
_parts = re.compile(r"(?<=\S) (?=\S)").split


def split(text: str) -> list[str]:
    """The text's head and the parts that each follow one space."""
    plain = text[0] != " " != text[-1] and not any(x in text for x in _UNEVEN)
    return text.split(" ") if plain or not _uneven(text) else _parts(text)


class PartEncoder:
    """Encodes texts by their distinct parts; ``resolve`` gives the packed ids of strings.

    Ids of about ``most`` parts are kept between corpora; beyond that those stay which
    recur in the corpus at hand.
    """

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], most: int = CACHE_PARTS):
        self.resolve, self.most = resolve, most
        self.known: dict[str, bytes] = {}

    def encode(self, blocks: list[Iterable[str | None]]) -> Iterator[list[bytes]]:
        """Packed ids of each text, block by block; all blocks are one corpus."""
        known = self.known
        fresh: set[str] = set()
        heads: set[str] = set()
        held: list[list[list[str]]] = []
        for texts in blocks:
            held.append([])
            for t in texts:
                parts = split(t) if t else []
                held[-1].append(parts)
                if parts:
                    heads.add(parts[0])
                    fresh.update(parts)
        if len(known) > self.most:
            again = fresh.intersection(known)
            self.known = known = dict(zip(again, map(known.__getitem__, again)))
        fresh.difference_update(known)
        new, firsts = list(fresh), list(heads)
        got = self.resolve([" " + p for p in new] + firsts)
        known.update(zip(new, got))
        first = dict(zip(firsts, got[len(new) :]))
        del fresh, new, got
        get = known.__getitem__
        held.reverse()
        while held:
            out = []
            for parts in held.pop():
                if parts:
                    head = first[parts[0]]
                    del parts[0]
                    out.append(head + b"".join(map(get, parts)))
                else:
                    out.append(b"")
            yield out
