"""Encoding of texts through a bounded cache of the chunks between spaces.

For the pre-token patterns handled here a boundary always lies before a space that is followed by a character other than white space, so a
text's ids are those of its chunks, one after the other. Most chunks recur; only the misses reach an encoder, all misses of a group at once.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from operator import itemgetter

#: Where a text has runs of white space around its spaces, it is cut before those spaces only that are followed by something else.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


class _Young(dict):
    """Chunks that were used lately; a chunk of the old generation moves here when asked for, an unknown one is noted and gives None."""

    __slots__ = ("missing", "old")

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            self.missing[chunk] = None
        else:
            self[chunk] = value
        return value


class _Known(dict):
    """The first tier: values that are known beforehand and stay as they are. What isn't among them is asked of the young generation."""

    __slots__ = ("young",)

    def __missing__(self, chunk: str):
        return self.young[chunk]


#: Longer chunks aren't remembered beyond a call, so that the cache's size in bytes is bounded, too.
LONGEST = 256


class ChunkCache:
    """encode(list of strings) -> list of values; `of` gives a text's values for its first chunk and then for each " " + chunk.

    known: values for " " + chunk that are looked up first and never dropped. Behind them the cache has two generations of at most `limit`
    chunks each, beside those of the group at hand: what is used again moves to the young one, the old one is dropped whole.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 150_000, known: dict | None = None):
        self._encode, self._limit = encode, limit
        self._young = _Young()
        self._young.old, self._young.missing = {}, {}
        self._known = _Known(known) if known else None

    def of(self, texts: list[str]) -> list[list]:
        odd = _ODD.search
        return self.values([_CUT.split(text) if odd(text) else text.split(" ") for text in texts], first=True)

    def values(self, lists: list[list[str]], first: bool = False) -> list[list]:
        """Values for " " + chunk for each (not empty) chunk of each list; first: but for a list's first chunk, as it is, if it isn't empty."""
        # Millions of small objects live for the length of a call and none of them in a cycle; the cycle collector would walk them again and again.
        gc.disable()
        try:
            return self._values(lists, first)
        finally:
            gc.enable()

    def _values(self, lists: list[list[str]], first: bool) -> list[list]:
        young, out, holes, firsts = self._young, [], [], {}
        table = young
        if self._known is not None:
            self._known.young = young
            table = self._known
        for chunks in lists:
            # One call looks all of them up; a call for each costs a third more. It gives a tuple only for two and more.
            if first:
                head, chunks[0] = chunks[0], ""
                values = list(itemgetter("", *chunks)(table))
                del values[0]
                values[0] = head
                if head:
                    firsts[head] = None
            else:
                values = list(itemgetter("", "", *chunks)(table))
                del values[:2]
            try:
                at = values.index(None)
                while True:
                    holes.append((values, at, chunks[at]))
                    at = values.index(None, at + 1)
            except ValueError:
                pass
            out.append(values)
        young.missing.pop("", None)
        if young.missing:
            missing = list(young.missing)
            young.missing.clear()
            found = dict(zip(missing, self._encode([" " + c for c in missing]), strict=True))
            young.update(found if max(map(len, missing)) <= LONGEST else {c: v for c, v in found.items() if len(c) <= LONGEST})
            for values, at, chunk in holes:
                values[at] = found[chunk]
        if firsts:
            firsts = dict(zip(firsts, self._encode(list(firsts)), strict=True))
        for values in out if first else ():
            if values[0]:
                values[0] = firsts[values[0]]
            else:
                del values[0]
        if len(young) > self._limit:
            self._young = _Young()
            self._young.old, self._young.missing = young, {}
            young.old, young.missing = {}, {}
        return out
