"""Cutting texts where every byte-level pre-tokeniser begins a new pre-token.

A space that a non-space character follows always begins a pre-token, so the
stretches between such spaces can be tokenised apart, and remembered, with the
same result as the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ODD = re.compile(r" (?:\s|\Z)")
#: White space of Latin-1, each after a space.
_AFTER = tuple(f" {c}" for c in map(chr, range(256)) if c.isspace())
#: Letters of the longest stretch that is kept, and bytes of an entry besides its letters.
LONGEST, ENTRY = 1024, 190
#: The first stretch of a text has no space before it; it is the only member of a tuple.
Unit = str | tuple[str]


def odd(text: str) -> bool:
    """Whether a space has white space, or nothing, after it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return text.endswith(" ") or any(pair in text for pair in (_AFTER if not text.isascii() else _AFTER[:-2]))


def units(text: str) -> list[Unit]:
    """The stretches of text, without the space that each but the first begins with."""
    parts = text.split(" ")
    if odd(text):
        out = [parts[0]]
        for part in parts[1:]:
            if not part or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(part)
        parts = out
    parts[0] = (parts[0],)
    return parts


def unit_text(unit: Unit) -> str:
    return unit[0] if type(unit) is tuple else " " + unit


class Cache:
    """A worker's memory of encoded stretches, bounded by about `most` bytes.

    `size` tells the bytes of what encode gives for a stretch, if that is more
    than a number. Stretches longer than LONGEST are never kept. When the
    memory is full, only what the current slice of texts uses is kept.
    """

    def __init__(self, encode: Callable[[list], list], size: Callable[[object], int] | None = None, most: int = 128 << 20):
        self.encode, self.size, self.most, self.known, self.held = encode, size, most, {}, 0

    def cost(self, found: dict) -> int:
        # a dict's entry and the objects' heads, and the letters; first stretches are in tuples
        letters = sum(len(u[0]) if type(u) is tuple else len(u) for u in found)
        return ENTRY * len(found) + 2 * letters + (sum(map(self.size, found.values())) if self.size else 0)

    def get(self, wanted: set) -> dict:
        """A dict that holds all of wanted."""
        known = self.known
        missing = [u for u in wanted if u not in known]
        if not missing:
            return known
        found = dict(zip(missing, self.encode(missing)))
        long = {u: found.pop(u) for u in [u for u in missing if len(u[0] if type(u) is tuple else u) > LONGEST]}
        added = self.cost(found)
        if self.held + added > self.most:
            known = self.known = {u: known[u] for u in wanted if u in known}
            self.held = self.cost(known)
        known.update(found)
        self.held += added
        return {u: long[u] if u in long else known[u] for u in wanted} if long else known
