"""Safe boundaries for byte-level BPE, and a cache over what lies between.

The split pattern of byte-level BPE never matches across a change from a
character that is not white space to one that is. Cutting a text only at such
places (or inside a very long run of white space, before its last character
when something follows) leaves the tokens as they were.

``pieces`` cuts long texts there. ``units`` cuts ordinary texts at each of
them, and ``UnitCache`` keeps values of distinct units.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

#: Unicode White_Space, as the tokenizers' regex engines see ``\s``.
WS = "\t-\r \x85\xa0" + "".join(map(chr, (
    0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECE = 1 << 16
LONG_RUN = 20_000
_TWO = re.compile(f"[{WS}]{{2}}")
_CUT = re.compile(f"(?<=[^{WS}])(?=[{WS}])")
_RUN = re.compile(f"[{WS}]{{{LONG_RUN},}}")
_ALL = re.compile(f"[{WS}]+")


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Parts of ``text`` in order, each at most about ``limit`` characters
    unless no safe place is near; their tokens are the text's tokens."""
    if len(text) <= limit:
        yield text
        return
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if b < len(text):
            b -= 1
        yield from _cut(text, at, a, limit)
        yield text[a:b]
        at = b
    yield from _cut(text, at, len(text), limit)


def is_long_run(piece: str) -> bool:
    """Whether a piece is such a run of white space (up to its last character)."""
    return len(piece) >= LONG_RUN - 1 and _ALL.fullmatch(piece) is not None


def _cut(text: str, lo: int, hi: int, limit: int) -> Iterator[str]:
    while lo < hi:
        m = _CUT.search(text, lo + limit, hi) if hi - lo > limit else None
        end = m.start() if m else hi
        yield text[lo:end]
        lo = end


def units(text: str) -> tuple[list[str], list[str], str] | None:
    """(what follows each space, what follows each line feed, what the text
    begins with), in no order across the three; None where two white-space
    characters meet, as then not every space is a safe place."""
    if _TWO.search(text):
        return None
    lines = text.split("\n")
    after_space: list[str] = []
    heads = []
    for line in lines:
        parts = line.split(" ")
        heads.append(parts[0])
        after_space += parts[1:]
    return after_space, heads[1:], heads[0]


class UnitCache:
    """Values of units, computed in batches. At ``limit`` entries it starts
    afresh, which bounds its memory and changes no result."""

    def __init__(self, compute: Callable[[Sequence[str]], Sequence], limit: int = 1_200_000):
        self.compute, self.limit, self.known = compute, limit, {}

    def learn(self, found: set[str]) -> dict:
        """A mapping that holds at least the units in ``found``."""
        if len(self.known) + len(found) > self.limit:
            self.known = {}
        new = [u for u in found if u not in self.known]
        self.known.update(zip(new, self.compute(new)))
        return self.known
