"""Splitting texts into pre-tokens, and a bounded memo of what each piece becomes."""

from __future__ import annotations

import re
from functools import lru_cache

#: Entries of a memo; with the older half at most twice as many are held.
PIECES = 400_000


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\u{points[i]:04x}-\\u{points[j]:04x}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def latin_splitter():
    """(beyond, split) for the public pattern: split is for texts in which beyond finds nothing, that is of characters up to U+024F. It uses the standard library's faster engine with the classes that the regex library has for those characters."""
    import regex

    letters, numbers, spaces = (_ranges([c for c in range(0x250) if regex.match(p, chr(c))]) for p in (r"\p{L}", r"\p{N}", r"\s"))
    low = re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
    return re.compile("[^\x00-\u024f]").search, low


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """text -> its matches."""
    import public_tokenizers
    import regex

    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    beyond, low = latin_splitter()
    return lambda text: low(text) if beyond(text) is None else full(text)


class PieceMemo(dict):
    """piece -> make(piece). A full memo becomes the older one, which still answers what is asked for again; very long pieces aren't kept."""

    def __init__(self, make, limit: int = PIECES):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, piece):
        out = self.older.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out
