"""Token ids of whole texts through a bounded cache of what stands between single spaces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: A single space between two other characters. Byte-level patterns join it to what follows, and
#: none of their alternatives reaches over it, so both sides have the ids they have alone.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a space: only SAFE places part such texts.
DOUBLE = re.compile(r" \s|\s ")


def little_endian(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if array("I", [1]).tobytes()[0] != 1:
        out.byteswap()
    return out.tobytes()


class ChunkCache:
    """ids(text) as bytes, with ``encode`` called for chunks that it doesn't hold.

    ``encode`` maps a list of strings to their id lists. At most ``entries`` chunks of up to
    ``longest`` characters are held; once that many again times ``patience`` were not found, the
    cache starts anew, so that it follows the texts. Results don't depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: int = 400_000, longest: int = 48, patience: int = 8):
        self.encode, self.entries, self.longest, self.patience = encode, entries, longest, patience
        self.held: dict[str, bytes] = {}
        self.missed = 0

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = SAFE.split(text) if DOUBLE.search(text) else text.split(" ")
        chunks = [first, *[" " + x for x in rest]]
        found = list(map(self.held.get, chunks))
        if None not in found:
            return b"".join(found)
        missing = list(dict.fromkeys([x for x, y in zip(chunks, found, strict=True) if y is None]))
        new = {x: little_endian(y) for x, y in zip(missing, self.encode(missing), strict=True)}
        self._keep(new)
        return b"".join([new[x] if y is None else y for x, y in zip(chunks, found, strict=True)])

    def _keep(self, new: dict[str, bytes]) -> None:
        self.missed += len(new)
        if self.missed > self.entries * self.patience:
            self.held.clear()
            self.missed = 0
        if len(self.held) + len(new) <= self.entries:
            self.held.update((x, y) for x, y in new.items() if len(x) <= self.longest)
