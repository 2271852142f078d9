"""Where a text may be cut so that byte-level BPE gives the same ids for the parts as for the whole, and a memory of the parts seen.

The split pattern of byte-level BPE lets white space join the word behind it only as one blank. So a piece always begins at a blank that is
followed by something visible, none reaches across it, and the ids of a text are the ids of its chunks one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: A blank before more white space or the end: no place to cut.
_LOOSE = re.compile(r" (?:\s|\Z)")
_SAFE = re.compile(r" (?=\S)")

#: Chunks, and characters in them, that a worker process remembers between slices (texts without blanks are one chunk each). Beyond either the memory is emptied and filled again; results do not change.
REMEMBERED, REMEMBERED_CHARACTERS = 700_000, 16_000_000


def split(text: str) -> list[str]:
    """Cut before every blank that is followed by something visible. All parts but the first have lost that blank."""
    return _SAFE.split(text) if _LOOSE.search(text) else text.split(" ")


class _Codes(dict):
    """chunk -> its number; a chunk that is not known gets the next one."""

    def __init__(self, lead: str, fresh: list[str]):
        self.lead, self.fresh = lead, fresh

    def __missing__(self, chunk: str) -> int:
        code = self.fresh[0]
        self.fresh[0] += 1
        self.fresh.append(self.lead + chunk)
        self[chunk] = code
        return code


class ChunkMemory:
    """Encodes texts by their chunks. ``learn`` gives the ids of many chunks one after another, and where each chunk's ids begin (one more at the end).
    A text that holds one of the strings ``whole`` is not cut: it is a chunk of its own."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: tuple[str, ...] = ()):
        self.learn, self.whole = learn, whole
        self.forget()

    def forget(self) -> None:
        self.fresh: list = [0]  # the next number, then the new chunks
        self.first, self.next = _Codes("", self.fresh), _Codes(" ", self.fresh)
        self.ids = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)
        self.characters = 0

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (unsigned 32-bit), and where each text's ids begin (one more at the end). Null is the empty text."""
        if self.fresh[0] > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.forget()
        codes: list[int] = []
        ends = [0]
        first, following = self.first.__getitem__, self.next.__getitem__
        for t in texts.to_pylist() if isinstance(texts, pa.Array) else texts:
            if t and any(w in t for w in self.whole):
                codes.append(first(t))
            elif t:
                parts = iter(split(t))
                codes.append(first(next(parts)))
                codes.extend(map(following, parts))
            ends.append(len(codes))
        if len(self.fresh) > 1:
            ids, begins = self.learn(self.fresh[1:])
            self.characters += sum(map(len, self.fresh[1:]))
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
            self.begins = np.concatenate((self.begins, begins[1:] + self.begins[-1]))
            del self.fresh[1:]
        code = np.array(codes, np.int64)
        begin = self.begins[code]
        n = self.begins[code + 1] - begin
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = self.ids[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[np.array(ends)]
