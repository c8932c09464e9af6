"""Encoding by chunks that are remembered.

A text is cut before each single space that neither follows nor precedes other white space. Pre-tokens never cross
such a place, so the ids of a text are the ids of its chunks, one after the other, and a chunk that was seen before
need not be encoded again. The chunks that are remembered are bounded by number and size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

from veldtext.llm.common import trim

#: White space other than the plain space.
_OTHER_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = re.compile(f"[{_OTHER_SPACES}] [{_OTHER_SPACES}]")
#: Half the chunks that are remembered at most, and their characters (beside those of one call).
MOST_CHUNKS, MOST_CHARS = 250_000, 4_000_000


class Cutter:
    """Cuts texts into chunks for one pattern of pre-tokens."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def keys(self, text: str) -> list:
        """A string stands for the chunk with a space before it, a tuple for one without.

        A text with a space beside other white space, or at an end, is cut by the pattern itself.
        """
        head, *rest = text.split(" ")
        if "" in rest or (not head and rest) or any(c in text and c + " " in text for c in _OTHER_SPACES) and _BETWEEN.search(text):
            return [t[1:] if t[0] == " " and len(t) > 1 else (t,) for t in self.pattern.findall(text)]
        return [(head,), *rest]

    @staticmethod
    def chunk(key: str | tuple) -> str:
        return key[0] if isinstance(key, tuple) else " " + key


class Numbers(dict):
    """Numbers keys from 0 as they are asked for; new has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


def gathered(flat: np.ndarray, starts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that the numbers name, one after the other, and where each of them ends there."""
    start = starts[number]
    n = starts[number + 1] - start
    ends = np.cumsum(n)
    return flat[np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class ChunkIds(Cutter):
    """value_of(list of chunks) gives the ids of each as little-endian 32-bit numbers; ids() gives those of texts.

    A chunk is looked up once, and the ids of all texts are gathered at a time. At the bounds the chunks that were used
    most stay, and what they were used before counts half from then on.
    """

    def __init__(self, value_of: Callable[[list[str]], list[bytes]], pattern: str):
        super().__init__(pattern)
        self.value_of = value_of
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.flat, self.starts, self.uses = np.empty(0, "<u4"), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _shrink(self) -> None:
        keys, flat, starts, uses = list(self.numbers), self.flat, self.starts, self.uses
        self._clear()
        chars = np.fromiter((len(k) if isinstance(k, str) else len(k[0]) for k in keys), np.int64, len(keys))
        order = np.argsort(-uses, kind="stable")[: min(MOST_CHUNKS, np.count_nonzero(uses > 1))]
        kept = np.sort(order[np.cumsum(chars[order]) <= MOST_CHARS // 2])
        for k in kept.tolist():
            dict.__setitem__(self.numbers, keys[k], len(self.numbers))
        self.chars, self.uses = int(chars[kept].sum()), (uses[kept] + 1) // 2
        self.flat, ends = gathered(flat, starts, kept)
        self.starts = np.concatenate([[0], ends])

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        if len(self.numbers) > 2 * MOST_CHUNKS or self.chars > MOST_CHARS:
            self._shrink()
        look = self.numbers.__getitem__  # text by text, as then its keys are still in the processor's cache
        looked = [np.fromiter(map(look, keys := self.keys(t) if t else []), np.int64, len(keys)) for t in texts]
        sizes, number = list(map(len, looked)), np.concatenate([np.empty(0, np.int64), *looked])
        new, self.numbers.new = self.numbers.new, []
        if new:
            values = self.value_of(list(map(self.chunk, new)))
            self.chars += sum(len(k) if isinstance(k, str) else len(k[0]) for k in new)
            lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(values), "<u4")])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.uses = np.bincount(number, minlength=len(self.numbers)) + np.pad(self.uses, (0, len(new)))
        data, ends = gathered(self.flat, self.starts, number)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b].tobytes() for a, b in itertools.pairwise(cuts)]


def sliced(texts: list, most_chars: int = 4_000_000) -> Iterable[list]:
    """Runs of texts of no more than most_chars characters each, or of one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most_chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_held: dict = {}


def held(make: Callable, *args):
    """make(*args), made once in each Python worker and kept until it is asked for something else, or to forget it."""
    key = (make, args)
    if key not in _held:
        forget()
        _held[key] = make(*args)
    return _held[key]


def forget() -> None:
    """Let go of what an earlier operator has left in this worker, which Spark uses again."""
    if _held:
        _held.clear()
        trim()
