"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

The strings are read from their ends on, one column of symbols in each round. A shard's transform holds, for each round,
the symbols before its suffixes, in the order of these suffixes. The merge never compares suffixes: it keeps, for every
place of the merged order, the shard whose suffix stands there. Reading each shard's transform in that order gives the
symbols before the suffixes, and a stable sort by these symbols gives the order of the suffixes by one symbol longer.

The strings here are aligned: each holds an anchor, the same bytes in all that can have a repeat in common, with up to
SIDE bytes on either side. A repeat of `window` bytes is an anchor with `o` bytes before it and SIDE - o behind it. After
the rounds of what stands behind the anchors, and one for the anchors themselves, the merged order has all strings with
a common prefix next to each other; the lengths of the prefixes that neighbours have in common are read off once. Each
further round puts one more symbol before the anchors, and the repeats with `o` bytes before the anchor are the runs of
places whose `o` symbols agree and whose common prefixes behind are long enough. So one suffix of a string is followed
in a round, not all of them, and no suffixes are sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols of a shard, and shards of a merge, at most.
SHARD, MOST_SHARDS = 1 << 18, 250


def shards(sizes: np.ndarray) -> np.ndarray:
    """The shard of each string: consecutive ones of SHARD symbols in all, or of more where there would be too many."""
    ends = np.cumsum(sizes)
    width = max(SHARD, -(-int(ends[-1]) // MOST_SHARDS)) if len(ends) else 1
    return ((ends - sizes) // width).astype(np.uint8)


def transforms(columns: Iterator[np.ndarray], shard: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each column (a symbol for each string): the strings shard by shard, in the order of their suffixes behind the
    column, and their symbols in that order."""
    order = np.argsort(shard, kind="stable").astype(np.int32)
    for column in columns:
        symbols = column[order]
        yield order, symbols
        order = order[np.argsort(symbols, kind="stable")]
        order = order[np.argsort(shard[order], kind="stable")]


def merged(streams: Iterator[tuple[np.ndarray, np.ndarray]], shard: np.ndarray, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Before each round: the strings in the merged order of their suffixes, and the number of each one's block of equal
    symbols since round `fresh`."""
    interleave = np.sort(shard)
    n = len(shard)
    block = np.zeros(n, np.int32)
    for number, (order, symbols) in enumerate(streams):
        place = np.argsort(interleave, kind="stable")
        strings = np.empty(n, np.int32)
        strings[place] = order
        yield strings, block
        before = np.empty(n, symbols.dtype)
        before[place] = symbols
        place = np.argsort(before, kind="stable")
        interleave = interleave[place]
        if number >= fresh:
            first, old = before[place], block[place]
            block = np.zeros(n, np.int32)
            np.cumsum((first[1:] != first[:-1]) | (old[1:] != old[:-1]), out=block[1:])


def repeats(data: np.ndarray, start: np.ndarray, ahead: np.ndarray, windows: np.ndarray, owners: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each string a mask of its windows that a string of a smaller owner has too.

    String k begins at data[start[k]], holds windows[k] windows, one after the other, and its anchor after ahead[k] bytes;
    all its windows hold the anchor. Bit i of its mask stands for the window that begins i bytes after its start.
    """
    n, side = len(start), window - anchor
    mask = np.zeros(n, np.uint64)
    if not n:
        return mask
    at = start + ahead
    behind = windows + side - 1 - ahead
    last = len(data) - 1

    def column(offset: int, there: np.ndarray) -> np.ndarray:
        return np.where(there, data[np.clip(at + offset, 0, last)], np.uint8(0))

    words = np.lib.stride_tricks.as_strided(np.r_[data, np.zeros(8, np.uint8)], (len(data) + 1, 8), (1, 1))
    parts = [words[at + k].copy().view("<u8").reshape(-1) for k in range(0, anchor, 8)]
    by_anchor = np.lexsort(parts)
    change = np.zeros(n, bool)
    for p in parts:
        ranked = p[by_anchor]
        change[1:] |= ranked[1:] != ranked[:-1]
    symbol = np.empty(n, np.int32)  # the anchor as one symbol
    symbol[by_anchor] = np.cumsum(change)

    def columns() -> Iterator[np.ndarray]:
        for k in range(side - 1, -1, -1):
            yield column(anchor + k, behind > k)
        yield symbol
        for k in range(1, side + 1):
            yield column(-k, ahead >= k)
        yield np.zeros(n, np.uint8)

    shard = shards(windows + window - 1)
    for number, (strings, block) in enumerate(merged(transforms(columns(), shard), shard, side + 1)):
        o = number - side - 1
        if o < 0:
            continue
        if not o:
            common = _common(strings, symbol, [column(anchor + k, behind > k) for k in range(side)])
            rank = np.empty(n, np.int32)
            rank[strings] = np.arange(n, dtype=np.int32)
        prefix = np.cumsum(common < side - o, dtype=np.int32)[rank[strings]]
        cut = np.ones(n, bool)
        cut[1:] = (block[1:] != block[:-1]) | (prefix[1:] != prefix[:-1])
        own, long = ahead[strings], windows[strings]
        valid = (own >= o) & (own - long < o)
        owner = np.where(valid, owners[strings], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(owner, np.flatnonzero(cut))[np.cumsum(cut) - 1]
        hit = strings[valid & (least < owner)]
        mask[hit] |= np.uint64(1) << (ahead[hit] - o).astype(np.uint64)
    return mask


def _common(strings: np.ndarray, symbol: np.ndarray, behind: list[np.ndarray]) -> np.ndarray:
    """How many symbols behind the anchor each place has in common with the one before; -1 if the anchors differ."""
    ranked = symbol[strings]
    equal = np.zeros(len(strings), bool)
    equal[1:] = ranked[1:] == ranked[:-1]
    out = equal.astype(np.int8) - np.int8(1)
    for column in behind:
        ranked = column[strings]
        equal[1:] &= ranked[1:] == ranked[:-1]
        out += equal
    return out
