"""Suffix-array dedup: removes each byte under a 50-byte string that also starts in a document with a smaller id.

1. Blocks. Documents are written in blocks of two megabytes, or of one larger document, compressed, one row each.
2. Anchors. The anchor of a 50-byte window is the least hash among its 24-byte strings. Equal windows have equal
   anchors, so a window whose anchor occurs once in the whole table is unique. Each block sends its distinct anchors,
   packed by ranges of the hash; the ranges return those that occur twice or more.
3. Segments. A maximal run of windows with one shared anchor at one place is a segment: its windows and the 49 bytes
   after them. It goes to the range of its anchor.
4. Merge. The segments of a range form shards, and the shards' Burrows-Wheeler transforms are merged by interleave
   refinement (see bwt.py). The repeated intervals of the merged order are the equal windows, each with the smallest id
   that holds it. Every segment takes part, equal ones as well as different ones; nothing is decided beside the merge
   but the windows of hot anchors.
5. Hot anchors. An anchor with more than HOT occurrences would gather them in one task. Its windows go one by one, and
   the smallest id of each is found by an aggregation that folds them before they are sent.
6. Removal. Each block gets its covered windows and removes their bytes.

Defined results: a null text counts as empty; matches never cross documents and a repeat inside one document alone
removes nothing; a null id counts as the largest id; rows that repeat an id are one document with regard to its
order, each with its own text; an empty table gives an empty result; other columns are ignored, and
:func:`survivors` returns them as they were, whatever their names. :func:`survivors` removes a character if all its
bytes are covered. A task's memory follows the size of a block, thus that of the largest document.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.bwt import repeats
from veldtext.llm.common import materialize, release, small, trim, trimmed
from veldtext.llm.pretokens import forget

#: Bytes of a repeated string, and of the strings whose least hash is a window's anchor (a multiple of 8).
WINDOW, GRAM = 50, 24
#: 24-byte strings of a window.
SPAN = WINDOW - GRAM + 1
#: Occurrences beyond which an anchor's windows go alone.
HOT = 50_000
#: Bytes of texts in a block, and of those whose anchors are in a range on average; windows hashed at a time.
BLOCK_BYTES, RANGE_BYTES, STEP = 2_000_000, 6_000_000, 1 << 18
#: Of zstandard, for what is written and shuffled.
LEVEL = 6
_MAX_ID = 2**63 - 1
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(29)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; len(data) - 7 of them."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the 24-byte string at each place of data."""
    n = len(data) - GRAM + 1
    w = _words(data)
    h = w[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h += w[8 : n + 8]
    h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(30)
    h += w[16 : n + 16]
    return _mixed(h * _U(0x165667B19E3779F9))


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window, of the hashes of all 24-byte strings."""
    windows, width = len(h) - SPAN + 1, 1
    while width * 2 <= SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:windows], h[SPAN - width :])


def runs(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of documents that lie one after the other and end at ends, a stretch at a time: the anchor, first window and
    windows of each run of windows with one anchor, the hashes of the stretch and its begin. Places count from there."""
    total = len(data)
    for at in range(0, max(0, total - WINDOW + 1), STEP):
        stop = min(at + STEP + WINDOW - 1, total)
        h = grams(data[at:stop])
        value = anchors(h)
        valid = np.ones(len(value), bool)
        for end in ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, stop)].tolist():
            valid[max(0, end - at - WINDOW + 1) : end - at] = False
        change = np.ones(len(value), bool)
        change[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        n = np.diff(first, append=len(value))
        keep = valid[first]
        first, n = first[keep], n[keep]
        yield value[first], first, n, h, at


def segments(value: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut where the place of the anchor changes: the anchor, first window, windows, and bytes before the anchor.

    A window's anchor is the first of its strings with that hash; it changes its place in a run only where a text
    repeats itself within a window's length.
    """
    ahead = _ahead(value, first, h)
    long = n > ahead + 1
    if not long.any():
        return value, first, n, ahead
    more = n[long] - ahead[long] - 1
    number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    place = np.repeat(first[long] + ahead[long] + 1, more) + number
    own = np.repeat(value[long], more)
    before = _ahead(own, place, h)
    anchor = place + before
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)])
    value, first = np.r_[value, own[cut]], np.r_[first, place[cut]]
    n, ahead = np.r_[np.minimum(n, ahead + 1), np.diff(cut, append=len(place))], np.r_[ahead, before[cut]]
    order = np.argsort(first, kind="stable")
    return value[order], first[order], n[order], ahead[order]


def _ahead(value: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How far behind its begin each window's anchor is."""
    out = np.full(len(first), -1)
    open_ = np.arange(len(first))
    for k in range(SPAN):
        hit = h[first[open_] + k] == value[open_]
        out[open_[hit]] = k
        open_ = open_[~hit]
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, n_bytes, ids, rows and ends as packed numbers, and the texts' bytes, compressed."""

    def pack(part: list[tuple[int, int, bytes]], block: int) -> pa.RecordBatch:
        part.sort(key=lambda x: (x[0], x[1]))
        ids, rows, texts = zip(*part, strict=True)
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        packed = [np.array(ids, np.int64).tobytes(), np.array(rows, np.int64).tobytes(), ends.tobytes(), _squeezed(b"".join(texts))]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(ends[-1])]), *(pa.array([p], pa.binary()) for p in packed)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        block, part, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and size + len(row[2]) > BLOCK_BYTES:
                    yield pack(part, block)
                    block, part, size = block + 1, [], 0
                part.append(row)
                size += len(row[2])
        if part:
            yield pack(part, block)

    names = ["block", "n_bytes", "ids", "rows", "ends", "data"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_order_id(id_col).alias("id"), _row_key(id_col, text_col).alias("row"), text.cast("binary").alias("data"))
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "block long, n_bytes long, ids binary, rows binary, ends binary, data binary")


def _order_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX_ID))


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _open(ends: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(_loose(data), np.uint8), np.frombuffer(ends, np.int64)


def _short(value: np.ndarray) -> np.ndarray:
    """The upper 48 bits, spread evenly as least hashes are small, by which anchors are counted and dealt: two anchors
    that agree in them only cost a needless look."""
    return (value >> _U(16)) * _U(0x9E3779B97F4B) & _U((1 << 48) - 1)


def _packed(short: np.ndarray) -> bytes:
    """Rising numbers of 48 bits as differences, which are small, byte plane by byte plane."""
    if not len(short):
        return b""
    return _squeezed(np.diff(short, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_loose(data), np.uint8).reshape(6, -1).T
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, :6] = planes
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def _loose(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _range_of(short: np.ndarray, ranges: int) -> np.ndarray:
    return ((short >> _U(16)) * _U(ranges) >> _U(32)).astype(np.int64)


def _pieces(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    cuts = np.flatnonzero(np.diff(sorted_keys, prepend=-1)).tolist()
    for a, b in itertools.pairwise([*cuts, len(sorted_keys)]):
        yield int(sorted_keys[a]), a, b


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _rows(batches: Iterator[pa.RecordBatch], work, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A batch of what work gives for each row (a list of dicts)."""
    forget()
    for batch in batches:
        for k in range(batch.num_rows):
            out = work(batch.slice(k, 1).to_pylist()[0])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def _sent_anchors(blocks: DataFrame, ranges: int) -> DataFrame:
    schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("value", pa.binary()), ("times", pa.binary())])

    def one(row: dict) -> list[dict]:
        value = np.concatenate([_short(v) for v, *_ in runs(*_open(row["ends"], row["data"]))] or [np.empty(0, np.uint64)])
        value, counts = np.unique(value, return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        return [
            {"range": k, "block": row["block"], "value": _packed(value[a:b]), "times": counts[a:b].tobytes()}
            for k, a, b in _pieces(_range_of(value, ranges))
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_rows(batches, one, schema))

    return blocks.select("block", "ends", "data").mapInArrow(run, "range int, block long, value binary, times binary")


def _shared_anchors(sent: DataFrame) -> DataFrame:
    """For each block, its anchors that occur twice or more anywhere, and those that occur more than HOT times."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpacked(v) for v in group.column("value").to_pylist()]
        value = np.concatenate(parts)
        times = np.frombuffer(b"".join(group.column("times").to_pylist()), np.uint8)
        order = np.argsort(value)
        value = value[order]
        cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        total = np.repeat(np.add.reduceat(times[order].astype(np.int64), cuts), np.diff(np.r_[cuts, len(value)]))
        seen = np.empty(len(value), np.int64)
        seen[order] = total
        ends = np.cumsum([len(p) for p in parts])
        out = {"block": [], "value": [], "hot": []}
        for block, own, count in zip(group.column("block").to_pylist(), parts, np.split(seen, ends[:-1]), strict=True):
            keep = count > 1
            if keep.any():
                out["block"].append(block)
                out["value"].append(_packed(own[keep]))
                out["hot"].append(_packed(own[count > HOT]))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "value": pa.array(out["value"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})

    found = sent.groupBy("range").applyInArrow(run, "block long, value binary, hot binary")
    # One row for each range and block; together no more than the block's own anchors.
    return found.groupBy("block").agg(F.collect_list("value").alias("value"), F.collect_list("hot").alias("hot"))


def _shared_runs(row: dict, hot: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """A block's runs whose anchors are shared, either those of hot anchors or the others; places count in the block."""
    data, ends = _open(row["ends"], row["data"])
    wanted, often = (np.sort(np.concatenate([np.empty(0, np.uint64), *map(_unpacked, row[c])])) for c in ("value", "hot"))
    if hot and not len(often):
        return
    for value, first, n, h, at in runs(data, ends):
        short = _short(value)
        keep = _isin(often, short) if hot else _isin(wanted, short) & ~_isin(often, short)
        if keep.any():
            yield value[keep], first[keep], n[keep], h, at, data, ends


#: Segments of a range and a block: place, windows, bytes before the anchor, id; and their texts. Both are compressed.
_MOVED = "range int, block long, numbers binary, texts binary"
_MOVED_ARROW = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("numbers", pa.binary()), ("texts", pa.binary())])


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all (start, length), one after the other."""
    ends = np.cumsum(length)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(step):
        step[0] = start[0]
        step[ends[:-1]] = start[1:] - (start[:-1] + length[:-1] - 1)
    return data[np.cumsum(step)]


def _moved(blocks: DataFrame, shared: DataFrame, ranges: int) -> DataFrame:
    """Each block's segments by ranges."""

    def one(row: dict) -> list[dict]:
        ids, found = np.frombuffer(row["ids"], np.int64), []
        for value, first, n, h, at, data, ends in _shared_runs(row, hot=False):
            value, first, n, ahead = segments(value, first, n, h)
            found.append((value, first + at, n, ahead))
        if not found:
            return []
        value, first, n, ahead = (np.concatenate(x) for x in zip(*found, strict=True))
        where = _range_of(_short(value), ranges)
        order = np.argsort(where, kind="stable")
        first, n, ahead = first[order], n[order], ahead[order]
        own = ids[np.searchsorted(ends, first, side="right")]
        out = []
        for k, a, b in _pieces(where[order]):
            numbers = first[a:b].astype("<u4").tobytes() + n[a:b].astype(np.uint8).tobytes() + ahead[a:b].astype(np.uint8).tobytes() + own[a:b].tobytes()
            texts = _gathered(data, first[a:b], n[a:b] + WINDOW - 1).tobytes()
            out.append({"range": k, "block": row["block"], "numbers": _squeezed(numbers), "texts": _squeezed(texts)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_rows(batches, one, _MOVED_ARROW))

    return blocks.join(shared, "block").mapInArrow(run, _MOVED)


def _met(moved: DataFrame) -> DataFrame:
    """For each block the segments with windows that a document of smaller id has too: their places and a mask of these
    windows, packed."""

    def run(group: pa.Table) -> pa.Table:
        first, windows, ahead, ids, texts, ends = [], [], [], [], [], []
        for packed, joined in zip(*(group.column(c).to_pylist() for c in ("numbers", "texts")), strict=True):
            packed = _loose(packed)
            n = len(packed) // 14
            first.append(np.frombuffer(packed, "<u4", n))
            windows.append(np.frombuffer(packed, np.uint8, n, 4 * n))
            ahead.append(np.frombuffer(packed, np.uint8, n, 5 * n))
            ids.append(np.frombuffer(packed, "<i8", n, 6 * n))
            texts.append(np.frombuffer(_loose(joined), np.uint8))
            ends.append(n)
        lengths = np.concatenate(windows).astype(np.int64)
        size = lengths + WINDOW - 1
        mask = repeats(np.concatenate(texts), np.cumsum(size) - size, np.concatenate(ahead).astype(np.int64), lengths, np.concatenate(ids), WINDOW, GRAM)
        out = {"block": [], "covered": []}
        for block, place, own in zip(group.column("block").to_pylist(), first, np.split(mask, np.cumsum(ends)[:-1]), strict=True):
            hit = own > 0
            if hit.any():
                out["block"].append(block)
                out["covered"].append(_squeezed(place[hit].tobytes() + own[hit].astype("<u4").tobytes()))
        trim()
        return pa.table({"block": pa.array(out["block"], pa.int64()), "covered": pa.array(out["covered"], pa.binary())})

    return moved.groupBy("range").applyInArrow(run, "block long, covered binary")


def _hot_windows(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """For each block the windows of hot anchors that a document of smaller id has too: their places."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("bytes", pa.binary())])

    def one(row: dict) -> list[dict]:
        ids, out = np.frombuffer(row["ids"], np.int64), []
        for _, first, n, _, at, data, ends in _shared_runs(row, hot=True):
            place = np.repeat(first + at - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = ids[np.searchsorted(ends, place, side="right")].tolist()
            out += [{"block": row["block"], "place": p, "id": i, "bytes": data[p : p + WINDOW].tobytes()} for p, i in zip(place.tolist(), own, strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_rows(batches, one, schema))

    hot = shared.where(F.exists("hot", lambda x: F.octet_length(x) > 0))
    rows = blocks.join(hot, "block").mapInArrow(run, "block long, place long, id long, bytes binary")
    least = rows.groupBy("bytes").agg(F.min("id").alias("least"))
    # Both sides have exchanges of their own, so that a hot window is split at run time.
    return rows.join(least, "bytes").where("id > least").select("block", "place")


def covered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, its row key, and with_texts the text
    without the characters whose bytes are all covered."""
    blocks = materialize(_blocks(docs, id_col, text_col))
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(48, total // RANGE_BYTES)
    shared = materialize(_shared_anchors(_sent_anchors(blocks, ranges)))
    release(docs.sparkSession)
    # The same rows in all joins below, so that Spark deals them out once and reads them again.
    blocks = blocks.where("block is not null").drop("n_bytes")
    met = _met(_moved(blocks, shared, ranges)).groupBy("block").agg(F.collect_list("covered").alias("covered"))
    hot = _hot_windows(blocks, shared).groupBy("block").agg(F.collect_list("place").alias("places"))
    covered = met.join(hot, "block", "full")  # no more than the block's own windows

    def finished(row: dict) -> list[dict]:
        data, ends = _open(row["ends"], row["data"])
        ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        window = np.zeros(len(data) + WINDOW, bool)
        for packed in row["covered"] or []:
            first, mask = np.frombuffer(_loose(packed), "<u4").reshape(2, -1).astype(np.int64)
            for k in range(SPAN):
                window[first[mask >> k & 1 > 0] + WINDOW - 1 + k] = True
        window[np.array(row["places"] or [], np.int64) + WINDOW - 1] = True
        before = np.cumsum(window, dtype=np.int64)  # place p has the windows that begin at p - WINDOW + 1 to p
        gone = before[WINDOW - 1 : len(data) + WINDOW - 1] - np.r_[0, before[: len(data)]][: len(data)] > 0
        out = []
        for i, r, a, b in zip(ids.tolist(), rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            mask, own = gone[a:b], data[a:b]
            found = {"doc_id": None if i == _MAX_ID else i, "n_bytes": b - a, "n_removed": int(mask.sum()), "row": r}
            found["n_spans"] = int((mask & ~np.r_[False, mask[:-1]]).sum())
            found["kept_sha256"] = hashlib.sha256(own[~mask].tobytes()).hexdigest()
            if with_texts:
                char = np.cumsum((own & 0xC0) != 0x80) - 1
                whole = np.ones(char[-1] + 1 if b > a else 0, bool)
                whole[char[~mask]] = False
                found["text"] = own[~whole[char]].tobytes().decode() if b > a else ""
            out.append(found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_rows(batches, finished, arrow))

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("row", pa.int64())]
    arrow = pa.schema([*fields, ("text", pa.string())] if with_texts else fields)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, row long" + ", text string" * with_texts
    return blocks.join(covered, "block", "left").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return covered_texts(docs, id_col, text_col).drop("row")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats removed from their texts, without the documents of which nothing is left.

    A column n_chars, if there is one, gets the number of characters left. Rows are told apart by id and a hash of their
    text; repeated rows have one result, and all of them get it.
    """
    left = covered_texts(docs, id_col, text_col, with_texts=True).where("n_bytes > n_removed")
    left = left.select(F.coalesce("doc_id", F.lit(_MAX_ID)).alias("id"), "row", F.col("text").alias("left")).dropDuplicates(["id", "row"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(None).alias("a struct needs a field"))
    own = docs.select(_order_id(id_col).alias("id"), _row_key(id_col, text_col).alias("row"), whole.alias("whole"))
    joined = own.join(left, ["id", "row"])
    changed = {text_col: F.col("left")}
    types = dict(docs.dtypes)
    if "n_chars" in types:
        changed["n_chars"] = F.length("left").cast(types["n_chars"])
    return joined.select(*[changed.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])
