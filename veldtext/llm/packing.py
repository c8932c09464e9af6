"""Best-fit packing by minimum bin slack.

For each bin, the largest length that is left comes first; a subset-sum over the lengths that are left, with sums held
as the bits of an integer, finds the fullest feasible combination, which is then removed. Bins that are filled to the
last token use up the small pieces early, and the last bins lack them. So the plan is made several times, each with some
slack that ends the search for a fuller combination (the sums grow from the larger lengths to the smaller), and the plan
with the fewest bins counts; the first that needs no more bins than the tokens do ends the trials. Pieces of one length are
interchangeable, so the scheduler works on the counts by length (at most `size` numbers, whatever the table's size) and
removes a combination as many times as the counts allow. The pieces themselves are numbered within their length and
look their place up in the resulting plan; only their numbers are shuffled.

Defined results: a null text counts as empty and is the end id alone; texts with equal lengths are placed in the order
of their numbering, so any of them may take any of their places; repeated rows are packed as rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldtext.llm.common import materialize, small
from veldtext.llm.pretokens import ChunkIds, Numbers, gathered, held, sliced

#: Pieces of one length that are numbered in one run, on average. A row for each run, and size more, are broadcast.
RUN_PIECES = 5_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Latin letters, and ASCII marks but the apostrophe, which begins pre-tokens like 's.
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-&(-/:-@\[-`{-~"
#: Chunks of these and digits, with single line ends. Each run of one kind is a pre-token, with the space before it.
_PLAIN = re.compile(f" ?(?:[{_LETTERS}0-9{_MARKS}]++\n?+)++")
_RUNS = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n|\0")
#: Byte-level models name the bytes that are not printable in Latin-1 by the characters from 256 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_NAMES = [(chr(b), chr(256 + k)) for k, b in enumerate(_HIDDEN) if b == 10 or b > 127]


class JsonTokenizer:
    """Ids by the tokenizers library, without special tokens of its own; a chunk's ids as little-endian 32-bit.

    With byte-level pre-tokens the library's model gets the runs of plain chunks by themselves, each of a call's runs
    once. All other chunks go through the library's own cutting.
    """

    def __init__(self, path: str, pattern: str, between: str = "<|endoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.between = Tokenizer.from_file(path), between
        self.end = self.model.token_to_id(between)
        self.added = [token.content for token in self.model.get_added_tokens_decoder().values()]
        self.memo = ChunkIds(self._encode_chunks, pattern)
        self.bare, cutting = None, self.model.pre_tokenizer
        if isinstance(cutting, pre_tokenizers.ByteLevel) and cutting.use_regex and not cutting.add_prefix_space and not self.model.normalizer:
            self.bare = Tokenizer(self.model.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocabulary = self.bare.get_vocab()
            self.first = np.zeros(max(vocabulary.values()) + 1, bool)
            self.first[[i for token, i in vocabulary.items() if token[0] in "\u0100\u0120"]] = True
            self.zero = vocabulary["\u0100"]

    def _one(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        plain = [self.bare is not None and _PLAIN.fullmatch(c) is not None for c in chunks]
        runs = iter(self._encode_plain([c for c, p in zip(chunks, plain, strict=True) if p]))
        rest = iter(self._encode_any([c for c, p in zip(chunks, plain, strict=True) if not p]))
        return [next(runs if p else rest) for p in plain]

    def _encode_plain(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        numbers = Numbers()
        found = _RUNS.findall("\0".join(["", *chunks, ""]))  # so a zero has number 0, and no ids
        number = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        texts = []
        for k in range(1, len(numbers), 256):
            # a run's first id shows the space or the zero that it begins with; the zeros before other runs are taken out
            text = "".join([r if r[0] == " " else "\0" + r for r in numbers.new[k : k + 256]])
            text = text.encode().decode("latin-1").replace(" ", " \u0120").replace("\0", " \u0100 ")
            for byte, name in _NAMES:
                text = text.replace(byte, name)
            texts.append(text)
        encodings = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, "<u4") for e in encodings])
        starts, zeros = np.flatnonzero(self.first[flat]), flat == self.zero
        starts -= np.cumsum(zeros)[starts] - zeros[starts]
        data, ends = gathered(flat[~zeros], np.concatenate([[0], starts, [np.count_nonzero(~zeros)]]), number)
        cuts, data = (ends[number == 0] * 4).tolist(), data.tobytes()
        return [data[a:b] for a, b in itertools.pairwise(cuts)]

    def _encode_any(self, chunks: list[str]) -> list[bytes]:
        """Many chunks in one call: the special token between them keeps them apart."""
        parts, out = [chunks[k : k + 64] for k in range(0, len(chunks), 64)], []
        found = self.model.encode_batch_fast([self.between.join(p) for p in parts], add_special_tokens=False)
        for part, encoding in zip(parts, found, strict=True):
            ids = np.array(encoding.ids, "<u4")
            cuts = np.flatnonzero(ids == self.end)
            if len(cuts) != len(part) - 1:  # a chunk holds the special token itself
                out += [np.array(self._one(c), "<u4").tobytes() for c in part]
                continue
            data = ids.tobytes()
            ends = [*(cuts * 4).tolist(), len(data)]
            starts = [0, *(cuts * 4 + 4).tolist()]
            out += [data[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """A text that holds an added token goes whole to the library, which cuts it there before all else."""
        whole = [any(token in t for token in self.added) for t in texts]
        plain = self.memo.ids("" if w else t for w, t in zip(whole, texts, strict=True))
        return [np.array(self._one(t), "<u4").tobytes() if w else ids for w, t, ids in zip(whole, texts, plain, strict=True)]


def token_pieces(
    docs: DataFrame,
    path: str,
    pattern: str,
    size: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each document's ids, then end_id, in pieces of at most size; of a longer document the first may be shorter."""
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(JsonTokenizer, path, pattern)
        for batch in small(batches):
            names, at = batch.column(0).to_pylist(), 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                ids, pieces, starts, lengths, crcs, data = [], [], [], [], [], []
                for doc_id, own in zip(names[at : at + len(texts)], model.encode(texts), strict=True):
                    own += last
                    n, start, piece = len(own) // 4, 0, 0
                    stop = n % size or size
                    while start < n:
                        part = own[4 * start : 4 * stop]
                        ids.append(doc_id)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(stop - start)
                        crcs.append(zlib.crc32(part))
                        if with_ids:
                            data.append(np.frombuffer(part, "<u4").astype("i4"))
                        start, stop, piece = stop, stop + size, piece + 1
                at += len(texts)
                columns = [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]
                keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(data, pa.list_(pa.int32())))
                    keys.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=keys)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


#: Slacks that are tried.
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64)


def fullest(counts: dict[int, int], size: int, slack: int = 0) -> dict[int, int]:
    """The combination with the largest sum up to size that holds the largest length: {length: times}. The first sum
    that leaves no more than slack is enough."""
    lengths = sorted(counts, reverse=True)
    top, mask = lengths[0], (1 << (size + 1)) - 1
    sums, steps = 1 << top, []
    for length in lengths:
        for _ in range(min(counts[length] - (length == top), (size - top) // length)):
            if sums >> max(0, size - slack):
                break
            more = sums | (sums << length) & mask
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
    total, used = sums.bit_length() - 1, {top: 1}
    for length, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


def combinations(counts: dict[int, int], size: int, slack: int) -> tuple[int, list[tuple[dict[int, int], int]]]:
    """The bins needed for counts, and the combinations with how often each is removed."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        used = fullest(left, size, slack)
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        out.append((used, times))
    return sum(times for _, times in out), out


def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each length go: sorted (length, first number) keys, and for each the first sequence, the
    pieces of that length in a sequence, and the offset of the first of them."""
    least, best = -(-sum(length * n for length, n in counts.items()) // size), None
    for slack in SLACKS:
        found = combinations(counts, size, slack)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] == least:
            break
    taken, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for used, times in best[1]:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], sequence, n, offset))
            offset += length * n
            taken[length] += n * times
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (table[:, 0] << 40) + table[:, 1], table[:, 1:]


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces (with doc_id, piece and length, 1 to size) and sequence_id and offset for each."""
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    if any(not 1 <= k <= size for k in counts):
        raise ValueError(f"a piece must have 1 to {size} tokens")
    keys, places = plan(counts, size)
    names = pieces.columns
    many = F.array(*[F.lit(-(-counts.get(k, 1) // RUN_PIECES)) for k in range(size + 1)])
    runs = pieces.withColumn("run", F.pmod(F.xxhash64("doc_id", "piece"), F.get(many, F.col("length").cast("int"))).cast("int"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        runs.groupBy("length", "run")
        .count()
        .select("length", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "run").orderBy("doc_id", "piece")
    numbered = (
        runs.withColumn("at", F.row_number().over(inside) - 1)
        .join(F.broadcast(firsts), ["length", "run"])  # size rows, and one for each RUN_PIECES pieces
        .select(*names, (F.col("first") + F.col("at")).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            row = places[np.searchsorted(keys, (length << 40) + number, side="right") - 1]
            bin_no, slot = np.divmod(number - row[:, 0], row[:, 2])
            columns = [batch.column(c) for c in names]
            columns += [pa.array(row[:, 1] + bin_no), pa.array(row[:, 3] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, path, pattern, size, end_id)), size)
