"""Byte-level BPE on sentencepiece.

A file of ranks becomes a sentencepiece BPE model, written directly in its serial form: each token's bytes are mapped
to one character each, its score is its negative rank, and the normaliser changes nothing. A BPE model merges the
adjacent pair whose union has the highest score, leftmost first, which is the merge of lowest rank. Pre-tokens are
encoded one by one; decoding looks each id's piece up and maps its characters back to bytes.

Defined results: a null or empty text has no tokens; the bytes after decoding equal the text's UTF-8 bytes; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import small
from veldtext.llm.pretokens import ChunkIds, held, sliced

#: Byte b is the character 256 + b: a letter, never a space or a control character.
_TO_CHARS = {b: 256 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"{path}: the ranks have gaps")
    return tokens


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - 256 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serial form of a sentencepiece model whose ids are the ranks; the unknown piece comes after the last.

    Field numbers are those of sentencepiece's public model format: pieces 1 (piece 1, score 2, type 3),
    trainer 2 (model type 3, size 4, ids 40 to 43), normaliser 3 (name 1, prefix 3, spaces 4 and 5).
    """
    out = bytearray()
    for rank, token in enumerate(tokens):
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _block(1, _block(1, to_chars(token).encode()) + score)
    unknown = len(tokens)
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _number(3, 2) + _number(4, unknown + 1) + _number(40, unknown)
    out += _block(2, trainer + _number(41, none) + _number(42, none) + _number(43, none))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder for one file of ranks and one pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(read_ranks(path)))
        self.pieces = [to_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.memo = ChunkIds(self._encode_chunks, pattern)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.memo.pattern.findall(c) for c in chunks]
        flat = [to_chars(t.encode()) for ts in split for t in ts]
        ids = iter(self.model.encode(flat, out_type=int, num_threads=1))
        return [array("I", itertools.chain.from_iterable(next(ids) for _ in ts)).tobytes() for ts in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.memo.ids(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded."""
    extra = ", ids array<int>, decoded binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(ByteBpe, path, pattern)
        for batch in small(batches):
            at = 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                n, shas, back, all_ids, decoded = [], [], [], [], []
                for ids in bpe.encode(texts):
                    data = bpe.decode(ids)
                    n.append(len(ids))
                    shas.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        decoded.append(data)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(shas), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
