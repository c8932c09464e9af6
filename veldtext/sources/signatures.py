"""The binary signature container: read, write, verify.

Big-endian: magic, version (16 bits), salt (16 bytes), size of the filter in bits, number of its hash functions and
offset of the seal (32 bits each); then the filter's bytes, the sorted 32-byte line hashes, and the seal, an
HMAC-SHA-256 over all before it.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import os
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from veldtext.operators.bloom import Bloom

MAGIC = b"PSIG"
HEADER = struct.Struct(">4sH16sIII")
HASH_BYTES = 32
#: The key that seals and checks where no other is given. Files sealed by another tool's built-in key need that key.
DEFAULT_KEY = b"veldtext default seal 1"
KEY_VARIABLE = "VELDTEXT_HMAC_KEY"
#: Where a scan looks for signatures if it is given none.
DEFAULT_PATHS = ("signatures/default.pgsig", "/usr/local/share/veldtext/default.pgsig")


class SignatureError(ValueError):
    """A container that cannot be read or trusted."""


@dataclass(frozen=True)
class Signatures:
    """The line hashes are a tuple, table, or the column hash of a DataFrame, rows, with n_hashes rows.

    ours: made by this library's compiler, so that the n-grams of a known line are in the filter if it has any; short:
    the hashes of the lines of fewer than four words, which have none, or None if they are not known or too many.
    """

    salt: bytes
    bloom: Bloom
    table: tuple[bytes, ...] | None
    version: int = 1
    ours: bool = False
    rows: DataFrame | None = field(default=None, compare=False)
    n_hashes: int = 0
    short: tuple[bytes, ...] | None = None

    @functools.cached_property
    def hashes(self) -> tuple[bytes, ...]:
        """All line hashes, sorted and with repeats, on the driver."""
        return self.table if self.table is not None else tuple(sorted(bytes(r.hash) for r in self.rows.collect()))

    @property
    def count(self) -> int:
        return len(self.table) if self.table is not None else self.n_hashes

    def __contains__(self, line_hash: bytes) -> bool:
        return line_hash in self.hashes


def salt_of(text: str | None = None) -> bytes:
    """16 random bytes, or those of a text, cut off or filled with zeros."""
    return os.urandom(16) if text is None else text.encode()[:16].ljust(16, b"\0")


def key_for_scan(flag: str | None = None) -> bytes:
    """The flag, else the environment, else the default."""
    chosen = flag or os.environ.get(KEY_VARIABLE)
    return chosen.encode() if chosen else DEFAULT_KEY


def to_bytes(found: Signatures, key: bytes = DEFAULT_KEY) -> bytes:
    if any(len(h) != HASH_BYTES for h in found.hashes):
        raise SignatureError(f"a hash entry must have {HASH_BYTES} bytes")
    bits = found.bloom.data.ljust((found.bloom.size + 7) // 8, b"\0")
    table = b"".join(sorted(found.hashes))
    # The offset counts the filter's nominal bytes, even where the data are longer.
    offset = HEADER.size + (found.bloom.size + 7) // 8 + len(table)
    body = HEADER.pack(MAGIC, found.version, found.salt, found.bloom.size, found.bloom.hashes, offset) + bits + table
    return body + hmac.digest(key, body, hashlib.sha256)


def from_bytes(data: bytes) -> Signatures:
    """Without a look at the seal or the version."""
    if data[:4] != MAGIC:
        raise SignatureError("bad magic")
    if len(data) < HEADER.size:
        raise SignatureError("the header is cut off")
    _, version, salt, size, hashes, offset = HEADER.unpack_from(data)
    start = HEADER.size + (size + 7) // 8
    if offset < start:
        raise SignatureError("the seal's offset lies inside the filter")
    if (offset - start) % HASH_BYTES:
        raise SignatureError(f"the table is no multiple of {HASH_BYTES} bytes")
    if len(data) < offset:
        raise SignatureError("the table is cut off")
    table = tuple(data[i : i + HASH_BYTES] for i in range(start, offset, HASH_BYTES))
    return Signatures(salt, Bloom(size, hashes, data[HEADER.size : start]), table, version)


def verify(data: bytes, key: bytes = DEFAULT_KEY) -> None:
    """Raise unless the seal is the key's."""
    if len(data) < HEADER.size + 32:
        raise SignatureError("too small for a signature file")
    if data[:4] != MAGIC:
        raise SignatureError("bad magic")
    offset = HEADER.unpack_from(data)[5]
    if offset + 32 != len(data):
        raise SignatureError(f"the seal is at {offset}, but the file has {len(data)} bytes")
    if not hmac.compare_digest(hmac.digest(key, data[:offset], hashlib.sha256), data[offset:]):
        raise SignatureError("the seal does not fit: damaged, or sealed with another key")


def write(path: str, found: Signatures, key: bytes = DEFAULT_KEY) -> None:
    with open(path, "wb") as file:
        file.write(to_bytes(found, key))


def read(path: str, key: bytes | None = None) -> Signatures:
    """The signatures of a file, verified first if a key is given."""
    with open(path, "rb") as file:
        data = file.read()
    if key is not None:
        verify(data, key)
    return from_bytes(data)
