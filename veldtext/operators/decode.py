"""Layers of decoding: zero-width characters, unicode escapes, HTML entities, base64.

The first layer and the score are expressions. The others replace by a rule and go through one Arrow function, which
sees null for every text without anything to decode.
"""

from __future__ import annotations

import base64
import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

#: Zero-width characters, escapes, entities and base64.
ZERO_WIDTH = "[\\u200B\\u200C\\u200D\\uFEFF]"
_SUSPICIOUS = r"\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|&|[A-Za-z0-9+/]{20}"
_SHORT, _LONG = re.compile(r"\\u([0-9a-fA-F]{4})"), re.compile(r"\\U([0-9a-fA-F]{8})")
_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|&[a-zA-Z0-9]+;?")
_BLOB = re.compile(r"(?:\A|[\t\n\f\r =])([A-Za-z0-9+/]{20,}={0,2})(?:[\t\n\f\r ]|\Z)")
DECODED = (
    StructType()
    .add("content", StringType())
    .add("has_unicode_escapes", BooleanType())
    .add("has_html_entities", BooleanType())
    .add("has_base64", BooleanType())
    .add("base64_decoded", ArrayType(StringType()))
)


def _scalar(code: int) -> bool:
    return code < 0xD800 or 0xDFFF < code <= 0x10FFFF


def expand_escapes(text: str) -> str:
    """Escapes of scalar values; surrogates stay as they are."""

    def one(m: re.Match) -> str:
        code = int(m[1], 16)
        return chr(code) if _scalar(code) else m[0]

    return _LONG.sub(one, _SHORT.sub(one, text))


def unescape(text: str) -> str:
    """HTML entities. A number that is no scalar value gives U+FFFD, one of 128 to 159 its Windows character."""

    def one(m: re.Match) -> str:
        if not (m[1] or m[2]):
            return html.unescape(m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        if 0x80 <= code <= 0x9F:
            return bytes([code]).decode("cp1252", "replace").replace("\ufffd", chr(code))
        return chr(code) if code and _scalar(code) else "\ufffd"

    return _NUMBER.sub(one, text) if "&" in text else text


def printable(data: bytes) -> bool:
    """Whether four fifths of the characters at least are printable; an invalid byte counts as one that is not."""
    chars = data.decode("utf-8", "surrogateescape")
    good = sum((c >= " " or c in "\n\r\t") and c != "\ufffd" and not "\udc80" <= c <= "\udcff" for c in chars)
    return bool(chars) and good / len(chars) >= 0.8


def expand_blobs(text: str) -> tuple[str, list[str]]:
    """Each printable base64 run keeps its place and gets what it says behind it; that in reverse order, too.

    The space that ends a run is used up, so a run right after it is not found.
    """
    out, decoded, at = [], [], 0
    for m in _BLOB.finditer(text):
        bare = m[1].rstrip("=")
        if len(bare) % 4 == 1:
            continue
        data = base64.b64decode(bare + "=" * (-len(bare) % 4))
        if printable(data):
            said = data.decode("utf-8", "replace")
            out += [text[at : m.end(1)], f" [decoded:{said}]"]
            decoded.append(said)
            at = m.end(1)
    return "".join([*out, text[at:]]), decoded[::-1]


def layers(text: str, is_html: bool) -> tuple:
    escapes = expand_escapes(text)
    entities = escapes if is_html else unescape(escapes)
    content, decoded = expand_blobs(entities)
    return content, escapes != text, entities != escapes, bool(decoded), decoded


@F.pandas_udf(DECODED)
def _layers(texts: pd.Series, is_html: pd.Series) -> pd.DataFrame:
    rows = [(None, False, False, False, []) if t is None else layers(t, bool(h)) for t, h in zip(texts, is_html, strict=True)]
    return pd.DataFrame(rows, columns=DECODED.names)


def is_html(path: Column) -> Column:
    return F.lower(path).rlike(r"\.html?\z")


def zero_width_removed(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def obfuscation(base64_: Column, escapes: Column, zero_width: Column, entities: Column) -> Column:
    """0.3 base64, 0.2 escapes, 0.3 zero-width characters, 0.2 entities."""
    parts = [F.when(c, F.lit(w)).otherwise(0.0) for c, w in ((base64_, 0.3), (escapes, 0.2), (zero_width, 0.3), (entities, 0.2))]
    return sum(parts[1:], parts[0])


def decode(rows: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """rows with content, the four flags, base64_decoded and obfuscation_score."""
    bare = zero_width_removed(F.col(text))
    layered = _layers(F.when(bare.rlike(_SUSPICIOUS), bare), is_html(F.col(path)))
    out = rows.withColumn("layers", layered)
    flags = ("has_base64", "has_unicode_escapes", "has_html_entities")
    return (
        out.withColumn("content", F.coalesce("layers.content", bare))
        .withColumn("has_zero_width", F.coalesce(F.col(text).rlike(ZERO_WIDTH), F.lit(False)))
        .withColumns({f: F.coalesce(F.col(f"layers.{f}"), F.lit(False)) for f in flags})
        .withColumn("base64_decoded", F.coalesce("layers.base64_decoded", F.array().cast("array<string>")))
        .withColumn("obfuscation_score", obfuscation(*[F.col(c) for c in ("has_base64", "has_unicode_escapes", "has_zero_width", "has_html_entities")]))
        .drop("layers")
    )
