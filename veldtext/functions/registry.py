"""The library's functions by name: Column and DataFrame functions for Python, scalar ones for SQL.

decode, analyze and scan take DataFrames (see their modules); normalize, salted_hash, ngrams and findings take Columns.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from veldtext.functions import text as T
from veldtext.functions.text import normal_form, normalize
from veldtext.operators.decode import decode, layers
from veldtext.operators.heuristics import analyzed as analyze
from veldtext.operators.heuristics import findings
from veldtext.operators.scan import scan

__all__ = ["analyze", "decode", "findings", "ngrams", "normalize", "register", "salted_hash", "scan"]


def salted_hash(text: Column, salt: bytes) -> Column:
    """SHA-256 over the salt and the text's normal form."""
    return T.salted(normalize(text), salt)


def ngrams(text: Column, n: int) -> Column:
    """The n-grams of the words of the text's normal form."""
    # The words are bound to a variable, as no Python function may stand inside a lambda.
    return F.get(F.transform(F.array(T.words(normalize(text))), lambda words: T.ngrams(words, n)), F.lit(0))


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form, na_action="ignore")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    strip = {0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None}
    return texts.map(lambda t: layers(t.translate(strip), False)[0], na_action="ignore")


@F.pandas_udf(BinaryType())
def _salted(texts: pd.Series, salts: pd.Series) -> pd.Series:
    pairs = zip(texts, salts, strict=True)
    return pd.Series([None if t is None or s is None else hashlib.sha256(bytes(s) + normal_form(t).encode()).digest() for t, s in pairs], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _grams(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    def one(text: str | None, n: int) -> list[str] | None:
        if text is None:
            return None
        words = normal_form(text).split()
        return [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]

    return pd.Series([one(t, int(n)) for t, n in zip(texts, sizes, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """normalize_text(text), decode_text(text), salted_hash(text, salt) and ngrams(text, n) for SQL."""
    for name, function in (("normalize_text", _normalized), ("decode_text", _decoded), ("salted_hash", _salted), ("ngrams", _grams)):
        spark.udf.register(name, function)
