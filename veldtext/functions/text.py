"""Text primitives as Column expressions: normal form, hashes, n-grams, lines, sentences, imperative starts.

Texts of ASCII and precomposed Latin-1 letters stay in the JVM: for these the compatibility form changes nothing and
lower case is the same everywhere. Only other texts go through an Arrow function, which sees null for all the rest.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space of the reference's regular expressions.
W = r"[\t\n\f\r ]"
_PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Words that do not start an imperative sentence.
STOP_WORDS = (
    "the a an this that these those i you he she it we they my your his her its our their and or but if when while "
    "because since although however moreover furthermore in on at to for with from by of about there here where what "
    "which who how why not no any some all each every both either neither many much few most several such only also "
    "then so as"
).split()
#: Endings of nouns.
NOUN_ENDINGS = ("tion", "ment", "ness", "ity", "ence", "ance")


def simple_lower(text: str) -> str:
    """Lower case letter by letter: no final sigma, and a dotted capital I gives a plain i."""
    return text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def normal_form(text: str) -> str:
    """Compatibility form, lower case, and only letters and numbers, in words parted by one space."""
    return " ".join(_WORD.findall(simple_lower(unicodedata.normalize("NFKC", text))))


@F.pandas_udf(StringType())
def _normal_form(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _normal_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [normal_form(line) for line in t.split("\n")], na_action="ignore")


def _plainly(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN), _plainly(text)).otherwise(_normal_form(F.when(~text.rlike(_PLAIN), text)))


def normal_lines(text: Column) -> Column:
    """The normal form of each line, as an array."""
    plain = F.transform(lines(text), _plainly)
    return F.when(text.rlike(_PLAIN), plain).otherwise(_normal_lines(F.when(~text.rlike(_PLAIN), text)))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def salted(normalized: Column, salt: bytes) -> Column:
    """SHA-256 over the salt and a text that is in normal form already."""
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(salt)), normalized.cast("binary")), 256))


def words(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, in order; none if there are fewer words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def multi_ngrams(tokens: Column) -> Column:
    """4-grams, then 5-grams, then 6-grams."""
    return F.concat(*[ngrams(tokens, n) for n in (4, 5, 6)])


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    parts = F.split(text, rf"[.!?]+{W}+|\n+", -1)
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", ""))
    return F.filter(trimmed, lambda s: s != "")


def imperative(sentence: Column) -> Column:
    """Whether a trimmed sentence starts like an order."""
    first = F.lower(F.replace(F.regexp_extract(sentence, r"(?U)\A(\S+)", 1), F.lit("\u0130"), F.lit("i")))
    noun = F.lit(False)
    for ending in NOUN_ENDINGS:
        noun = noun | (first.endswith(ending) & (F.octet_length(first) > len(ending) + 2))
    letter = first.rlike(r"\A[a-z]") | first.rlike(r"\A[^\x{0}-\x{7f}\x{5c0}-\x{5ff}]")
    return sentence.rlike(r"(?U)\s") & ~first.isin(STOP_WORDS) & ~noun & letter


def imperative_flags(text: Column) -> Column:
    return F.transform(sentences(text), imperative)
