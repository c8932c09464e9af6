"""Signatures: their compilation, and the lines of texts that match them.

A text's matching lines count only if one of its 4-, 5- or 6-grams passes the filter. The join on lines runs first, as
few texts have a matching line; only those texts are probed. Where the signatures come from this library's compiler, a
matching line of four words or more has its own n-grams in the filter, so that these texts need no probe; and while the
signatures have few shorter lines, the texts with one of these are found, and probed, as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from veldtext.functions.text import multi_ngrams, normal_form, normal_lines, normalize, salted, words
from veldtext.operators.bloom import Bloom, filled, sizing
from veldtext.sources.signatures import Signatures

#: Line hashes up to which their table is broadcast; it takes some 100 bytes for each.
MOST_BROADCAST = 500_000
#: Short lines up to which texts with one of them are found row by row, by a list of constants.
MOST_SHORT = 256


def clean_patterns(rows: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that are neither empty nor comments, as a column pattern."""
    trimmed = F.regexp_replace(F.col(column), r"(?U)\A\s+|\s+\z", "")
    return rows.select(trimmed.alias("pattern")).where("pattern <> '' and not startswith(pattern, '#')")


def pattern_hashes(patterns: DataFrame, salt: bytes) -> DataFrame:
    """(kind, hash): each pattern's line hash, and the hashes of its n-grams."""
    rows = patterns.select(normalize(F.col("pattern")).alias("norm"))
    whole = F.array(F.struct(F.lit("line").alias("kind"), F.col("norm").alias("text")))
    grams = F.transform(multi_ngrams(words(F.col("norm"))), lambda g: F.struct(F.lit("gram").alias("kind"), g.alias("text")))
    rows = rows.select(F.explode(F.concat(whole, grams)).alias("x")).select("x.kind", "x.text")
    return rows.select("kind", salted(F.col("text"), salt).alias("hash"))


def compile_signatures(patterns: DataFrame, salt: bytes, rate: float = 0.001) -> Signatures:
    """Signatures of a DataFrame with a column pattern. Their line hashes stay a DataFrame until a file needs them."""
    norms = patterns.select(normalize(F.col("pattern")).alias("norm"))
    short = F.size(words(F.col("norm"))) < 4
    few = norms.where(short).select(salted(F.col("norm"), salt).alias("hash")).distinct().limit(MOST_SHORT + 1).collect()
    n = patterns.count()
    if not n:
        raise ValueError("there are no patterns")
    hashes = pattern_hashes(patterns, salt)
    bloom = filled(hashes.select("hash"), *sizing(10 * n, rate))
    known = tuple(sorted(bytes(r.hash) for r in few)) if len(few) <= MOST_SHORT else None
    return Signatures(salt, bloom, None, ours=True, rows=hashes.where("kind = 'line'").select("hash"), n_hashes=n, short=known)


def signature_table(spark: SparkSession, found: Signatures) -> DataFrame:
    """The distinct line hashes, broadcast if they are few; beyond that Spark chooses the join."""
    rows = found.rows
    if rows is None:
        rows = spark.createDataFrame([(bytearray(h),) for h in found.hashes], "hash binary")
    rows = rows.select(F.col("hash").alias("line_hash")).distinct()
    return F.broadcast(rows) if found.count <= MOST_BROADCAST else rows


def line_entries(text: Column, salt: bytes) -> Column:
    """line_no (from 1), n_words and line_hash of each line that is not empty in normal form, as an array."""
    each = F.transform(normal_lines(text), lambda norm, at: F.struct((at + 1).alias("line_no"), norm.alias("norm")))
    kept = F.filter(each, lambda x: x["norm"] != "")
    return F.transform(
        kept, lambda x: F.struct(x["line_no"], F.size(words(x["norm"])).alias("n_words"), salted(x["norm"], salt).alias("line_hash"))
    )


def line_hashes(rows: DataFrame, salt: bytes, *key: str, text: str = "content") -> DataFrame:
    """key columns, line_no (from 1), n_words and line_hash of each line that is not empty in normal form."""
    return rows.select(*key, F.inline(line_entries(F.col(text), salt)))


def matching_lines(rows: DataFrame, found: Signatures, *key: str, text: str = "content") -> DataFrame:
    return line_hashes(rows, found.salt, *key, text=text).join(signature_table(rows.sparkSession, found), "line_hash", "left_semi")


def opens_gate(content: str, salt: bytes, bloom: Bloom) -> bool:
    """Whether an n-gram of the text passes the filter."""
    tokens = normal_form(content).split()
    for n in (4, 5, 6):
        for at in range(0, len(tokens) - n + 1, 512):
            stop = min(at + 512, len(tokens) - n + 1)
            digests = [hashlib.sha256(salt + " ".join(tokens[i : i + n]).encode()).digest() for i in range(at, stop)]
            if digests and bloom.test(digests).any():
                return True
    return False


def gated(rows: DataFrame, found: Signatures, *key: str, text: str = "content") -> DataFrame:
    """key columns and bloom_hit of each row. Only the salt and the filter's bits are sent to the tasks."""
    shipped = rows.sparkSession.sparkContext.broadcast((found.salt, found.bloom))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [t is not None and opens_gate(t, *shipped.value) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.bool_())], names=[*key, "bloom_hit"])

    own = rows.select(*key, text)
    return own.mapInArrow(run, own.select(*key).schema.add("bloom_hit", "boolean"))


def with_entries(rows: DataFrame, found: Signatures, text: str = "content") -> DataFrame:
    """rows with entries, as :func:`line_entries` gives them, and probed: whether the text has a short line of the
    signatures and opens the gate; null where that is not decided here."""
    entries = F.coalesce(line_entries(F.col(text), found.salt), F.array().cast("array<struct<line_no:int,n_words:int,line_hash:binary>>"))
    # The entries depend on a number that changes nothing, so that later filters are not computed from a copy of them.
    rows = rows.withColumn("entries", F.when(F.monotonically_increasing_id() >= 0, entries))
    if not found.ours or found.short is None:
        return rows.withColumn("probed", F.lit(None).cast("boolean"))
    if not found.short:
        return rows.withColumn("probed", F.lit(False))
    shipped = rows.sparkSession.sparkContext.broadcast((found.salt, found.bloom))

    @F.pandas_udf(BooleanType())
    def probe(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: opens_gate(t, *shipped.value), na_action="ignore")

    known = [F.lit(bytearray(h)) for h in found.short]
    suspected = F.exists("entries", lambda e: (e["n_words"] < 4) & e["line_hash"].isin(known))
    return rows.withColumn("probed", F.coalesce(probe(F.when(suspected, F.col(text))), F.lit(False)))


def gate_open(hits: DataFrame, rows: DataFrame, found: Signatures, *key: str, text: str = "content") -> DataFrame:
    """hits (key columns, longest: words of the longest matching line or null, probed, ...) with open in place of probed:
    whether the matches count.

    rows are read again only where :func:`with_entries` could not probe, and then only those whose matches need it.
    """
    sure = F.col("longest") >= 4 if found.ours else F.lit(False)
    if not found.ours or found.short is None:
        unsure = hits.where(F.col("longest").isNotNull() & ~sure).select(*key).distinct()
        opened = gated(rows.join(unsure, [*key], "left_semi"), found, *key, text=text).where("bloom_hit").select(*key).distinct()
        hits = hits.drop("probed").join(opened.withColumn("probed", F.lit(True)), [*key], "left")
    return hits.withColumn("open", F.col("longest").isNotNull() & (sure | F.coalesce("probed", F.lit(False)))).drop("probed")


def hash_matches(rows: DataFrame, found: Signatures, *key: str, text: str = "content") -> DataFrame:
    """key columns, hash_matches and first_line of the texts whose gate is open; a line counts every time it occurs."""
    each = with_entries(rows, found, text).select(*key, "probed", F.inline("entries"))
    hits = each.join(signature_table(rows.sparkSession, found), "line_hash", "left_semi").groupBy(*key).agg(
        F.count_distinct("line_no").alias("hash_matches"), F.min("line_no").alias("first_line"), F.max("n_words").alias("longest"), F.bool_or("probed").alias("probed")
    )
    return gate_open(hits, rows, found, *key, text=text).where("open").drop("open", "longest")
