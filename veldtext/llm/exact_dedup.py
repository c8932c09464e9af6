"""Exact dedup: texts grouped by a 128-bit content hash, with the bytes compared inside each group.

The grouping key is the pair (hash, normalised text). The hash spreads and orders the groups; the text beside it
makes the aggregate compare the bytes of all rows of a group, so two texts that collide in the hash never merge.
Copies are folded on the map side before anything is shuffled: a group that holds a third of all rows leaves each
task as one row.

Defined results: a null text counts as empty, and empty texts form one group; of equal code-point counts the smaller
id stays; a null id counts as the largest one; repeated rows (same id, same text) belong to one group, and
:func:`survivors` keeps one of them; an empty table gives an empty result; other columns never matter to
:func:`exact_groups` and pass :func:`survivors` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import empty_if_null, squeezed

_MAX_ID = 2**63 - 1


def _rank(n_points: Column, doc_id: Column) -> Column:
    """One decimal that is larger for more code points, then for a smaller id: it fits a fixed-width buffer."""
    low = F.lit(_MAX_ID).cast("decimal(20,0)") - F.coalesce(doc_id, F.lit(_MAX_ID)).cast("decimal(20,0)")
    return n_points.cast("decimal(10,0)") * F.expr("cast(100000000000000000000 as decimal(21,0))") + low


def _id_of(rank: Column) -> Column:
    low = rank % F.expr("cast(100000000000000000000 as decimal(21,0))")
    out = (F.lit(_MAX_ID).cast("decimal(20,0)") - low).cast("long")
    return F.when(out != F.lit(_MAX_ID), out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(empty_if_null(F.col(text_col))).alias("n_points"),
        squeezed(F.col(text_col)).alias("norm"),
    )
    return rows.select("doc_id", "n_points", "norm", F.unhex(F.md5("norm")).alias("h128"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _keyed(docs, id_col, text_col)
    groups = (
        rows.groupBy("h128", "norm")
        .agg(F.max(_rank(F.col("n_points"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", F.sha2("norm", 256).alias("text_sha256"), _id_of(F.col("best")).alias("keep_id"), "group_size")
    )
    own = rows.select("doc_id", "h128", F.sha2("norm", 256).alias("text_sha256"))
    # Both sides of this join come from exchanges of their own, so that a hot hash is split at run time.
    return own.join(groups, ["h128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    picked = docs.select(
        whole.alias("row"),
        squeezed(F.col(text_col)).alias("norm"),
        _rank(F.length(empty_if_null(F.col(text_col))), F.col(id_col).cast("long")).alias("best"),
    ).select("row", "norm", "best", F.unhex(F.md5("norm")).alias("h128"), F.xxhash64("row").alias("tie"))
    one = picked.groupBy("h128", "norm").agg(F.max_by("row", F.struct("best", "tie")).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
