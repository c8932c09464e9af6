"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: a space and the control characters 9 to 13.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in spark.checkpoint.dir. Only where that is unset and the master is local
    (tests on one machine) a temporary folder is set in its place; a cluster without one is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="veldtext-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: What is written inside each :func:`scratch` that is open, the innermost last.
_open: list[dict[str, DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and keeps what several later steps read from being computed
    again. The files stay until the :func:`scratch` around them ends, or else until the cluster clears the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldtext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1][path] = out
    return out


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that marks a table as needed later; all other tables written inside are deleted at the end."""
    written: dict[str, DataFrame] = {}
    _open.append(written)

    def keep(df: DataFrame) -> DataFrame:
        for path in [p for p, own in written.items() if own is df]:
            del written[path]
            if len(_open) > 1:
                _open[-2][path] = df
        return df

    try:
        yield keep
    finally:
        _open.pop()
        for path, df in written.items():
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so once the driver's garbage collector finds them unused, which by itself may be long after the disks of
    the executors are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give back to the system what is free, as idle workers keep their memory."""
    libc = ctypes.CDLL(None)
    pa.default_memory_pool().release_unused()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """batches, with :func:`trim` after each."""
    for batch in batches:
        yield batch
        trim()


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that what is made of texts is not made of thousands of them at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def squeezed(text: Column) -> Column:
    """text without any white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
