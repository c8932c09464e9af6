"""Files to scan, as rows (path, text): listed on the driver, read by the executors.

Spark's own file readers drop names that begin with a dot or an underscore and cannot prune folders, so that folders
come through a Python data source. The folder must be one that all executors see. For a store that only Spark reads,
:func:`stored_files` uses Spark's binary reader, without the files that it drops.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from veldtext.config import EXTENSIONS, ScanConfig

SCHEMA = "path string, length bigint, text string"
FILES_PER_PARTITION = 256
BYTES_PER_PARTITION = 64 * 1024 * 1024


def extension(name: str) -> str:
    """From the last dot of the base name on, so that a file called .env has one."""
    dot = os.path.basename(name).rfind(".")
    return os.path.basename(name)[dot:].lower() if dot >= 0 else ""


def listed(path: str, config: ScanConfig = ScanConfig()) -> list[tuple[str, int]]:
    """(path, bytes) of the files to scan, folder by folder in the order of names.

    A path that does not exist raises. A file named itself is kept whatever its size if its extension is known.
    Hidden folders are left out, hidden files are not; what cannot be examined is skipped.
    """
    info = os.lstat(path) if os.path.islink(path) else os.stat(path)
    if not os.path.isdir(path) or os.path.islink(path):
        return [(path, info.st_size)] if extension(path) in EXTENSIONS else []
    out: list[tuple[str, int]] = []

    def walk(folder: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError:
            return
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    if config.recursive and not entry.name.startswith("."):
                        walk(entry.path)
                elif extension(entry.name) in EXTENSIONS:
                    size = entry.stat(follow_symlinks=False).st_size
                    if size <= config.max_file_size:
                        out.append((entry.path, size))
            except OSError:
                continue

    walk(path)
    return out


def decoded(data: bytes) -> str:
    """UTF-8, each byte that is none as one U+FFFD."""
    text = data.decode("utf-8", "surrogateescape")
    return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text) if not text.isascii() else text


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        default = ScanConfig()
        size = int(options.get("maxfilesize", default.max_file_size))
        self.config = ScanConfig(recursive=str(options.get("recursive", "true")).lower() == "true", max_file_size=size)

    def partitions(self) -> list[InputPartition]:
        out, run, size = [], [], 0
        for file in listed(self.path, self.config):
            if run and (len(run) >= FILES_PER_PARTITION or size + file[1] > BYTES_PER_PARTITION):
                out.append(_Files(run))
                run, size = [], 0
            run.append(file)
            size += file[1]
        return [*out, _Files(run)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        """A file that cannot be read has a null text and still counts."""
        for path, size in partition.files:
            try:
                with open(path, "rb") as file:
                    yield path, size, decoded(file.read())
            except OSError:
                yield path, size, None


class TextFiles(DataSource):
    """format("textfiles") with options path, recursive and maxFileSize."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def text_files(spark: SparkSession, path: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    os.stat(path)
    spark.dataSource.register(TextFiles)
    options = {"path": path, "recursive": str(config.recursive).lower(), "maxFileSize": str(config.max_file_size)}
    return spark.read.format("textfiles").options(**options).load()


def stored_files(spark: SparkSession, path: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Files of any store that Spark reads, by the rules of :func:`listed`, listed and read by Spark.

    Spark's reader sees neither names that begin with a dot or an underscore nor empty files. A store has no unreadable
    entries to skip: a read that fails fails the query.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(config.recursive).lower()).load(path)
    known = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1)).isin(*EXTENSIONS)
    rows = rows.where((F.col("length") <= config.max_file_size) & known)
    return rows.select("path", "length", _decoded("content").alias("text"))


@F.pandas_udf(StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    return contents.map(decoded, na_action="ignore")


#: Bytes up to which a table is dealt out anew.
MOST_SPREAD = 1 << 30


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where the table is small.

    A file of one row group is read by one task, however many cores there are. A table of more bytes than MOST_SPREAD, by
    the optimizer's estimate, has row groups enough and stays as it is.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= MOST_SPREAD else rows


#: Bytes of a line of a pattern list.
MOST_LINE = 64 * 1024


def pattern_file(spark: SparkSession, path: str) -> DataFrame:
    """A pattern list: one pattern a line, comments and empty lines left out. A line of MOST_LINE bytes or more is an
    error when the rows are read."""
    from veldtext.operators.match import clean_patterns

    lines = spark.read.option("lineSep", "\n").text(path)
    long = F.octet_length("value") >= MOST_LINE
    checked = F.when(long, F.raise_error(F.lit(f"a pattern has {MOST_LINE} bytes or more"))).otherwise(F.col("value"))
    return clean_patterns(lines.select(checked.alias("value")))
