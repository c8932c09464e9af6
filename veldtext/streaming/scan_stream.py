"""Scans of streams: the scan is stateless for each text, so that each micro-batch is scanned as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from veldtext.config import ScanConfig
from veldtext.operators.scan import scan
from veldtext.sources.signatures import Signatures


def scan_stream(rows: DataFrame, target: str, checkpoint: str, signatures: Signatures | None = None, config: ScanConfig = ScanConfig()) -> StreamingQuery:
    """Append the results of a stream of (path, text) to a Parquet folder; a batch that is repeated replaces its own.

    Each batch writes to a folder of its own number, so that a restart after a failure gives no result twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        scan(batch, signatures, config).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
