"""Continuous ingestion of text lines into a database.

Each micro-batch is one transaction. The manifest remembers the last batch of a
stream, so a batch that is run again after a failure is committed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import parse_lines
from ..operators.merge import latest_wins
from ..sources.store import Database


def line_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of files as they appear in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder, lineSep="\n")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines that a socket sends, as a stream. The source cannot be read again after a failure, so lines may be lost then."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def ingest(db: Database, lines: DataFrame, name: str, checkpoint: str, fmt: str | None = None, time_format: str | None = None, **trigger) -> StreamingQuery:
    """Start committing a stream's lines; ``trigger`` is as for ``writeStream.trigger``."""

    def commit(batch: DataFrame, number: int) -> None:
        db.add(parse_lines(batch, fmt, time_format), batch=(name, number))

    writer = lines.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest_of_stream(records: DataFrame, order: str = "txid") -> DataFrame:
    """Last wins within a batch of rows that carry an order; across batches the store's merge decides."""
    return latest_wins(records, order=order)
