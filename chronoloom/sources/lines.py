"""Text in and out of a database."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_lines, render_lines, renderer
from ..operators.keys import partition_by_key, pipe, whole_keys
from .store import COLUMNS, Database, Snapshot, check_order


def lines_of(spark: SparkSession, source: str | Iterable[str]) -> DataFrame:
    """Lines of a file or folder, or a few given ones, in column ``value``. Only a line feed ends a line."""
    if isinstance(source, str):
        return spark.read.text(source, lineSep="\n")
    return spark.createDataFrame([(x,) for x in source], "value string")


@contextlib.contextmanager
def spooled(db: Database, chunks: Iterable[bytes]) -> Iterator[DataFrame]:
    """Lines of bytes that come in chunks (a request's body, standard input), by way of a file beside the database's own.

    Neither the driver nor one task holds them as a whole; the file goes in the end.
    """
    name = f"_staging/{uuid.uuid4().hex}.txt"
    try:
        db.files.write(name, chunks)
        yield lines_of(db.spark, f"{db.root}/{name}")
    finally:
        db.files.delete(name)


def add_lines(db: Database, lines: DataFrame, fmt: str | None = None, time_format: str | None = None, ordered_by: str | None = None) -> int | None:
    """Commit text lines as one transaction; with ``ordered_by``, a column of positions, they must come sorted."""
    if ordered_by is not None:
        parsed = parse_lines(lines.orderBy(ordered_by), fmt, time_format)
        check_order(parsed.withColumn("position", F.monotonically_increasing_id()), "position")
        return db.add(parsed)
    return db.add(parse_lines(lines, fmt, time_format))


def put(db: Database, body: str | bytes | Iterable[bytes]) -> int | None:
    """An unsorted request body: a format on each line, times in nanoseconds, one transaction."""
    body = body.encode() if isinstance(body, str) else body
    with spooled(db, [body] if isinstance(body, bytes) else body) as lines:
        return add_lines(db, lines)


def write_lines(records: DataFrame, path: str, **how) -> None:
    """Text files in the order of key and time."""
    render_lines(partition_by_key(records), **how).write.text(path)


def iterate_lines(records: DataFrame, **how):
    """Lines in the order of key and time, a partition at a time on the driver."""
    for row in render_lines(records.orderBy("key", "ts_nanos"), **how).toLocalIterator():
        yield row.value


def text_chunks(lines: DataFrame) -> Iterator[bytes]:
    """Lines as the chunks of a body, in no order: all tasks make them, and the driver fetches them a bounded partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = "".join([f"{x}\n" for x in batch.column(0).to_pylist()]).encode()
                yield pa.RecordBatch.from_arrays([pa.array([text], pa.binary())], names=["value"])

    # the shuffle's files keep the chunks, so no partition is made while the driver waits
    for row in lines.select("value").mapInArrow(run, "value binary").repartition("value").toLocalIterator(prefetchPartitions=True):
        yield bytes(row.value)


def read_parallel(snapshot: Snapshot, command: str, partitions: int | None = None, rendered: dict | None = None, **selection) -> DataFrame:
    """Selected records as lines through a shell command per partition; a key is never split. Gives the commands' output lines.

    ``rendered`` are arguments of ``render_lines``. The records are dealt out by key before they
    are merged, and the merge's order is that of the lines, so they are shuffled and sorted once.
    """
    rows = snapshot.read(**selection, dealt=lambda df: whole_keys(df, partitions)).sortWithinPartitions("key", "ts_nanos")
    return pipe(rows.select(COLUMNS), command, renderer(**(rendered or {})))
