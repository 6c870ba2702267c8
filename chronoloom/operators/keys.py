"""Work by key: groups, per-key functions, and partitions that never split a key."""

from __future__ import annotations

import contextlib
import itertools
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.predicates import free_name


def by_key(records: DataFrame) -> DataFrame:
    """A row per key with its records in the order of time, as an array.

    For keys of moderate size; ``per_key_stats``, ``stream_keys`` and ``iterate_keys`` hold no series as a whole.
    """
    rest = [c for c in records.columns if c != "key"]
    ordered = ["ts_nanos", *[c for c in rest if c != "ts_nanos"]]
    return records.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias("records"))


def first_per_key(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records of each key: a group that is left early."""
    rank = free_name(records, "rank")
    return records.withColumn(rank, F.row_number().over(Window.partitionBy("key").orderBy("ts_nanos"))).where(F.col(rank) <= n).drop(rank)


def per_key_stats(records: DataFrame, value: Column) -> DataFrame:
    """Count, first and last time, least, greatest and summed value of each key."""
    return records.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"),
        F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(value).alias("total"),
    )


def map_keys(records: DataFrame, f: Callable[[pa.RecordBatch], Iterable[tuple]], schema: str) -> DataFrame:
    """A function of each key's records in the order of time, all at once; it gives rows of ``schema``.

    Keys are cut from the sorted rows' batches without a copy, as a data frame for
    each key would cost milliseconds where keys are many and short.
    """
    fields = records.sparkSession.createDataFrame([], schema).schema
    place = records.columns.index("key")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the key that the last batch has ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(place).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            if held and held[0].column(place)[0].as_py() != batch.column(place)[0].as_py():
                yield pa.concat_batches(held)
                held = []
            for a, b in zip(starts, starts[1:]):
                part = batch.slice(a, b - a)
                yield pa.concat_batches([*held, part]) if held else part
                held = []
            held.append(batch.slice(starts[-1]))
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((row for group in groups(batches) for row in f(group)), to_arrow_schema(fields))

    return records.repartition("key").sortWithinPartitions("key", "ts_nanos").mapInArrow(run, schema)


def stream_keys(records: DataFrame, f: Callable[[str, Iterator[dict]], Iterator[tuple]], schema: str, partitions: int | None = None) -> DataFrame:
    """A function of each key and its records in the order of time, which come one by one and are never held together.

    ``f`` gives rows of ``schema``. It may stop reading a key early; what is left of the key is passed over.
    """
    fields = records.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for a in range(0, batch.num_rows, 1000) for row in batch.slice(a, 1000).to_pylist())
        return _batched((row for key, group in itertools.groupby(rows, key=lambda r: r["key"]) for row in f(key, group)), to_arrow_schema(fields))

    return partition_by_key(records, partitions).mapInArrow(run, schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def iterate_keys(records: DataFrame) -> Iterator[tuple[str, Iterator[Row]]]:
    """Keys in order, each with its records in the order of time, a partition at a time on the driver.

    A key's records are read as they are asked for; going on to the next key passes over the rest.
    """
    return itertools.groupby(records.orderBy("key", "ts_nanos").toLocalIterator(), key=lambda r: r["key"])


def map_reduce(records: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over all records: partial ones in each task, then one row."""
    return records.agg(*aggregates)


def partition_by_key(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ranges of keys, each key in one partition, sorted by key and time: what parallel consumers and writers need."""
    n = [partitions] if partitions else []
    return records.repartitionByRange(*n, "key").sortWithinPartitions("key", "ts_nanos")


def whole_keys(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each key in one partition, in no ranges, so that no pass over the rows has to find their bounds; not sorted."""
    n = [partitions] if partitions else []
    return records.repartition(*n, "key")


def pipe(rows: DataFrame, command: str, lines: Callable[[pa.RecordBatch], list[str]] | None = None) -> DataFrame:
    """Each partition's lines through a shell command of its own; a failing command fails the job.

    The lines are the first column, or what ``lines`` makes of a batch of all columns:
    made here, they go to the command without passing through Spark as rows.

    Partitions without lines start none. Status 1 without any output is no failure,
    as ``grep`` ends so where it lets nothing through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (batch for batch in batches if batch.num_rows)
        first = next(filled, None)
        if first is None:
            return
        child = subprocess.Popen(["/bin/sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                with contextlib.suppress(BrokenPipeError), child.stdin as out:
                    for batch in itertools.chain([first], filled):
                        out.write("".join([f"{x}\n" for x in (lines(batch) if lines else batch.column(0).to_pylist())]).encode())
                for _ in filled:  # what a command that has ended early leaves
                    pass
            except BaseException as e:
                failed.append(e)

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        said = False
        while some := child.stdout.readlines(1 << 18):
            said = True
            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\n") for x in map(bytes.decode, some)], pa.string())], names=["value"])
        feeder.join()
        if failed:
            raise failed[0]
        if child.wait() not in ((0,) if said else (0, 1)):
            raise RuntimeError(f"command ended with status {child.returncode}: {command}")

    return (rows if lines else rows.select(rows.columns[0])).mapInArrow(run, "value string")
