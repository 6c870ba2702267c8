"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters that Python counts as white space and the tokenizer libraries do not.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies; looked up on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_slices(texts: list[str], max_chars: int = 1_000_000) -> Iterator[list[str]]:
    """Cut a batch in runs of bounded size; one text is never cut."""
    part: list[str] = []
    chars = 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= max_chars:
            yield part
            part, chars = [], 0
    if part:
        yield part


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that their Python copies stay small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_kept: dict[str, list[dict]] = {}


def kept(operator: str) -> dict:
    """A dict in which an operator keeps things in its Python worker from task to task."""
    _kept.setdefault(operator, []).append(own := {})
    return own


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def claim(operator: str) -> None:
    """A task's operator takes over its worker: what the others have kept goes.

    Else the caches of all operators of a job would add up in the workers, which
    live on. Closures must call this and reach their caches by module functions,
    as a dict that a closure names is copied into each task.
    """
    gone = [d for name, dicts in _kept.items() if name != operator for d in dicts if d]
    for d in gone:
        d.clear()
    if gone:
        trim()


def strings(column) -> list[str]:
    """An Arrow string column as Python strings; a null text counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine only in local mode, where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return named or os.path.join(tempfile.gettempdir(), "chronoloom-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
