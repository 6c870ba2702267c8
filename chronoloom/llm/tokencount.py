"""Token counts by a map-side two-tier lookup.

The tokenizer's pre-tokens never hold white space, so a text's count is the sum
over its white-space-separated chunks. Tier one is a compact table of the
corpus's most frequent chunks and their lengths in tokens: every task finds its
own heavy hitters over all its rows, the small candidate lists are summed, and
the best ``table_size`` are broadcast. That parameter and ``LONGEST`` bound its
bytes; longer chunks, such as text without white space, are left to tier two, a
cache in each Python worker; a chunk in neither is encoded by the library once
and remembered. No chunk is shuffled on the counting path.

Counts are those of the library with ``add_special_tokens=False``. A text that
holds the string of a special token, or a control character on which Python and
the library disagree about white space, is encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD_SPACES, claim, kept, small, strings, text_slices

#: Entries of a worker's cache; it starts anew beyond that.
CACHE_ENTRIES = 1_000_000
#: Characters of a chunk in tier one.
LONGEST = 64
_loaded: dict[str, tuple] = kept("tokencount")
_tables: dict[str, dict[str, int]] = kept("tokencount")


def _library(path: str):
    """The tokenizer, its special strings and the worker's cache of lengths."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        _loaded[path] = (tok, special, {})
    return _loaded[path]


def chunk_lengths(path: str, chunks: list[str]) -> list[int]:
    tok, _, _ = _library(path)
    return [len(e) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]


class _TwoTier(dict):
    """Tier one as a dict; what it lacks is read from the worker's cache."""

    cache: dict[str, int]

    def __missing__(self, chunk: str) -> int:
        return self.cache[chunk]


def tier_one(key: str, shared) -> _TwoTier:
    """The broadcast table as this worker keeps it."""
    if key not in _tables:
        _tables.clear()
        joined, raw = shared.value
        _tables[key] = _TwoTier(zip(joined.split("\n") if joined else [], np.frombuffer(raw, np.uint32).tolist()))
    return _tables[key]


def count_tokens(texts: list[str], path: str, hot: dict[str, int]) -> list[int]:
    """Tokens of each text, given tier one's lengths."""
    tok, special, cache = _library(path)
    look = hot if isinstance(hot, _TwoTier) else _TwoTier(hot)
    look.cache = cache
    out: list[int] = []
    for part in text_slices(texts):
        split: list[list[str] | None] = []
        seen: set[str] = set()
        for t in part:
            if any(s in t for s in special) or any(c in t for c in ODD_SPACES):
                split.append(None)
            else:
                chunks = t.split()
                split.append(chunks)
                seen.update(chunks)
        missing = [c for c in seen if c not in hot and c not in cache]
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = [c for c in seen if c not in hot]
        if missing:
            cache.update(zip(missing, chunk_lengths(path, missing)))
        of = look.__getitem__
        for t, chunks in zip(part, split):
            out.append(len(tok.encode(t, add_special_tokens=False)) if chunks is None else sum(map(of, chunks)))
    return out


def _heavy_hitters(keep: int, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokencount")
        counts: Counter[str] = Counter()
        for batch in small(batches):
            for part in text_slices(strings(batch.column(0))):
                counts.update([c for c in " ".join(part).split() if len(c) <= LONGEST])
            floor = 1
            while len(counts) > limit:  # forget the rarest; tier one only has to be good, not exact
                counts = Counter({c: n for c, n in counts.items() if n > floor})
                floor += 1
        best = counts.most_common(keep)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["chunk", "n"])

    return run


def frequent_chunks(docs: DataFrame, text: str, table_size: int, per_task: int = 2048) -> list[str]:
    """The corpus's most frequent chunks of at most ``LONGEST`` characters, at most ``table_size`` (both bound what the driver gets)."""
    found = docs.select(text).mapInArrow(_heavy_hitters(per_task, 60_000), "chunk string, n long")
    best = found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(table_size)
    return [r.chunk for r in best.collect()]


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, table_size: int = 16_384) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null text counts as empty: 0 bytes and tokens. Repeated rows each give a
    row. Other columns are ignored, whatever their names. An empty table gives no row.
    """
    hot = frequent_chunks(docs, text, table_size)
    lengths = np.asarray(chunk_lengths(tokenizer, hot), dtype=np.uint32) if hot else np.zeros(0, np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(("\n".join(hot), lengths.tobytes()))
    key = hashlib.sha1("\n".join([tokenizer, *hot]).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokencount")
        hot = tier_one(key, shared)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_tokens(strings(batch.column(2)), tokenizer, hot), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
