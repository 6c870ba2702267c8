"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character,
and none holds a line feed, so a marked text falls into chunks that segment
independently: runs of line feeds, and words with the markers before them. Each
worker segments a distinct chunk once, keeps its ids and its decoded form, and
joins them back by position. ``check_vocabulary`` makes sure that the model has
this property; a model without it is encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, kept, small, strings, text_slices

MARK = "▁"
CHUNKS = re.compile(r"\n+| *[^ \n]+| +")
CACHE_ENTRIES = 250_000
_loaded: dict[str, tuple] = kept("pieces")


def check_vocabulary(pieces: list[str]) -> bool:
    """Whether pieces cannot cross a marker or hold a line feed."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)


def _model(path: str):
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                raw.append(b"")
            else:
                raw.append(p.replace(MARK, " ").encode())
        # the property also needs a normaliser that only writes markers, and one marker put in front
        plain = sp.normalize(" Ａ a  ") == f"{MARK}{MARK}Ａ{MARK}a{MARK}{MARK}" and sp.encode("\n")[:1] == [sp.piece_to_id(MARK)]
        chunked = plain and check_vocabulary(pieces)
        _loaded[path] = (sp, raw, {}, chunked)
    return _loaded[path]


def _segment(sp, raw: list[bytes], chunks: list[str]) -> dict[str, tuple[str, str]]:
    """Ids, as decimal text, and decoded form of each chunk."""
    whole = [c[1:] if c[0] == " " else "\n" + c for c in chunks]  # the library adds one marker in front
    out = {}
    for c, ids in zip(chunks, sp.encode(whole, num_threads=1)):
        if c[0] != " ":
            ids = ids[2:]
        elif len(c) == 1:  # one marker, and an empty text gets none
            ids = [sp.piece_to_id(MARK)]
        out[c] = (" ".join(map(str, ids)), b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace"))
    return out


def encode_decode(texts: list[str], path: str) -> Iterator[tuple[str, str]]:
    """For each text, its ids with the end id as decimal text, and the ids decoded again."""
    sp, raw, cache, chunked = _model(path)
    end = str(sp.eos_id())
    for part in text_slices(texts):
        if not chunked:
            for t in part:
                ids = sp.encode(t, add_eos=True)
                yield " ".join(map(str, ids)), sp.decode(ids)
            continue
        split = [CHUNKS.findall(" " + t.replace(MARK, " ")) if t else [] for t in part]
        seen: set[str] = set()
        for chunks in split:
            seen.update(chunks)
        missing = [c for c in seen if c not in cache]
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = list(seen)
        if missing:
            cache.update(_segment(sp, raw, missing))
        for chunks in split:
            found = [cache[c] for c in chunks]
            ids = " ".join([x[0] for x in found])
            yield (f"{ids} {end}" if ids else end), "".join([x[1] for x in found])[1:]


def sentencepiece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens`` with the end id, digests of ids and decoded text.

    A null or empty text has the end id alone. Repeated rows each give a row;
    other columns are ignored; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        for batch in small(batches):
            n, ids_sha, text_sha = [], [], []
            for ids, decoded in encode_decode(strings(batch.column(1)), model):
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves, one array a document, with the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        for batch in small(batches):
            got = list(encode_decode(strings(batch.column(1)), model))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[int(i) for i in ids.split()] for ids, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
