"""Order-preserving packing by dynamic programming.

Documents keep their order. Their ids, each document closed by an end id, form
one stream per task; the stream may be cut at document ends (free) and at sentence
ends, at a penalty in tokens. Only where neither comes for over ``LONG`` ids, the
stretch may be cut at word ends too, and where no word ends for so long, between
ids, at higher penalties. The program minimises padding plus penalties over all
cuts with windows of at most ``length`` ids:

    best[j] = min over i with pos[j] - pos[i] <= length of
              best[i] + length - (pos[j] - pos[i]) + penalty[j]

The minimum of ``best[i] + pos[i]`` over that sliding window comes from a
monotone queue, so the work is linear in the number of cuts. The stream is worked
off in blocks; the last window of a block is carried on to the next. What is left
at a task's end is cut in powers of two, which need no padding.

Nothing is shuffled: a task packs the rows that it scans, in their order, so a
task that runs again makes the same sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD_SPACES, claim, kept, small, strings

#: Penalties in tokens of a cut at the end of a document, of a sentence, of a word in a stretch without either, and between two ids of a long word.
PENALTIES = {"document": 0, "sentence": 1, "word": 16, "inside": 32}
#: A stretch of more ids without the end of a sentence or document may be cut at word ends, and one of more ids without any end every STEP ids.
LONG, STEP = 48, 16
_loaded: dict[str, tuple] = kept("packing")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte for each printable symbol of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _library(path: str):
    """The tokenizer, a quicker encoder over the same vocabulary, its special strings, and by id whether a sentence ends or a word starts."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = tok.get_added_tokens_decoder()
        symbols = _bytes_of_symbols()
        ranks = {bytes(map(symbols.__getitem__, s)): i for s, i in tok.get_vocab(with_added_tokens=False).items()}
        quick = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        ends, starts = np.zeros((2, tok.get_vocab_size()), dtype=bool)
        for raw, i in ranks.items():
            ends[i] = raw[-1:] in (b".", b"!", b"?", b"\n")
            starts[i] = raw[:1] in (b" ", b"\n")
        _loaded[path] = (tok, quick, tuple(t.content for t in special.values()), ends, starts)
    return _loaded[path]


def encode_documents(texts: list[str], path: str, end_id: int = 0) -> Iterator[np.ndarray]:
    """Each text's ids with the end id.

    Texts with special strings, or with characters on which the libraries differ
    about white space, go through the tokenizer itself.
    """
    tok, quick, special, _, _ = _library(path)
    for t in texts:
        if any(s in t for s in special) or any(c in t for c in ODD_SPACES):
            ids = np.asarray(tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        else:
            ids = quick.encode_to_numpy(t, disallowed_special=())
        full = np.empty(len(ids) + 1, dtype="<u4")
        full[:-1] = ids
        full[-1] = end_id
        yield full


Cuts = tuple[np.ndarray, np.ndarray]  # rising positions from 0 on, and what a cut there costs


def cuts_of(ids: np.ndarray, ends: np.ndarray, path: str, most: int = LONG) -> Cuts:
    """Where a stream of documents that end at ``ends`` may be cut."""
    _, _, _, sentence, word = _library(path)
    closed = np.zeros(len(ids), dtype=bool)
    closed[ends - 1] = True
    at = np.flatnonzero(sentence[ids] | closed)
    cuts = np.append(0, at + 1), np.append(0, np.where(closed[at], PENALTIES["document"], PENALTIES["sentence"]))
    if cuts[0][-1] < len(ids):
        cuts = np.append(cuts[0], len(ids)), np.append(cuts[1], PENALTIES["inside"])
    return fill_gaps(*fill_gaps(*cuts, np.flatnonzero(word[ids[1:]]) + 1, PENALTIES["word"], most), None, PENALTIES["inside"], most)


def fill_gaps(pos: np.ndarray, penalty: np.ndarray, more: np.ndarray | None, cost: int, most: int) -> Cuts:
    """Cuts with those of ``more`` (None: one every STEP ids) that lie where neighbouring cuts are over ``most`` apart."""
    wide = np.diff(pos) > most
    if not wide.any():
        return pos, penalty
    if more is None:
        step = min(STEP, most)
        more = np.concatenate([np.arange(pos[k] + step, pos[k + 1], step) for k in np.flatnonzero(wide)])
    gap = np.searchsorted(pos, more, side="right") - 1
    ok = gap < len(wide)
    more, gap = more[ok], gap[ok]
    more = more[wide[gap] & (pos[gap] != more)]
    pos, penalty = np.append(pos, more), np.append(penalty, np.full(len(more), cost))
    order = np.argsort(pos, kind="stable")
    return pos[order], penalty[order]


def choose_cuts(pos: list[int], penalty: list[int], length: int) -> tuple[list[int], list[int]]:
    """Least cost of a cut at each position and the cut before it, by a monotone queue."""
    n = len(pos)
    best, before = [0] * n, [0] * n
    queue, keys, head = [0], [pos[0]], 0  # candidates in order of position, their keys rising
    for j in range(1, n):
        at = pos[j]
        low = at - length
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        best[j] = cost = keys[head] + length - at + penalty[j]
        before[j] = i
        key = cost + at
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
        if head > 4096:
            del queue[:head], keys[:head]
            head = 0
    return best, before


def windows(pos: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Ends of the whole windows of the cheapest packing; the rest, of at most ``length`` ids, stays open.

    Neighbouring cuts are at most ``length`` apart.
    """
    at = pos.tolist()
    best, before = choose_cuts(at, penalty.tolist(), length)
    low = at[-1] - length
    first = int(np.searchsorted(pos, low))
    j = min(range(first, len(at)), key=lambda k: (best[k] + at[k], -k))  # padding so far, and what is left to pack
    ends: list[int] = []
    while j > 0:
        ends.append(at[j])
        j = before[j]
    return ends[::-1]


def powers_of_two(start: int, end: int) -> list[int]:
    """Ends of windows that are powers of two, the largest first."""
    ends = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        ends.append(start)
    return ends


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` give pieces."""

    def __init__(self, path: str, length: int, first_sequence: int, block: int = 1 << 20):
        self.path, self.length, self.sequence, self.block = path, length, first_sequence, block
        self.docs: list[tuple[object, int, int]] = []  # id, ids packed before, ids of the document
        self.ids: list[np.ndarray] = []  # what is left of each
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        stream = np.concatenate(self.ids)
        stops = np.cumsum([len(x) for x in self.ids])
        pos, penalty = cuts_of(stream, stops, self.path, min(LONG, max(1, self.length // 4)))
        ends = windows(pos, penalty, self.length)
        names = {cost: name for name, cost in PENALTIES.items()}
        kinds = {end: names[c] for end, c in zip(ends, penalty[np.searchsorted(pos, ends)].tolist())}
        if last:
            ends += powers_of_two(ends[-1] if ends else 0, self.held)
        raw, upto = memoryview(stream.tobytes()), stops.tolist()
        d = start = begin = 0  # begin: where document d starts in the stream
        for end in ends:
            at = start
            while at < end:
                if upto[d] <= at:
                    begin, d = upto[d], d + 1
                doc_id, done, total = self.docs[d]
                stop = min(end, upto[d])
                kind = "document" if stop == upto[d] else kinds.get(end, "tail")
                yield doc_id, done + at - begin, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), total, self.sequence, at - start, kind
                at = stop
            self.sequence += 1
            start = end
        if d < len(upto) and upto[d] <= start:
            begin, d = upto[d], d + 1
        if d < len(self.docs):
            doc_id, done, total = self.docs[d]
            self.docs[d] = (doc_id, done + start - begin, total)
            self.ids[d] = self.ids[d][start - begin :]
        self.docs, self.ids = self.docs[d:], self.ids[d:]
        self.held -= start


COLUMNS = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long", "ends_at": "string"}


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence.

    A null or empty text is its end id alone. Repeated rows are packed each;
    other columns are ignored; an empty table gives no row. Sequence ids are
    unique, not consecutive: the upper bits name the task. ``ends_at`` tells where a
    piece was cut: at the end of its document, of a sentence, of a word, inside a
    word, or in the powers of two at a task's end (tail).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        packer = Packer(tokenizer, length, TaskContext.get().partitionId() << 36)
        kind = None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())], names=["doc_id", *COLUMNS])
            rows.clear()
            return out

        for batch in small(batches):
            kind = batch.column(0).type
            ids = batch.column(0).to_pylist()
            for i, encoded in zip(ids, encode_documents(strings(batch.column(1)), tokenizer, end_id)):
                rows.extend(packer.add(i, encoded))
                if len(rows) >= 20_000:
                    yield flush()
        rows.extend(packer.finish())
        if rows:
            yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()))
