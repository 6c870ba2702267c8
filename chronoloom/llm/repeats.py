"""Repeated byte strings across a corpus, by column-wise construction over aligned fragments.

Every ``width``-byte string lies in one fragment (see ``fragments``), and equal
strings lie in fragments of one anchor hash, at equal distances from the anchor.
So each group of fragments with one anchor hash is a collection of short
documents that is aligned at the anchor. The construction goes through its
columns from right to left. Each round inserts one symbol per document: the
order of all suffixes that start in the column follows from the order in the
last one by a stable sort on the inserted symbols (that sequence of symbols, in
the last order, is the column's part of the Burrows-Wheeler transform of the
collection), and the lengths of common prefixes of neighbours follow from minima
over the old ones. A string is repeated when its suffix has a neighbour with a
common prefix of at least ``width``. Groups are packed in collections of bounded
size; each is read, as sorted runs, from the shuffle's sequential files.

A group holds each distinct fragment once, however often that occurs. Where a
group would still be too large for one task (an anchor amid a passage that very
many contexts surround), its fragments are cut in pieces, whose strings stand at
neighbouring distances from the anchor and so share more bytes than the anchor.
Pieces meet again by all the bytes that they share. Most then are alike, and are
one, or alone, and are none. What is still large is cut once more, at last in
single strings, so every group that is built is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut_lineage, free, small
from .fragments import GRAM, fragments

#: Fragments that are built together, beside what the last group has more.
COLLECTION = 16_384
#: Most distinct fragments of a group; a larger one is cut in pieces.
GROUP = 2_048
#: Distances from the anchor that a piece spans, for each time that a group is cut.
PIECES = (24, 4, 1)
#: Bytes that are cut in fragments at once, and of one text.
SLICE = 1 << 20
#: Most bits of each broadcast table of anchors: 32 MB.
MOST_BITS = 28


def intervals(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of marks in a matrix."""
    edge = np.zeros((len(marked), marked.shape[1] + 2), np.int8)
    edge[:, 1:-1] = marked
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    return row, first, stop - 1


def repeated_starts(group: np.ndarray, anchor: np.ndarray, texts: list[bytes], many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, within their fragment, of strings that occur more than once: fragment, first, last.

    ``group`` numbers the fragments' groups in rising order; ``anchor`` is where the
    anchor starts in each; ``many`` tells fragments that occur more than once as a whole.
    """
    m = len(texts)
    lead = width - GRAM  # a string starts so far before its anchor at most
    columns = lead + width
    size = np.fromiter(map(len, texts), np.int64, m)
    left = lead - anchor  # the column of a fragment's first byte
    matrix = np.zeros((m, columns), np.uint16)
    ends = np.cumsum(size)
    flat = np.arange(ends[-1]) + np.repeat(np.arange(m) * columns + left - (ends - size), size)
    matrix.ravel()[flat] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    matrix = np.ascontiguousarray(matrix.T)
    _, local = np.unique(group, return_inverse=True)
    block = local.astype(np.int64) * 257
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)
    found = np.zeros((m, lead + 1), bool)
    for column in range(columns - 1, -1, -1):
        symbol = matrix[column][order]
        key = block + symbol
        if (key[1:] >= key[:-1]).all():  # the order stays
            grown = common[:-1] + 1
            grown[1:][key[1:] != key[:-1]] = 0
            grown[0] = 0
        else:
            moved = np.argsort(key, kind="stable")
            key, order, symbol = key[moved], order[moved], symbol[moved]
            grown = common[moved] + 1
            grown[0] = 0
            same = key[1:] == key[:-1]
            grown[1:][~same] = 0
            far = np.flatnonzero(same & (moved[1:] != moved[:-1] + 1))
            if len(far):  # least common prefix over all that stood between
                span = np.empty(2 * len(far), np.int64)
                span[::2], span[1::2] = moved[far] + 1, moved[far + 1] + 1
                grown[far + 1] = np.minimum.reduceat(common, span)[::2] + 1
        grown[symbol == 0] = 0  # nothing is common beyond a fragment's end
        common[:-1] = grown
        if column <= lead:
            hit = grown >= width
            if hit.any():
                hit[:-1] |= hit[1:]
                found[order[hit], column] = True
    whole = np.flatnonzero(many)
    at = np.arange(lead + 1)
    found[whole] = (at >= left[whole, None]) & (at <= (left + size - width)[whole, None])
    row, first, last = intervals(found)
    return row, first - left[row], last - left[row]


def slices(ids: list, texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, list[int]]]:
    """Joined texts in slices of bounded size: bytes, ends, and for each piece its id and where in its text it starts.

    A long text goes on in the next piece with ``width - 1`` bytes of overlap, so each string is in one piece.
    """
    parts: list[bytes] = []
    names: list = []
    base: list[int] = []
    held = 0
    for i, t in zip(ids, texts):
        for a in range(0, max(1, len(t) - width + 1), SLICE):
            piece = t[a : a + SLICE + width - 1]
            parts.append(piece)
            names.append(i)
            base.append(a)
            held += len(piece)
            if held >= SLICE // 2:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), names, base
                parts, names, base, held = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), names, base


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _anchor_counts(width: int):
    """Anchor hashes with their numbers, merged within a slice; strings of copied documents count twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            copied = batch.column("copied").to_pylist()
            for data, ends, names, _ in slices(list(range(batch.num_rows)), _bytes(batch.column("text")), width):
                h, first, _, _ = fragments(data, ends, width)
                if len(h):
                    twice = np.asarray([1 + copied[k] for k in names])[np.searchsorted(ends, first, side="right")]
                    unique, at = np.unique(h, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.bincount(at, weights=twice).astype(np.int64))], names=["h", "n"])

    return run


def _bitmap(bits: int):
    """64 KB of the table at most from the hashes that fall in one chunk of it."""

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
        chunk = int(h[0]) >> 19
        own = np.zeros(min(1 << 19, 1 << bits), np.uint8)
        own[(h & np.uint64((1 << 19) - 1)).astype(np.int64)] = 1
        return pa.table([pa.array([chunk], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["chunk", "bitmap"])

    return run


def _table_of(hashes: DataFrame, bits: int) -> bytes:
    """A bit for each value of the low bits of a hash, set where ``h`` has it: 2**MOST_BITS bits at most."""
    chunk = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 19)
    out = bytearray(max(1, (1 << bits) >> 3))
    for r in hashes.select("h", chunk.alias("chunk")).groupBy("chunk").applyInArrow(_bitmap(bits), "chunk long, bitmap binary").collect():
        at = r.chunk << 16
        out[at : at + len(r.bitmap)] = r.bitmap
    return bytes(out)


def anchor_tables(docs: DataFrame, width: int) -> tuple[int, bytes, bytes]:
    """Tables of bits with one set for each anchor hash that occurs more than once, and for each that occurs more than GROUP times.

    Other hashes may share a bit; what the tables say depends on the hash alone, so places of one anchor go one way.
    """
    counts = cut_lineage(docs.mapInArrow(_anchor_counts(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    bits = min(MOST_BITS, max(16, (16 * counts.count()).bit_length()))
    return bits, _table_of(counts, bits), _table_of(counts.where(F.col("n") > GROUP), bits)


def _in(h: np.ndarray, bits: int, table: bytes) -> np.ndarray:
    at = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (np.frombuffer(table, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _fragments_of(batch: pa.RecordBatch, width: int, shared) -> Iterator[tuple]:
    """Fragments that may hold repeated strings: number of the row, hash, start in the text, start of the anchor, content, all as columns."""
    bits, repeated, _ = shared.value
    for data, ends, names, base in slices(list(range(batch.num_rows)), _bytes(batch.column("text")), width):
        h, first, size, anchor = fragments(data, ends, width)
        ok = np.flatnonzero(_in(h, bits, repeated))
        if len(ok):
            h, first, size, anchor = h[ok], first[ok], size[ok], anchor[ok]
            piece = np.searchsorted(ends, first, side="right")
            rows = np.asarray(names)[piece]
            starts = first - (ends - np.diff(ends, prepend=0))[piece] + np.asarray(base)[piece]
            raw = data.tobytes()
            content = [raw[a:b] for a, b in zip(first.tolist(), (first + size + width - 1).tolist())]
            yield rows, h.view(np.int64), starts, anchor - first, content


def _digest(content: list[bytes]) -> tuple[pa.Array, pa.Array]:
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(c) for c in content]), ">i8").astype(np.int64)
    return pa.array(raw[::2]), pa.array(raw[1::2])


#: Distinct fragments: group, digest, where the anchor starts, whether it occurs more than once, bytes.
_CONTENTS = "g long, c1 long, c2 long, anchor int, many boolean, content binary"


def _contents(width: int, shared):
    """Distinct fragments of each slice, with whether they occur more than once in it, and whether their anchors occur often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            copied = batch.column("copied").to_pylist()
            for rows, h, _, anchor, content in _fragments_of(batch, width, shared):
                seen: dict[tuple[int, bytes], list] = {}
                for row, k, a, c in zip(rows.tolist(), h.tolist(), anchor.tolist(), content):
                    if known := seen.get((k, c)):
                        known[2] = True
                    else:
                        seen[(k, c)] = [k, a, copied[row], c]
                g, anchor, many, content = zip(*seen.values())
                big = _in(np.asarray(g).view(np.uint64), shared.value[0], shared.value[2])
                arrays = [pa.array(g, pa.int64()), *_digest(list(content)), pa.array(anchor, pa.int32()), pa.array(many, pa.bool_()), pa.array(content, pa.binary()), pa.array(big)]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "c1", "c2", "anchor", "many", "content", "big"])

    return run


def _places(width: int, shared):
    """Where fragments stand: digest, row, starts; one row for each text, slice and distinct fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            keys = [batch.column(c).to_numpy() for c in ("r1", "r2")]
            for rows, _, starts, _, content in _fragments_of(batch, width, shared):
                seen: dict[tuple[int, bytes], list[int]] = {}
                for row, start, c in zip(rows.tolist(), starts.tolist(), content):
                    seen.setdefault((row, c), []).append(start)
                row = np.asarray([k for k, _ in seen])
                arrays = [*_digest([c for _, c in seen]), *[pa.array(k[row]) for k in keys], pa.array(seen.values(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "r1", "r2", "starts"])

    return run


def _pieces(width: int, span: int):
    """Fragments (digest, group, anchor, many, content) in pieces whose strings start ``span`` neighbouring distances from the anchor.

    A piece's group is the hash of the bytes that all strings at those distances
    share, so equal strings stay in one group. ``lo`` is where it starts in the fragment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            out = []
            for g, c1, c2, anchor, many, content in zip(*[batch.column(c).to_pylist() for c in ("g", "c1", "c2", "anchor", "many", "content")]):
                last = len(content) - width  # a string that starts at k stands anchor - k before the anchor
                for cell in range((anchor - last) // span, anchor // span + 1):
                    a, b = max(0, anchor - cell * span - span + 1), min(last, anchor - cell * span)
                    core = content[anchor - cell * span : anchor - cell * span - span + 1 + width]
                    own = xxhash.xxh3_64_intdigest(core, seed=(g ^ cell) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    out.append((c1, c2, a, own, anchor - a, many, content[a : b + width]))
            if out:
                c1, c2, lo, own, anchor, many, content = zip(*out)
                arrays = [pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(lo, pa.int32()), pa.array(own, pa.int64()), *_digest(list(content)), pa.array(anchor, pa.int32()), pa.array(many, pa.bool_()), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["p1", "p2", "lo", "g", "c1", "c2", "anchor", "many", "content"])

    return run


def _construct(width: int):
    """Sorted fragments of whole groups: for each distinct one with repeated strings, the runs of their starts."""

    def build(rows: list[list]) -> pa.RecordBatch:
        group, one, two, anchor, many, content = (list(x) for x in zip(*rows))
        row, first, last = repeated_starts(np.asarray(group), np.asarray(anchor), content, np.asarray(many), width)
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        pairs = np.empty(2 * len(row), np.int32)
        pairs[::2], pairs[1::2] = first, last + width
        offsets = pa.array(np.append(2 * cut, len(pairs)).astype(np.int32))
        who = row[cut].tolist()
        return pa.RecordBatch.from_arrays([pa.array([one[k] for k in who], pa.int64()), pa.array([two[k] for k in who], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(pairs))], names=["c1", "c2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        held: list[list] = []
        for batch in small(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][1] == row[1] and held[-1][2] == row[2] and held[-1][0] == row[0]:
                    held[-1][4] = True  # the same fragment from another task
                    continue
                if len(held) >= COLLECTION and held[-1][0] != row[0]:
                    yield build(held)
                    held = []
                held.append(list(row))
        if held:
            yield build(held)

    return run


def merged(pairs: list[list[int]]) -> list[tuple[int, int]]:
    """Flat lists of (start, end) as disjoint spans that do not touch."""
    flat = np.concatenate([np.asarray(p, np.int64) for p in pairs]).reshape(-1, 2) if pairs else np.zeros((0, 2), np.int64)
    return list(map(tuple, _joined(flat[:, 0], flat[:, 1]).tolist()))


def _joined(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as rows (start, end) in order, those that meet or overlap as one."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return np.stack([first[fresh], reach[np.append(fresh[1:], len(first)) - 1]], axis=1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, the starts of a fragment in them and its runs: the spans that these cover."""
    claim("repeats")
    for batch in small(batches):
        out = []
        for starts, runs in zip(batch.column("starts").to_pylist(), batch.column("runs").to_pylist()):
            at = np.asarray(starts, np.int64)[:, None]
            pairs = np.asarray(runs, np.int64).reshape(-1, 2)
            out.append(_joined((at + pairs[:, 0]).ravel(), (at + pairs[:, 1]).ravel()).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("r1"), batch.column("r2"), pa.array(out, pa.list_(pa.int64()))], names=["r1", "r2", "spans"])


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


#: Ids or spans go to every task up to so many rows (at most about 100 bytes each), and meet in a sorted join beyond.
BROADCAST_ROWS = 500_000


def _few(rows: DataFrame) -> DataFrame:
    """Stored rows, sent to every task where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _built(contents: DataFrame, width: int) -> DataFrame:
    """Runs of repeated strings' starts in distinct fragments; a group is in one task."""
    parts = max(1, int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return contents.repartition(parts, "g").sortWithinPartitions("g", "c1", "c2").mapInArrow(_construct(width), "c1 long, c2 long, runs array<int>")


def _runs(texts: DataFrame, width: int, shared) -> DataFrame:
    """``c1, c2, runs``: the distinct fragments that hold repeated strings, and where these start and end."""
    own = texts.mapInArrow(_contents(width, shared), f"{_CONTENTS}, big boolean")
    if not any(shared.value[2]):
        return _built(own.drop("big"), width)
    own = cut_lineage(own)
    own, found = own.where("not big").drop("big"), own.where("big").drop("big")
    levels = []  # (fragments to build, those that were cut to make them, how long the pieces are)
    above, span = None, None
    for finer in (*PIECES, None):
        whole = F.any_value  # rows of a group and digest are alike but for ``many``
        found = cut_lineage(found.groupBy("g", "c1", "c2").agg(whole("anchor").alias("anchor"), (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many"), whole("content").alias("content")))
        large = cut_lineage(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("g"))
        if finer is None or large.isEmpty():
            levels.append((found, above, span))
            break
        large = _few(large)
        levels.append((found.join(large, "g", "left_anti"), above, span))
        above, span = cut_lineage(found.join(large, "g", "left_semi")), finer
        found = above.mapInArrow(_pieces(width, span), f"p1 long, p2 long, lo int, {_CONTENTS}").drop("p1", "p2", "lo")
    runs = None
    for contents, cut, span in reversed(levels):
        if cut is None:
            contents = own.unionByName(contents)
        built = _built(contents, width)
        runs = built if runs is None else built.unionByName(runs)
        if cut is not None:
            pieces = cut.mapInArrow(_pieces(width, span), f"p1 long, p2 long, lo int, {_CONTENTS}").select("p1", "p2", "lo", "c1", "c2")
            lifted = pieces.join(runs, ["c1", "c2"]).groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2"))
            runs = lifted.agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("lo")))).alias("runs"))
    return runs


def repeated_spans(docs: DataFrame, width: int = 200) -> tuple[DataFrame, DataFrame, list[str], str]:
    """``docs`` with a key of two columns, and by that key spans: flat pairs (start, end) of bytes that repeated strings cover.

    The names of the key's columns and of the spans' column, all free in ``docs``, come third and last.

    A string of ``width`` bytes is repeated when it also starts anywhere else in
    the corpus, in the same document too. Matches never cross documents.

    A text that several rows have and that has ``width`` bytes is repeated as a
    whole. Its strings still count against other documents, from one of its rows.
    Rows are told apart by 128 bits of id and text; rows equal in both are such copies.
    """
    text = F.coalesce("text", F.lit(""))
    k1, k2, held = free(docs, "row1"), free(docs, "row2"), free(docs, "spans")
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", text), k2: F.xxhash64(F.lit(1), "doc_id", text)})
    key = [F.col(k1).alias("r1"), F.col(k2).alias("r2")]
    long = keyed.where(F.octet_length("text") >= width)
    digest = long.select(*key, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.octet_length("text").alias("size"))
    same = digest.groupBy("t1", "t2", "size").agg(F.min(F.struct("r1", "r2")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = _few(cut_lineage(same))  # where they are few, copies stay where they are
    copies = digest.join(same, ["t1", "t2", "size"]).groupBy("r1", "r2").agg((F.min("first") == F.struct("r1", "r2")).alias("lead"), F.min("size").alias("size"))
    copies = cut_lineage(copies)
    roles = _few(copies.select("r1", "r2", "lead", F.lit(True).alias("copied")))
    texts = long.select(*key, "text").join(roles, ["r1", "r2"], "left").where(F.coalesce("lead", F.lit(True))).select("r1", "r2", "text", F.coalesce("copied", F.lit(False)).alias("copied"))
    # rows equal in id and text would stand here more than once; that changes no result, as all of them is repeated anyway
    shared = docs.sparkSession.sparkContext.broadcast(anchor_tables(texts, width))  # 2 * 2**MOST_BITS bits at most

    places = texts.where("not copied").mapInArrow(_places(width, shared), "c1 long, c2 long, r1 long, r2 long, starts array<long>")
    hits = places.join(_runs(texts, width, shared), ["c1", "c2"]).select("r1", "r2", "starts", "runs").mapInArrow(_spans, "r1 long, r2 long, spans array<long>")
    found = hits.groupBy("r1", "r2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = copies.select("r1", "r2", F.array(F.lit(0).cast("long"), F.col("size").cast("long")).alias("spans"))
    spans = cut_lineage(found.unionByName(whole)).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("spans").alias(held))
    return keyed, spans, [k1, k2], held


def _apply(held: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            size, removed, count, sha = [], [], [], []
            for data, flat in zip(_bytes(batch.column("text")), batch.column(held).to_pylist()):
                spans = merged([flat]) if flat else []
                size.append(len(data))
                removed.append(sum(b - a for a, b in spans))
                count.append(len(spans))
                sha.append(hashlib.sha256(without(data, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (size, removed, count)], pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _cut_texts(held: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        for batch in small(batches):
            k = batch.schema.get_field_index("text")
            out = []
            for text, flat in zip(batch.column(k).to_pylist(), batch.column(held).to_pylist()):
                if flat and text is not None:
                    data = text.encode("utf-8", "surrogatepass")
                    inner = []
                    for a, b in merged([flat]):  # a character that a span covers in part stays
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        inner.append((a, b))
                    text = without(data, inner).decode("utf-8", "replace")
                out.append(text)
            columns = list(batch.columns)
            columns[k] = pa.array(out, pa.string())
            kept = [j for j, n in enumerate(batch.schema.names) if n != held]
            yield pa.RecordBatch.from_arrays([columns[j] for j in kept], names=[batch.schema.names[j] for j in kept])

    return run


def _split(docs: DataFrame, spans: DataFrame, key: list[str], held: str) -> tuple[DataFrame, DataFrame]:
    """Rows with spans, which move to meet them, and rows without, which stay where they are."""
    ids = _few(spans.select(key))
    plain = docs.join(ids, key, "left_anti").withColumn(held, F.lit(None).cast("array<long>"))
    return docs.join(ids, key, "left_semi").join(spans, key), plain


def repeat_digests(docs: DataFrame, width: int = 200) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A null or empty text has no bytes, and the digest of none. Texts shorter than
    ``width`` lose nothing. Repeated rows are documents of their own, so they lose
    all. Only ``doc_id`` and ``text`` are read. An empty table gives no row.
    """
    keyed, spans, key, held = repeated_spans(docs.select("doc_id", "text"), width)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut, plain = _split(keyed, spans, key, held)
    one, two = (df.select("doc_id", "text", held).mapInArrow(_apply(held), schema) for df in (cut, plain))
    return one.unionByName(two)


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with every repeated string taken out of ``text``; other columns stay as they are, whatever their names.

    All of a string's places lose it. A character that a span covers only in part is kept.
    """
    names = docs.columns
    keyed, spans, key, held = repeated_spans(docs, width)
    cut, plain = _split(keyed, spans, key, held)
    return cut.select(*names, held).mapInArrow(_cut_texts(held), docs.schema).unionByName(plain.select(*names))
