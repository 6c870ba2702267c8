"""The line protocol: tokens between white space, backslash escapes, values as text.

Splitting and rendering are Arrow-batched Python: one pass over a line cannot be
said with regular expressions, and 17 exact decimals not with Java's formatter.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import CODES, RECORD, VALUE, parse_format
from .predicates import NANOS, checked_nanos, chosen, select_columns

# Letters after a backslash and the characters that they stand for.
ESCAPES = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", " ": " ", "\\": "\\"}
_NAMES = {c: f"\\{k}" for k, c in ESCAPES.items()}
_TOKEN = re.compile(r"[ \t\n\r\f]*((?:\\.|[^\\ \t\n\r\f])*)(\\?)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]*")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Tokens of a line that does not end in a lone backslash, and of one without any.
_TOKENS = re.compile(r"(?:\\.|[^\\ \t\n\r\f]+)+", re.S)
_WORDS = re.compile(r"[^ \t\n\r\f]+")
_SPECIAL = re.compile("[" + "".join(map(re.escape, _NAMES)) + "]")


def _plain(token: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPES.get(m[1], m[1]), token) if "\\" in token else token


def split_one(line: str) -> tuple[str, str] | None:
    """The first token, unescaped, and what follows the white space after it; None if the line ends in a lone backslash."""
    m = _TOKEN.match(line)
    if m[2]:
        return None
    return _plain(m[1]), line[_SPACE.match(line, m.end()).end() :]


def split(line: str) -> list[str] | None:
    """All tokens of a line."""
    if "\\" not in line:
        return _WORDS.findall(line)
    if (len(line) - len(line.rstrip("\\"))) % 2:
        return None
    return [_plain(x) for x in _TOKENS.findall(line)]


def escape(text: str) -> str:
    return "".join(_NAMES.get(c, c) for c in text) if _SPECIAL.search(text) else text


def escape_column(column: str) -> Column:
    """``escape`` as built-in functions; the backslash goes first."""
    out = F.replace(F.col(column), F.lit("\\"), F.lit("\\\\"))
    for c, name in _NAMES.items():
        if c != "\\":
            out = F.replace(out, F.lit(c), F.lit(name))
    return out


# --- values ---------------------------------------------------------------


#: Numbers in ASCII; Python's own parsers take other digits and underscores too.
_INTEGER = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"(?i)[+-]?(?:[0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)")


def _integer(token: str) -> int:
    if not _INTEGER.fullmatch(token):
        raise ValueError(f"not an integer: {token!r}")
    return int(token)


def _value(code: str, token: str) -> object:
    """What a token stands for; text that does not fit its type is an error."""
    _, _, low, high = CODES[code]
    if code in "iIuU":
        n = _integer(token)
        low, high = (low, high) if low is not None else (-(2**63), 2**63 - 1)
        if not low <= n <= high:
            raise ValueError(f"{n} is out of range for '{code}'")
        return Decimal(n) if code == "U" else n
    if code in "fF":
        if not _FLOAT.fullmatch(token):
            raise ValueError(f"not a number: {token!r}")
        return float(token)
    return token if code == "s" else base64.b64decode(token + "=" * (-len(token) % 4), validate=True)


def parse_value(code: str, token: str) -> dict:
    """A token as a stored value; text that does not fit its type is an error."""
    value = _value(code, token)
    return {f.name: value if f.name == CODES[code][0] else None for f in VALUE}


def render_value(code: str, value: dict) -> str:
    """A stored value as text: floats with 17 exact decimals, strings escaped, bytes in padded base64."""
    return _text(code, value[CODES[code][0]])


def _text(code: str, v: object) -> str:
    if code in "fF":
        v = float(v)
        return "NaN" if math.isnan(v) else f"{v:.17f}" if math.isfinite(v) else ("inf" if v > 0 else "-inf")
    if code == "s":
        return escape(v)
    return base64.b64encode(v).decode() if code == "B" else str(int(v))


# --- times ----------------------------------------------------------------


def parse_stamp(token: str, pattern: str | None) -> int:
    """Nanoseconds of a time token: by a strptime pattern, or an integer."""
    if pattern is None:
        return checked_nanos(_integer(token))
    full = pattern.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")
    at = datetime.strptime(token, full)
    whole = at.replace(tzinfo=at.tzinfo or UTC)
    return checked_nanos(int(whole.replace(microsecond=0).timestamp()) * NANOS + at.microsecond * 1000)


def render_stamp(nanos: int, mode: str) -> str:
    """A time as ``nanos``, as ``seconds`` (rounded down), or by a strftime pattern in UTC; ``%f`` gives nine digits."""
    if mode == "nanos":
        return str(nanos)
    if mode == "seconds":
        return str(nanos // NANOS)
    part = f"{nanos % NANOS:09d}"
    return datetime.fromtimestamp(nanos // NANOS, UTC).strftime(mode.replace("%.f", f".{part}").replace("%f", part))


# --- lines ----------------------------------------------------------------


def parse_line(line: str, fmt: str | None = None, time_format: str | None = None) -> tuple[str, int, str, list[dict]] | None:
    """A record of a line ``key time [format] values...``; None for an empty line. A wrong number of values is an error."""
    got = _parsed(line, fmt, time_format)
    return None if got is None else (*got[:3], [{f.name: v if f.name == CODES[c][0] else None for f in VALUE} for c, v in zip(got[2], got[3])])


def _parsed(line: str, fmt: str | None, time_format: str | None) -> tuple[str, int, str, list] | None:
    """``parse_line`` with the bare values."""
    tokens = split(line)
    if tokens is None:
        raise ValueError(f"line ends in a backslash: {line!r}")
    if not tokens:
        return None
    head = 2 if fmt is not None else 3
    if len(tokens) < head:
        raise ValueError(f"line has too few tokens: {line!r}")
    own = fmt if fmt is not None else tokens[2]
    codes, values = parse_format(own), tokens[head:]
    if len(codes) != len(values):
        raise ValueError(f"format {own!r} has {len(codes)} columns, the line has {len(values)}: {line!r}")
    return tokens[0], parse_stamp(tokens[1], time_format), own, [_value(c, v) for c, v in zip(codes, values)]


_ARROW = pa.schema([("key", pa.string()), ("ts_nanos", pa.int64()), ("fmt", pa.string()), ("cols", pa.list_(pa.struct([("l", pa.int64()), ("u", pa.decimal128(20, 0)), ("f", pa.float32()), ("d", pa.float64()), ("s", pa.string()), ("b", pa.binary())])))])


def parse_lines(lines: DataFrame, fmt: str | None = None, time_format: str | None = None, column: str = "value") -> DataFrame:
    """Records of text lines; with ``fmt`` all lines have that format, else each line names its own."""
    if fmt is not None:
        parse_format(fmt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in batch.column(0).to_pylist() if x is not None and (r := _parsed(x, fmt, time_format)) is not None]
            keys, stamps, fmts, values = zip(*rows) if rows else [[], [], [], []]
            columns = [pa.array(c, f.type) for c, f in zip((keys, stamps, fmts), _ARROW)]
            yield pa.RecordBatch.from_arrays([*columns, _stored(fmts, values)], schema=_ARROW)

    return lines.select(column).mapInArrow(run, RECORD)


def _stored(fmts: Sequence[str], values: Sequence[list]) -> pa.Array:
    """Rows' bare values as the column ``cols``, a field at a time."""
    kind = _ARROW.field("cols").type
    fields = [CODES[c][0] for f in fmts for c in f]
    flat = [v for row in values for v in row]
    used = set(fields)
    parts = [pa.array([v if n == f.name else None for n, v in zip(fields, flat)], f.type) if f.name in used else pa.nulls(len(flat), f.type) for f in kind.value_type]
    ends = pa.array(itertools.accumulate(map(len, values), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)


def render_line(key: str, nanos: int, fmt: str, cols: list[dict], time: str = "%F %T", show_format: bool = False, columns: str | None = None) -> str:
    """``key \\t time \\t [format \\t] values``; only the chosen columns' values."""
    ranges = select_columns(columns)
    return _line(key, nanos, fmt, [render_value(c, v) for n, (c, v) in enumerate(zip(fmt, cols), 1) if chosen(n, ranges)], time, show_format)


def _line(key: str, nanos: int, fmt: str, values: list[str], time: str, show_format: bool) -> str:
    return "\t".join([escape(key), render_stamp(nanos, time), *([fmt] if show_format else []), " ".join(values)])


def renderer(time: str = "%F %T", show_format: bool = False, columns: str | None = None) -> Callable[[pa.RecordBatch], list[str]]:
    """A function of a batch ``key, ts_nanos, fmt, cols`` that gives its lines."""
    ranges = select_columns(columns)

    def lines(batch: pa.RecordBatch) -> list[str]:
        key, nanos, fmt, cols = batch.columns
        if cols.null_count:
            raise ValueError("a record lacks its columns")
        heads = [_each(key, escape), _each(nanos, lambda t: render_stamp(t, time)), *([fmt.to_pylist()] if show_format else [])]
        return list(map("\t".join, zip(*heads, _rows(fmt, cols, None if columns is None else ranges))))

    return lines


def _each(column: pa.Array, f: Callable) -> list:
    """``f`` of each value, called once for equal ones."""
    coded = column.dictionary_encode(null_encoding="encode")
    words = [f(x) for x in coded.dictionary.to_pylist()]
    return [words[k] for k in coded.indices.to_numpy().tolist()]


def _rows(fmt: pa.Array, cols: pa.Array, ranges: list[tuple[int, int]] | None) -> list[str]:
    """The rows' chosen values as text: a column at a time where all rows have one format, else a row at a time."""
    ends = cols.offsets.to_numpy()
    formats = fmt.unique().to_pylist()
    n = len(formats[0] or "") if len(formats) == 1 else 0
    if n and (np.diff(ends) == n).all():
        # the values of all rows lie one after another, so every n-th is of one column
        values = cols.values.slice(ends[0], ends[-1] - ends[0])
        fields = dict(zip((f.name for f in cols.type.value_type), values.flatten()))
        texts = [_texts(c, fields[CODES[c][0]].take(pa.array(np.arange(j, len(values), n)))) for j, c in enumerate(formats[0]) if ranges is None or chosen(j + 1, ranges)]
        return texts[0] if len(texts) == 1 else list(map(" ".join, zip(*texts))) if texts else [""] * len(fmt)
    fields = {f.name: x.to_pylist() if x.null_count < len(x) else [None] * len(x) for f, x in zip(cols.type.value_type, cols.values.flatten())}
    places = ends.tolist()
    return [" ".join([_text(c, fields[CODES[c][0]][p]) for p, c in zip(range(a, b), f) if ranges is None or chosen(p - a + 1, ranges)]) for f, a, b in zip(fmt.to_pylist(), places, places[1:])]


def _texts(code: str, values: pa.Array) -> list[str]:
    """``_text`` of a column's values."""
    if code in "fF" and not values.null_count and np.isfinite(numbers := values.to_numpy()).all():
        return [f"{v:.17f}" for v in numbers.tolist()]
    return _each(values, lambda v: _text(code, v)) if code == "s" else [_text(code, v) for v in values.to_pylist()]


def render_lines(records: DataFrame, time: str = "%F %T", show_format: bool = False, columns: str | None = None) -> DataFrame:
    """Records as text lines in column ``value``, in the rows' order."""
    lines = renderer(time, show_format, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(lines(batch), pa.string())], names=["value"])

    return records.select("key", "ts_nanos", "fmt", "cols").mapInArrow(run, "value string")


def unescape_tokens(column: str) -> Column:
    """The tokens of a line as an array."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split(x) for x in lines], dtype=object)

    return run(column)


