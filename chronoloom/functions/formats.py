"""Row formats: one character per column, chosen anew for every record.

A record keeps its columns in an array of structs with one field per storage
class, so that records of different formats share a schema and a scan still
reads only the fields that a query touches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One column's value: exactly one field is set.
VALUE = T.StructType([
    T.StructField("l", T.LongType()), T.StructField("u", T.DecimalType(20, 0)), T.StructField("f", T.FloatType()),
    T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType()),
])
RECORD = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("ts_nanos", T.LongType(), False),
    T.StructField("fmt", T.StringType(), False), T.StructField("cols", T.ArrayType(VALUE), False),
])

# Code, storage field, Spark type, least and greatest value.
CODES: dict[str, tuple[str, T.DataType, int | None, int | None]] = {
    "i": ("l", T.IntegerType(), -(2**31), 2**31 - 1),
    "I": ("l", T.LongType(), None, None),
    "u": ("l", T.LongType(), 0, 2**32 - 1),
    "U": ("u", T.DecimalType(20, 0), 0, 2**64 - 1),
    "f": ("f", T.FloatType(), None, None),
    "F": ("d", T.DoubleType(), None, None),
    "s": ("s", T.StringType(), None, None),
    "B": ("b", T.BinaryType(), None, None),
}
# Kinds that a reader may ask for, the codes that widen to them without loss, and the result's type.
WIDENING: dict[str, tuple[str, T.DataType]] = {
    "i32": ("i", T.IntegerType()), "i64": ("iI", T.LongType()), "u32": ("u", T.LongType()), "u64": ("uU", T.DecimalType(20, 0)),
    "f32": ("f", T.FloatType()), "f64": ("fF", T.DoubleType()), "str": ("s", T.StringType()), "bytes": ("B", T.BinaryType()),
}


def parse_format(fmt: str) -> list[str]:
    """The codes of a format; unknown ones are an error."""
    for c in fmt:
        if c not in CODES:
            raise ValueError(f"unknown format code {c!r} in {fmt!r}")
    return list(fmt)


def wide_schema(fmt: str) -> T.StructType:
    """Concrete columns v1, v2, ... of records that share one format."""
    return T.StructType([T.StructField(f"v{n}", CODES[c][1]) for n, c in enumerate(parse_format(fmt), 1)])


def row_size(fmt: str) -> int | None:
    """Bytes of the fixed-size values of a record, None where a value has no fixed size."""
    sizes = {"i": 4, "I": 8, "u": 4, "U": 8, "f": 4, "F": 8}
    codes = parse_format(fmt)
    return None if any(c not in sizes for c in codes) else sum(sizes[c] for c in codes)


def _checked(code: str, value: Column) -> Column:
    field, kind, low, high = CODES[code]
    stored = VALUE[field].dataType
    if low is None or code == "i":
        out = value.cast(kind).cast(stored)
    else:
        wide = value.cast(T.DecimalType(38, 0))
        out = F.when(wide.between(F.lit(low).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")), wide.cast(stored)).otherwise(
            F.when(value.isNotNull(), F.raise_error(F.concat(F.lit(f"value out of range for '{code}': "), value.cast("string"))).cast(stored))
        )
    return out


def value_struct(code: str, value: Column) -> Column:
    """A value in its storage field, range-checked."""
    field = CODES[code][0]
    return F.struct(*[(_checked(code, value) if f.name == field else F.lit(None).cast(f.dataType)).alias(f.name) for f in VALUE])


def pack_columns(fmt: str, *values: Column) -> Column:
    """The ``cols`` array of a record from typed columns; their number must match the format."""
    codes = parse_format(fmt)
    if len(codes) != len(values):
        raise ValueError(f"format {fmt!r} has {len(codes)} columns, got {len(values)}")
    return F.array(*[value_struct(c, v) for c, v in zip(codes, values)]) if codes else F.array().cast(T.ArrayType(VALUE))


def infer_format(schema: T.StructType) -> str:
    """Codes for typed columns, as a typed writer would choose them."""
    known = {T.IntegerType: "i", T.ShortType: "i", T.ByteType: "i", T.LongType: "I", T.FloatType: "f", T.DoubleType: "F", T.StringType: "s", T.BinaryType: "B", T.DecimalType: "U"}
    try:
        return "".join(known[type(f.dataType)] for f in schema)
    except KeyError as e:
        raise ValueError(f"no format code for {e.args[0].__name__}") from None


def typed(n: int, kind: str, fmt: Column | str = "fmt", cols: Column | str = "cols") -> Column:
    """Column ``n`` (from 0) read as ``kind``: only lossless widening, anything else raises an error."""
    codes, result = WIDENING[kind]
    fmt, cols = (F.col(x) if isinstance(x, str) else x for x in (fmt, cols))
    code = F.substring(fmt, n + 1, 1)
    value = F.get(cols, F.lit(n))
    out = None
    for c in codes:
        got = value[CODES[c][0]].cast(result)
        out = F.when(code == c, got) if out is None else out.when(code == c, got)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"column {n} is not readable as {kind}: format "), fmt)).cast(result))


def try_typed(n: int, kind: str, fmt: Column | str = "fmt", cols: Column | str = "cols") -> Column:
    """As ``typed``, but null where the column is missing or of another type."""
    codes, result = WIDENING[kind]
    fmt, cols = (F.col(x) if isinstance(x, str) else x for x in (fmt, cols))
    value = F.get(cols, F.lit(n))
    return F.coalesce(*[F.when(F.substring(fmt, n + 1, 1) == c, value[CODES[c][0]].cast(result)) for c in codes])


def unpack_columns(fmt: str) -> list[Column]:
    """Columns v1, v2, ... of records that all have ``fmt``."""
    return [F.get("cols", F.lit(n))[CODES[c][0]].cast(CODES[c][1]).alias(f"v{n + 1}") for n, c in enumerate(parse_format(fmt))]
