import math
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoloom.functions import text
from chronoloom.functions.formats import CODES, infer_format, pack_columns, parse_format, row_size, try_typed, typed, wide_schema
from chronoloom.functions.predicates import key_range, like_pattern, parse_time, select_columns, wildcard
from chronoloom.functions.text import escape, escape_column, parse_line, parse_lines, parse_value, render_line, render_lines, render_value, split, split_one, unescape_tokens


@pytest.mark.parametrize("line, want", [
    ("loom\\", None), ("loom\\\\", ("loom\\", "")), ("12 7 9", ("12", "7 9")), ("warp\\\\ weft", ("warp\\", "weft")),
    ("warp\\ and\\ weft \t  end", ("warp and weft", "end")), ("", ("", "")), (" ", ("", "")), ("\\n\\t\\q x", ("\n\tq", "x")),
])
def test_split_one(line, want):
    assert split_one(line) == want


def test_split():
    assert split("a b\\ c  d ") == ["a", "b c", "d"]
    assert split("") == [] and split("  ") == []
    assert split("a \\") is None


@given(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=["Cs"]), min_size=1))
def test_escape_round_trip(text):
    got = split_one(escape(text))
    assert got == (text, "")


def test_lines_in_columns(spark):
    """Records of mixed formats, also in slices of a batch, as lines and back, as the functions for one line have them."""
    lines = ["a\t1\tiIuUfF\t-1 5 4 18446744073709551615 0.50000000000000000 NaN", "b\\ c\t2\tu\t7", "d\t3\tsB\tx\\ \\\\\\n YQ==", "e\t4\tF\t-inf"] * 3
    rows = parse_lines(spark.createDataFrame([(x,) for x in ["", *lines]], "value string").coalesce(1))
    got = [tuple(r.asDict(recursive=True).values()) for r in rows.collect()]
    assert repr(got) == repr([parse_line(x) for x in lines])
    assert [r.value for r in render_lines(rows, time="nanos", show_format=True).collect()] == lines
    assert [r.value for r in render_lines(rows.limit(1), time="nanos", columns="2,4-5").collect()] == ["a\t1\t5 18446744073709551615 0.50000000000000000"]


def test_golden_lines():
    for line, fmt in [("oak\t2031-07-09_11:22:33\tuu\t71 8", None), ("oak\t2031-07-09_11:22:34\tf\t0.12500000000000000", None), ("elm\t1999-12-31_23:59:59\tsu\ttall\\ tree 5", None)]:
        record = parse_line(line, fmt, "%F_%T")
        assert render_line(*record, time="%F_%T", show_format=True) == line
    record = parse_line("a 5 1 2 3 4", "uuuu")
    assert render_line(*record, time="nanos", columns="1,3-4") == "a\t5\t1 3 4"
    assert render_line("k", 1_500_000_000, "", [], time="seconds") == "k\t1\t"
    assert render_line("k", 1_500_000_001, "", [], time="%S%.f") == "k\t01.500000001\t"


def test_values():
    assert render_value("F", parse_value("F", "0.1")) == "0.10000000000000001"
    assert math.isnan(parse_value("f", "nan")["f"]) and render_value("f", parse_value("f", "NaN")) == "NaN"
    assert parse_value("U", str(2**64 - 1))["u"] == Decimal(2**64 - 1)
    assert parse_value("B", "aGk")["b"] == b"hi" and render_value("B", parse_value("B", "aGk")) == "aGk="
    for code, bad in [("u", "-1"), ("u", str(2**32)), ("i", str(2**31)), ("U", str(2**64)), ("i", "x"), ("f", "y"), ("u", "1_000"), ("u", "\u0663"), ("f", "1_0.5"), ("F", "\u0661.5"), ("F", ""), ("F", "1e"), ("u", " 1")]:
        with pytest.raises(ValueError):
            parse_value(code, bad)


@pytest.mark.parametrize("line, fmt", [("a 1 2 3", "u"), ("a 1", "u"), ("a", None), ("a 1 z 3", None), ("a -1 5", "u"), ("a 1 \\", "s"), ("a 1_0 5", "u"), ("a \u0661 5", "u")])
def test_bad_lines(line, fmt):
    with pytest.raises(ValueError):
        parse_line(line, fmt)


def test_formats():
    assert parse_format("iIuUfFsB") == list(CODES) and row_size("uF") == 12 and row_size("us") is None
    assert [f.name for f in wide_schema("uF")] == ["v1", "v2"]
    with pytest.raises(ValueError):
        parse_format("x")


def test_typed_columns(spark):
    df = spark.range(1).selectExpr("'k' key", "1L ts_nanos", "7 a", "1.5f b", "'t' c")
    assert infer_format(df.select("a", "b", "c").schema) == "ifs"
    rec = df.select("ts_nanos", pack_columns("ifs", df.a, df.b, df.c).alias("cols")).selectExpr("*", "'ifs' fmt")
    got = rec.select(typed(0, "i64").alias("x"), typed(1, "f64").alias("y"), typed(2, "str").alias("z"), try_typed(0, "u32").alias("n")).first()
    assert (got.x, got.y, got.z, got.n) == (7, 1.5, "t", None)
    for n, kind in [(0, "u64"), (1, "i64"), (2, "f64"), (5, "i64")]:  # unsigned is not signed; no column 5
        with pytest.raises(Exception, match="not readable"):
            rec.select(typed(n, kind)).collect()
    with pytest.raises(Exception, match="out of range"):
        df.select(pack_columns("u", -df.a)).collect()


def test_escape_and_tokens_in_columns(spark):
    texts = ["a b", "x\\y\n\t", "", "é\v\f\r\a\b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.e for r in df.select(escape_column("t").alias("e")).collect()] == [escape(t) for t in texts]
    assert df.select(unescape_tokens("t").alias("x")).first().x == ["a", "b"]


def test_lines_through_frames(spark):
    lines = ["a 1 uF 5 2.5", "", "b 2 s x\\ y", "c 3 B aGk="]
    rec = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = [r.value for r in render_lines(rec.orderBy("key"), time="nanos", show_format=True).collect()]
    assert out == ["a\t1\tuF\t5 2.50000000000000000", "b\t2\ts\tx\\ y", "c\t3\tB\taGk="]


def test_predicates(spark):
    assert parse_time("1970-01-01T00:00:01.5") == 1_500_000_000 and parse_time("1970-01-02") == 86_400 * 10**9
    for bad in ["1960-01-01", "x", "1970-01-01T1"]:
        with pytest.raises(ValueError):
            parse_time(bad)
    for a, b, kw in [("b", "a", {}), ("a", "a", {})]:
        with pytest.raises(ValueError):
            key_range(a, b, **kw)
    key_range("a", "a", include_upper=True)
    assert select_columns("1,3,5-7") == [(1, 1), (3, 3), (5, 7)]
    with pytest.raises(ValueError):
        select_columns("0")
    assert like_pattern("a_b\\%") == "a\\_b\\\\%"
    keys = ["a_b", "axb", "a+b", "a%b", "ab", "a\\b"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    pick = lambda p: {r.key for r in df.where(wildcard(p)).collect()}
    assert pick("a_b") == {"a_b"} and pick("a_%") == {"a_b"} and pick("%+%") == {"a+b"} and pick("%") == set(keys) and pick("a\\%") == {"a\\b"}


@pytest.mark.parametrize("columns", [None, "2", "1,3-9"])
def test_lines_of_batches(columns):
    """Batches of one format are rendered a column at a time, others a row at a time, with the same lines."""
    import pyarrow as pa

    one = [("a b", 5, "Fsi", [0.1, "x y", -3]), ("a b", 6, "Fsi", [float("inf"), "", 4]), ("é\t", 6, "Fsi", [float("nan"), "\\", 5])]
    finite = [("k", n, "fF", [n / 4, n / 3]) for n in range(5)]  # the first is exact in 32 bits
    mixed = [*one, ("z", 7, "", []), ("z", 8, "uUB", [1, Decimal(2**64 - 1), b"q"]), *finite]
    for rows in (one, finite, mixed, [("k", 1, "", []), ("l", 2, "", [])], []):
        full = [(k, t, f, [{x.name: v if x.name == text.CODES[c][0] else None for x in text.VALUE} for c, v in zip(f, values)]) for k, t, f, values in rows]
        batch = pa.RecordBatch.from_pylist([dict(zip(text._ARROW.names, r)) for r in full], schema=text._ARROW)
        want = [text.render_line(*r, show_format=True, columns=columns) for r in full]
        assert text.renderer(show_format=True, columns=columns)(batch) == want
        assert text.renderer(show_format=True, columns=columns)(batch.slice(1)) == want[1:]
