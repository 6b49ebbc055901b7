"""Generated strings: the Spark parsers agree with Python's int / float /
strptime('%Y-%m-%d') after strip, on the alphabets the feeds use (documented
divergences — '1_000', unbounded ints, non-finite floats — are excluded)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clientlens.functions.parsing import parse_date, parse_float, parse_int

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def py_int(s):
    try:
        v = int(s)
    except Exception:
        return None
    return v if -(2**31) <= v < 2**31 else None


def py_float(s):
    try:
        v = float(s)
    except Exception:
        return None
    return v if v == v and abs(v) != float("inf") else None


def py_date(s):
    try:
        return dt.datetime.strptime(s.strip(), "%Y-%m-%d").date()
    except Exception:
        return None


def _spark_eval(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


int_text = st.text(alphabet="0123456789+- \t.", min_size=0, max_size=9)
float_text = st.one_of(
    st.text(alphabet="0123456789+-.e \t", min_size=0, max_size=10),
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
)
date_text = st.one_of(
    st.builds(lambda y, m, d, pad: f"{pad}{y}-{m}-{d}{pad}",
              st.integers(1000, 2999), st.sampled_from(["1", "01", "9", "12", "13", "00", "7"]),
              st.sampled_from(["1", "05", "28", "29", "30", "31", "32", "0"]), st.sampled_from(["", " ", "\n"])),
    st.text(alphabet="0123456789- ", min_size=0, max_size=12),
)


@SETTINGS
@given(st.lists(int_text, min_size=200, max_size=200))
def test_parse_int_matches_python(spark, values):
    assert _spark_eval(spark, parse_int, values) == [py_int(v) for v in values]


@SETTINGS
@given(st.lists(float_text, min_size=200, max_size=200))
def test_parse_float_matches_python(spark, values):
    got = _spark_eval(spark, parse_float, values)
    exp = [py_float(v) for v in values]
    assert [None if g is None else round(g, 6) for g in got] == [None if e is None else round(e, 6) for e in exp]


@SETTINGS
@given(st.lists(date_text, min_size=200, max_size=200))
def test_parse_date_matches_python(spark, values):
    got = _spark_eval(spark, parse_date, values)
    exp = [py_date(v) for v in values]
    assert [(v, g) for v, g, e in zip(values, got, exp) if g != e] == []
