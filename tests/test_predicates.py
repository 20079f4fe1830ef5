"""The predicate table: unknown keeps, NaN prunes unless asked otherwise, kinds that do not compare keep."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from stratalake.functions.predicates import readings, verdict
from stratalake.functions.schema import COLUMN_STAT

NAN = float("nan")


def num(x):
    return None if x is None else ("num", x, None, None, None, None, None)


def whole(x):
    return ("int", None, decimal.Decimal(x), None, None, None, None)


def truth(x):
    return ("bool", None, None, None, None, x, None)


def day(x):
    return ("ts", None, None, None, datetime.datetime.fromisoformat(x), None, None)


CASES = [
    (num(1.0), num(5.0), 0, 3, "eq", "5", "", True), (num(1.0), num(5.0), 0, 3, "eq", "6", "", False), (num(1.0), num(5.0), 0, 3, "eq", "", "", True),
    (num(1.0), num(5.0), 0, 3, "eq", "abc", "", True), (num(1.0), num(5.0), 0, 3, "eq", "12d", "", True), (num(1.0), None, 0, 3, "eq", "9", "", True),
    (num(1.0), None, 0, 3, "gte", "9", "", True), (num(1.0), None, 0, 3, "lte", "0", "", False), (num(0.0), num(20.0), 0, 3, "between", "10", "0", True),
    (num(0.0), num(20.0), 0, 3, "between", "30", "", True), (num(0.0), num(20.0), 0, 3, "between", "30", "40", False), (num(NAN), num(NAN), 0, 3, "eq", "1", "", False),
    (whole(9007199254740993), whole(9007199254740993), 0, 3, "eq", "9007199254740992", "", False), (whole(1), whole(2), 0, 3, "eq", "1.5", "", True),
    (whole(16), whole(16), 0, 3, "eq", "0x10", "", True), (whole(16), whole(16), 0, 3, "eq", "0x11", "", False), (num(1.0), num(5.0), 0, 3, "eq", "Infinity", "", True),
    (truth(False), truth(False), 0, 3, "eq", "YES", "", False), (truth(False), truth(False), 0, 3, "eq", "f", "", True), (truth(False), truth(False), 0, 3, "eq", "maybe", "", True),
    (day("2024-01-01"), day("2024-01-31"), 0, 3, "gte", "2024-02-01", "", False), (day("2024-01-01"), day("2024-01-31"), 0, 3, "gte", "soon", "", True),
    (("bin", None, None, None, None, None, b"a"), ("bin", None, None, None, None, None, b"b"), 0, 3, "eq", "00", "", True),
    (num(1.0), num(2.0), 0, 3, "is_null", "", "", False), (num(1.0), num(2.0), None, 3, "is_null", "", "", True), (num(1.0), num(2.0), 3, 3, "is_null", "", "", True),
    (num(1.0), num(2.0), 0, 3, "is_not_null", "", "", True), (num(1.0), num(2.0), None, 3, "is_not_null", "", "", True), (num(1.0), num(2.0), 3, 3, "is_not_null", "", "", False),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, ("c", None, None, n, None, None, lo, hi, nulls, None, None, None, None), op, a, b, keep) for i, (lo, hi, nulls, n, op, a, b, keep) in enumerate(CASES)]
    return spark.createDataFrame(rows, f"id int, stat {COLUMN_STAT}, op string, a string, b string, keep boolean").cache()


def test_table(frame):
    got = frame.select("id", "keep", verdict(F.col("stat"), F.col("op"), F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.id, r.v) for r in got if r.v != r.keep] == []


def test_whole_numbers_of_any_length(spark):
    """Literals in bases 2, 8 and 16 are exact as far as 38 decimal digits go, then doubles, and never end the job."""
    cases = {
        "0x" + "f" * 18: 16**18 - 1, "0X1fFfffffffffffff1": 0x1FFFFFFFFFFFFFFF1, "0b1" + "0" * 69 + "1": 2**70 + 1, "0o7" + "0" * 30: 7 * 8**30, "0x" + "0" * 60 + "2a": 42,
        "0x" + "f" * 31: 16**31 - 1, "0b" + "1" * 126: 2**126 - 1, "0x": None, "0xg": None, "-0x1": None, "0b2": None, "0o8": None, "9" * 38: 10**38 - 1, "-" + "9" * 30: 1 - 10**30,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r for r in df.select("t", readings(F.col("t")).alias("r")).select("t", "r.*").collect()}
    for t, want in cases.items():
        assert got[t].int == want if want is None else int(got[t].int) == want, t
        if t[:2].lower() in ("0x", "0b", "0o"):
            assert got[t].num == (None if want is None else float(want)), t
    long = {"0x" + "f" * 40: 16.0**40, "0b1" + "0" * 400: 2.0**400, "0x1" + "0" * 256: None, "1" * 50: float("1" * 50)}
    rows = spark.createDataFrame([(k,) for k in long], "t string").select("t", readings(F.col("t")).alias("r")).select("t", "r.int", "r.num").collect()
    assert all(r.int is None and (r.num == long[r.t] if long[r.t] is None else abs(r.num / long[r.t] - 1) < 1e-12) for r in rows)


def test_nan_unknown(frame):
    v = verdict(F.col("stat"), F.col("op"), F.col("a"), F.col("b"), nan_bound="unknown")
    assert frame.where("isnan(stat.min_raw.num)").select(v.alias("v")).first().v


def test_missing_column(spark):
    from stratalake.operators.prune import keeps

    df = spark.createDataFrame([([],)], f"columns array<{COLUMN_STAT}>")
    assert df.select(keeps([("x", "eq", "1"), ("x", "is_null", "")]).alias("v")).first().v
    assert df.select(keeps([]).alias("v")).first().v
