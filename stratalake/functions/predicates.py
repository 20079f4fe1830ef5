"""Zone-map predicates on a column record: true keeps the row group, and whatever is unknown keeps.

All are Column expressions, so that they run inside generated code and take literals or columns alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "gte", "lte", "between", "is_null", "is_not_null")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
#: Prefixes of whole numbers in other bases (fixed values).
_BASES = {"0x": (16, "0-9a-f"), "0o": (8, "0-7"), "0b": (2, "01")}


def let(value: Column, f) -> Column:
    """f of a value that is computed once per row, and written once into the plan."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _folded(t: Column, base: int, kind: str) -> Column:
    """The digits behind a two-letter prefix as a number; null where a whole number has more than 38 decimal digits."""
    digits = F.filter(F.split(F.lower(F.substring(t, 3, 2**31 - 1)), ""), lambda c: c != "")
    worth = lambda c: (F.position(c, F.lit("0123456789abcdef")) - 1).cast(kind)
    number = F.lit(base).cast("decimal(2,0)" if kind != "double" else kind)
    return F.aggregate(digits, F.lit(0).cast(kind), lambda a, c: F.try_add(F.try_multiply(a, number).cast(kind), worth(c)).cast(kind))


def _prefixed(t: Column):
    for prefix, (base, digits) in _BASES.items():
        yield F.lower(t).rlike(f"^{prefix}[{digits}]+$"), base


def _integer(t: Column) -> Column:
    out = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("decimal(38,0)"))
    for given, base in _prefixed(t):
        out = out.when(given, _folded(t, base, "decimal(38,0)"))
    return out


def _number(t: Column, whole: Column) -> Column:
    """whole: the literal as a whole number, if it is one that 38 digits hold: its double is the nearest one."""
    out = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    for given, base in _prefixed(t):
        out = out.when(given, F.coalesce(whole.cast("double"), _folded(t, base, "double")))
    return F.when(F.abs(out) < float("inf"), out)


#: White space that literals lose at both ends: ASCII, no-break and other Unicode spaces, byte order mark (fixed values).
_BLANKS = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def readings(text: Column) -> Column:
    """struct<num, int, str, ts, bool>: a literal read in every way at once, so that it need be parsed once only; null if blank."""
    t = F.regexp_replace(text, f"^{_BLANKS}|{_BLANKS}$", "")
    low = F.lower(t)
    truth = F.when(low.isin("true", "t", "1", "yes"), True).when(low.isin("false", "f", "0", "no"), False)
    ts = F.when(t.rlike(_DATE), t.try_cast("timestamp"))
    made = lambda w: F.struct(_number(t, w).alias("num"), w.alias("int"), t.alias("str"), ts.alias("ts"), truth.alias("bool"))
    return F.when(t != "", let(_integer(t), made))


def read_as(r: Column, kind: Column) -> Column:
    """struct<kind, num, int, str, ts, bool> of readings for a column of this kind; null where the literal cannot be read so.

    Whole numbers stay exact for int columns, other numbers are compared as doubles; dates are ISO 8601, in UTC unless
    they name a zone; binary columns read nothing.
    """
    own = (
        F.when(kind == "num", F.when(r["num"].isNotNull(), "num"))
        .when(kind == "int", F.when(r["int"].isNotNull(), "int").when(r["num"].isNotNull(), "num"))
        .when(kind == "bool", F.when(r["bool"].isNotNull(), "bool"))
        .when(kind == "ts", F.when(r["ts"].isNotNull(), "ts"))
        .when(kind == "str", F.when(r["str"].isNotNull(), "str"))
    )
    made = F.struct(own.alias("kind"), *[r[f].alias(f) for f in ("num", "int", "str", "ts", "bool")])
    return F.when(own.isNotNull(), made)


def literal(text: Column, kind: Column) -> Column:
    """A literal as a column of this kind reads it: read_as of its readings."""
    return let(readings(text), lambda r: read_as(r, kind))


def _compared(bound: Column, lit: Column, at_least: bool, nan_keeps: bool) -> Column:
    """bound >= lit (or <=). NaN on either side is false; kinds that do not compare count as equal."""
    op = (lambda a, b: a >= b) if at_least else (lambda a, b: a <= b)
    double = lambda s: F.when(s["kind"] == "int", s["int"].cast("double")).otherwise(s["num"])
    numbers = bound["kind"].isin("num", "int") & lit["kind"].isin("num", "int")
    nan = F.isnan(double(bound))
    return F.coalesce(
        F.when(numbers & (bound["kind"] == "int") & (lit["kind"] == "int"), op(bound["int"].cast("decimal(38,0)"), lit["int"]))
        .when(numbers & nan, F.lit(nan_keeps))
        .when(numbers, op(double(bound), double(lit)))
        .when((bound["kind"] == "ts") & (lit["kind"] == "ts"), op(bound["ts"], lit["ts"]))
        .when((bound["kind"] == "bool") & (lit["kind"] == "bool"), op(bound["bool"].cast("int"), lit["bool"].cast("int")))
        .when((bound["kind"] == "str") & (lit["kind"] == "str"), op(bound["str"], lit["str"])),
        F.lit(True),
    )


def verdict(stat: Column, op: Column | str, value: Column | str, value2: Column | str = "", nan_bound: str = "prune") -> Column:
    """Whether the predicate keeps a row group whose column has these statistics; never null.

    value and value2 are texts, or their readings. nan_bound: "prune" lets a NaN bound fail every comparison; "unknown" keeps,
    as real scan planning must.
    """
    texts = [F.lit(x) if isinstance(x, str) else x for x in (value, value2)]
    return let(F.struct(readings(texts[0]).alias("a"), readings(texts[1]).alias("b")), lambda r: verdict_of(stat, op, r["a"], r["b"], nan_bound))


def verdict_of(stat: Column, op: Column | str, value: Column, value2: Column, nan_bound: str = "prune") -> Column:
    """verdict for literals given as readings."""
    keeps = nan_bound == "unknown"
    ge = lambda s, x: s.isNull() | _compared(s, x, True, keeps)
    le = lambda s, x: s.isNull() | _compared(s, x, False, keeps)

    def judged(c: Column, a: Column, b: Column) -> Column:
        low, high, nulls = c["min_raw"], c["max_raw"], c["null_count"]
        one = low.isNull() | high.isNull()
        by = {
            "is_null": lambda: nulls.isNull() | (nulls > 0),
            "is_not_null": lambda: nulls.isNull() | (c["num_values"] > nulls),
            "eq": lambda: a.isNull() | one | (le(low, a) & ge(high, a)),
            "gte": lambda: a.isNull() | ge(high, a),
            "lte": lambda: a.isNull() | le(low, a),
            "between": lambda: a.isNull() | b.isNull() | one | (ge(high, a) & le(low, b)),
        }
        if isinstance(op, str):
            return by[op]() if op in by else F.lit(True)
        out = F.when(F.lit(False), F.lit(True))
        for name, test in by.items():
            out = out.when(op == name, test())
        return out

    def of(c: Column) -> Column:
        kind = F.coalesce(c["min_raw"]["kind"], c["max_raw"]["kind"])
        pair = F.struct(read_as(value, kind).alias("a"), read_as(value2, kind).alias("b"))
        return let(pair, lambda lit: judged(c, lit["a"], lit["b"]))

    return F.coalesce(let(stat, of), F.lit(True))
