"""Texts of sizes, boxes and statistics, as Column expressions. Rounding follows the shortest decimal form, half up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import EDGES

MISSING = "—"
#: Units of sizes, each 1024 of the one before (fixed values).
UNITS = ("B", "KB", "MB", "GB", "TB")


def bytes_text(n: Column) -> Column:
    """A size with its unit: no decimals for bytes and from 100 on, one from 10 on, else two."""
    n = n.cast("double")
    out = F.when(~F.coalesce((n > 0) & (n < float("inf")) & ~F.isnan(n), F.lit(False)), F.lit("0 B"))
    for i, unit in enumerate(UNITS):
        v = n / float(1024**i)
        digits = F.when((v >= 100) | F.lit(i == 0), F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v))
        here = F.concat(digits.otherwise(F.format_string("%.2f", v)), F.lit(f" {unit}"))
        out = out.otherwise(here) if i == len(UNITS) - 1 else out.when(v < 1024, here)
    return out


def exponential(x: Column, digits: int) -> Column:
    """Scientific form without zeros padded to the exponent."""
    return F.regexp_replace(F.format_string(f"%.{digits}e", x), r"e([+-])0+(\d)", "e$1$2")


def coordinate_text(x: Column) -> Column:
    a = F.abs(x)
    return (
        F.when(a == 0, F.lit("0"))
        .when((a < 0.01) | (a >= 100000), exponential(x, 3))
        .when(a < 1, F.format_string("%.5f", x))
        .when(a < 100, F.format_string("%.4f", x))
        .otherwise(F.format_string("%.2f", x))
    )


def bbox_text(box: Column) -> Column:
    """[xmin, ymin, xmax, ymax]; null for no box."""
    parts = [coordinate_text(box[e]) for e in EDGES]
    return F.when(box.isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")))


def number_text(x: Column) -> Column:
    a = F.abs(x)
    odd = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    grouped = F.regexp_replace(F.format_number(F.round(x, 6), 6), r"\.?0+$", "")  # format_number alone rounds half to even
    return F.coalesce(
        odd,
        F.when((a != 0) & ((a < 1e-4) | (a >= 1e15)), exponential(x, 4))
        .when(x == F.floor(x), F.format_number(x, 0))
        .otherwise(grouped),
    )


def stat_text(s: Column) -> Column:
    """A typed statistic for reading; null for unknown."""
    size = F.length(s["bin"])
    short = lambda t: F.when(F.length(t) > 64, F.concat(F.substring(t, 1, 63), F.lit("…"))).otherwise(t)
    return (
        F.when(s["kind"] == "num", number_text(s["num"]))
        .when(s["kind"] == "int", s["int"].cast("string"))
        .when(s["kind"] == "str", short(s["str"]))
        .when(s["kind"] == "ts", F.date_format(s["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(s["kind"] == "bin", F.when(size <= 32, F.lower(F.hex(s["bin"]))).otherwise(F.concat(F.lit("<"), F.format_number(size, 0), F.lit(" bytes>"))))
        .when(s["kind"] == "bool", s["bool"].cast("string"))
    )


def or_missing(x: Column) -> Column:
    """Text of x; the sign for missing where it is null or empty."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(MISSING))


def grouped(n: Column) -> Column:
    """A whole number with its digits in groups of three; null stays."""
    return F.format_number(n, 0)


def joined(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, F.lit(", "), b), parts)
