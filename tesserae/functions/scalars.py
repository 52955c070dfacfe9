"""Scalar helpers: lenient numbers, truthiness, boxes, angles, seeds, model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x + 0.0)


def safe_number(value: Column, default: float = 0.0) -> Column:
    """A finite number; anything else, unreadable text included, is ``default``."""
    return F.coalesce(finite(value.try_cast("double")), F.lit(default))


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor '' nor, for numbers, 0; else the last one as it is."""
    out = values[-1]
    for v in reversed(values[:-1]):
        text = v.cast("string")
        zero = F.coalesce(text.try_cast("double") == 0, F.lit(False))
        out = F.when(v.isNotNull() & (text != "") & ~zero, v).otherwise(out)
    return out


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def angle_difference(a: Column, b: Column) -> Column:
    """Least turn between two undirected directions, in degrees (0 to 90)."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90)


def stable_seed(text: Column) -> Column:
    """A number from the first eight hex digits of the SHA-256 of the quoted text."""
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return F.conv(F.substring(F.sha2(quoted, 256), 1, 8), 16, 10).cast("bigint")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clipped_box(b: Column, width: Column, height: Column) -> Column:
    """Corners put in order and inside the image; half-open."""
    side = lambda p, q, top: (F.least(F.greatest(F.least(b[p], b[q]), F.lit(0)), top), F.least(F.greatest(F.greatest(b[p], b[q]), F.lit(0)), top))
    (x1, x2), (y1, y2) = side("x1", "x2", width), side("y1", "y2", height)
    return box(x1, y1, x2, y2)


def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def box_state(b: Column, width: Column, height: Column, least: float = 0.0001, most: float = 0.72, aspect: float = 25.0) -> Column:
    """ok, empty, too_small, too_large or too_thin."""
    w, h = (b["x2"] - b["x1"]).cast("double"), (b["y2"] - b["y1"]).cast("double")
    share = w * h / (width * height)
    return (
        F.when((w <= 0) | (h <= 0), "empty")
        .when(share < least, "too_small")
        .when(share > most, "too_large")
        .when(F.greatest(w / h, h / w) > aspect, "too_thin")
        .otherwise("ok")
    )


def answered_json(text: Column) -> Column:
    """The outermost braces of a model's answer, as text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def reasons(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in the order given; one that is null does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named]))
