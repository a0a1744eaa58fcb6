"""Small Catalyst expression builders.  Nothing here touches data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst merges neighbouring projections, so a computed array that is read
    inside a lambda would be rebuilt for every element.  A lambda variable
    bound to a one-element array keeps it to one evaluation per row.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def int_div(a: Column, b: Column | int) -> Column:
    """Truncating integer division."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, divisor)


def to_int(value: Column) -> Column:
    return value.cast("int")


def clamp(value: Column, low: int | float | Column, high: int | float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def clamp_byte(value: Column) -> Column:
    """Round half away from zero, then limit to 0..255.

    ``floor(x + 0.5)`` only differs from half-away rounding below zero, where
    the lower limit wins anyway.
    """
    return to_int(clamp(F.floor(value + F.lit(0.5)), 0, 255))


def half_away(value: Column) -> Column:
    """Round half away from zero without leaving double arithmetic."""
    return let(
        value,
        lambda v: F.when(v >= 0, F.floor(v + F.lit(0.5))).otherwise(F.ceil(v - F.lit(0.5))),
    )


def luma(red: Column, green: Column, blue: Column) -> Column:
    """BT.601 luma in 8-bit fixed point."""
    return F.shiftright(red * 77 + green * 150 + blue * 29, 8)


def indices(count: Column) -> Column:
    """``[0 .. count-1]``; an empty array when ``count`` is zero."""
    return F.when(count > 0, F.sequence(F.lit(0), to_int(count) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def array_total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, v: acc + v.cast(kind))


def literal_structs(rows: Sequence[dict]) -> Column:
    """A fixed small catalog as one literal array of structs.

    Used where a lookup needs predicates rather than equality: the catalog
    travels inside the expression, so no join and no shuffle is planned.
    """
    return F.array(
        *[
            F.struct(
                *[
                    (F.array(*[F.lit(i) for i in v]) if isinstance(v, (list, tuple)) else F.lit(v)).alias(k)
                    for k, v in row.items()
                ]
            )
            for row in rows
        ]
    )
