"""Column helpers for ratios, clipping, rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two 26-bit halves


def lit_double(value) -> Column:
    return F.lit(float(value))


def ratio(numerator: Column, denominator: Column, otherwise=0.0) -> Column:
    """``numerator / denominator``, or ``otherwise`` where the denominator is 0 or null."""
    fallback = otherwise if isinstance(otherwise, Column) else lit_double(otherwise)
    safe = F.when(denominator != 0, denominator.cast("double"))
    return F.coalesce(numerator.cast("double") / safe, fallback.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(lit_double(low), F.least(lit_double(high), value))


def normalized(value: Column, cap: float) -> Column:
    """``value`` as a share of ``cap`` on 0-100, clipped at both ends."""
    if cap <= 0:
        return lit_double(0.0)
    return clip(value.cast("double") / lit_double(cap) * lit_double(100.0), 0.0, 100.0)


def _rounded_sql(x: str, digits: int) -> str:
    scale = f"{float(10**digits)!r}D"
    scaled = f"({x} * {scale})"
    high = f"({x} * {_SPLITTER!r}D - ({x} * {_SPLITTER!r}D - {x}))"
    error = f"(({high} * {scale} - {scaled}) + ({x} - {high}) * {scale})"
    floor = f"CAST(floor({scaled}) AS DOUBLE)"
    tie = f"CASE WHEN {error} > 0 THEN {floor} + 1D WHEN {error} < 0 THEN {floor} ELSE {floor} + pmod({floor}, 2D) END"
    return f"CASE WHEN {scaled} - {floor} = 0.5D THEN {tie} ELSE rint({scaled}) END / {scale}"


def round_exact(name: str, digits: int) -> Column:
    """Round the stored binary value of a column to ``digits`` (0-8) places, ties to even.

    ``bround`` looks at the decimal text of a double, so 0.00625 counts as a
    tie although the stored value lies above it. Here the scaled value decides,
    and only where it looks like a tie the exact error of the product does.
    """
    return F.expr(_rounded_sql(name, digits))


def round_scaled(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (array rounding)."""
    scale = lit_double(10**digits)
    return F.rint(value * scale) / scale


def fixed_text(name: str, digits: int) -> Column:
    return F.expr(f"format_string('%.{digits}f', {_rounded_sql(name, digits)})")


def percent_text(name: str, digits: int = 0) -> Column:
    return F.expr(f"format_string('%.{digits}f%%', {_rounded_sql(f'({name} * 100D)', digits)})")


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def kept(*conditional: Column) -> Column:
    """The non-null entries, in order, as an array of strings."""
    return F.array_compact(F.array(*conditional))
