"""Circular and calendar column expressions. All angles are degrees unless said otherwise; every function is lazy and JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY_FIRST = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def modulo(x: Column, period: float) -> Column:
    """Floored modulo in [0, period); Spark's % keeps the sign. Rounds like the SQL form, as bins and the wrap to 0 hang on the last bit."""
    p = F.lit(float(period))
    return (x % p + p) % p


def sin_cos(x: Column, period: float, origin: float = 0.0) -> tuple[Column, Column]:
    theta = 2 * F.pi() * (x - F.lit(float(origin))) / F.lit(float(period))
    return F.sin(theta), F.cos(theta)


def signed_separation(a: Column, b: Column) -> Column:
    """b ahead of a, in [0, 360)."""
    return modulo(b - a, 360)


def circular_distance(a: Column, b: Column) -> Column:
    """Shortest way round, in [0, 180]; differences below 360 are taken as they are, to the last bit."""
    d = F.abs(a - b) % F.lit(360.0)
    return F.least(d, 360 - d)


def folded_elongation(e: Column) -> Column:
    return F.abs(modulo(e + 180, 360) - 180)


def antipode(x: Column) -> Column:
    return modulo(x + 180, 360)


def level_index(x: Column, order: Sequence[str]) -> Column:
    """0-based place of x in the declared order; an unknown or null level raises."""
    at = F.array_position(F.array(*map(F.lit, order)), x)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("undeclared level: "), F.coalesce(x, F.lit("null"))))).otherwise(at - 1).cast("int")


def weekday_index(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def sector(x: Column, width: float, count: int) -> Column:
    return F.pmod(F.floor(x / F.lit(float(width))), F.lit(count))


def lunar_bin(ahead: Column, behind: Column, bins: int = 30) -> Column:
    """1-based bin of the separation."""
    return F.floor(modulo(ahead - behind, 360) / F.lit(360.0 / bins)) + 1


def triangular_ramp(x: Column, period: float) -> Column:
    """1 in the middle of each period, 0 at its ends."""
    half = F.lit(period / 2)
    return 1 - F.abs(modulo(x, period) - half) / half


def cosine_strength(x: Column, peak: float, middle: float = 75.0, swing: float = 25.0) -> Column:
    return middle + swing * F.cos(F.radians(x - F.lit(float(peak))))


def clipped_ramp(x: Column, low: Column, high: float) -> Column:
    """0 at low, 100 at high, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (x - low) / (F.lit(float(high)) - low)))


def conditional_line(flag: Column, x: Column, slope: float, intercept: float) -> Column:
    """slope * x + intercept where flag holds, 0 elsewhere and where flag is null."""
    return F.when(flag, F.lit(float(slope)) * x + F.lit(float(intercept))).otherwise(0.0)


def lookup(x: Column, table: Mapping[str, float]) -> Column:
    """Value of a fixed table; an absent key raises, a null stays null."""
    pairs = F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])
    return F.when(x.isNotNull(), F.coalesce(F.try_element_at(pairs, x), F.raise_error(F.concat(F.lit("no entry for "), x.cast("string"))).cast("double")))


def dignity_ramp(x: Column, width: float, count: int, weights: Sequence[float]) -> Column:
    """A sector's weight times the triangular ramp inside it; weights by sector."""
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), (sector(x, width, count) + 1).cast("int"))
    return w * triangular_ramp(x, width)


def off_unit_circle(s: Column, c: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(F.hypot(s, c) - 1) > tolerance


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)
