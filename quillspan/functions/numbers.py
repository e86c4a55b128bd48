"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half up by floor, the same arithmetic in every engine (no decimal text in between)."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def half_up_sql(x: str, digits: int = 0) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.5::DOUBLE) / {scale})"


def ramp(v: Column, low: float, high: float, invert: bool = False) -> Column:
    """0-100 score: clamped position between low and high (low > high counts down), one decimal; 0 when they are equal."""
    if low == high:
        return F.lit(0.0)
    x = F.least(F.greatest((v - F.lit(float(low))) / F.lit(float(high) - float(low)), F.lit(0.0)), F.lit(1.0))
    return half_up((F.lit(1.0) - x if invert else x) * 100.0, 1)


def ramp_sql(v: str, low: float, high: float, invert: bool = False) -> str:
    if low == high:
        return "0.0::DOUBLE"
    x = f"least(greatest((({v}) - {float(low)!r}::DOUBLE) / ({float(high)!r}::DOUBLE - {float(low)!r}::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
    return half_up_sql(f"(1.0::DOUBLE - {x}) * 100.0::DOUBLE" if invert else f"{x} * 100.0::DOUBLE", 1)


def ladder(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step (highest first) whose threshold ``c`` reaches."""
    out = None
    for threshold, value in steps:
        out = (F if out is None else out).when(c >= threshold, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def safe_int(c: Column) -> Column:
    """Whole number of a text, truncated; 0 when it is none."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(c: Column, digits: int = 2) -> Column:
    return F.coalesce(half_up(c.try_cast("double"), digits), F.lit(0.0))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def rating(c: Column) -> Column:
    """Clamped to 1-5; 5 when it is no number."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(5.0)), F.lit(1.0)), F.lit(5.0))


def token_cost(model: Column, in_tokens: Column, out_tokens: Column, prices: dict[str, tuple[float, float]], currency: float = 1.0) -> Column:
    """Price per million input and output tokens by model; null for unknown models."""
    out = None
    for name, (p_in, p_out) in prices.items():
        cost = (in_tokens / 1e6 * p_in + out_tokens / 1e6 * p_out) * currency
        out = (F if out is None else out).when(model == name, cost)
    return out
