"""Tick values for the axes of a report."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(low: float, high: float, most: int = 8) -> list[float]:
    """Multiples of 1, 2 or 5 times a power of ten within the range, ``most`` at most."""
    if not high > low:
        return [low]
    step = 10.0 ** math.floor(math.log10((high - low) / most))
    step = next(step * k for k in (1, 2, 5, 10, 20) if (high - low) / (step * k) <= most - 1)
    first = math.ceil(low / step - 1e-9)
    return [round(step * k, 12) for k in range(first, math.floor(high / step + 1e-9) + 1)]


def logarithmic(low: float, high: float) -> list[float]:
    """1, 2 and 5 times the powers of ten within a positive range."""
    if low <= 0 or high < low:
        raise ValueError("a logarithmic axis needs a positive range")
    powers = range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1)
    return [v for p in powers for k in (1, 2, 5) if low * (1 - 1e-9) <= (v := round(k * 10.0**p, 12)) <= high * (1 + 1e-9)]


def linear_ticks(low: Column, high: Column, most: int = 8) -> Column:
    """``linear`` as an expression, for an axis in each row."""
    unit = F.pow(F.lit(10.0), F.floor(F.round(F.log10((high - low) / most), 9)))
    step = F.coalesce(*(F.when((high - low) / (unit * k) <= most - 1, unit * k) for k in (1, 2, 5, 10, 20)))
    places = F.sequence(F.ceil(low / step - 1e-9).cast("bigint"), F.floor(high / step + 1e-9).cast("bigint"))
    return F.when(high > low, F.transform(places, lambda k: F.round(k * step, 9))).otherwise(F.array(low))
