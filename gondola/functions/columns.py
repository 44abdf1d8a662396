"""Column expressions: calendar arithmetic, rounding, percent change, hashed draws.

The draws are functions of a seed and of row keys, so a row gets the same value
however the data is partitioned and however often a lost task is run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_index(day: Column) -> Column:
    """Months since year 0; differences count month boundaries, not elapsed months."""
    return (F.year(day) * 12 + F.month(day)).cast("long")


def month_diff(start: Column, end: Column) -> Column:
    return month_index(end) - month_index(start)


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_number(day: Column) -> Column:
    """Year and month as one integer, e.g. 202403."""
    return F.year(day) * 100 + F.month(day)


def money(amount: Column) -> Column:
    """Exact decimal to double, at the four decimals the source tables carry."""
    return F.round(amount, 4).cast("double")


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double half away from zero, in plain double arithmetic."""
    scale = float(10 ** digits)
    scaled = F.abs(value) * scale
    # From 2^52 on a double has no fraction left to round.
    rounded = F.signum(value) * F.floor(scaled + 0.5) / scale
    return F.when(scaled < float(2 ** 52), rounded).otherwise(value)


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double, ties to the even neighbour, as figures for display are rounded."""
    scale = float(10 ** digits)
    # From 2^52 on a double has no fraction left to round.
    return F.when(F.abs(value) * scale < float(2 ** 52), F.rint(value * scale) / scale).otherwise(value)


def settled(value: Column, digits: int) -> Column:
    """Round a sum of doubles; three decimals more first, to be rid of its summing noise.

    Without that a value half way between two results would go either way, by the order
    in which tasks happened to add. With two digits this holds up to about 4.5e10.
    """
    return round_half_even(round_half_even(value, digits + 3), digits)


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change to two decimals; null where there is nothing to compare with."""
    return F.when(previous > 0, round_half_even((current - previous) / previous * 100, 2))


def ratio(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def hash_key(seed: int, *keys) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def hash_uniform(seed: int, *keys) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    bits = F.shiftrightunsigned(hash_key(seed, *keys), 11)
    return (bits + 0.5) / float(2 ** 53)


def hash_normal(seed: int, *keys) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    radius = F.sqrt(-2.0 * F.log(hash_uniform(seed, F.lit("radius"), *keys)))
    return radius * F.cos(2.0 * math.pi * hash_uniform(seed, F.lit("angle"), *keys))


def hash_beta(alpha: float, seed: int, *keys, tries: int = 64) -> Column:
    """Symmetric Beta(alpha, alpha) draw.

    Over one half, in closed form: with S uniform and an angle uniform,
    1/2 + 1/2 sin(angle) sqrt(1 - S^(2 / (2 alpha - 1))) has this distribution (the polar
    method without its rejection). Otherwise by Joehnk's rejection method; a pair is
    accepted with probability 0.785 at least, so ``tries`` refusals in a row (1e-42) do
    not happen.
    """
    if alpha <= 0:
        raise ValueError(f"alpha must be over 0, not {alpha}")
    if alpha > 0.5:
        angle = 2.0 * math.pi * hash_uniform(seed, F.lit("angle"), *keys)
        radius = F.pow(hash_uniform(seed, F.lit("radius"), *keys), F.lit(2.0 / (2.0 * alpha - 1.0)))
        return 0.5 + 0.5 * F.sin(angle) * F.sqrt(1.0 - radius)

    def attempt(i: Column) -> Column:
        x = F.pow(hash_uniform(seed, F.lit("x"), i, *keys), F.lit(1.0 / alpha))
        y = F.pow(hash_uniform(seed, F.lit("y"), i, *keys), F.lit(1.0 / alpha))
        return F.when((x + y <= 1.0) & (x + y > 0.0), x / (x + y))

    draws = F.transform(F.sequence(F.lit(1), F.lit(tries)), attempt)
    return F.get(F.array_compact(draws), F.lit(0))
