"""Scalar rules: round trips, sample budgets, bin-width rules, uniforms from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def seconds(ts: str | Column, kind: str) -> Column:
    """Epoch seconds of a timestamp column, reading a zone-less timestamp as UTC in any session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if kind == "timestamp_ntz":
        ts = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.unix_micros(ts) / F.lit(1e6)


def rtt(syn: Column, synack: Column, ack: Column) -> Column:
    """Round trip seen from the middle: server side plus twice half of the client side."""
    return (synack - syn) + F.lit(2.0) * ((ack - synack) / F.lit(2.0))


def min_samples(epsilon: float, delta: float) -> Column:
    """Fewest samples for accuracy epsilon with failure probability delta."""
    return F.lit(2.0) / F.lit(epsilon * epsilon) * F.log(F.lit(2.0) / F.lit(delta))


def outcome_budget(n: Column, epsilon: float) -> Column:
    """Outcomes that n samples can support. A lower epsilon gives fewer."""
    return F.floor(n * F.lit(epsilon * epsilon)).cast("long")


def integer_root(value: Column, degree: Column) -> Column:
    """Largest r with r ** degree <= value.

    Searched among the integers around the floating root, because engines disagree on the floor of the
    floating cube root of perfect cubes.
    """
    guess = F.floor(F.pow(value.cast("double"), F.lit(1.0) / degree) + F.lit(0.5)).cast("long")
    return F.when(F.pow(guess.cast("double"), degree) <= value, guess).otherwise(guess - 1)


def isqrt(value: Column) -> Column:
    return integer_root(value, F.lit(2))


def freedman_diaconis(lo: Column, hi: Column, n: Column, iqr: Column) -> Column:
    """Bin count by the Freedman-Diaconis rule, 1 for no spread."""
    width = F.lit(2.0) * iqr * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
    return F.when((iqr == 0) | (lo == hi), F.lit(1)).otherwise(F.ceil((hi - lo) / width)).cast("long")


def scott(lo: Column, hi: Column, domain_min: float, n: Column, sigma: Column) -> Column:
    """Bin count by Scott's rule. The zero test looks at the domain minimum, not at the lower bound."""
    width = F.lit(3.49) * sigma * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
    flat = (sigma <= 0) | (hi == F.lit(domain_min))
    return F.when(flat, F.lit(1)).otherwise(F.ceil((hi - lo) / width)).cast("long")


def ln1p(x: Column) -> Column:
    """ln(1 + x), written out so that other engines give the same digits."""
    return F.log(F.lit(1.0) + x)


def uniform(*parts: str | int | Column) -> Column:
    """A number in [0, 1) fixed by its arguments: 52 bits of an md5, as many as a double holds exactly.

    The same on any partitioning and on every retry, unlike a random generator per partition.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def snapped(x: Column) -> Column:
    """Values within 1e-9 of an integer become that integer."""
    return F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x)).otherwise(x)
