"""Link performance (BPR) and equilibrium expressions.

``v`` volume, ``cap`` capacity, ``t0`` free-flow minutes; capacities above zero
are the reader's promise (see ``sources.network.checked_links``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA, BETA = 0.15, 4.0


def free_flow_minutes(length: Column, speed: Column) -> Column:
    """60 * length / max(speed, 1); null where the speed is."""
    return F.when(speed.isNotNull(), F.lit(60.0) * length / F.greatest(speed, F.lit(1.0)))


def travel_time(v: Column, cap: Column, t0: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """t0 * (1 + alpha * (v / cap) ** beta)"""
    return t0 * (F.lit(1.0) + F.lit(alpha) * F.pow(v / cap, F.lit(beta)))


def congestion_delay(v: Column, cap: Column, t0: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """The part of the travel time above free flow."""
    return t0 * F.lit(alpha) * F.pow(v / cap, F.lit(beta))


def beckmann_term(v: Column, cap: Column, t0: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Integral of the travel time from 0 to v."""
    return t0 * v + t0 * cap * F.lit(alpha / (beta + 1)) * F.pow(v / cap, F.lit(beta + 1))


def positive_part(mu: Column, c: float, u: Column) -> Column:
    """max(0, mu - c * u)"""
    return F.greatest(F.lit(0.0), mu - F.lit(c) * u)


def depth_below_zero(u: Column) -> Column:
    """-min(u, 0)"""
    return F.abs(F.least(u, F.lit(0.0)))


def percent_error(predicted: Column, wanted: Column, least: float = 0.001) -> Column:
    """100 * |predicted - wanted| / wanted, 0 where what is wanted is negligible."""
    return F.when(wanted > least, F.lit(100.0) * F.abs(predicted - wanted) / wanted).otherwise(F.lit(0.0))
