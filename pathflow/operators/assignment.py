"""Flows spread over routes, accuracy against the reference, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.congestion import congestion_delay, depth_below_zero, percent_error, positive_part, travel_time
from ..sources.network import Network
from .classes import OD
from .network import link_volume, multiplicities, od_counts, od_demand, with_od_counts

TINY = 1e-10


def proportional_assignment(net: Network, classes: DataFrame | None = None) -> DataFrame:
    """``route_id, o_zone_id, d_zone_id, flow``: a pair's demand spread evenly over its major routes (all routes without classes)."""
    pairs = od_demand(net)
    if classes is None:
        part = F.col("demand") / F.col("n_paths")
        return with_od_counts(net).join(pairs, list(OD)).select("route_id", *OD, part.alias("flow"))
    # majors are counted before the shuffle and joined back, so a pair of very many routes meets in no task
    majors = classes.groupBy(*OD).agg(F.count_if(F.col("class") == "major").alias("n_major"))
    shares = pairs.join(majors, list(OD))
    part = F.when(F.col("class") == "singleton", F.col("demand")).when(F.col("class") == "major", F.col("demand") / F.col("n_major")).otherwise(0.0)
    return classes.select("route_id", *OD, "class").join(shares, list(OD)).select("route_id", *OD, part.alias("flow"))


def od_flow(assigned: DataFrame) -> DataFrame:
    """``o_zone_id, d_zone_id, flow``: sums of route flows."""
    return assigned.groupBy(*OD).agg(F.sum("flow").cast("double").alias("flow"))


def accuracy(pairs: DataFrame, predicted: Column, reference: Column) -> DataFrame:
    """One row ``n, mae, rmse, r2``; r2 = 1 - SSE / (SST + 1e-10)."""
    both = pairs.select(predicted.cast("double").alias("p"), reference.cast("double").alias("r"))
    off = F.col("p") - F.col("r")
    out = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.sum(off * off).alias("sse"), (F.var_pop("r") * F.count("r")).alias("sst")
    )
    return out.select("n", "mae", "rmse", (F.lit(1.0) - F.col("sse") / (F.col("sst") + F.lit(TINY))).alias("r2"))


def link_accuracy(net: Network, assigned: DataFrame) -> DataFrame:
    """Accuracy of link volumes against those of the reference flows."""
    predicted = link_volume(net, assigned.select("route_id", "flow"))
    both = predicted.join(link_volume(net).withColumnRenamed("volume", "ref"), "link_id")
    return accuracy(both, F.col("volume"), F.col("ref"))


def travel_time_accuracy(net: Network, assigned: DataFrame) -> DataFrame:
    """Accuracy of congestion delays."""
    predicted = link_volume(net, assigned.select("route_id", "flow"))
    both = net.links.join(predicted, "link_id").join(link_volume(net).withColumnRenamed("volume", "ref"), "link_id")
    return accuracy(both, congestion_delay(F.col("volume"), F.col("capacity"), F.col("t0")), congestion_delay(F.col("ref"), F.col("capacity"), F.col("t0")))


def path_accuracy(net: Network, assigned: DataFrame, classes: DataFrame) -> DataFrame:
    """Accuracy of route flows by class: ``class, n, mae, rmse``."""
    both = assigned.select("route_id", F.col("flow").alias("p")).join(classes.select("route_id", "class", F.col("flow").cast("double").alias("r")), "route_id")
    off = F.col("p") - F.col("r")
    return both.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))


def od_errors(net: Network, assigned: DataFrame) -> DataFrame:
    """``o_zone_id, d_zone_id, flow, demand, violation, pct_error`` of the pairs with several routes."""
    several = od_counts(net).where("n_paths > 1").select(*OD)
    both = od_flow(assigned).join(several, list(OD), "left_semi").join(od_demand(net), list(OD))
    return both.select(*OD, "flow", "demand", (F.col("flow") - F.col("demand")).alias("violation"), percent_error(F.col("flow"), F.col("demand")).alias("pct_error"))


def od_accuracy(errors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row over pair errors: n_od, max and mean violation, n_violated, mean percent error."""
    size = F.abs(F.col("violation"))
    return errors.agg(
        F.count(F.lit(1)).alias("n_od"), F.max(size).alias("max_violation"), F.avg(size).alias("mean_violation"), F.count_if(size > tolerance).alias("n_violated"), F.avg("pct_error").alias("mean_pct_error")
    )


def worst_pairs(errors: DataFrame, n: int = 5) -> DataFrame:
    """The n pairs of the largest violation."""
    return errors.orderBy(F.abs(F.col("violation")).desc(), *OD).limit(n)


def link_deviation(net: Network, assigned: DataFrame) -> DataFrame:
    """One row: links, congested ones (reference above half the capacity) and their MAE, links off by over 10 %, largest deviation."""
    both = net.links.join(link_volume(net, assigned.select("route_id", "flow")), "link_id").join(link_volume(net).withColumnRenamed("volume", "ref"), "link_id")
    off = F.col("volume") - F.col("ref")
    busy = F.col("ref") > F.lit(0.5) * F.col("capacity")
    return both.agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(busy).alias("n_congested"), F.avg(F.when(busy, F.abs(off))).alias("congested_mae"),
        F.count_if(F.abs(F.lit(100.0) * off / (F.col("ref") + F.lit(TINY))) > 10).alias("n_over_10pct"), F.max(F.abs(off)).alias("max_abs_error"),
    )


def path_gradient(net: Network, assigned: DataFrame, dual: float = 1000.0) -> DataFrame:
    """``route_id, gradient``: the route's travel time plus ``dual`` times its pair's violation."""
    v = link_volume(net, assigned.select("route_id", "flow"))
    times = net.links.join(v, "link_id").select("link_id", travel_time(F.col("volume"), F.col("capacity"), F.col("t0")).alias("tt"))
    cost = multiplicities(net).join(times, "link_id").groupBy("route_id").agg(F.sum(F.col("mult") * F.col("tt")).alias("cost"))
    wrong = od_flow(assigned).join(od_demand(net), list(OD)).select(*OD, (F.lit(dual) * (F.col("flow") - F.col("demand"))).alias("pull"))
    return assigned.join(cost, "route_id", "left").join(wrong, list(OD)).select("route_id", (F.coalesce("cost", F.lit(0.0)) + F.col("pull")).alias("gradient"))


def kkt_projection(flows: DataFrame, u: Column, mu: Column, c: float) -> DataFrame:
    """``route_id, u, mu_next, depth``: the multiplier step of the non-negativity penalty and the depth below zero."""
    return flows.select("route_id", u.alias("u"), positive_part(mu, c, u).alias("mu_next"), depth_below_zero(u).alias("depth"))


def negative_flows(flows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row on ``u`` below -tolerance: count, least, mean, largest depth."""
    low = F.col("u") < -tolerance
    return flows.agg(F.count_if(low).alias("n_negative"), F.min(F.when(low, F.col("u"))).alias("min_u"), F.avg(F.when(low, F.col("u"))).alias("mean_u"), F.max(F.when(low, -F.col("u"))).alias("max_depth"))


def lowest_flows(flows: DataFrame, n: int = 3) -> DataFrame:
    """The n lowest u."""
    return flows.orderBy("u", "route_id").limit(n)
