"""Building the network: dimensions, incidence, volumes, demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.congestion import beckmann_term, travel_time
from ..functions.sequences import parse_link_sequence
from ..sources.network import Network
from .indexing import dense_index

#: Steps that a task counts, about.
TASK_STEPS = 1_000_000


def link_dim(net: Network) -> DataFrame:
    """``link_idx, link_id``: links in order of their id."""
    return dense_index(net.links.select("link_id"), ["link_id"], "link_idx").select("link_idx", "link_id")


def path_dim(net: Network) -> DataFrame:
    """``path_idx, route_id``: routes in order of their id; routes without links are among them."""
    return dense_index(net.routes.select("route_id"), ["route_id"], "path_idx").select("path_idx", "route_id")


def od_dim(net: Network) -> DataFrame:
    """``od_idx, o_zone_id, d_zone_id``: pairs that own a route, in order."""
    pairs = net.routes.select("o_zone_id", "d_zone_id").distinct()
    return dense_index(pairs, ["o_zone_id", "d_zone_id"], "od_idx").select("od_idx", "o_zone_id", "d_zone_id")


def written_steps(net: Network) -> DataFrame:
    """``route_id, link_id``: a row for each step as the tables have it, unknown routes and links among them."""
    if net.uses is not None:
        return net.uses.select("route_id", "link_id")
    return net.routes.select("route_id", F.explode(parse_link_sequence(F.col("link_seq"))).alias("link_id"))


def steps(net: Network) -> DataFrame:
    """``route_id, link_id``: a row for each step of a route over a known link."""
    own = written_steps(net)
    if net.uses is not None:
        own = own.join(net.routes.select("route_id"), "route_id", "left_semi")
    return own.join(net.links.select("link_id"), "link_id", "left_semi").select("route_id", "link_id")


def multiplicities(net: Network) -> DataFrame:
    """``route_id, link_id, mult``: how often a route uses a link.

    Steps are dealt to as many tasks as their number asks for, so what a task
    counts doesn't grow with the table or with the size of what it reads.
    """
    context = net.links.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-written_steps(net).count() // TASK_STEPS))
    # nearly all steps differ, so they are counted where they are dealt to
    return steps(net).repartition(tasks, "route_id").groupBy("route_id", "link_id").agg(F.count(F.lit(1)).alias("mult"))


def incidence(net: Network) -> DataFrame:
    """``path_idx, link_idx, mult``: the route-link matrix."""
    return multiplicities(net).join(path_dim(net), "route_id").join(link_dim(net), "link_id").select("path_idx", "link_idx", "mult")


def link_volume(net: Network, flows: DataFrame | None = None, column: str = "flow") -> DataFrame:
    """``link_id, volume`` of every link under the routes' flows (``route_id, flow``); 0 where none passes."""
    flows = flows if flows is not None else net.routes.select("route_id", "flow")
    # the joins with flows and links turn unknown routes and links away
    used = written_steps(net).join(flows, "route_id").groupBy("link_id").agg(F.sum(column).cast("double").alias("v"))
    return net.links.select("link_id").join(used, "link_id", "left").select("link_id", F.coalesce("v", F.lit(0.0)).alias("volume"))


def link_bpr(net: Network, volumes: DataFrame | None = None) -> DataFrame:
    """``link_id, volume, travel_time, beckmann`` of every link."""
    volumes = volumes if volumes is not None else link_volume(net)
    v, cap, t0 = F.col("volume"), F.col("capacity"), F.col("t0")
    return net.links.join(volumes, "link_id").select("link_id", "volume", travel_time(v, cap, t0).alias("travel_time"), beckmann_term(v, cap, t0).alias("beckmann"))


def reference_volume(net: Network) -> DataFrame:
    """``link_id, ref_volume``: from the performance table, else the link table, else zeros."""
    given = net.performance
    if given is None and "ref_volume" in net.links.columns:
        given = net.links.select("link_id", "ref_volume")
    if given is None:
        return net.links.select("link_id", F.lit(0.0).alias("ref_volume"))
    return net.links.select("link_id").join(given, "link_id", "left").select("link_id", F.coalesce("ref_volume", F.lit(0.0)).alias("ref_volume"))


def reference_stats(reference: DataFrame) -> DataFrame:
    """One row: least, largest and mean volume, links, zeros, and whether the volumes are too few to use."""
    out = reference.agg(
        F.min("ref_volume").alias("min_volume"), F.max("ref_volume").alias("max_volume"), F.avg("ref_volume").alias("mean_volume"),
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("ref_volume") == 0).alias("n_zero"),
    )
    return out.withColumn("recompute", (F.col("mean_volume") < 0.1) | (F.col("n_zero") > F.lit(0.8) * F.col("n_links")))


def chosen_volume(net: Network) -> DataFrame:
    """``link_id, ref_volume``: the reference volumes, or those of the routes' flows where the former are too few."""
    reference = reference_volume(net)
    both = reference.join(link_volume(net), "link_id").crossJoin(F.broadcast(reference_stats(reference).select("recompute")))  # one row
    return both.select("link_id", F.when(F.col("recompute"), F.col("volume")).otherwise(F.col("ref_volume")).alias("ref_volume"))


def od_inferred(net: Network) -> DataFrame:
    """``o_zone_id, d_zone_id, demand``: the sum of the pair's flows; NaN flows make it NaN, null ones count as 0."""
    return net.routes.groupBy("o_zone_id", "d_zone_id").agg(F.coalesce(F.sum("flow").cast("double"), F.lit(0.0)).alias("demand"))


def od_demand(net: Network) -> DataFrame:
    """``o_zone_id, d_zone_id, demand`` of every pair that owns a route.

    From the demand table, 0 for pairs that it lacks; of repeated rows the last
    one read counts.  Without a table, the sum of flows.
    """
    if net.demand is None:
        return od_inferred(net)
    last = net.demand.withColumn("__at", F.monotonically_increasing_id()).groupBy("o_zone_id", "d_zone_id").agg(F.max_by("demand", "__at").alias("demand"))
    pairs = net.routes.select("o_zone_id", "d_zone_id").distinct()
    return pairs.join(last, ["o_zone_id", "d_zone_id"], "left").select("o_zone_id", "d_zone_id", F.coalesce("demand", F.lit(0.0)).alias("demand"))


def od_counts(net: Network) -> DataFrame:
    """``o_zone_id, d_zone_id, n_paths, is_singleton``"""
    return net.routes.groupBy("o_zone_id", "d_zone_id").agg(F.count(F.lit(1)).alias("n_paths")).withColumn("is_singleton", F.col("n_paths") == 1)


def od_routes(net: Network) -> DataFrame:
    """``o_zone_id, d_zone_id, route_ids``: the pair's routes in order, joined by commas (a report column)."""
    listed = F.array_join(F.sort_array(F.collect_list("route_id")).cast("array<string>"), ",")
    return net.routes.groupBy("o_zone_id", "d_zone_id").agg(listed.alias("route_ids"))


def with_od_counts(net: Network) -> DataFrame:
    """Routes with the number of routes of their pair."""
    return net.routes.join(od_counts(net).select("o_zone_id", "d_zone_id", "n_paths"), ["o_zone_id", "d_zone_id"])
