"""The two-corridor sample network: six parallel links, one OD pair."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.network import Network, checked_links

# Lengths in miles, capacities, and the flows of the equilibrium.
LENGTHS = (10.0, 11.0, 12.0, 20.0, 21.0, 22.0)
CAPACITIES = (400.0, 400.0, 400.0, 50.0, 50.0, 50.0)
FLOWS = (669.8486989502824, 639.7512112249042, 610.957645985739, 43.98500995276579, 35.45743388630843, 0.0)
SPEED, DEMAND = 60.0, 2000.0


def two_corridor(spark: SparkSession) -> Network:
    links = spark.createDataFrame([(i + 1, c, n, SPEED) for i, (c, n) in enumerate(zip(CAPACITIES, LENGTHS, strict=True))], "link_id long, capacity double, length double, speed double")
    routes = spark.createDataFrame([(i, 1, 2, f, str(i + 1)) for i, f in enumerate(FLOWS)], "route_id long, o_zone_id long, d_zone_id long, flow double, link_seq string")
    return Network(checked_links(links), routes, spark.createDataFrame([(1, 2, DEMAND)], "o_zone_id long, d_zone_id long, demand double"))
