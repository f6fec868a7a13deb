"""Repeated products with one incidence: layouts that join without moving it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.network import Network
from .network import multiplicities


@dataclass
class Layouts:
    """The incidence as two tables, in buckets of its routes and of its links.

    A product joins vectors of routes or links to the layout in buckets of their
    key: the vector moves to the buckets, the incidence is read where it lies,
    and what moves afterwards are sums.  An iteration that forms many products so
    shuffles vectors alone.
    """

    spark: SparkSession
    by_route: str
    by_link: str
    buckets: int

    @classmethod
    def of(cls, net: Network, buckets: int | None = None) -> Layouts:
        """Write both layouts as tables of the warehouse; ``buckets`` is by default the number of shuffle partitions."""
        spark = net.links.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"pathflow_{uuid.uuid4().hex}"
        entries = multiplicities(net)
        out = cls(spark, f"{name}_routes", f"{name}_links", n)
        for table, key in ((out.by_route, "route_id"), (out.by_link, "link_id")):
            entries.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(table)
            entries = spark.table(out.by_route)  # the second is made from the first
        return out

    def link_sums(self, routes: DataFrame, column: str = "flow") -> DataFrame:
        """``link_id, total``: a column of the routes (``route_id``) summed over the links that they use."""
        value = routes.select("route_id", F.col(column).cast("double").alias("v")).repartition(self.buckets, "route_id")
        return self.spark.table(self.by_route).join(value.hint("merge"), "route_id").groupBy("link_id").agg(F.sum(F.col("mult") * F.col("v")).alias("total"))

    def route_sums(self, links: DataFrame, column: str = "travel_time") -> DataFrame:
        """``route_id, total``: a column of the links (``link_id``) summed along the routes."""
        value = links.select("link_id", F.col(column).cast("double").alias("v")).repartition(self.buckets, "link_id")
        return self.spark.table(self.by_link).join(value.hint("merge"), "link_id").groupBy("route_id").agg(F.sum(F.col("mult") * F.col("v")).alias("total"))

    def drop(self) -> None:
        """Delete both tables."""
        for table in (self.by_route, self.by_link):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
