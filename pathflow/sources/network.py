"""Network tables from CSV or Parquet files, or derived from a star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.congestion import free_flow_minutes
from . import aliases

TYPES = {
    "link_id": "long", "capacity": "double", "length": "double", "speed": "double", "ref_volume": "double", "route_id": "long",
    "link_seq": "string", "flow": "double", "o_zone_id": "long", "d_zone_id": "long", "demand": "double", "node_id": "long", "zone_id": "long", "x_coord": "double", "y_coord": "double",
}


@dataclass
class Network:
    """Canonical tables.

    ``links``: link_id, capacity, length, speed, t0 [, ref_volume];
    ``routes``: route_id, o_zone_id, d_zone_id, flow [, link_seq];
    ``demand``: o_zone_id, d_zone_id, demand, or None;
    ``performance``: link_id, ref_volume, or None;
    ``uses``: route_id, link_id, a row for each step of a route, or None where
    ``link_seq`` holds the steps as text.
    """

    links: DataFrame
    routes: DataFrame
    demand: DataFrame | None = None
    performance: DataFrame | None = None
    uses: DataFrame | None = None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever file system it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text, or a Parquet file."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True)


def checked_links(links: DataFrame) -> DataFrame:
    """Links with free-flow times; a capacity that isn't above zero is an error when the row is read."""
    checked = links.withColumn("capacity", F.when(F.col("capacity") > 0, F.col("capacity")).otherwise(F.raise_error(F.concat(F.lit("capacity of link "), F.coalesce(F.col("link_id").cast("string"), F.lit("null")), F.lit(" is not above zero"))).cast("double")))
    return checked.withColumn("t0", free_flow_minutes(F.col("length"), F.col("speed")))


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, or an error if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {key} {twice[0][0]} occurs more than once")
    return df


def beside(path: str, name: str) -> str:
    """A file of another name in the same folder."""
    return path[: path.rstrip("/").rfind("/") + 1] + name


def read_network(spark: SparkSession, links: str, routes: str, demand: str | None = None, performance: str | None = None) -> Network:
    """Read a network.

    A demand file that is named must be there.  Without ``performance`` the file
    ``link_performance_ue.csv`` beside the links serves if there is one; a
    performance file that isn't there counts as not given.  Route and zone ids
    are whole numbers (also written ``0.0``); where any is not, they are text,
    zones alike in routes and demand.
    """
    raw = read_table(spark, links)
    link = aliases.canonical(raw, aliases.LINK, TYPES, "links")
    have = {c.lower() for c in raw.columns}
    if any(n in have for n in aliases.LINK_VOLUME):
        named = aliases.LINK | {"ref_volume": aliases.LINK_VOLUME}
        link = aliases.canonical(raw, named, TYPES, "links")
    link = require_unique(checked_links(link), "link_id", "links")
    raw = read_table(spark, routes)
    zones = {c: aliases.find_column(raw, aliases.ROUTE[c], "routes") for c in ("o_zone_id", "d_zone_id")}
    kinds = [aliases.identifier(raw, *zones.values())]
    given = None
    if demand:
        given = read_table(spark, demand)
        kinds.append(aliases.identifier(given, *(aliases.find_column(given, aliases.DEMAND[c], "demand") for c in zones)))
    zone = "string" if "string" in kinds else "long"
    types = TYPES | {"o_zone_id": zone, "d_zone_id": zone, "route_id": aliases.identifier(raw, aliases.find_column(raw, aliases.ROUTE["route_id"], "routes"))}
    route = require_unique(aliases.canonical(raw, aliases.ROUTE, types, "routes"), "route_id", "routes")
    wanted = None if given is None else aliases.canonical(given, aliases.DEMAND, types, "demand")
    perf = None
    performance = performance or beside(links, "link_performance_ue.csv")
    if exists(spark, performance):
        raw = read_table(spark, performance)
        aliases.find_column(raw, aliases.LINK["link_id"], "performance")
        if any(n in {c.lower() for c in raw.columns} for n in aliases.PERFORMANCE_VOLUME):
            names = {"link_id": aliases.LINK["link_id"], "ref_volume": aliases.PERFORMANCE_VOLUME}
            perf = aliases.canonical(raw, names, TYPES, "performance")  # without a volume column the link table serves
    return Network(link, route, wanted, perf)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, zone_id, x_coord, y_coord``; blanks are null."""
    names = {c: (c,) for c in ("node_id", "zone_id", "x_coord", "y_coord")}
    return aliases.canonical(read_table(spark, path), names, TYPES, "nodes")


def network_from_star(spark: SparkSession, sf_dir: str) -> Network:
    """The network that the order tables describe: parts are links, orders routes, their items the links that they use."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    links = read("part").select(
        F.col("p_partkey").alias("link_id"),
        (F.lit(1000) + F.lit(200) * F.col("p_size")).cast("double").alias("capacity"),
        (F.col("p_retailprice") / F.lit(100.0)).alias("length"),
        (F.lit(20) + F.col("p_size")).cast("double").alias("speed"),
    )
    flow = F.expr("cast(cast(o_totalprice as decimal(18,2)) * cast(0.001 as decimal(4,3)) as decimal(18,5))")
    customers = read("customer").select("c_custkey", "c_nationkey")
    routes = (
        read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("route_id"), F.col("c_nationkey").cast("long").alias("o_zone_id"), F.col("o_custkey").alias("d_zone_id"), flow.alias("flow"))
    )
    uses = read("lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_partkey").alias("link_id"))
    demand = routes.where("d_zone_id % 7 <> 0").groupBy("o_zone_id", "d_zone_id").agg((F.sum("flow") * F.expr("cast(1.1 as decimal(2,1))")).cast("double").alias("demand"))
    performance = read("lineitem").groupBy(F.col("l_partkey").alias("link_id")).agg(F.sum("l_quantity").alias("ref_volume"))
    return Network(checked_links(links), routes, demand, performance, uses)
