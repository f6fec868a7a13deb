"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assignment as asg
from .operators import classes as cls
from .operators import linalg
from .operators import network as nw
from .operators.layouts import Layouts
from .operators.spread import Spread
from .plans import alm, fixtures
from .plans.config import Config
from .sources.network import Network, network_from_star
from .sources.store import stored

Query = Callable[[SparkSession, str], DataFrame]
#: The threshold of the class queries, by its index.
STANDARD = 8
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions that the SQL builds on, in order of dependence.
_CTES = {
    "link": "SELECT p_partkey AS link_id, CAST(1000 + 200 * p_size AS DOUBLE) AS capacity, p_retailprice / 100.0e0 AS length, CAST(20 + p_size AS DOUBLE) AS speed, 60.0e0 * (p_retailprice / 100.0e0) / greatest(CAST(20 + p_size AS DOUBLE), 1.0e0) AS t0 FROM part",
    "route": "SELECT o_orderkey AS route_id, CAST(c_nationkey AS BIGINT) AS o_zone_id, o_custkey AS d_zone_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,5)) AS flow FROM orders JOIN customer ON o_custkey = c_custkey",
    "step": "SELECT l_orderkey AS route_id, l_partkey AS link_id FROM lineitem",
    "od": "SELECT o_zone_id, d_zone_id, count(*) AS n_paths, CAST(sum(flow) AS DOUBLE) AS inferred FROM route GROUP BY ALL",
    "demand": "SELECT o_zone_id, d_zone_id, CAST(sum(flow) * CAST(1.1 AS DECIMAL(2,1)) AS DOUBLE) AS demand FROM route WHERE d_zone_id % 7 <> 0 GROUP BY ALL",
    "odd": "SELECT od.*, coalesce(demand.demand, 0.0e0) AS demand FROM od LEFT JOIN demand USING (o_zone_id, d_zone_id)",
    "volume": "SELECT link.link_id, coalesce(v, 0.0e0) AS volume FROM link LEFT JOIN (SELECT link_id, CAST(sum(flow) AS DOUBLE) AS v FROM step JOIN route USING (route_id) GROUP BY link_id) USING (link_id)",
    "ranked": "SELECT route.*, n_paths, row_number() OVER (PARTITION BY o_zone_id, d_zone_id ORDER BY flow DESC, route_id) AS rn FROM route JOIN od USING (o_zone_id, d_zone_id)",
    "minorable": "SELECT route_id, flow FROM ranked WHERE n_paths > 1 AND rn > 1",
    "placed": "SELECT flow, row_number() OVER (ORDER BY flow) - 1 AS pos, count(*) OVER () AS n FROM minorable",
    "spots": "SELECT i, max(CASE WHEN i = 10 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 10.0e0)) AS BIGINT) END) AS pos FROM placed, range(11) r(i) GROUP BY i",
    "cuts": "SELECT i, CASE WHEN i = 0 THEN 0.0e0 ELSE CAST(flow AS DOUBLE) END AS threshold FROM spots JOIN placed USING (pos)",
    "listed": "SELECT CAST(row_number() OVER (ORDER BY min(i)) - 1 AS INTEGER) AS threshold_index, threshold FROM cuts GROUP BY threshold",
    "classes": "SELECT route_id, o_zone_id, d_zone_id, flow, n_paths, CASE WHEN n_paths = 1 THEN 'singleton' WHEN CAST(flow AS DOUBLE) > t OR (NOT any_major AND rn = 1) THEN 'major' ELSE 'minor' END AS class, n_paths > 1 AND NOT any_major AND rn = 1 AS promoted FROM (SELECT ranked.*, t, bool_or(n_paths > 1 AND CAST(flow AS DOUBLE) > t) OVER (PARTITION BY o_zone_id, d_zone_id) AS any_major FROM ranked, (SELECT threshold AS t FROM listed WHERE threshold_index = 8))",
    "assigned": "SELECT route_id, o_zone_id, d_zone_id, demand / n_paths AS flow FROM route JOIN odd USING (o_zone_id, d_zone_id)",
    "avolume": "SELECT link.link_id, coalesce(v, 0.0e0) AS volume FROM link LEFT JOIN (SELECT link_id, sum(assigned.flow) AS v FROM step JOIN assigned USING (route_id) GROUP BY link_id) USING (link_id)",
    "pairs": "SELECT o_zone_id, d_zone_id, sum(assigned.flow) AS flow, any_value(demand) AS demand FROM assigned JOIN odd USING (o_zone_id, d_zone_id) WHERE n_paths > 1 GROUP BY ALL",
}
_BPR = "t0 * (1.0e0 + 0.15e0 * pow(volume / capacity, 4.0e0))"


def _sql(body: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in _CTES.items()) + " " + body


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _sql(sql)
        return f

    return add


def _on_network(name: str, f: Callable[[Network], DataFrame], sql: str | None = None) -> None:
    _register(name, sql)(lambda spark, sf_dir: f(network_from_star(spark, sf_dir)))


def standard_threshold(net: Network, base: DataFrame | None = None) -> float:
    """The threshold of index 8."""
    found = cls.threshold_values(net, base=base)
    if len(found) <= STANDARD:
        raise ValueError(f"fewer than {STANDARD + 1} thresholds")
    return found[STANDARD]


def standard_classes(net: Network) -> DataFrame:
    """Classes at the threshold of index 8."""
    base = cls.ranked(net).persist()  # read for the threshold, and again by whoever reads the classes
    return cls.path_classes(net, standard_threshold(net, base), base=base)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_on_network("link_freeflow", lambda n: n.links.select("link_id", "capacity", "length", "speed", F.round("t0", 9).alias("t0")), "SELECT link_id, capacity, length, speed, round(t0, 9) AS t0 FROM link")
_on_network("route_parse_steps", nw.steps, "SELECT route_id, link_id FROM step JOIN link USING (link_id) JOIN route USING (route_id)")


def as_text(net: Network) -> Network:
    """The network with every route's links as text, as route files have them."""
    texts = net.uses.groupBy("route_id").agg(F.array_join(F.collect_list(F.col("link_id").cast("string")), ";").alias("link_seq"))
    return Network(net.links, net.routes.join(texts, "route_id"), net.demand, net.performance)


_on_network("route_text_steps", lambda n: nw.steps(as_text(n)), "SELECT route_id, link_id FROM step JOIN link USING (link_id) JOIN route USING (route_id)")
_on_network(
    "incidence", nw.incidence,
    "SELECT p.path_idx, l.link_idx, count(*) AS mult FROM step JOIN (SELECT route_id, row_number() OVER (ORDER BY route_id) - 1 AS path_idx FROM route) p USING (route_id) JOIN (SELECT link_id, row_number() OVER (ORDER BY link_id) - 1 AS link_idx FROM link) l USING (link_id) GROUP BY ALL",
)
_on_network("link_dim", nw.link_dim, "SELECT row_number() OVER (ORDER BY link_id) - 1 AS link_idx, link_id FROM link")
_on_network("path_dim", nw.path_dim, "SELECT row_number() OVER (ORDER BY route_id) - 1 AS path_idx, route_id FROM route")
_on_network("od_dim", nw.od_dim, "SELECT row_number() OVER (ORDER BY o_zone_id, d_zone_id) - 1 AS od_idx, o_zone_id, d_zone_id FROM od")
_on_network("link_volume", nw.link_volume, "SELECT link_id, volume FROM volume")
_on_network(
    "link_bpr", lambda n: _rounded(_rounded(nw.link_bpr(n), 4, "travel_time"), 2, "beckmann"),
    f"SELECT link_id, volume, round({_BPR}, 4) AS travel_time, round(t0 * volume + t0 * capacity * (0.15e0 / 5.0e0) * pow(volume / capacity, 5.0e0), 2) AS beckmann FROM link JOIN volume USING (link_id)",
)
_on_network(
    "beckmann_total", lambda n: nw.link_bpr(n).agg(F.round(F.sum("beckmann"), 1).alias("beckmann_total"), F.count(F.lit(1)).alias("n_links")),
    "SELECT round(sum(t0 * volume + t0 * capacity * (0.15e0 / 5.0e0) * pow(volume / capacity, 5.0e0)), 1) AS beckmann_total, count(*) AS n_links FROM link JOIN volume USING (link_id)",
)
_REFERENCE = "(SELECT link.link_id, coalesce(v, 0.0e0) AS ref_volume FROM link LEFT JOIN (SELECT l_partkey AS link_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1) USING (link_id))"
_STATS = f"SELECT min(ref_volume) AS min_volume, max(ref_volume) AS max_volume, round(avg(ref_volume), 6) AS mean_volume, count(*) AS n_links, CAST(sum(CASE WHEN ref_volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, avg(ref_volume) < 0.1 OR sum(CASE WHEN ref_volume = 0 THEN 1 ELSE 0 END) > 0.8 * count(*) AS recompute FROM {_REFERENCE}"
_on_network("ref_volume_stats", lambda n: _rounded(nw.reference_stats(nw.reference_volume(n)), 6, "mean_volume"), _STATS)
_on_network("ref_volume_choice", nw.chosen_volume, f"SELECT r.link_id, CASE WHEN s.recompute THEN volume ELSE r.ref_volume END AS ref_volume FROM {_REFERENCE} r JOIN volume USING (link_id), ({_STATS}) s")
_on_network("ref_volume_absent", lambda n: nw.chosen_volume(Network(n.links, n.routes, uses=n.uses)), "SELECT link_id, volume AS ref_volume FROM volume")
_on_network("od_demand_inferred", nw.od_inferred, "SELECT o_zone_id, d_zone_id, inferred AS demand FROM od")
_on_network("od_demand_joined", nw.od_demand, "SELECT o_zone_id, d_zone_id, demand FROM odd")
_on_network("od_path_counts", nw.od_counts, "SELECT o_zone_id, d_zone_id, n_paths, n_paths = 1 AS is_singleton FROM od")
_on_network("singleton_ods", lambda n: nw.od_counts(n).where("is_singleton").select("o_zone_id", "d_zone_id"), "SELECT o_zone_id, d_zone_id FROM od WHERE n_paths = 1")
_on_network("multi_ods", lambda n: nw.od_counts(n).join(nw.od_counts(n).where("is_singleton"), list(cls.OD), "left_anti").select(*cls.OD, "n_paths"), "SELECT o_zone_id, d_zone_id, n_paths FROM od WHERE n_paths > 1")
_on_network("od_paths", nw.od_routes, "SELECT o_zone_id, d_zone_id, string_agg(CAST(route_id AS VARCHAR), ',' ORDER BY route_id) AS route_ids FROM route GROUP BY ALL")
_on_network("mandatory_major", cls.mandatory_majors, "SELECT route_id FROM ranked WHERE n_paths > 1 AND rn = 1")
_on_network("can_be_minor", lambda n: cls.can_be_minor(n).select("route_id", F.col("flow").cast("double").alias("flow")), "SELECT route_id, CAST(flow AS DOUBLE) AS flow FROM minorable")
_on_network("thresholds", cls.thresholds, "SELECT threshold_index, threshold FROM listed")
_on_network("path_classes", lambda n: standard_classes(n).select("route_id", "class", "promoted"), "SELECT route_id, class, promoted FROM classes")
_on_network("class_index", lambda n: cls.class_index(standard_classes(n)), "SELECT route_id, class, row_number() OVER (PARTITION BY class ORDER BY route_id) - 1 AS class_idx FROM classes")
_on_network(
    "class_stats", lambda n: _rounded(cls.class_stats(standard_classes(n)), 6, "path_share", "flow_share"),
    "SELECT class, count(*) AS n_paths, CAST(sum(flow) AS DOUBLE) AS flow, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS path_share, round(100.0e0 * CAST(sum(flow) AS DOUBLE) / sum(CAST(sum(flow) AS DOUBLE)) OVER (), 6) AS flow_share FROM classes GROUP BY class",
)
_on_network(
    "decomposition_stats", lambda n: _rounded(cls.class_stats(standard_classes(n).where("class <> 'singleton'")), 6, "path_share", "flow_share"),
    "SELECT class, count(*) AS n_paths, CAST(sum(flow) AS DOUBLE) AS flow, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS path_share, round(100.0e0 * CAST(sum(flow) AS DOUBLE) / sum(CAST(sum(flow) AS DOUBLE)) OVER (), 6) AS flow_share FROM classes WHERE class <> 'singleton' GROUP BY class",
)
_on_network(
    "flow_deciles", lambda n: _rounded(cls.flow_deciles(n), 6, "flow"),
    "SELECT CAST(10 * i AS INTEGER) AS decile, round(p[i], 6) AS flow FROM (SELECT quantile_cont(CAST(flow AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS p FROM route WHERE flow > 0), range(1, 10) r(i)",
)
_on_network("multi_flow_range", cls.multi_flow_range, "SELECT CAST(min(flow) AS DOUBLE) AS min_flow, CAST(max(flow) AS DOUBLE) AS max_flow FROM ranked WHERE n_paths > 1")
_on_network(
    "singleton_volume", cls.singleton_volume,
    "SELECT link.link_id, coalesce(v, 0.0e0) AS volume FROM link LEFT JOIN (SELECT link_id, sum(demand) AS v FROM step JOIN route USING (route_id) JOIN odd USING (o_zone_id, d_zone_id) WHERE n_paths = 1 GROUP BY link_id) USING (link_id)",
)
_on_network("proportional_assignment", asg.proportional_assignment, "SELECT route_id, o_zone_id, d_zone_id, flow FROM assigned")
_on_network("od_flow", lambda n: _rounded(asg.od_flow(asg.proportional_assignment(n)), 6, "flow"), "SELECT o_zone_id, d_zone_id, round(sum(flow), 6) AS flow FROM assigned GROUP BY ALL")
_on_network("assigned_link_volume", lambda n: _rounded(nw.link_volume(n, asg.proportional_assignment(n)), 4, "volume"), "SELECT link_id, round(volume, 4) AS volume FROM avolume")
_FIT = "count(*) AS n, round(avg(abs(p - r)), 5) AS mae, round(sqrt(avg((p - r) * (p - r))), 5) AS rmse"
_R2 = "round(1.0e0 - sum((p - r) * (p - r)) / (var_pop(r) * count(*) + 1e-10), 6) AS r2"
_fit = lambda df: _rounded(_rounded(df, 5, "mae", "rmse"), 6, *(["r2"] if "r2" in df.columns else []))
_on_network("link_accuracy", lambda n: _fit(asg.link_accuracy(n, asg.proportional_assignment(n))), f"SELECT {_FIT}, {_R2} FROM (SELECT a.volume AS p, v.volume AS r FROM avolume a JOIN volume v USING (link_id))")
_on_network(
    "travel_time_accuracy", lambda n: _fit(asg.travel_time_accuracy(n, asg.proportional_assignment(n))),
    f"SELECT {_FIT}, {_R2} FROM (SELECT t0 * 0.15e0 * pow(a.volume / capacity, 4.0e0) AS p, t0 * 0.15e0 * pow(v.volume / capacity, 4.0e0) AS r FROM link JOIN avolume a USING (link_id) JOIN volume v USING (link_id))",
)
_on_network("path_accuracy", lambda n: _fit(asg.path_accuracy(n, asg.proportional_assignment(n), standard_classes(n))), f'SELECT class, {_FIT} FROM (SELECT class, assigned.flow AS p, CAST(classes.flow AS DOUBLE) AS r FROM assigned JOIN classes USING (route_id)) GROUP BY class')
_SCALED = "SELECT o_zone_id, d_zone_id, inferred AS flow, demand, inferred - demand AS violation, CASE WHEN demand > 0.001 THEN 100.0e0 * abs(inferred - demand) / demand ELSE 0.0e0 END AS pct_error FROM odd WHERE n_paths > 1"


def reference_errors(net: Network) -> DataFrame:
    """Errors of the reference flows against the demand table."""
    return asg.od_errors(net, net.routes.select("route_id", *cls.OD, "flow"))


_on_network("od_pct_error", lambda n: _rounded(reference_errors(n), 6, "flow", "demand", "violation", "pct_error"), f"SELECT o_zone_id, d_zone_id, round(flow, 6) AS flow, round(demand, 6) AS demand, round(violation, 6) AS violation, round(pct_error, 6) AS pct_error FROM ({_SCALED})")
_on_network(
    "od_accuracy", lambda n: _rounded(asg.od_accuracy(reference_errors(n)), 4, "max_violation", "mean_violation", "mean_pct_error"),
    f"SELECT count(*) AS n_od, round(max(abs(violation)), 4) AS max_violation, round(avg(abs(violation)), 4) AS mean_violation, CAST(sum(CASE WHEN abs(violation) > 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS n_violated, round(avg(pct_error), 4) AS mean_pct_error FROM ({_SCALED})",
)
_on_network(
    "threshold_counts", lambda n: _rounded(cls.threshold_counts(n), 4, "major_share", "major_flow", "flow_share"),
    "SELECT threshold_index, threshold, count(*) FILTER (WHERE major) AS n_major, count(*) FILTER (WHERE NOT major) AS n_minor, round(100.0e0 * count(*) FILTER (WHERE major) / count(*), 4) AS major_share, round(coalesce(CAST(sum(flow) FILTER (WHERE major) AS DOUBLE), 0.0e0), 4) AS major_flow, round(100.0e0 * coalesce(CAST(sum(flow) FILTER (WHERE major) AS DOUBLE), 0.0e0) / CAST(sum(flow) AS DOUBLE), 4) AS flow_share FROM (SELECT listed.*, flow, CAST(flow AS DOUBLE) > threshold OR rn = 1 AS major FROM listed, ranked WHERE n_paths > 1) GROUP BY ALL",
)
_on_network(
    "od_violation_top5", lambda n: _rounded(asg.worst_pairs(reference_errors(n)), 6, "flow", "demand", "violation", "pct_error"),
    f"SELECT o_zone_id, d_zone_id, round(flow, 6) AS flow, round(demand, 6) AS demand, round(violation, 6) AS violation, round(pct_error, 6) AS pct_error FROM ({_SCALED}) ORDER BY abs(violation) DESC, o_zone_id, d_zone_id LIMIT 5",
)
_on_network(
    "link_deviation_report", lambda n: _rounded(asg.link_deviation(n, asg.proportional_assignment(n)), 4, "congested_mae", "max_abs_error"),
    "SELECT count(*) AS n_links, CAST(sum(CASE WHEN v.volume > 0.5e0 * capacity THEN 1 ELSE 0 END) AS BIGINT) AS n_congested, round(avg(CASE WHEN v.volume > 0.5e0 * capacity THEN abs(a.volume - v.volume) END), 4) AS congested_mae, CAST(sum(CASE WHEN abs(100.0e0 * (a.volume - v.volume) / (v.volume + 1e-10)) > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_over_10pct, round(max(abs(a.volume - v.volume)), 4) AS max_abs_error FROM link JOIN avolume a USING (link_id) JOIN volume v USING (link_id)",
)
_on_network(
    "path_gradient", lambda n: _rounded(asg.path_gradient(n, n.routes.select("route_id", *cls.OD, "flow")), 2, "gradient"),
    f"SELECT route_id, round(coalesce(cost, 0.0e0) + 1000.0e0 * (inferred - demand), 2) AS gradient FROM route JOIN odd USING (o_zone_id, d_zone_id) LEFT JOIN (SELECT route_id, sum({_BPR}) AS cost FROM step JOIN link USING (link_id) JOIN volume USING (link_id) GROUP BY route_id) USING (route_id)",
)


def repeated_products(net: Network) -> DataFrame:
    """``route_id, cost``: travel times along every route under its flows, by two products over one layout of the incidence."""
    layouts = Layouts.of(net)
    volume = layouts.link_sums(net.routes).select("link_id", F.col("total").alias("volume"))
    times = nw.link_bpr(net, volume)
    out, _ = stored(layouts.route_sums(times).select("route_id", F.round("total", 4).alias("cost")))
    layouts.drop()
    return out


_on_network(
    "repeated_products", repeated_products,
    f"SELECT route_id, round(sum({_BPR}), 4) AS cost FROM step JOIN link USING (link_id) JOIN volume USING (link_id) JOIN route USING (route_id) GROUP BY route_id",
)


def signed_flows(net: Network) -> DataFrame:
    """Flows shifted down by 100, to have some below zero: ``route_id, u``."""
    return net.routes.select("route_id", (F.col("flow").cast("double") - F.lit(100.0)).alias("u"))


_on_network(
    "kkt_projection", lambda n: _rounded(asg.kkt_projection(signed_flows(n), F.col("u"), F.lit(50.0), 2.0), 6, "u", "mu_next", "depth"),
    "SELECT route_id, round(u, 6) AS u, round(greatest(0.0e0, 50.0e0 - 2.0e0 * u), 6) AS mu_next, round(abs(least(u, 0.0e0)), 6) AS depth FROM (SELECT route_id, CAST(flow AS DOUBLE) - 100.0e0 AS u FROM route)",
)
_on_network(
    "negative_flow_report", lambda n: _rounded(asg.negative_flows(signed_flows(n)), 5, "min_u", "mean_u", "max_depth"),
    "SELECT count(*) AS n_negative, round(min(u), 5) AS min_u, round(avg(u), 5) AS mean_u, round(max(-u), 5) AS max_depth FROM (SELECT CAST(flow AS DOUBLE) - 100.0e0 AS u FROM route) WHERE u < -0.0001",
)
_on_network("lowest_flows", lambda n: _rounded(asg.lowest_flows(signed_flows(n)), 5, "u"), "SELECT route_id, round(CAST(flow AS DOUBLE) - 100.0e0, 5) AS u FROM route ORDER BY flow, route_id LIMIT 3")


def minor_entries(net: Network) -> DataFrame:
    """``route_id, link_id, mult`` of the minor routes."""
    return nw.multiplicities(net).join(standard_classes(net).where("class = 'minor'").select("route_id"), "route_id", "left_semi")


_on_network(
    "minor_gramian", lambda n: linalg.gramian(minor_entries(n)),
    "SELECT x.link_id AS a, y.link_id AS b, CAST(sum(x.mult * y.mult) AS BIGINT) AS val FROM e x JOIN e y ON x.route_id = y.route_id AND x.link_id <= y.link_id GROUP BY ALL",
)
ORACLE_SQL["minor_gramian"] = ORACLE_SQL["minor_gramian"].replace(" SELECT x.link_id", ", e AS (SELECT route_id, link_id, count(*) AS mult FROM step JOIN classes USING (route_id) WHERE class = 'minor' GROUP BY ALL) SELECT x.link_id")
_COMPRESSED = "SELECT n_major, n_minor, n_links, CASE WHEN n_minor = 0 THEN 0 ELSE greatest(1, least(CAST(floor(0.3e0 * n_minor) AS BIGINT), 50, least(n_minor, n_links) - 1)) END AS r FROM (SELECT CAST(sum(CASE WHEN class = 'major' THEN 1 ELSE 0 END) AS BIGINT) AS n_major, CAST(sum(CASE WHEN class = 'minor' THEN 1 ELSE 0 END) AS BIGINT) AS n_minor FROM classes), (SELECT count(*) AS n_links FROM link)"
_on_network(
    "compression_stats", lambda n: _rounded(cls.compression_stats(n, standard_classes(n)), 6, "compression_ratio", "reduction_pct", "speedup_bound"),
    f"SELECT n_major, n_minor, CAST(r AS BIGINT) AS r, CAST(n_major + r AS BIGINT) AS total_vars, round(CAST(n_minor AS DOUBLE) / r, 6) AS compression_ratio, round(100.0e0 * (n_minor - r) / (n_major + n_minor), 6) AS reduction_pct, round(CAST(n_major + n_minor AS DOUBLE) / (n_major + r), 6) AS speedup_bound FROM ({_COMPRESSED})",
)
_on_network(
    "rank_rule", lambda n: n.links.sparkSession.range(0, 400).select(F.col("id").alias("n_minor"), cls.rank_rule(F.col("id"), F.lit(1000)).alias("r")),
    "SELECT i AS n_minor, CAST(CASE WHEN i = 0 THEN 0 ELSE greatest(1, least(CAST(floor(0.3e0 * i) AS BIGINT), 50, least(i, 1000) - 1)) END AS BIGINT) AS r FROM range(400) t(i)",
)


def _minor_svd(net: Network) -> tuple[linalg.Svd | Spread, DataFrame, int]:
    """SVD of the minor incidence at the rank of the rule, the minor routes (``route_id, pair, flow, links, mults``), and the number of links."""
    minor = standard_classes(net).where("class = 'minor'").select("route_id", *cls.OD, F.col("flow").cast("double").alias("flow"))
    entries = nw.multiplicities(net).join(nw.link_dim(net), "link_id")
    lists = entries.groupBy("route_id").agg(F.collect_list("link_idx").alias("links"), F.collect_list("mult").alias("mults"))
    routes, _ = stored(minor.join(lists, "route_id", "left"))
    n_links, config = net.links.count(), Config()
    rank = alm.wanted_rank(routes.count(), n_links, config.rank_share, config.max_rank)
    slabs = linalg.slabs_of(routes)
    out = linalg.truncated_svd(slabs, n_links, rank, apart=True)
    slabs.unpersist()
    return out, routes, n_links


@_register("minor_svd_sigma")
def minor_svd_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading singular values of the minor incidence, as many as the rank rule gives."""
    svd, _, _ = _minor_svd(network_from_star(spark, sf_dir))
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(svd.sigma)], "component int, sigma double")


@_register("latent_reference")
def latent_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference flows of the minor routes in the latent basis."""
    svd, routes, _ = _minor_svd(network_from_star(spark, sf_dir))
    totals = svd.latent_totals(routes, "flow") if isinstance(svd, Spread) else linalg.latent_totals(routes, svd, "flow")
    return totals.withColumnRenamed("total", "z_ref")


@_register("od_latent_map")
def od_latent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the minor routes' latent rows by pair."""
    svd, routes, _ = _minor_svd(network_from_star(spark, sf_dir))
    return linalg.latent_by_key(routes, svd, list(cls.OD), "m")


@_register("link_latent_map")
def link_latent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the minor routes' latent rows by link."""
    svd, routes, n_links = _minor_svd(network_from_star(spark, sf_dir))
    return svd.latent_by_link(routes, "d") if isinstance(svd, Spread) else linalg.latent_by_link(routes, svd, n_links, "d")


def _at_standard(spark: SparkSession, sf_dir: str, work: Callable, every: bool = False):
    """What ``work`` gives for the problem at the threshold of index 8."""
    net = network_from_star(spark, sf_dir)
    values = cls.threshold_values(net)
    if len(values) <= STANDARD:
        raise ValueError(f"fewer than {STANDARD + 1} thresholds")
    return alm.at_thresholds(net, values, [STANDARD], Config(), work, every=every)[0][1]


@_register("evaluator_agreement")
def evaluator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and gradient norm of every evaluator at one point, with their distance from the first."""
    return spark.createDataFrame(_at_standard(spark, sf_dir, alm.agreement, every=True), "evaluator string, value double, gradient_norm double, value_gap double, gradient_gap double")


@_register("alm_history")
def alm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each outer turn of the solve."""
    return alm.history_frame(spark, _at_standard(spark, sf_dir, alm.outcome))


@_register("alm_summary")
def alm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary row of the solve."""
    return alm.summary_frame(spark, [_at_standard(spark, sf_dir, alm.outcome).summary])


@_register("alm_link_flows")
def alm_link_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link volumes and travel times of the solve."""
    return spark.createDataFrame(_at_standard(spark, sf_dir, alm.outcome).flows, alm.FLOWS)


@_register("threshold_sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries at all thresholds."""
    return alm.sweep(network_from_star(spark, sf_dir))


@_register("two_corridor_golden")
def two_corridor_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solved two-corridor network against its closed-form equilibrium."""
    net = fixtures.two_corridor(spark)
    p = alm.prepare(net, 0.0)
    solved = alm.link_flow_frame(spark, p, alm.solve(p))
    return solved.join(net.routes.select((F.col("route_id") + 1).alias("link_id"), F.col("flow").alias("equilibrium")), "link_id")
