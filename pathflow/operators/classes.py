"""Thresholds and the three classes of routes: singleton, major, minor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.network import Network
from . import indexing
from .indexing import LANES, lane_among, sketch_of
from .network import od_demand, with_od_counts, written_steps

OD = ("o_zone_id", "d_zone_id")
#: Quantiles that bracket a wanted position.
BRACKETS = 256
#: Rows within brackets that go to the driver at most.
COLLECTED = 200_000


def above(flow: Column, threshold: float) -> Column:
    """flow > threshold, false for null and NaN."""
    value = flow.cast("double")
    return F.coalesce((value > F.lit(float(threshold))) & ~F.isnan(value), F.lit(False))


def ranked(net: Network) -> DataFrame:
    """``route_id, o_zone_id, d_zone_id, flow, n_paths, is_best``: every route with its pair's number of routes and whether it is the pair's best.

    The best route has the largest flow, of equal ones the smallest id; null and
    NaN flows count as the lowest.  Pairs are summed up before the shuffle and
    joined back, so a pair of very many routes costs no task more than its share.
    """
    value = F.col("flow").cast("double")
    sortable = F.when(~F.isnan(value), value)
    order = F.struct(sortable.isNull().alias("none"), (-sortable).alias("low"), "route_id")
    pairs = net.routes.groupBy(*OD).agg(F.count(F.lit(1)).alias("n_paths"), F.min(order).alias("best"))
    routes = net.routes.select("route_id", *OD, "flow").join(pairs.select(*OD, "n_paths", F.col("best.route_id").alias("best")), list(OD))
    return routes.select("route_id", *OD, "flow", "n_paths", (F.col("route_id") == F.col("best")).alias("is_best"))


def mandatory_majors(net: Network) -> DataFrame:
    """``route_id``: the route of the largest flow of every pair with several, ties to the smaller id."""
    return ranked(net).where("n_paths > 1 and is_best").select("route_id")


def can_be_minor(net: Network) -> DataFrame:
    """``route_id, flow``: routes of pairs with several, without the mandatory majors."""
    return ranked(net).where("not is_best").select("route_id", "flow")


def value_at(df: DataFrame, column: str, places: Callable[[int], dict[int, int]]) -> dict[int, float]:
    """Values at positions (from 0) in the ascending order of a column of numbers.

    ``places`` gives the wanted positions for the number of rows, and names them.
    A sketch brackets each position by two of ``BRACKETS`` quantiles; a pass
    counts the rows below, at and within the bounds of every bracket.  The rows
    within go to the driver if they are few, else the same is done to them
    alone, so the result is exact at any size.  Null values don't count.
    """
    held = df.select(F.col(column).cast("double").alias("x")).where("x is not null").persist()
    out = _selected(held, places)
    held.unpersist()
    return out


def _selected(held: DataFrame, places: Callable[[int], dict[int, int]]) -> dict[int, float]:
    """``value_at`` over the column x."""
    grid = [i / BRACKETS for i in range(BRACKETS + 1)]
    known = held.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.lit(grid), 20 * BRACKETS).alias("grid")).head()
    n, quantiles = known["n"], known["grid"]
    wanted = places(n) if n else {}
    if not wanted:
        return {}
    near = lambda share: quantiles[min(BRACKETS, max(0, int(share * BRACKETS)))]
    brackets: list[list[float]] = []
    for low, high in sorted({(near(at / n - 1 / BRACKETS), near((at + 1) / n + 2 / BRACKETS)) for at in wanted.values()}):
        if brackets and low <= brackets[-1][1]:  # those that meet are one
            brackets[-1][1] = max(high, brackets[-1][1])
        else:
            brackets.append([low, high])
    x = F.col("x")
    within = [(x > low) & (x < high) for low, high in brackets]
    tests = [t for (low, high), w in zip(brackets, within, strict=True) for t in (x < low, x == low, w, (x == high) & F.lit(low < high))]
    counts = held.agg(*[F.count_if(t) for t in tests]).head()
    few = sum(counts[2::4]) <= COLLECTED
    number = F.coalesce(*[F.when(w, i) for i, w in enumerate(within)])
    rows: dict[int, list[float]] = {}
    if few and sum(counts[2::4]):
        for r in held.select(number.alias("i"), "x").where("i is not null").collect():
            rows.setdefault(r["i"], []).append(r["x"])
    out: dict[int, float] = {}
    for i, (low, high) in enumerate(brackets):
        below, at_low, middle, at_high = counts[4 * i : 4 * i + 4]
        own = {name: at - below for name, at in wanted.items() if below <= at < below + at_low + middle + at_high}
        out |= {name: low for name, at in own.items() if at < at_low} | {name: high for name, at in own.items() if at >= at_low + middle}
        inner = {name: at - at_low for name, at in own.items() if at_low <= at < at_low + middle}
        if few:
            values = sorted(rows.get(i, []))
            out |= {name: values[at] for name, at in inner.items()}
        elif inner:
            out |= _selected(held.where(within[i]), lambda _, inner=inner: inner)
    if len(out) < len(wanted):
        raise ValueError("a position lies outside of its bracket")
    return out


def threshold_values(net: Network, bins: int = 10, *, base: DataFrame | None = None) -> list[float]:
    """Values at evenly spaced positions among the flows that can be minor; the first is 0, repeats go.  An error if no pair has several routes.

    ``base`` is ``ranked(net)``, where the caller has it.
    """
    places = lambda n: {i: n - 1 if i == bins else int(i * ((n - 1) / float(bins))) for i in range(bins + 1)}
    found = value_at((ranked(net) if base is None else base).where("not is_best"), "flow", places)
    if not found:
        raise ValueError("no pair has multiple routes, so there is nothing to part")
    return list(dict.fromkeys([0.0] + [float(found[i]) for i in range(1, bins + 1)]))


def thresholds(net: Network, bins: int = 10) -> DataFrame:
    """``threshold_index, threshold``: see ``threshold_values``."""
    return net.routes.sparkSession.createDataFrame(list(enumerate(threshold_values(net, bins))), "threshold_index int, threshold double")


def threshold_counts(net: Network, bins: int = 10) -> DataFrame:
    """``threshold_index, threshold, n_major, n_minor, major_share, major_flow, flow_share`` at every threshold, by one pass over the routes.

    A route is major where its flow is above the threshold; below the largest
    flow of a pair its best route is major as well.  Shares are of the routes
    with alternatives, in per cent.
    """
    values = threshold_values(net, bins)
    several = ranked(net).where("n_paths > 1").withColumn("value", F.coalesce(F.when(~F.isnan(F.col("flow").cast("double")), F.col("flow").cast("double")), F.lit(0.0)))
    major = lambda t: above(F.col("flow"), t) | F.col("is_best")
    found = several.agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("flow"), *[F.count_if(major(t)).alias(f"n{i}") for i, t in enumerate(values)], *[F.coalesce(F.sum(F.when(major(t), F.col("value"))), F.lit(0.0)).alias(f"flow{i}") for i, t in enumerate(values)]
    ).head()
    share = lambda part, whole: 100.0 * part / whole if whole else 0.0
    rows = [(i, t, found[f"n{i}"], found["n"] - found[f"n{i}"], share(found[f"n{i}"], found["n"]), found[f"flow{i}"], share(found[f"flow{i}"], found["flow"])) for i, t in enumerate(values)]
    return net.routes.sparkSession.createDataFrame(rows, "threshold_index int, threshold double, n_major long, n_minor long, major_share double, major_flow double, flow_share double")


def path_classes(net: Network, threshold: float, *, ensure_major: bool = True, base: DataFrame | None = None) -> DataFrame:
    """``route_id, o_zone_id, d_zone_id, flow, n_paths, class, promoted``.

    Routes without an alternative are singletons; others are major above the
    threshold, else minor.  With ``ensure_major`` a pair without a major has its
    largest route promoted.  ``base`` is ``ranked(net)``, where the caller has it.
    """
    # the largest flow of a pair is above the threshold if any is
    classed = (ranked(net) if base is None else base).withColumn("is_major", (F.col("n_paths") > 1) & above(F.col("flow"), threshold))
    promoted = F.lit(ensure_major) & (F.col("n_paths") > 1) & ~F.col("is_major") & F.col("is_best")
    kind = F.when(F.col("n_paths") == 1, "singleton").when(F.col("is_major") | promoted, "major").otherwise("minor")
    return classed.select("route_id", *OD, "flow", "n_paths", kind.alias("class"), promoted.alias("promoted"))


def class_index(classes: DataFrame) -> DataFrame:
    """``route_id, class, class_idx``: positions within the class in order of route id."""
    rows, bounds = sketch_of(classes, "route_id", LANES)
    if rows > LANES * indexing.LANE_ROWS:
        return indexing.by_ranges(classes.select("route_id", "class"), ["route_id"], rows, ["class"]).withColumnRenamed("__at", "class_idx")
    lane = lane_among("route_id", bounds)
    laned = classes.select("route_id", "class").withColumn("__lane", lane)
    bases = laned.groupBy("class", "__lane").agg(F.count(F.lit(1)).alias("__n")).select(
        "class", "__lane", F.coalesce(F.sum("__n").over(Window.partitionBy("class").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")
    )
    rank = F.row_number().over(Window.partitionBy("class", "__lane").orderBy("route_id")) - 1
    return laned.withColumn("__r", rank).join(F.broadcast(bases), ["class", "__lane"]).select("route_id", "class", (F.col("__base") + F.col("__r")).cast("long").alias("class_idx"))


def class_stats(classes: DataFrame) -> DataFrame:
    """``class, n_paths, flow, path_share, flow_share``: counts, flows and percentages; null and NaN flows add nothing."""
    value = F.when(~F.isnan(F.col("flow").cast("double")), F.col("flow"))
    per = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("flow"))
    total = Window.partitionBy()  # three rows at most
    share = lambda c: F.when(F.sum(c).over(total) > 0, F.lit(100.0) * F.col(c) / F.sum(c).over(total)).otherwise(0.0)
    return per.select("class", "n_paths", "flow", share("n_paths").alias("path_share"), share("flow").alias("flow_share"))


def flow_deciles(net: Network) -> DataFrame:
    """``decile, flow``: exact interpolated percentiles 10 to 90 of the flows above zero."""
    used = net.routes.select(F.col("flow").cast("double").alias("flow")).where("flow > 0 and not isnan(flow)")
    marks: dict[int, float] = {}

    def places(n: int) -> dict[int, int]:
        marks.update({d: (n - 1) * d / 100 for d in range(10, 100, 10)})
        return {d: int(x) for d, x in marks.items()} | {1000 + d: min(n - 1, int(x) + 1) for d, x in marks.items()}

    at = value_at(used, "flow", places)
    rows = [(d, at[d] + (at[1000 + d] - at[d]) * (x - int(x))) for d, x in marks.items()] if at else []
    return net.routes.sparkSession.createDataFrame(rows, "decile int, flow double")


def multi_flow_range(net: Network) -> DataFrame:
    """One row: least and largest flow of routes with alternatives."""
    return with_od_counts(net).where("n_paths > 1").agg(F.min("flow").cast("double").alias("min_flow"), F.max("flow").cast("double").alias("max_flow"))


def singleton_volume(net: Network) -> DataFrame:
    """``link_id, volume``: what singleton routes, carrying their pair's whole demand, put on every link."""
    alone = with_od_counts(net).where("n_paths = 1").join(od_demand(net), list(OD)).select("route_id", "demand")
    used = written_steps(net).join(alone, "route_id").groupBy("link_id").agg(F.sum("demand").alias("v"))
    return net.links.select("link_id").join(used, "link_id", "left").select("link_id", F.coalesce("v", F.lit(0.0)).alias("volume"))


def rank_rule(n_minor: Column, n_links: Column, share: float = 0.30, most: int = 50) -> Column:
    """max(1, min(int(share * n_minor), most, min(n_minor, n_links) - 1)), 0 without minor routes."""
    wanted = F.least(F.floor(F.lit(share) * n_minor).cast("long"), F.lit(most).cast("long"), (F.least(n_minor, n_links) - 1).cast("long"))
    return F.when(n_minor == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), wanted))


def compression_stats(net: Network, classes: DataFrame) -> DataFrame:
    """One row: n_major, n_minor, r, total_vars, compression_ratio (null where infinite), reduction_pct, speedup_bound."""
    counts = classes.agg(F.count_if(F.col("class") == "major").alias("n_major"), F.count_if(F.col("class") == "minor").alias("n_minor"))
    both = counts.crossJoin(net.links.agg(F.count(F.lit(1)).alias("n_links")))  # one row each
    both = both.withColumn("r", rank_rule(F.col("n_minor"), F.col("n_links"))).withColumn("total_vars", F.col("n_major") + F.col("r"))
    n = F.col("n_major") + F.col("n_minor")
    return both.select(
        "n_major", "n_minor", "r", "total_vars", F.when(F.col("r") > 0, F.col("n_minor") / F.col("r")).alias("compression_ratio"),
        F.when(n > 0, F.lit(100.0) * (n - F.col("total_vars")) / n).alias("reduction_pct"), F.when(F.col("total_vars") > 0, n / F.col("total_vars")).alias("speedup_bound"),
    )
