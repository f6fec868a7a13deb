"""Reports: each is a DataFrame, and one renderer prints any of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classes import flow_deciles, multi_flow_range, threshold_counts
from ..operators.network import chosen_volume, reference_stats, reference_volume
from ..sources.network import Network
from . import alm

#: A pair's error above which it is among the worst pairs.
SHOWN_ERROR = 0.01
#: Rows of a table that are printed.
PRINTED = 40


def input_reports(net: Network) -> dict[str, DataFrame]:
    """What is known before a solve: reference volumes, the distribution of flows, and the classes at every threshold."""
    stats = reference_stats(reference_volume(net)).withColumn("source", F.when(F.col("recompute"), "route flows").otherwise("table")).drop("recompute")
    used = chosen_volume(net).agg(F.avg("ref_volume").alias("mean_used"), F.max("ref_volume").alias("max_used"))
    return {"reference volumes": stats.crossJoin(used), "flow range": multi_flow_range(net), "flow deciles": flow_deciles(net), "classes by threshold": threshold_counts(net)}  # one row each


def decomposition_frame(p: alm.Prepared) -> DataFrame:
    """``class, n_paths, path_share, flow, flow_share`` of majors and minors, singletons left out."""
    q = p.problem
    n, flow = q.n_major + q.n_minor, p.major_flow + p.minor_flow
    rows = [(k, c, 100.0 * c / n if n else 0.0, f, 100.0 * f / flow if flow > 0 else 0.0) for k, c, f in (("major", q.n_major, p.major_flow), ("minor", q.n_minor, p.minor_flow))]
    return p.pairs.sparkSession.createDataFrame(rows, "class string, n_paths long, path_share double, flow double, flow_share double")


def link_frame(p: alm.Prepared, s: alm.Solution) -> DataFrame:
    """One row about the links' distance from their reference volumes; those above half their capacity are congested."""
    off, busy = np.abs(s.volumes - p.v_ref), p.v_ref > 0.5 * p.problem.capacity
    over = int((100 * off / (p.v_ref + 1e-10) > 10).sum())
    row = (len(off), float(off.max(initial=0.0)), over, int(busy.sum()), float(off[busy].mean()) if busy.any() else None)
    return p.pairs.sparkSession.createDataFrame([row], "n_links long, max_error double, n_over_10pct long, n_congested long, congested_mae double")


def pair_frame(flows: DataFrame, s: alm.Solution, tolerance: float) -> DataFrame:
    """One row about the pairs' errors."""
    size = F.abs("error")
    own = flows.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(size > tolerance).alias("n_violated"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_error"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_error"))
    return own.select("*", *[F.lit(float(s.pair_fit[k])).alias(k) for k in ("r2", "mae", "rmse")])


def worst_pairs(flows: DataFrame, n: int = 5) -> DataFrame:
    """The pairs of the largest error, if above ``SHOWN_ERROR``: number among the pairs with several routes, zones, demand, flow and error."""
    size = F.abs("error")
    worst = flows.where(size > SHOWN_ERROR).orderBy(size.desc(), "pair_no").limit(n)
    return worst.select("pair_no", "o_zone_id", "d_zone_id", "demand", (F.col("demand") + F.col("error")).alias("flow"), size.alias("error"))


def minor_frame(routes: DataFrame, tolerance: float) -> DataFrame:
    """One row about minor routes below -tolerance."""
    flow = F.when(F.col("flow") < -tolerance, F.col("flow"))
    return routes.where("class = 'minor'").agg(F.count(F.lit(1)).alias("n_minor"), F.count(flow).alias("n_negative"), F.min(flow).alias("lowest"), F.avg(flow).alias("mean_negative"))


def lowest_minors(routes: DataFrame, tolerance: float, n: int = 3) -> DataFrame:
    """Numbers and flows of the minor routes furthest below -tolerance."""
    return routes.where((F.col("class") == "minor") & (F.col("flow") < -tolerance)).select("no", "flow").orderBy("flow", "no").limit(n)


def solve_reports(p: alm.Prepared, s: alm.Solution, tolerance: float) -> dict[str, DataFrame]:
    """Everything about one solve."""
    spark = p.pairs.sparkSession
    pairs, routes = s.pair_flows(p), s.route_flows(p)
    return {
        "decomposition": decomposition_frame(p), "history": alm.history_frame(spark, s), "links": link_frame(p, s), "pairs": pair_frame(pairs, s, tolerance), "worst pairs": worst_pairs(pairs),
        "minor routes": minor_frame(routes, tolerance), "lowest minor routes": lowest_minors(routes, tolerance), "summary": alm.summary_frame(spark, [alm.summary_row(p, s)]),
    }


def cell(value: object) -> str:
    """A value as text: numbers with six significant digits, nothing for null."""
    if value is None:
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rendered(title: str, df: DataFrame, most: int = PRINTED) -> list[str]:
    """A title and a table: names beside values for one row, else a line for each of the first rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) == 1:
        width = max(map(len, df.columns))
        body = [f"  {name:<{width}}  {cell(value)}" for name, value in zip(df.columns, rows[0], strict=True)]
    else:
        table = [df.columns, *([cell(v) for v in r] for r in rows[:most])]
        widths = [max(len(line[i]) for line in table) for i in range(len(df.columns))]
        body = ["  " + "  ".join(text.rjust(w) for text, w in zip(line, widths, strict=True)) for line in table] if rows else ["  (none)"]
        body += ["  ..."] if len(rows) > most else []
    return [f"[{title}]", *body, ""]


def report_text(reports: dict[str, DataFrame]) -> str:
    """All reports, one after the other."""
    return "\n".join(line for title, df in reports.items() for line in rendered(title, df))


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Reports as Parquet tables in a folder, named after their titles."""
    for title, df in reports.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{title.replace(' ', '_')}.parquet")
