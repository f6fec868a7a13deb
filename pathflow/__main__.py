"""Solve one network from a configuration file and print the report: ``python -m pathflow --config config.json``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.classes import threshold_values
from .plans import alm, report
from .plans.config import Config, load_config
from .sources.network import Network, exists, read_network


def load(spark: SparkSession, config: Config, base: str) -> Network:
    """The network of the data set's folder below ``base``; demand and performance files found there serve where the configuration names none."""
    folder = f"{base.rstrip('/')}/{config.dataset}"
    demand = config.demand_file
    if demand is None and exists(spark, f"{folder}/demand.csv"):
        demand = f"{folder}/demand.csv"
    return read_network(spark, f"{folder}/link.csv", f"{folder}/columns.csv", demand, config.link_perf_file)


def run(spark: SparkSession, config: Config, base: str, *, sweep: bool = False, out: str | None = None) -> str:
    """The reports' text; with ``out`` they are written there as tables as well, with the links' flows."""
    net = load(spark, config, base)
    if sweep:
        reports = {"sweep": alm.sweep(net, config).orderBy("threshold_index")}
        if out:
            report.write_reports(reports, out)
        return report.report_text(reports)
    values = threshold_values(net)
    if not 0 <= config.threshold_index < len(values):
        raise ValueError(f"there are {len(values)} thresholds, numbered from 0; number {config.threshold_index} is out of range")
    p = alm.prepare(net, values[config.threshold_index], config)
    solved = alm.solve(p, config)
    reports = report.input_reports(net) | report.solve_reports(p, solved, config.alm.tolerance)
    text = f"Solve at threshold {p.threshold}\n\n" + report.report_text(reports)
    if out:
        report.write_reports(reports | {"link_flows": alm.link_flow_frame(spark, p, solved)}, out)
    solved.release()
    p.release()
    return text


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pathflow", description="Compressed user-equilibrium assignment")
    parser.add_argument("--config", default="config.json", help="JSON configuration file")
    parser.add_argument("--data", default="data", help="folder that holds the data sets")
    parser.add_argument("--sweep", action="store_true", help="solve at every threshold and print the table")
    parser.add_argument("--out", help="folder for the report's tables")
    given = parser.parse_args(arguments)
    config = load_config(given.config)
    spark = SparkSession.builder.appName("pathflow").getOrCreate()
    print(run(spark, config, given.data, sweep=given.sweep, out=given.out))


if __name__ == "__main__":
    main()
