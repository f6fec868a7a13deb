"""Settings, stop rules, metrics, reports and the command line."""

import json
from dataclasses import replace

import numpy as np
import pytest

from pathflow import __main__ as cli
from pathflow.operators import classes as cls
from pathflow.operators import network as nw
from pathflow.plans import alm, fixtures, report
from pathflow.plans.config import AlmSettings, Config, load_config
from pathflow.plans.lbfgs import minimise
from pathflow.sources.network import read_network, read_nodes


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """The two-corridor network as files with the headers and number formats of published data sets."""
    base = tmp_path_factory.mktemp("data")
    folder = base / "two_corridor"
    folder.mkdir()
    links = [f"c{k},{k},1,2,1,{n},{n},1,{c},60,60,1,0.15,4" for k, (n, c) in enumerate(zip(fixtures.LENGTHS, fixtures.CAPACITIES, strict=True), 1)]
    (folder / "link.csv").write_text("name,link_id,from_node_id,to_node_id,dir_flag,length,vdf_length_mi,lanes,capacity,free_speed,vdf_free_speed_mph,link_type,vdf_alpha,vdf_beta\n" + "\n".join(links) + "\n")
    routes = [f"1,2,{k + 1},{f / 2000},{f},21.8,ue,{k}.0" for k, f in enumerate(fixtures.FLOWS)]
    (folder / "columns.csv").write_text("o_zone_id,d_zone_id,link_ids,prob_ref,ref_volume,cost_base,source,unique_route_id\n" + "\n".join(routes) + "\n")
    (folder / "demand.csv").write_text("o_zone_id,d_zone_id,volume\n1,2,2000\n")
    (folder / "node.csv").write_text("node_id,zone_id,x_coord,y_coord\n1,1,0.5,1\n2,,0,0\n")
    return base


def test_number_formats(spark, data):
    folder = f"{data}/two_corridor"
    net = read_network(spark, f"{folder}/link.csv", f"{folder}/columns.csv", f"{folder}/demand.csv")
    assert sorted(tuple(r) for r in net.routes.select("route_id", "o_zone_id", "flow").collect()) == [(k, 1, f) for k, f in enumerate(fixtures.FLOWS)]
    assert sorted(tuple(r) for r in nw.steps(net).collect()) == [(k, k + 1) for k in range(6)]
    assert sorted(tuple(r) for r in read_nodes(spark, f"{folder}/node.csv").select("node_id", "zone_id").collect()) == [(1, 1), (2, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_network(spark, f"{folder}/link.csv", f"{folder}/columns.csv", f"{folder}/none.csv")


def test_many_nodes(spark, tmp_path):
    # as node files of whole cities: zones first, then nodes without a zone, coordinates of many digits, some blank
    lines = [f"{k},{k if k <= 387 else ''},{-87.6 - k / 1e4!r},{'' if k % 100 == 0 else repr(41.8 + k / 1e5)}" for k in range(1, 934)]
    (tmp_path / "node.csv").write_text("node_id,zone_id,x_coord,y_coord\n" + "\n".join(lines) + "\n")
    nodes = {r["node_id"]: r for r in read_nodes(spark, f"{tmp_path}/node.csv").collect()}
    assert sorted(nodes) == list(range(1, 934)) and sum(r["zone_id"] is not None for r in nodes.values()) == 387
    assert all(r["x_coord"] == -87.6 - k / 1e4 and r["y_coord"] == (None if k % 100 == 0 else 41.8 + k / 1e5) for k, r in nodes.items())


def test_text_ids(spark, tmp_path):
    (tmp_path / "link.csv").write_text("id,cap,length,free_speed\n1.0,100,1,60\n2,50,1,60\n")
    (tmp_path / "columns.csv").write_text("path_id,origin,destination,flow,links\nr1,A,7,3,1\nr2,A,7,5,2\nr3,B,7,1,1;2\n")
    (tmp_path / "demand.csv").write_text("origin,destination,demand\nA,7,9\n")
    (tmp_path / "link_performance_ue.csv").write_text("link_id,volume\n1,4\n2,6\n")
    net = read_network(spark, f"{tmp_path}/link.csv", f"{tmp_path}/columns.csv", f"{tmp_path}/demand.csv")
    assert {tuple(r) for r in nw.od_demand(net).collect()} == {("A", "7", 9.0), ("B", "7", 0.0)}
    assert [tuple(r) for r in nw.od_dim(net).orderBy("od_idx").collect()] == [(0, "A", "7"), (1, "B", "7")]
    assert {tuple(r) for r in nw.path_dim(net).collect()} == {(0, "r1"), (1, "r2"), (2, "r3")}
    assert {r["link_id"]: r["ref_volume"] for r in nw.chosen_volume(net).collect()} == {1: 4.0, 2: 6.0}  # the file beside the links
    p = alm.prepare(net, 0.0)
    assert alm.solve(p).converged and [tuple(r) for r in p.pairs.select("o_zone_id", "d_zone_id").collect()] == [("A", "7")]
    (tmp_path / "bad.csv").write_text("id,cap,length,free_speed\nx,100,1,60\n")
    with pytest.raises(Exception, match="not a whole number"):
        read_network(spark, f"{tmp_path}/bad.csv", f"{tmp_path}/columns.csv")


def test_config(tmp_path):
    given = {"data_dir": "net", "rank": 20, "random_state": 7, "tolerance": 0.01, "threshold_index": 3, "demand_file": None, "link_perf_file": None, "note": "kept", "alm": {"c1_init": 10.0, "stagnation_window": 5, "odd": 1}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(given))
    c = load_config(str(path))
    assert (c.dataset, c.max_rank, c.seed, c.threshold_index) == ("net", 20, 7, 3)
    assert (c.alm.c1, c.alm.c2, c.alm.tolerance, c.alm.stagnation_window) == (10.0, 1e3, 0.01, 5)
    assert c.more == {"note": "kept", "alm": {"odd": 1}}
    assert load_config() == Config()
    path.write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        load_config(str(path))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_stop_rules():
    a = AlmSettings()
    history = [{"bpr": 100.0, "od_violation": 8.0}] * 3
    assert alm.stop_reason(0, 9e-5, 9e-5, [], 1.0, a) == (True, "converged")
    assert alm.stop_reason(0, 1e-4, 0.0, [], 1.0, a) == (False, "")
    assert alm.stop_reason(2, 1.0, 0.0, history[:2], 1.0, a)[0] is False
    assert alm.stop_reason(3, 1.0, 0.0, history, 1.0, a) == (True, "stagnated")
    # the range counts against the first value of the window
    wide = [{"bpr": 100.0, "od_violation": v} for v in (8.0, 8.0, 8.0 + 7.9e-6)]
    assert alm.stop_reason(3, 1.0, 0.0, wide, 1.0, a)[0] is True
    grown = [{"bpr": 100.0, "od_violation": v} for v in (1e-9, 1.0, 1.0)]
    assert alm.stop_reason(3, 1.0, 0.0, grown, 1.0, a)[0] is False
    assert alm.stop_reason(5, 1.0, 0.0, [], alm.PENALTY_CAP, replace(a, stagnation_window=9)) == (True, "penalty limit")
    assert alm.stop_reason(19, 1.0, 0.0, [], 1.0, replace(a, stagnation_window=99)) == (False, "iteration limit")


def test_penalties():
    a = AlmSettings()
    c, before = 1.0, None
    grown = []
    for violation in (8.0, 2.0, 1.0, 1e-5):
        c, before = alm.next_penalty(c, violation, before, a), violation
        grown.append(c)
    assert grown == [4.0, 4.0, 16.0, 16.0]
    assert alm.next_penalty(9e19, 5.0, None, a) == alm.PENALTY_CAP


def test_bounded_minimum():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(12, 12))
    q, b, low = m @ m.T + np.eye(12), rng.normal(size=12) * 5, np.where(np.arange(12) % 2, 0.0, -np.inf)
    best = minimise(lambda x: (0.5 * x @ q @ x - b @ x, q @ x - b), np.zeros(12), low, max_iter=500, ends=(0.0, 1))
    g = q @ best.x - b
    assert best.converged and (best.x >= low).all()
    assert np.abs(np.where(best.x > low, g, np.minimum(g, 0))).max() < 1e-5  # the optimality conditions


def test_fits():
    assert alm.fit(np.zeros(0), np.zeros(0)) == {"mae": 0.0, "rmse": 0.0, "r2": 1.0}
    assert alm.fit(np.array([1.5]), np.array([1.0]))["r2"] == 1 - 0.25 / 1e-10


@pytest.mark.parametrize(("start", "off"), [("proportional", 0.05), ("zero", 0.3), ("warm", 0.05)])
def test_golden_flows(spark, start, off):
    net = fixtures.two_corridor(spark)
    config = Config(start=start, alm=AlmSettings(tolerance=1e-6))
    p = alm.prepare(net, 0.0, config)
    s = alm.solve(p, config)
    assert s.converged and np.abs(s.volumes - np.array(fixtures.FLOWS)).max() < off
    row = alm.summary_row(p, s)
    assert len(row) == len(alm.SUMMARY.split(", ")) and row["bpr_ref"] == pytest.approx(26871.892964853432, rel=1e-12)
    assert (row["n_major"], row["n_minor"], row["rank"], row["total_vars"], row["major_flow_pct"]) == (5, 1, 1, 6, 100.0)
    assert row["link_r2"] > 0.999999 and row["seconds_per_outer"] == row["seconds"] / row["outer_iters"]


@pytest.mark.parametrize(("index", "most"), [(1, 26907.198356), (2, 27031.465928), (3, 45561.550023), (4, 395000.0)])
def test_bounds_of_compressed_solves(spark, index, most):
    # z = 0 is feasible, so the value lies between the equilibrium's and that of the majors alone
    net = fixtures.two_corridor(spark)
    p = alm.prepare(net, cls.threshold_values(net)[index])
    s = alm.solve(p)
    assert s.converged and 26871.89 * (1 - 1e-5) < s.history[-1]["bpr"] < most * (1 + 1e-4)
    assert p.problem.rank == 1 and len(alm.history_frame(spark, s).columns) == len(alm.HISTORY.split(", "))


def test_report(spark, data, tmp_path):
    text = cli.run(spark, Config(), str(data), out=str(tmp_path))
    for title in ("reference volumes", "flow deciles", "classes by threshold", "decomposition", "history", "links", "pairs", "minor routes", "summary"):
        assert f"[{title}]" in text, title
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("summary", "history", "link_flows", "decomposition", "links", "classes_by_threshold", "flow_deciles")}
    assert tables["summary"].count() == 1 and tables["link_flows"].count() == 6 and tables["links"].head()["n_congested"] == 5
    assert {r["class"]: r["path_share"] for r in tables["decomposition"].collect()} == pytest.approx({"major": 100 * 5 / 6, "minor": 100 / 6})
    assert [r["n_major"] for r in tables["classes_by_threshold"].orderBy("threshold_index").collect()] == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError, match="out of range"):
        cli.run(spark, Config(threshold_index=9), str(data))


def test_sweep_table(spark, data):
    lines = cli.run(spark, Config(), str(data), sweep=True).split("\n")
    assert lines[0] == "[sweep]" and lines[1].split()[:3] == ["threshold_index", "threshold", "n_major"] and [line.split()[2] for line in lines[2:7]] == ["5", "4", "3", "2", "1"]


def test_violation_reports(spark):
    p = alm.prepare(fixtures.two_corridor(spark), 100.0)
    s = alm.solve(p, Config(alm=AlmSettings(max_outer_iter=1, max_inner_iter=1)))
    s.errors, s.minor = np.array([-3.0]), np.array([0.5, -0.2, -0.7])
    found = report.solve_reports(p, s, 1e-4)
    assert [tuple(r) for r in found["worst pairs"].collect()] == [(0, 1, 2, 2000.0, 1997.0, 3.0)]
    assert found["pairs"].head()[:4] == (1, 1, 3.0, 3.0)
    assert found["minor routes"].head()[:] == pytest.approx((3, 2, -0.7, -0.45))
    assert [tuple(r) for r in found["lowest minor routes"].collect()] == [(2, -0.7), (1, -0.2)]


def test_rendering(spark):
    many = spark.createDataFrame([(k, None if k else 1234567.891, "x" * k) for k in range(5)], "a int, b double, c string")
    assert report.rendered("t", many, most=3) == ["[t]", "  a            b   c", "  0  1.23457e+06    ", "  1                x", "  2               xx", "  ...", ""]
    assert report.rendered("t", many.limit(1)) == ["[t]", "  a  0", "  b  1.23457e+06", "  c  ", ""]
    assert report.rendered("t", many.where("false")) == ["[t]", "  (none)", ""]
