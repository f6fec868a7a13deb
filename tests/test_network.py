"""Readers, sequences, classes and the solved two-corridor network on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from pathflow.functions.congestion import free_flow_minutes
from pathflow.functions.sequences import parse_link_sequence
from pathflow.operators import classes as cls
from pathflow.operators import network as nw
from pathflow.plans import alm, fixtures
from pathflow.sources.network import Network, checked_links, read_network


def network(spark, routes, demand=None, n_links=6):
    links = checked_links(spark.createDataFrame([(i, 100.0, 1.0, 30.0) for i in range(1, n_links + 1)], "link_id long, capacity double, length double, speed double"))
    wanted = spark.createDataFrame(demand, "o_zone_id long, d_zone_id long, demand double").coalesce(1) if demand is not None else None
    return Network(links, spark.createDataFrame(routes, "route_id long, o_zone_id long, d_zone_id long, flow double, link_seq string"), wanted)


@pytest.mark.parametrize(
    ("text", "steps"),
    [("1; 2;;3", [1, 2, 3]), ("1,2,", [1, 2]), ("7", [7]), (" 7 ", [7]), (None, None), ("", []), ("1;2;1", [1, 2, 1]), ("3.0;4", [3, 4])],
)
def test_sequences(spark, text, steps):
    assert spark.createDataFrame([(text,)], "s string").select(parse_link_sequence(F.col("s"))).head()[0] == steps


def test_slow_links(spark):
    row = spark.range(1).select(free_flow_minutes(F.lit(10.0), F.lit(0.5)).alias("a"), free_flow_minutes(F.lit(10.0), F.lit(60.0)).alias("b")).head()
    assert (row["a"], row["b"]) == (600.0, 10.0)


def test_steps_and_volumes(spark):
    net = network(spark, [(1, 1, 2, 10.0, "1;2;1"), (2, 1, 2, 5.0, "1;999"), (3, 1, 2, 7.0, None)])
    assert {(r["route_id"], r["link_id"]): r["mult"] for r in nw.multiplicities(net).collect()} == {(1, 1): 2, (1, 2): 1, (2, 1): 1}
    assert {r["link_id"]: r["volume"] for r in nw.link_volume(net).collect()} == {1: 25.0, 2: 10.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    assert [r["route_id"] for r in nw.path_dim(net).orderBy("path_idx").collect()] == [1, 2, 3]


def test_demand(spark):
    routes = [(1, 1, 2, 10.0, "1"), (2, 1, 2, 5.0, "1"), (3, 3, 4, 7.0, "2")]
    given = network(spark, routes, [(1, 2, 5.0), (9, 9, 1.0), (1, 2, 9.0)])
    assert sorted(map(tuple, nw.od_demand(given).collect())) == [(1, 2, 9.0), (3, 4, 0.0)]
    assert sorted(map(tuple, nw.od_demand(network(spark, routes)).collect())) == [(1, 2, 15.0), (3, 4, 7.0)]


def test_classes(spark):
    net = network(spark, [(1, 1, 2, 3.0, "1"), (2, 1, 2, 3.0, "2"), (3, 1, 2, 1.0, "3"), (4, 5, 6, 8.0, "4"), (5, 7, 8, 9.0, "5"), (6, 7, 8, 5.0, "6"), (7, 7, 8, None, "6")])
    found = {r["route_id"]: (r["class"], r["promoted"]) for r in cls.path_classes(net, 5.0).collect()}
    assert found == {1: ("major", True), 2: ("minor", False), 3: ("minor", False), 4: ("singleton", False), 5: ("major", False), 6: ("minor", False), 7: ("minor", False)}


def test_thresholds(spark):
    net = network(spark, [(1, 1, 2, 4.0, "1"), (2, 1, 2, 2.0, "2")])
    assert [r["threshold"] for r in cls.thresholds(net).orderBy("threshold_index").collect()][0] == 0.0
    found = [r["threshold"] for r in cls.thresholds(fixtures.two_corridor(spark)).orderBy("threshold_index").collect()]
    assert found == pytest.approx([0.0, 35.45743388630843, 43.98500995276579, 610.957645985739, 639.7512112249042])


def test_ranks(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (10,), (400,)], "n long").select("n", cls.rank_rule(F.col("n"), F.lit(1000)).alias("r")).collect()
    assert {r["n"]: r["r"] for r in rows} == {0: 0, 1: 1, 3: 1, 10: 3, 400: 50}


def test_only_singletons(spark):
    net = network(spark, [(1, 1, 2, 3.0, "1"), (2, 3, 4, 3.0, "2")])
    with pytest.raises(ValueError, match="multi"):
        alm.sweep(net)


def test_two_corridor_equilibrium(spark):
    net = fixtures.two_corridor(spark)
    p = alm.prepare(net, 0.0)
    rows = {r["link_id"]: r for r in alm.link_flow_frame(spark, p, alm.solve(p)).collect()}
    for k, flow in enumerate(fixtures.FLOWS):
        assert rows[k + 1]["volume"] == pytest.approx(flow, abs=1.0)
    total = nw.link_bpr(net).agg(F.sum("beckmann")).head()[0]
    assert total == pytest.approx(26871.892964853432, rel=1e-12)


def test_read_csv(spark, tmp_path):
    (tmp_path / "link.csv").write_text("LINK_ID,Capacity,length,vdf_length_mi,free_speed\n1,100,5,10,60\n2,200,6,,30\n")
    (tmp_path / "columns.csv").write_text("unique_route_id,o_zone_id,d_zone_id,ref_volume,flow,link_ids\n1,1,2,5,8,1;2\n2,1,2,1,2,2\n")
    (tmp_path / "demand.csv").write_text("o_zone_id,d_zone_id,volume\n1,2,12\n")
    net = read_network(spark, f"{tmp_path}/link.csv", f"{tmp_path}/columns.csv", f"{tmp_path}/demand.csv", f"{tmp_path}/missing.csv")
    links = {r["link_id"]: r for r in net.links.collect()}
    assert links[1]["length"] == 10.0 and links[1]["t0"] == 10.0
    assert sorted(r["flow"] for r in net.routes.collect()) == [2.0, 8.0]
    assert nw.od_demand(net).head()["demand"] == 12.0 and net.performance is None
    (tmp_path / "bad.csv").write_text("link_id,length\n1,5\n")
    with pytest.raises(ValueError, match="capacity"):
        read_network(spark, f"{tmp_path}/bad.csv", f"{tmp_path}/columns.csv")
