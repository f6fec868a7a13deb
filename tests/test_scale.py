"""Operators whose working sets are bounded: selection, numbering and pairs that hold most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathflow.operators import assignment as asg
from pathflow.operators import classes as cls
from pathflow.operators import indexing, linalg
from pathflow.operators import network as nw
from pathflow.operators.layouts import Layouts
from pathflow.sources.network import Network, checked_links, network_from_star


@pytest.mark.parametrize("collected", [200_000, 3])
@pytest.mark.parametrize("kind", ["spread", "ties", "one", "two", "skewed"])
def test_exact_selection(spark, monkeypatch, collected, kind):
    monkeypatch.setattr(cls, "COLLECTED", collected)
    rng = random.Random(kind)
    values = {
        "spread": [rng.uniform(-5, 5) for _ in range(900)], "ties": [float(rng.randrange(7)) for _ in range(900)], "one": [2.5], "two": [1.0] * 450 + [2.0] * 450,
        "skewed": [1.0] * 700 + [rng.lognormvariate(0, 3) for _ in range(200)],
    }[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered, n = sorted(values), len(values)
    places = {k: at for k, at in enumerate(sorted({0, n - 1, n // 2, n // 3, (n - 1) // 10, min(n - 1, 449), min(n - 1, 450)}))}
    assert cls.value_at(df, "v", lambda rows: places if rows == n else {}) == {k: ordered[at] for k, at in places.items()}
    assert cls.value_at(df.where("false"), "v", lambda rows: {0: 0}) == {}


@pytest.mark.parametrize("rows", [1_000_000, 5])
def test_numbering_by_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(indexing, "LANE_ROWS", rows)
    keys = [(a, b) for a in range(20) for b in range(3)] + [(99, b) for b in range(300)]  # one first key has most rows
    df = spark.createDataFrame(keys, "a long, b long").repartition(5)
    found = {(r["a"], r["b"]): r["no"] for r in indexing.dense_index(df, ["a", "b"], "no").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}
    names = spark.createDataFrame([(f"n{k:03}",) for k in range(200)], "name string")
    assert [r["no"] for r in indexing.dense_index(names, ["name"], "no").orderBy("name").collect()] == list(range(200))
    classes = spark.createDataFrame([(k, "minor" if k % 3 else "major") for k in range(400)], "route_id long, class string")
    numbers = {r["route_id"]: r["class_idx"] for r in cls.class_index(classes).collect()}
    assert numbers == {k: (k - 1 - (k - 1) // 3 if k % 3 else k // 3) for k in range(400)}


def test_no_range_above_its_size(spark, monkeypatch):
    monkeypatch.setattr(indexing, "LANE_ROWS", 50)
    df = spark.createDataFrame([(7, k) for k in range(4_000)], "a long, b long")  # one first key alone
    ranged = indexing.by_ranges(df, ["a", "b"], 4_000)
    assert [r["__at"] for r in ranged.orderBy("b").collect()] == list(range(4_000))
    sizes = df.repartitionByRange(80, "a", "b").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() <= 3 * 50


@pytest.fixture(scope="module")
def hot(spark):
    """300 routes over 20 links; 200 of them belong to one pair."""
    rng = np.random.default_rng(4)
    pair = [0 if k < 200 else k % 40 for k in range(300)]
    links = checked_links(spark.createDataFrame([(i, 100.0, 1.0 + i, 30.0) for i in range(20)], "link_id long, capacity double, length double, speed double"))
    routes = [(k, pair[k], 100 + pair[k], float(rng.uniform(1, 9)), ";".join(map(str, rng.integers(0, 20, 3)))) for k in range(300)]
    return Network(links, spark.createDataFrame(routes, "route_id long, o_zone_id long, d_zone_id long, flow double, link_seq string"))


def test_assignment_of_a_hot_pair(hot):
    classes = cls.path_classes(hot, 5.0)
    kind = {r["route_id"]: r["class"] for r in classes.collect()}
    routes = hot.routes.collect()
    demand, majors, all_ = {}, {}, {}
    for r in routes:
        o = r["o_zone_id"]
        demand[o] = demand.get(o, 0.0) + r["flow"]
        majors[o] = majors.get(o, 0) + (kind[r["route_id"]] == "major")
        all_[o] = all_.get(o, 0) + 1
    expected = {r["route_id"]: {"singleton": demand[r["o_zone_id"]], "major": demand[r["o_zone_id"]] / max(1, majors[r["o_zone_id"]]), "minor": 0.0}[kind[r["route_id"]]] for r in routes}
    assigned = asg.proportional_assignment(hot, classes)
    assert {r["route_id"]: r["flow"] for r in assigned.collect()} == pytest.approx(expected)
    even = {r["route_id"]: r["flow"] for r in asg.proportional_assignment(hot).collect()}
    assert even == pytest.approx({r["route_id"]: demand[r["o_zone_id"]] / all_[r["o_zone_id"]] for r in routes})
    assert "Window" not in assigned._jdf.queryExecution().optimizedPlan().toString()


def test_threshold_counts(hot):
    for r in cls.threshold_counts(hot).collect():
        kinds = [x["class"] for x in cls.path_classes(hot, r["threshold"]).select("class").collect()]
        assert (r["n_major"], r["n_minor"]) == (kinds.count("major"), kinds.count("minor"))


def test_incidence_numbers(hot):
    dims = {r["link_id"]: r["link_idx"] for r in nw.link_dim(hot).collect()}
    assert dims == {k: k for k in range(20)}


@pytest.mark.parametrize("most", [1_000, 3])
def test_gramian_of_long_rows(spark, monkeypatch, most):
    monkeypatch.setattr(linalg, "ROW_ENTRIES", most)
    rng = np.random.default_rng(6)
    dense = np.zeros((30, 40))
    dense[0] = rng.integers(1, 4, 40)  # a route over every link
    for k in range(1, 30):
        dense[k, rng.choice(40, rng.integers(0, 6), replace=False)] = 1 + k % 3
    row, col = dense.nonzero()
    entries = spark.createDataFrame([(int(r), int(c), int(dense[r, c])) for r, c in zip(row, col, strict=True)], "route_id long, link_id long, mult long")
    whole = dense.T @ dense
    found = {(r["a"], r["b"]): r["val"] for r in linalg.gramian(entries).collect()}
    assert found == {(a, b): whole[a, b] for a in range(40) for b in range(a, 40) if whole[a, b]}


def test_products_leave_the_incidence_where_it_lies(spark, hot):
    layouts = Layouts.of(hot, 4)
    flows = hot.routes.select("route_id", "flow")
    times = hot.links.select("link_id", F.col("t0").alias("travel_time"))
    for product in (layouts.link_sums(flows), layouts.route_sums(times)):
        plan = product._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 1
        assert plan.count("Exchange hashpartitioning") == 2  # the vector's, and the sums'
    volume = {r["link_id"]: r["total"] for r in layouts.link_sums(flows).collect()}
    expected = {r["link_id"]: r["volume"] for r in nw.link_volume(hot).collect() if r["volume"]}
    assert volume == pytest.approx(expected)
    cost = {r["route_id"]: r["total"] for r in layouts.route_sums(times).collect()}
    t0 = {r["link_id"]: r["t0"] for r in hot.links.collect()}
    assert cost == pytest.approx({r["route_id"]: sum(t0[int(x)] for x in r["link_seq"].split(";")) for r in hot.routes.collect()})
    layouts.drop()


def test_no_task_counts_more_steps_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(nw, "TASK_STEPS", 40)
    net = network_from_star(spark, "/root/testdata/sf0.001")
    n = net.uses.count()
    entries = nw.multiplicities(net)
    sizes = entries.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert entries.rdd.getNumPartitions() >= n / 40 and sizes.max() < 4 * 40


def test_lists_are_dealt_by_their_products(spark, monkeypatch):
    """More tasks than the session's parallelism where there are many products, with the same sums."""
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 2, (200, 30))
    matrix = spark.createDataFrame([(int(r), int(c), 1) for r, c in zip(*dense.nonzero(), strict=True)], "route_id long, link_id long, mult long")
    tasks, repartition = [], type(matrix).repartition
    monkeypatch.setattr(type(matrix), "repartition", lambda self, n, *keys: tasks.append(n) or repartition(self, n, *keys))
    monkeypatch.setattr(linalg, "TASK_PRODUCTS", 1_000)
    found = {(r["a"], r["b"]): r["val"] for r in linalg.gramian(matrix).collect()}
    products = sum(n * (n + 1) // 2 for n in dense.sum(axis=1).tolist())
    assert min(tasks) >= products // 1_000 > 8
    whole = dense.T @ dense
    assert found == {(a, b): whole[a, b] for a in range(30) for b in range(a, 30) if whole[a, b]}
