"""The truncated SVD against numpy's on matrices of a flat spectrum."""

import tracemalloc

import numpy as np
import pytest

from pathflow.operators import linalg


@pytest.fixture(scope="module")
def flat(spark):
    """About 4 links of 300 for each of 1,500 routes, some twice, as a matrix and as slabs."""
    rng = np.random.default_rng(3)
    dense = np.zeros((1500, 300))
    np.add.at(dense, (rng.integers(0, 1500, 6000), rng.integers(0, 300, 6000)), 1)
    row, col = dense.nonzero()
    entries = spark.createDataFrame([(int(r), int(c), int(dense[r, c])) for r, c in zip(row, col, strict=True)], "path_idx long, link_idx long, mult long")
    return dense, linalg.slabs_of(entries)


def check(svd, dense, rank):
    sigma, v = np.linalg.svd(dense)[1:]
    assert svd.sigma == pytest.approx(sigma[:rank], rel=1e-10)
    assert np.abs((svd.v * v[:rank].T).sum(axis=0)).min() > 1 - 1e-8


@pytest.mark.parametrize(("most", "blocks"), [(2_500, 20), (0, 20), (0, 4)])
@pytest.mark.parametrize("rank", [10, 50])
def test_leading_vectors(flat, monkeypatch, most, blocks, rank):
    monkeypatch.setattr(linalg, "EXACT_LINKS", most)
    monkeypatch.setattr(linalg, "BLOCKS", blocks)
    check(linalg.truncated_svd(flat[1], 300, rank), flat[0], rank)


def test_no_silent_end(flat, monkeypatch):
    monkeypatch.setattr(linalg, "EXACT_LINKS", 0)
    with pytest.raises(ValueError, match="residual"):
        linalg.truncated_svd(flat[1], 300, 10, iterations=2)


@pytest.mark.parametrize("most", [2_500, 0])
def test_equal_and_zero_values(spark, monkeypatch, most):
    monkeypatch.setattr(linalg, "EXACT_LINKS", most)
    entries = spark.createDataFrame([(i, i % 12, 1) for i in range(24)], "path_idx long, link_idx long, mult long")
    svd = linalg.truncated_svd(linalg.slabs_of(entries), 15, 14)
    assert svd.sigma == pytest.approx([2**0.5] * 12)
    assert svd.v.T @ svd.v == pytest.approx(np.eye(12), abs=1e-12)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_steps_over_slabs_and_in_one_task(flat, monkeypatch, most):
    monkeypatch.setattr(linalg, "EXACT_LINKS", 0)
    monkeypatch.setattr(linalg, "TASK_ENTRIES", most)
    check(linalg.truncated_svd(flat[1], 300, 20), flat[0], 20)


def test_no_steps_on_the_driver(flat, monkeypatch):
    monkeypatch.setattr(linalg, "EXACT_LINKS", 0)
    monkeypatch.setattr(linalg, "_leading", None)  # a task has its own
    check(linalg.truncated_svd(flat[1], 300, 20), flat[0], 20)


@pytest.mark.parametrize("numbers", [32_000_000, 3_000])
def test_vectors_stay_on_the_executors(spark, flat, monkeypatch, numbers):
    """Beyond a task the driver makes no step, whatever the number of links; groups of columns and parts of any size."""
    dense, slabs = flat
    for name, most in (("EXACT_LINKS", 0), ("TASK_ENTRIES", 0), ("DRIVER_NUMBERS", 1)):
        monkeypatch.setattr(linalg, name, most)
    monkeypatch.setattr(linalg, "_leading", None)
    monkeypatch.setattr(linalg.spread, "TASK_NUMBERS", numbers)
    monkeypatch.setattr(linalg.spread, "PART_NUMBERS", numbers)
    check(linalg.truncated_svd(slabs, 300, 20), dense, 20)
    apart = linalg.truncated_svd(slabs, 300, 20, apart=True)
    sigma, v = np.linalg.svd(dense)[1:]
    v = v[:20].T * np.where(v[:20].T[np.abs(v[:20].T).argmax(axis=0), np.arange(20)] < 0, -1.0, 1.0)
    u, flow = dense @ v / sigma[:20], np.arange(1500.0)
    routes = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r > 0].astype(int).tolist(), f) for r, f in zip(dense, flow.tolist(), strict=True)], "links array<long>, mults array<long>, flow double")
    assert {r["component"]: r["total"] for r in apart.latent_totals(routes, "flow").collect()} == pytest.approx(dict(enumerate(u.T @ flow)), rel=1e-6, abs=1e-3)
    found, d = apart.latent_by_link(routes, "d").toPandas(), dense.T @ u
    assert len(found) == 20 * (dense.sum(axis=0) > 0).sum() and np.abs(found["d"] - d[found["link_idx"], found["component"]]).max() < 1e-6
    with pytest.raises(ValueError, match="residual"):
        linalg.truncated_svd(slabs, 300, 10, iterations=1)


def test_converged_vectors_are_set_aside(spark):
    """A value far above the others doesn't hold down the polynomials' degree for long: 16 turns when it did."""
    rng = np.random.default_rng(3)
    dense = np.zeros((8_000, 1_500))
    np.add.at(dense, (np.repeat(np.arange(8_000), 5), rng.integers(0, 1_500, 40_000)), 1.0)
    dense[:, 0] += 1  # a link on every route
    parts = [dense[k::4] for k in range(4)]
    slabs = spark.sparkContext.parallelize([(*x.nonzero(), x[x.nonzero()], len(x)) for x in parts], 4)
    svd = linalg.spread.spread_svd(slabs, 1_500, 20, 20, iterations=9)
    v = svd.collected()
    assert svd.sigma == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:20], rel=1e-12)
    assert np.abs(v.T @ v - np.eye(20)).max() < 1e-12 and np.abs(dense.T @ (dense @ v) - v * svd.sigma**2).max() < 1e-9 * svd.sigma[0] ** 2
    svd.drop()


def test_a_group_of_columns_holds_the_matrix_in_few_bytes():
    rng = np.random.default_rng(5)
    n_links, rows, slabs = 3_000, 40_000, []
    for _ in range(12):
        row = np.sort(rng.integers(0, rows, 120_000))
        slabs.append((row, rng.integers(0, n_links, len(row)), np.where(rng.random(len(row)) < 1e-3, 2.0, 1.0), rows))
    x = rng.normal(size=(n_links, 3))
    wanted = sum(linalg.times(col, row, val, linalg.times(row, col, val, x, n), n_links) for row, col, val, n in slabs)
    packed = [linalg.spread.packed(s) for s in slabs]
    tracemalloc.start()
    held = linalg.spread.Rows.of(packed, n_links)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * 12 * 120_000
    assert np.allclose(held.gramian_times(x), wanted)
    halves = [linalg.spread.packed((row, col, val / 2, n)) for row, col, val, n in slabs]
    assert np.allclose(linalg.spread.Rows.of(halves, n_links).gramian_times(x), wanted / 4)


def test_sums_by_key_where_the_vectors_lie(spark, flat, monkeypatch):
    dense, slabs = flat
    for name, most in (("EXACT_LINKS", 0), ("TASK_ENTRIES", 0), ("DRIVER_NUMBERS", 1)):
        monkeypatch.setattr(linalg, name, most)
    monkeypatch.setattr(linalg.spread.Spread, "collected", None)
    svd = linalg.truncated_svd(slabs, 300, 20, apart=True)
    v = np.linalg.svd(dense)[2][:20].T
    u = dense @ (v * np.where(v[np.abs(v).argmax(axis=0), np.arange(20)] < 0, -1.0, 1.0)) / svd.sigma
    rows = [(i, i % 7, f"k{i % 3}", np.flatnonzero(r).tolist(), r[r > 0].astype(int).tolist()) for i, r in enumerate(dense)]
    routes = spark.createDataFrame([*rows, (9999, 8, "k9", None, None)], "route_id long, a int, b string, links array<long>, mults array<long>")
    found = linalg.latent_by_key(routes, svd, ["a", "b"], "m", routes_a_part=20).collect()
    at = np.arange(1500)
    wanted = {(a, f"k{b}", k): u[(at % 7 == a) & (at % 3 == b), k].sum() for a in range(7) for b in range(3) for k in range(20)} | {(8, "k9", k): 0.0 for k in range(20)}
    assert len(found) == len(wanted)
    assert {(r["a"], r["b"], r["component"]): r["m"] for r in found} == pytest.approx(wanted, abs=1e-6)
