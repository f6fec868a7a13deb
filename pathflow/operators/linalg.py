"""The Gramian and the truncated SVD of the minor incidence."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from . import spread

#: Largest dense block of link rows that the driver holds, in numbers.
DRIVER_NUMBERS = 100_000_000
#: Links up to which the Gramian is held whole, in each task and on the driver.
EXACT_LINKS = 2_500
#: Entries of a row whose products one task makes.
ROW_ENTRIES = 1_000
#: Products that a task makes and sums up, about.
TASK_PRODUCTS = 1_000_000
#: Widest Krylov basis, in blocks.
BLOCKS = 10
#: Entries up to which one task makes all Krylov steps; so many fit a slab of a solve.
TASK_ENTRIES = 2_000_000


def gramian(matrix: DataFrame, *, row: str = "route_id", col: str = "link_id") -> DataFrame:
    """``a, b, val`` with a <= b: the products of columns that share rows.

    A row is one list of its entries, whose pairs arise where it lies.  A row of
    more than ``ROW_ENTRIES`` is parted into lists by a hash of the column, and
    every two of its lists go to a task of their own, so no task makes more than
    that number's square of products for a row.  Lists are written once and
    dealt to as many tasks as their products ask for (``TASK_PRODUCTS``), and
    so are the products, which are summed up where they are dealt to.
    """
    sizes = matrix.groupBy(row).agg(F.ceil(F.count(F.lit(1)) / ROW_ENTRIES).alias("parts"))
    lists, _ = stored(matrix.join(sizes, row).groupBy(row, "parts", F.pmod(F.xxhash64(col), F.col("parts")).alias("part")).agg(F.collect_list(F.struct(F.col(col).alias("c"), "mult")).alias("cells")))
    products = lists.groupBy(row).agg(F.sum(F.size("cells")).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).head()[0] or 0
    tasks = max(matrix.sparkSession.sparkContext.defaultParallelism, int(products // TASK_PRODUCTS) + 1)
    lists = lists.repartition(tasks, row, "part")
    alone = lists.where("parts = 1").select(F.col("cells").alias("x"), F.col("cells").alias("y"), F.lit(True).alias("same"))
    left, right = (lists.where("parts > 1").select(row, F.col("part").alias(p), F.col("cells").alias(c)) for p, c in (("i", "x"), ("j", "y")))
    crossed = left.join(right, row).where("i <= j").repartition(tasks, row, "i", "j").select("x", "y", (F.col("i") == F.col("j")).alias("same"))
    pairs = alone.unionByName(crossed).select(F.explode("x").alias("p"), "y", "same").select("p", F.explode("y").alias("q"), "same").where("not same or p.c <= q.c")
    cells = pairs.select(F.least("p.c", "q.c").alias("a"), F.greatest("p.c", "q.c").alias("b"), (F.col("p.mult") * F.col("q.mult")).alias("val"))
    return cells.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("val").alias("val"))


def times(row: np.ndarray, col: np.ndarray, val: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    """A sparse matrix in coordinates times a vector or a block of vectors."""
    if x.ndim == 1:
        return np.bincount(row, weights=val * x[col], minlength=n_rows)[:n_rows]
    x, out = np.asfortranarray(x), np.empty((n_rows, x.shape[1]), order="F")  # columns lie together, as they are read and written
    for k in range(x.shape[1]):
        out[:, k] = np.bincount(row, weights=val * x[:, k][col], minlength=n_rows)[:n_rows]
    return out


@dataclass
class Svd:
    """B2 ~ U diag(sigma) V'; U's rows are B2's rows times ``basis`` = V / sigma."""

    sigma: np.ndarray
    v: np.ndarray
    wanted: int  # rank by the rule; fewer where the numerical rank is lower

    @property
    def basis(self) -> np.ndarray:
        return self.v / self.sigma


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches (links, mults) as one set of coordinates."""
    rows, cols, vals, n = [], [], [], 0
    for batch in batches:
        links, mults = (pc.fill_null(c, []) for c in batch.columns)
        sizes = pc.list_value_length(links).to_numpy(zero_copy_only=False)
        rows.append(n + np.repeat(np.arange(len(sizes)), sizes))
        cols.append(pc.list_flatten(links).to_numpy(zero_copy_only=False))
        vals.append(pc.list_flatten(mults).to_numpy(zero_copy_only=False))
        n += len(sizes)
    parts = [np.concatenate(x or [np.zeros(0)]).astype(t) for x, t in ((rows, np.int64), (cols, np.int64), (vals, float))]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((*parts, n), pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["slab"])


def slabs_of(matrix: DataFrame) -> RDD:
    """A matrix as one set of coordinates for each partition: rows with ``links, mults``, or entries ``path_idx, link_idx, mult``."""
    if "links" not in matrix.columns:
        matrix = matrix.groupBy("path_idx").agg(F.collect_list("link_idx").alias("links"), F.collect_list("mult").alias("mults"))
    blobs = matrix.select(F.col("links").cast("array<long>"), F.col("mults").cast("array<double>")).mapInArrow(_coordinates, "slab binary")
    return blobs.rdd.map(lambda r: pickle.loads(r["slab"])).persist(StorageLevel.MEMORY_AND_DISK)


def _pairs(slab: tuple, n_links: int) -> np.ndarray:
    """The slab's share of B'B as a dense matrix."""
    row, col, val, _ = slab
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    out, steps = np.zeros((n_links, n_links)), 1
    np.add.at(out, (col, col), val * val)
    while True:  # entries that lie so many places apart in one row
        near = np.flatnonzero(row[steps:] == row[:-steps]) if steps < len(row) else []
        if not len(near):
            return out
        share = val[near] * val[near + steps]
        np.add.at(out, (col[near], col[near + steps]), share)
        np.add.at(out, (col[near + steps], col[near]), share)
        steps += 1


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns, also to the basis, of a block that is orthogonal to it but for rounding."""
    block = np.linalg.qr(block)[0]  # what rounding left of the basis in short columns grows with them, and goes then
    return np.linalg.qr(block - basis @ (basis.T @ block))[0]


def _leading(times_gramian, n_links: int, rank: int, k: int, iterations: int, tolerance: float, seed: int, start: np.ndarray | None = None, blocks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of B'B and their vectors by block Krylov steps with thick restarts; an error if they don't converge. ``start``: vectors to begin with."""
    most = min((blocks or BLOCKS) * k, DRIVER_NUMBERS // n_links)
    basis = np.empty((n_links, min(most, n_links)), order="F")
    block = np.random.default_rng(seed).normal(size=(n_links, k))
    if start is not None:
        block[:, : min(k, start.shape[1])] = start[:, :k]
    block = np.linalg.qr(block)[0]
    inner, n, worst = np.zeros((0, 0)), 0, np.inf
    for _ in range(iterations):
        width = block.shape[1]
        basis[:, n : n + width] = block
        q = basis[:, : n + width]
        image = times_gramian(block)
        against = q.T @ image
        grown = np.zeros((n + width, n + width))
        grown[:n, :n] = inner
        grown[:, n:] = against
        grown[n:, :] = against.T
        inner, n = (grown + grown.T) / 2, n + width
        rest = image - q @ against
        rest -= q @ (q.T @ rest)
        values, turn = np.linalg.eigh(inner)
        values, turn = values[::-1], turn[:, ::-1]
        # every vector's residual lies in the part of the last block's image outside the basis
        worst = np.linalg.norm(rest @ turn[n - width :, :rank], axis=0).max() / max(values[0], 1e-300)
        if worst <= tolerance or n == n_links:
            return values[:rank], q @ turn[:, :rank]
        if n + k > basis.shape[1] and n_links > basis.shape[1]:
            n = max(k, basis.shape[1] // 3)
            block = _orthonormal(rest, q)
            basis[:, :n] = q @ turn[:, :n]
            inner = np.diag(values[:n])
        else:
            block = _orthonormal(rest, q)[:, : n_links - n]
    raise ValueError(f"the leading {rank} singular vectors have a residual of {worst:.1e} of the largest value after {iterations} block steps, above {tolerance:.1e}")


def truncated_svd(slabs: RDD, n_links: int, rank: int, *, wanted: int | None = None, iterations: int = 400, oversample: int = 10, tolerance: float = 1e-10, seed: int = 42, apart: bool = False) -> Svd | spread.Spread:
    """Leading singular values and right vectors.

    Up to ``EXACT_LINKS`` links the slabs' shares of B'B are summed in a tree
    and the driver has all its eigenvectors.  Beyond that, block Krylov steps
    with full orthogonalisation.  A matrix of at most ``TASK_ENTRIES`` entries
    goes to one task, which makes all steps and gives the vectors alone.  Of a
    larger one the vectors stay on the executors (``spread.spread_svd``); the
    driver gets them in the end, or with ``apart`` not at all.  Above
    ``spread.COLUMN_ENTRIES`` every step sends a block (links x rank) to the
    slabs and sums their shares of B'B V on the driver.  The steps end when B'B v - value v is at
    most ``tolerance`` of the largest value for each vector; an error if
    ``iterations`` steps don't reach that.  The block is wider than the rank, so
    equal values are all found.  The rank is cut to the singular values above
    1e-9 of the largest, or above what the rounding of B'B leaves of a zero.
    Signs: the component of largest size in each vector is above zero.
    """
    k = min(rank + oversample, n_links)
    sc = slabs.context
    if n_links <= EXACT_LINKS:
        return of_gramian(slabs.map(lambda slab: _pairs(slab, n_links)).treeReduce(lambda a, b: a + b), rank, wanted)
    entries = slabs.map(lambda slab: len(slab[0])).sum()
    if entries <= TASK_ENTRIES and n_links * 3 * k <= DRIVER_NUMBERS:
        return _in_one_task(slabs, n_links, rank, rank if wanted is None else wanted, dict(iterations=iterations, oversample=oversample, tolerance=tolerance, seed=seed, blocks=BLOCKS))
    if entries <= spread.COLUMN_ENTRIES:
        found = spread.spread_svd(slabs, n_links, rank, rank if wanted is None else wanted, iterations=iterations, tolerance=tolerance, seed=seed)
        if apart:
            return found
        out = Svd(found.sigma, found.collected(), found.wanted)
        found.drop()
        return out
    if n_links * 3 * k > DRIVER_NUMBERS:
        raise ValueError(f"{n_links} links at rank {rank} don't fit the driver's bound of {DRIVER_NUMBERS} numbers")

    def share(block):
        def one(slab):
            row, col, val, n = slab
            return times(col, row, val, times(row, col, val, block.value, n), n_links)

        return one

    def times_gramian(q):
        block = sc.broadcast(q)
        out = slabs.map(share(block)).treeReduce(lambda a, b: a + b)
        block.destroy()
        return out

    return finished(*_leading(times_gramian, n_links, rank, k, iterations, tolerance, seed), rank if wanted is None else wanted)


def _in_one_task(slabs: RDD, n_links: int, rank: int, wanted: int, settings: dict) -> Svd:
    """``of_coordinates`` of all slabs, in a task."""

    def one(parts: Iterator[tuple]) -> Iterator[bytes]:
        rows, cols, vals, n = [], [], [], 0
        for row, col, val, size in parts:
            rows.append(row + n)
            cols.append(col)
            vals.append(val)
            n += size
        try:
            found = of_coordinates((*(np.concatenate(x) for x in (rows, cols, vals)), n), n_links, rank, **settings)
        except ValueError as e:  # raised again by the driver
            found = e
        yield pickle.dumps(found, pickle.HIGHEST_PROTOCOL)

    found = pickle.loads(slabs.coalesce(1).mapPartitions(one).first())
    if isinstance(found, ValueError):
        raise found
    found.wanted = wanted
    return found


def of_gramian(whole: np.ndarray, rank: int, wanted: int | None = None) -> Svd:
    """Leading singular values and right vectors from all of B'B."""
    values, vectors = np.linalg.eigh(whole)
    return finished(values[::-1][:rank], vectors[:, ::-1][:, :rank], rank if wanted is None else wanted)


def of_coordinates(slab: tuple, n_links: int, rank: int, *, start: np.ndarray | None = None, iterations: int = 400, oversample: int = 10, tolerance: float = 1e-10, seed: int = 42, blocks: int | None = None) -> Svd:
    """``truncated_svd`` of one slab's coordinates; ``start`` holds right vectors of a matrix alike."""
    row, col, val, n = slab
    gramian_times = lambda q: times(col, row, val, times(row, col, val, q, n), n_links)
    return finished(*_leading(gramian_times, n_links, rank, min(rank + oversample, n_links), iterations, tolerance, seed, start, blocks), rank)


def finished(values: np.ndarray, vectors: np.ndarray, wanted: int) -> Svd:
    """Singular values above rounding with their vectors, signs fixed."""
    sigma = np.sqrt(np.maximum(values, 0))
    zero = np.sqrt(len(vectors) * np.finfo(float).eps)
    good = sigma > max(1e-9, zero) * max(sigma[0], 1e-300) if len(sigma) else np.zeros(0, bool)
    v = vectors[:, good]
    top = np.abs(v).argmax(axis=0)
    v = v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Svd(sigma[good], v, wanted)


def _latent(links: pa.Array, mults: pa.Array, basis: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Rows of U of a batch's routes, and the batch's coordinates."""
    links, mults = (pc.fill_null(c, []) for c in (links, mults))
    sizes = pc.list_value_length(links).to_numpy(zero_copy_only=False)
    row, col = np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(links).to_numpy(zero_copy_only=False)
    val = pc.list_flatten(mults).to_numpy(zero_copy_only=False).astype(float)
    return times(row, col, val, basis, len(sizes)), (row, col, val)


def _cells(keys: list[pa.Array], names: list[str], block: np.ndarray, value: str) -> pa.RecordBatch:
    """A row for each key and component of a block."""
    n, r = block.shape
    at = pa.array(np.repeat(np.arange(n), r))
    return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(np.tile(np.arange(r, dtype=np.int32), n)), pa.array(block.ravel())], names=[*names, "component", value])


def latent_totals(routes: DataFrame, svd: Svd, weight: str) -> DataFrame:
    """``component, total``: U' times a column of the routes (``links, mults``); a partition gives one row for each component."""
    basis = routes.sparkSession.sparkContext.broadcast(svd.basis)  # links x rank, which the SVD bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, len(svd.sigma)))
        for batch in batches:
            u, _ = _latent(*batch.columns[:2], basis.value)
            total += batch.column(2).to_numpy(zero_copy_only=False) @ u
        yield _cells([], [], total, "total")

    parts = routes.select(F.col("links").cast("array<long>"), F.col("mults").cast("array<double>"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight")).mapInArrow(run, "component int, total double")
    return parts.groupBy("component").agg(F.sum("total").alias("total"))


def latent_by_key(routes: DataFrame, svd: Svd | spread.Spread, keys: list[str], value: str, *, routes_a_part: int = 100_000) -> DataFrame:
    """``keys, component, value``: sums of the rows of U by keys.

    Routes (``links, mults``) move once, those of a key together, a key of very
    many routes in parts; what then moves are sums, keys times the rank.
    """
    counts = routes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    salt = F.pmod(F.xxhash64("links", "route_id"), F.ceil(F.col("__n") / routes_a_part))
    dealt = routes.join(counts, keys).withColumn("__salt", salt).repartition(*keys, "__salt").sortWithinPartitions(*keys)
    if isinstance(svd, spread.Spread):
        return svd.latent_by_key(dealt, keys, value).groupBy(*keys, "component").agg(F.sum(value).alias(value))
    basis = routes.sparkSession.sparkContext.broadcast(svd.basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, _ = _latent(batch.column(0), batch.column(1), basis.value)
            own = [batch.column(2 + i) for i in range(len(keys))]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for k in own:
                change[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(change)
            yield _cells([k.take(pa.array(first)) for k in own], keys, np.add.reduceat(u, first, axis=0), value)

    types = dict(routes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"component int, {value} double"])
    parts = dealt.select(F.col("links").cast("array<long>"), F.col("mults").cast("array<double>"), *keys).mapInArrow(run, schema)
    return parts.groupBy(*keys, "component").agg(F.sum(value).alias(value))


def latent_by_link(routes: DataFrame, svd: Svd, n_links: int, value: str) -> DataFrame:
    """``link_idx, component, value``: B'U of the routes (``links, mults``); a partition gives its links times the rank."""
    basis = routes.sparkSession.sparkContext.broadcast(svd.basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((n_links, len(svd.sigma))), np.zeros(n_links, bool)
        for batch in batches:
            u, (row, col, val) = _latent(*batch.columns, basis.value)
            total += times(col, row, val, u, n_links)
            used[col] = True
        links = np.flatnonzero(used)
        for i in range(0, len(links), 1000):
            part = links[i : i + 1000]
            yield _cells([pa.array(part)], ["link_idx"], total[part], value)

    parts = routes.select(F.col("links").cast("array<long>"), F.col("mults").cast("array<double>")).mapInArrow(run, f"link_idx long, component int, {value} double")
    return parts.groupBy("link_idx", "component").agg(F.sum(value).alias(value))
