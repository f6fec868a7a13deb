"""Exact top-k inner products over an impact-ordered index, score at a time.

A block of vectors is indexed by posting segments.  In a dimension in which few
rows have a component, a segment holds the rows whose components are of one
sign and lie in one of ``LEVELS`` steps of size; a dimension in which most rows
have one is a single segment with a value for every row.  The impact of a
segment on a query is the size of the query's component times the largest one
in the segment.  A query processes the segments of all dimensions by descending
impact, quantised, and each adds its share to the accumulators of its rows.
What the segments left can still add to a row is bounded by the sum over
dimensions of the largest impact left there, and by the length of the query in
those dimensions times the row's length.  Processing stops once these bounds
prove that only a few rows can be among the k best; those are scored exactly
from their vectors.

Spark deals queries and candidates into blocks of bounded size, searches every
pair of blocks as a task of its own, and merges the k best of each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LONG = np.iinfo(np.int64)


class ImpactIndex:
    """Posting segments of a block of integer vectors, by dimension and step of size."""

    LEVELS = 8  # steps of size of a dimension's components
    IMPACTS = 64  # steps to which a query's impacts are quantised
    SPARSE = 4  # a dimension with a component in fewer rows than one in so many has lists of rows

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.largest = max((abs(int(x)) for x in (vectors.max(initial=0), vectors.min(initial=0))), default=0)
        self.kind = np.int32 if self.largest**2 * max(1, dims) < 1 << 30 else np.int64
        #: (dimension, largest size, rows or None for all, values)
        self.segments: list[tuple[int, int, np.ndarray | None, np.ndarray]] = []
        if self.largest >= 1 << 62:
            return  # beyond 64-bit products; rows are compared one by one
        for d in range(dims):
            column = vectors[:, d].astype(self.kind)
            rows = np.flatnonzero(column)
            if self.SPARSE * len(rows) >= n:
                self.segments.append((d, int(np.abs(column).max(initial=0)), None, np.ascontiguousarray(column)))
                continue
            values = column[rows]
            size = np.abs(values)
            step = np.where(values > 0, 1, -1) * (1 + (self.LEVELS - 1) * size.astype(np.int64) // max(1, int(size.max(initial=0))))
            for level in np.unique(step).tolist():
                own = step == level
                self.segments.append((d, int(size[own].max()), rows[own], values[own]))

    def search(self, query: np.ndarray, own: int, k: int, enough: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id isn't ``own``, by falling score, then by id; scores beyond a long are its end."""
        far = max((abs(int(x)) for x in query), default=0) * self.largest * max(1, len(query)) >= 1 << 62
        possible = np.arange(len(self.ids)) if far else self.members(query, k, enough)
        possible = possible[self.ids[possible] != own]
        if far:  # exact integers of any size
            exact = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in self.vectors[possible]]
            ends = [min(max(x, int(_LONG.min)), int(_LONG.max)) for x in exact]
            best = sorted(range(len(possible)), key=lambda i: (-ends[i], self.ids[possible[i]]))[:k]
            return self.ids[possible[best]], np.array([ends[i] for i in best], np.int64)
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]

    def members(self, query: np.ndarray, k: int, enough: int = 256) -> np.ndarray:
        """Rows that may be among the k + 1 best (one of them may be the query's own row): all others are proven not to be."""
        n, size = len(self.ids), np.abs(query)
        if n <= k + 1:
            return np.arange(n)
        kind = self.kind if int(size.max(initial=0)) * self.largest * max(1, len(query)) < 1 << 30 else np.int64
        weight, sums, term = query.astype(kind), np.zeros(n, kind), np.empty(n, kind)
        impacts = [int(size[d]) * most for d, most, _, _ in self.segments]
        step = max(1, max(impacts, default=0) // self.IMPACTS)
        order = sorted((s for s in range(len(impacts)) if impacts[s]), key=lambda s: (-(impacts[s] // step), self.segments[s][0], -impacts[s]))
        # after each place: the sum over dimensions of the largest impact left, and the query's squared length in those dimensions
        left: dict[int, int] = {}
        bounds, total, square = [], 0, 0
        for s in reversed(order):
            bounds.append((total, square))
            d = self.segments[s][0]
            if d not in left:
                square += int(size[d]) ** 2
            if impacts[s] > left.get(d, 0):
                total += impacts[s] - left.get(d, 0)
                left[d] = impacts[s]
        bounds.reverse()
        check = 0.12 * square**0.5
        for s, (total, square) in zip(order, bounds, strict=True):
            d, _, rows, values = self.segments[s]
            if rows is None:
                np.multiply(values, weight[d], out=term)
                sums += term
            else:
                sums[rows] += values * weight[d]
            if square**0.5 > check and total:
                continue
            check = square**0.5 / 2
            more = np.minimum(self.norms * (square**0.5 * (1 + 1e-9)), total)
            least = np.partition(sums - more, n - k - 1)[n - k - 1]
            possible = np.flatnonzero(sums + more >= least)
            if len(possible) <= enough or not total:
                return possible
        return np.arange(n)


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as long; null for a null vector, and for one with a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def top_k(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", queries: str = "vec_id % 20 = 0", k: int = 20, scale: float = 64.0, query_block: int = 1024, block: int = 16_384
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows.

    Queries are the rows that meet the SQL condition ``queries``; candidates
    are all rows with another key than the query's.  Ties go to the smaller
    key.  Rows without a usable vector or key take no part; vectors of unlike
    length are compared as if the shorter ended in zeros.  Rows repeated under
    one key are candidates each; as queries equal ones count once, and unlike
    ones have ranks of their own.  Components and scores beyond a long are its
    end.  An empty table gives an empty result.
    """
    usable = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v"), F.expr(queries).alias("asks"))
    usable = usable.where("id is not null and v is not null")
    totals = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("dims")).head()
    dims, blocks, query_blocks = totals["dims"] or 0, -(-totals["n"] // block) or 1, -(-totals["q"] // query_block) or 1
    form = F.xxhash64("v").alias("form")
    at_q = F.pmod(F.xxhash64("id", "form"), F.lit(query_blocks)).cast("int")
    # candidates are dealt by their place, so rows of one key don't meet in a block
    at_b = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asked = usable.where("asks").select("id", "v", form).dropDuplicates(["id", "form"])
    asking = asked.select(F.lit(True).alias("asks"), "id", "v", "form", at_q.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    placed = usable.select("id", "v", at_b.alias("cb"))
    offered = placed.select(F.lit(False).alias("asks"), "id", "v", F.lit(0).cast("long").alias("form"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "cb")

    def dense(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = part.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), dims), np.int64)
        out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
        return part.column("id").to_numpy(), out

    def search(pair: pa.Table) -> pa.Table:
        asks = pair.column("asks").combine_chunks()
        own = pair.filter(asks)
        ids, qs = dense(own)
        index_ids, index_vectors = dense(pair.filter(pc.invert(asks)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(index_ids):
            index = ImpactIndex(index_ids, index_vectors)
            found = [index.search(q, mine, k) for mine, q in zip(ids.tolist(), qs, strict=True)]
        empty, sizes = np.empty(0, np.int64), [len(f[0]) for f in found]
        return pa.table({
            "query_id": pa.array(np.repeat(ids[: len(found)], sizes), pa.int64()),
            "form": pa.array(np.repeat(own.column("form").to_numpy()[: len(found)], sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([empty, *(f[0] for f in found)]), pa.int64()),
            "score": pa.array(np.concatenate([empty, *(f[1] for f in found)]), pa.int64()),
        })

    local = asking.unionByName(offered).groupBy("qb", "cb").applyInArrow(search, "query_id long, form long, vec_id long, score long")
    best = Window.partitionBy("query_id", "form").orderBy(F.col("score").desc(), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q, usable c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
