"""Dense indexes in sorted order without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

LANES = 32
#: Rows that are ranked in one task, about.
LANE_ROWS = 1_000_000


def sketch_of(df: DataFrame, column: str, lanes: int) -> tuple[int, list]:
    """The number of rows, and bounds that part a column into ranges: quantiles, of text those of a bounded number of its values."""
    if dict(df.dtypes)[column] == "string":
        some = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(50 * lanes).collect())
        return df.count(), sorted(set(some[49::50]))
    found = df.agg(F.count(F.lit(1)), F.percentile_approx(column, F.lit([(i + 1) / lanes for i in range(lanes - 1)]), 20 * lanes)).head()
    return found[0], sorted(set(found[1] or []))


def bounds_of(df: DataFrame, column: str, lanes: int) -> list:
    """Bounds that part a column into ranges."""
    return sketch_of(df, column, lanes)[1] if lanes > 1 else []


def lane_among(column: str, bounds: list) -> Column:
    """The number of bounds below a value."""
    return F.size(F.filter(F.lit(bounds), lambda b: b < F.col(column))) if bounds else F.lit(0)


def lane_of(df: DataFrame, column: str, lanes: int) -> Column:
    """Which of some ranges of a column a row lies in."""
    return lane_among(column, bounds_of(df, column, lanes))


def by_ranges(df: DataFrame, keys: Sequence[str], rows: int, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` dealt to ranges of about ``LANE_ROWS`` rows by its distinct keys, and written with ``__at``: the row's place from 0 within its group.

    Bounds are sampled, so there are as many ranges as the rows ask for, and a
    first key that very many rows have is parted by the others.  The prefix sums
    over ranges see a row for each range and group.
    """
    ranged, _ = stored(df.repartitionByRange(max(2, -(-rows // LANE_ROWS)), *keys).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*groups, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*keys)) - 1
    placed = ranged.withColumn("__rank", rank).join(bases, [*groups, "__range"])
    return placed.select(*df.columns, (F.col("__base") + F.col("__rank")).cast("long").alias("__at"))


def dense_index(df: DataFrame, keys: Sequence[str], into: str, *, lanes: int = LANES) -> DataFrame:
    """Number the rows of ``df``, whose keys are distinct and not null, from 0 in order of the keys.

    Rows are ranked within ranges of the first key and the ranges' sizes summed
    up.  A value of the first key that has very many rows bounds a range and has
    one of its own, which is parted by the last key.  The summing window sees a
    row for each range alone, whose number is bounded.  A table too large for so
    few ranges is written in ranges of a bounded size (``by_ranges``).
    """
    rows, bounds = sketch_of(df, keys[0], lanes) if lanes > 1 else (df.count(), [])
    if rows > lanes * LANE_ROWS:
        return by_ranges(df, keys, rows).withColumnRenamed("__at", into)
    lane = F.lit(2) * lane_among(keys[0], bounds)
    groups = ["__lane"]
    if len(keys) > 1 and bounds:
        alone = F.col(keys[0]).isin(bounds)
        laned = df.withColumn("__lane", lane + alone.cast("int")).withColumn("__sub", F.when(alone, lane_of(df, keys[-1], lanes)).otherwise(0))
        groups.append("__sub")
    else:
        laned = df.withColumn("__lane", lane)
    counts = laned.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*groups, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)) - 1
    return laned.withColumn("__rank", rank).join(F.broadcast(bases), groups).withColumn(into, (F.col("__base") + F.col("__rank")).cast("long")).select(*df.columns, into)
