"""Sharding by rendezvous (highest random weight) hashing.

Every record scores each shard with a hash of (record key, shard number) and
goes to the best-scoring shard.  Adding a shard adds one contestant: a record
either keeps its shard or moves to the new one.  With weights, the score of
shard s is ``-ln(u) / weight`` with u uniform in (0, 1) and the smallest score
wins, so a shard receives records in proportion to its weight.

All of it is DataFrame expressions.  The position of a record in its shard is
counted in two levels, (shard, sub-bucket) then rank inside the sub-bucket, so
that no task sorts a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, written


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard of ``key`` among ``len(weights)`` shards.

    Shards of weight 0 win nothing.  A null key is a key like any other.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and one at least positive")
    name = F.coalesce(key.cast("string"), F.lit("\0null"))
    entries = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 bits of the hash, as a double strictly between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
            entries.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*entries) if len(entries) > 1 else entries[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], *, into: str = "shard", grown_into: str | None = None) -> DataFrame:
    """Add the shard of every row; with ``grown_into`` also the shard after one
    more shard of weight 1 joins.

    No shuffle.  Rows are neither dropped nor merged: repeated rows share a
    shard; an empty table stays empty; existing columns named like the new ones
    are replaced.
    """
    out = df.withColumn(into, rendezvous(F.col(f"`{key}`"), weights))
    if grown_into:
        out = out.withColumn(grown_into, rendezvous(F.col(f"`{key}`"), [*weights, 1.0]))
    return out


def number_slots(df: DataFrame, shard: str, spread: Sequence[str], *, into: str = "slot", sub_buckets: int = 256) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    ``spread`` lists the columns that deal a shard's rows over ``sub_buckets``
    and order them there; rows equal in all of them differ by the place they are
    read from, so ``df``, which is read twice, should be a written table.  One shuffle by (shard, sub-bucket); the offsets are
    a running sum over ``shards x sub_buckets`` counts, which is a bounded
    table whatever the input's size, hence the broadcast.
    """
    cols = [F.col(f"`{c}`") for c in spread]
    sub, count, base, rank, own, part, tie = (free_name(df.columns, c) for c in ("__sub", "__n", "__base", "__rank", "__s", "__b", "__tie"))
    at = F.col(f"`{shard}`")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).withColumn(sub, F.pmod(F.xxhash64(*cols, tie), F.lit(sub_buckets)))
    counts = dealt.groupBy(at.alias(own), F.col(sub).alias(part)).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(own, part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    number = F.row_number().over(Window.partitionBy(at, sub).orderBy(*cols, tie)) - 1
    placed = dealt.withColumn(rank, number).join(F.broadcast(bases), (at == F.col(own)) & (F.col(sub) == F.col(part)))
    return placed.withColumn(into, (F.col(base) + F.col(rank)).cast("long")).drop(sub, rank, own, part, base, tie)


#: Rows that a sub-bucket should have, and the limits of the number of sub-buckets of a shard.
SUB_ROWS, LEAST_SUBS, MOST_SUBS = 20_000, 16, 4096


def shard_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, sub_buckets: int | None = None) -> DataFrame:
    """Deal documents over weighted shards by their key (law ``key``).

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``: size is
    the UTF-8 bytes of the text plus 1 and text_crc32 the CRC-32 of its bytes;
    a null text counts as empty, an empty text has size 1.  Rows with equal
    keys, equal texts or null keys are all kept, each with its own slot.
    Only digests enter the shuffle, never the texts.
    """
    if sub_buckets is None:  # by the number of rows, which Parquet files state
        sub_buckets = min(MOST_SUBS, max(LEAST_SUBS, docs.count() // (SUB_ROWS * len(weights))))
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(f"`{key}`"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = assign_shards(written(slim), key, weights, grown_into="grown_shard")
    slotted = number_slots(sharded, "shard", [key, "text_crc32", "size"], sub_buckets=sub_buckets)
    return slotted.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
