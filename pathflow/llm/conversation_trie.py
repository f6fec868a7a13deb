"""Prefix trie of conversations: who shares which first turns, and what sharing saves.

A node is a distinct sequence of first turns.  Its key is 128 bits: the XOR of a
mixed hash of every turn and its place, so the keys of all prefixes are one
running XOR, and a very long conversation can be worked on in blocks.

Partitions of whole conversations build partial tries: node tables with the
number of members, the smallest member and the list of members that end there.
Tables are merged by key, in a tree of rounds where there are very many.  What
then matters is the smallest member of a node: the nodes with the same one form
a chain, the deep part of that conversation, which hangs from a node of another
chain.  The rollup goes over the chains bottom up, level by level of chains, and
ends with running sums within them.

No step needs all rows of a conversation, of a node or of a chain in one task:
conversations of more than ``long_turns`` turns are ordered by ranges, and
chains are summed in blocks of so many nodes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written
from .shingles import mix

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PARTIAL = "k1 long, k2 long, p1 long, p2 long, depth long, chars long, n long, rep long, ends array<long>, part long"


@dataclass(frozen=True)
class Settings:
    """Sizes of the working sets; results don't depend on them."""

    long_turns: int = 50_000  # conversations of more turns, and chains of more nodes, are worked on in blocks
    buffer: int = 100_000  # turns of whole conversations that a partial trie is made of
    fan: int = 256  # partial tables of a node that one merge takes
    chunk: int = 1_000  # members in a row of the end lists


@dataclass(frozen=True)
class Graft:
    """Conversation c begins with the first turns of conversation c - c % every, as many as crc32(c) % most, in place of as many of its own."""

    every: int = 100
    most: int = 6

    def donor(self, conv: Column) -> Column:
        return conv - conv % F.lit(self.every)

    def turns(self, conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % F.lit(self.most)


@dataclass
class Trie:
    """``nodes``: k1, k2 (key), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  ``ends``: k1, k2, first, conv_ids: members that end at a node, in rows of ascending ids."""

    nodes: DataFrame
    ends: DataFrame


def turn_digests(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, a, b, chars``: 128 bits of the SHA-256 of role and text, and the text's code points."""
    r, x = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, x), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), half(1).alias("a"), half(17).alias("b"), F.char_length(x).cast("long").alias("chars"))


def _order(*more: str) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc(), *[F.col(c).asc() for c in more]]


def contributions(a: np.ndarray, b: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns at positions from 1 add to the keys."""
    at = position.astype(np.uint64)
    return mix(a.view(np.uint64) + mix(at * _A)), mix(b.view(np.uint64) + mix(at * _B))


def _rebuilt(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Conversations with their grafted heads: the ids, their lengths, and the source row of every turn."""
    family, conv = rows["family"], rows["conv"]
    new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (family[1:] != family[:-1])))
    start = np.flatnonzero(new)
    k = np.diff(np.append(start, len(conv)))
    own_family, ids, h = family[start], conv[start], rows["h"][start]
    change = np.concatenate(([True], own_family[1:] != own_family[:-1]))
    donor = np.flatnonzero(change)[np.cumsum(change) - 1]  # the donor stands first among its family
    taken = np.minimum(h, np.where(ids[donor] == own_family, k[donor], 0))
    length = np.where(rows["silent"][start], 0, taken + np.maximum(k - h, 0))
    owner = np.repeat(np.arange(len(ids)), length)
    position = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
    source = np.where(position < taken[owner], start[donor][owner] + position, (start + h - taken)[owner] + position)
    return ids, length, owner, position, source, rows["silent"][start]


def partial_trie(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The node table of whole conversations, sorted by family, donor first, conversation and order."""
    ids, length, owner, position, source, silent = _rebuilt(rows)
    c1, c2 = contributions(rows["a"][source], rows["b"][source], position + 1)
    begin = np.cumsum(length) - length
    keys = []
    for c in (c1, c2):
        run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(c))) if len(c) else np.zeros(1, np.uint64)
        keys.append(run[1:] ^ run[begin[owner]])
    member, last = ids[owner], position + 1 == length[owner]
    order = np.lexsort((member, keys[1], keys[0]))
    k1, k2 = keys[0][order], keys[1][order]
    first = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))) if len(order) else np.zeros(0, np.int64)
    at = order[first]
    ends = last[order]
    live = ids[~silent]
    empty = np.sort(ids[~silent & (length == 0)])
    out = {"k1": k1[first], "k2": k2[first], "p1": k1[first] ^ c1[at], "p2": k2[first] ^ c2[at], "depth": position[at] + 1, "chars": rows["chars"][source][at], "n": np.diff(np.append(first, len(order))), "rep": member[at]}
    sizes = np.add.reduceat(ends, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    if len(live):  # the root
        root = {"rep": live.min(), "n": len(live)}
        out = {c: np.concatenate((np.array([root.get(c, 0)]).astype(v.dtype), v)) for c, v in out.items()}
        sizes = np.concatenate(([len(empty)], sizes))
    return out | {"sizes": sizes, "members": np.concatenate((empty, member[order][ends]))}


def _partial_tries(settings: Settings):
    """Over rows ``family, conv, a, b, chars, h, silent`` in order: partial tries of about ``buffer`` turns each."""
    names = ("family", "conv", "a", "b", "chars", "h", "silent")

    def table(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        trie = partial_trie(rows)
        ends = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(trie["sizes"]))), pa.int32()), pa.array(trie["members"], pa.int64()))
        cols = [pa.array(trie[c].view(np.int64) if trie[c].dtype == np.uint64 else trie[c], pa.int64()) for c in ("k1", "k2", "p1", "p2", "depth", "chars", "n", "rep")]
        part = pa.array(np.full(len(trie["k1"]), TaskContext.get().partitionId()), pa.int64())
        return pa.RecordBatch.from_arrays([*cols, ends, part], names=["k1", "k2", "p1", "p2", "depth", "chars", "n", "rep", "ends", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, n = {}, [], 0

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([p[c] for p in parts]) for c in names}

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append({c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)})
            n += batch.num_rows
            if n < settings.buffer:
                continue
            held = joined()
            change = (held["conv"][1:] != held["conv"][:-1]) | (held["family"][1:] != held["family"][:-1])
            cuts = np.flatnonzero(change) + 1
            if not len(cuts):
                parts = [held]
                continue
            cut = int(cuts[-1])  # the last conversation may go on
            yield table({c: v[:cut] for c, v in held.items()})
            rest = {c: v[cut:] for c, v in held.items()}
            family = rest["family"][0]
            donor = np.flatnonzero((held["family"][:cut] == family) & (held["conv"][:cut] == family))[: settings.head]
            if len(donor) and rest["conv"][0] != family:
                rest = {c: np.concatenate((held[c][donor], v)) for c, v in rest.items()}
                rest["silent"][: len(donor)] = True
            parts, n = [rest], len(rest["conv"])
        if n:
            yield table(joined())

    return run


@dataclass(frozen=True)
class _Work(Settings):
    head: int = 5  # turns that a graft takes at most


def _long_partials(rows: DataFrame, heads: DataFrame, known: DataFrame, graft: Graft, settings: Settings, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """Partial node rows of long conversations, worked on in ranges and blocks of turns; and the tables that they read."""
    parts = max(1, -(-2 * total // settings.long_turns))
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, F.col("conv"), *_order("place"))
    ranged = written(ordered.withColumn("pid", F.spark_partition_id()))
    sums = ranged.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("k"))
    before = sums.select("conv", "pid", F.coalesce(F.sum("k").over(Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("conv", "pid").orderBy(*_order("place")))
    given = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).select(F.col("conv").alias("donor"), "k")
    info = known.select("conv", "turns", graft.donor(F.col("conv")).alias("donor"), graft.turns(F.col("conv")).alias("h")).join(given, "donor", "left")
    info = info.select("conv", "turns", "donor", "h", F.least("h", F.coalesce("k", F.lit(0))).alias("taken"))
    head = info.join(heads.select(F.col("conv").alias("donor"), "nth", "a", "b", "chars"), "donor").where("nth <= taken").select("conv", F.col("nth").cast("long").alias("position"), "a", "b", "chars")
    own = ranged.withColumn("nth", nth).join(before, ["conv", "pid"]).join(info, "conv").withColumn("at", F.col("before") + F.col("nth")).where("at > h")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("position"), "a", "b", "chars")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, position, a, b, chars = batch.columns
            c = contributions(a.to_numpy(), b.to_numpy(), position.to_numpy())
            yield pa.RecordBatch.from_arrays([conv, position, chars, *[pa.array(x.view(np.int64)) for x in c]], names=["conv", "position", "chars", "c1", "c2"])

    keyed = written(head.unionByName(own).mapInArrow(add, "conv long, position long, chars long, c1 long, c2 long").withColumn("block", F.expr(f"position div {settings.long_turns}")))
    blocks = keyed.groupBy("conv", "block").agg(F.bit_xor("c1").alias("c1"), F.bit_xor("c2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(o) for c, o in (("c1", "o1"), ("c2", "o2"))])
    within = Window.partitionBy("conv", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lasts = info.select("conv", (F.col("turns") - F.col("h") + F.col("taken")).alias("last"))
    run = keyed.join(offsets, ["conv", "block"]).join(lasts, "conv").select("*", *[F.bit_xor(c).over(within).bitwiseXOR(F.col(o)).alias(k) for c, o, k in (("c1", "o1", "k1"), ("c2", "o2", "k2"))])
    none = F.array().cast("array<long>")
    nodes = run.select(
        "k1", "k2", F.col("k1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("c2")).alias("p2"), F.col("position").alias("depth"), "chars",
        F.lit(1).cast("long").alias("n"), F.col("conv").alias("rep"), F.when(F.col("position") == F.col("last"), F.array("conv")).otherwise(none).alias("ends"), F.lit(0).cast("long").alias("part"),
    )
    zero = F.lit(0).cast("long")
    root = known.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")).select(*[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "depth", "chars")], "n", "rep", none.alias("ends"), zero.alias("part"))
    return nodes.unionByName(root), [ranged, keyed]


def merged(partial: DataFrame, settings: Settings, parts: int) -> DataFrame:
    """Node tables summed by key: rounds that each take ``fan`` parts of a node together, until one is left."""
    aggs = [*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars")], F.sum("n").alias("n"), F.min("rep").alias("rep")]
    while parts > settings.fan:
        partial = partial.groupBy("k1", "k2", F.expr(f"part div {settings.fan}").alias("part")).agg(*aggs)
        parts = -(-parts // settings.fan)
    return partial.groupBy("k1", "k2").agg(*aggs)


def end_lists(partial: DataFrame, settings: Settings) -> DataFrame:
    """``k1, k2, first, conv_ids``: members that end at a node in rows of at most ``chunk`` ascending ids."""
    ends = partial.select("k1", "k2", F.explode("ends").alias("conv")).repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, conv = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1, [len(conv)]))
            cuts = np.unique(np.concatenate([new, *[np.arange(a, b, settings.chunk) for a, b in zip(new[:-1], new[1:], strict=True) if b - a > settings.chunk]]))
            at = cuts[:-1]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(conv))
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(conv[at]), lists], names=["k1", "k2", "first", "conv_ids"])

    return ends.mapInArrow(run, "k1 long, k2 long, first long, conv_ids array<long>")


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the ids in decimal, ascending and joined by commas; rows of a node are read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            ids = batch.column(3)
            for i, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest, comma = own, hashlib.sha256(), b""
                digest.update(comma + ",".join(map(str, ids[i].as_py())).encode())
                comma = b","
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])
            out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def chain_totals(chains: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rep, leaves, saved`` of each chain's whole subtree, and the tables that it reads.

    Level by level of chains, what a chain has passed to it goes on to the one
    that it hangs from: after k rounds the sums of all chains k levels below.
    """
    level = written(chains.select("rep", "leaves", "saved"))
    up = chains.where("parent_rep is not null").select("rep", "parent_rep")
    found = [level]
    while level.limit(1).count():
        level = written(level.join(up, "rep").groupBy(F.col("parent_rep").alias("rep")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        found.append(level)
    return functools.reduce(DataFrame.unionByName, found).groupBy("rep").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), found


def rolled_up(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Node rows with their parents, children, leaves and savings."""
    worth = (F.col("n") - 1) * F.col("chars")
    own = nodes.groupBy("rep").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"), F.sum(worth).alias("saved"))
    own = own.select("rep", "top", "bottom", "p.p1", "p.p2", "saved")
    at = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_rep"))
    hung = written(own.where("top > 0").join(at, ["p1", "p2"]).select("rep", "parent_rep", "top", "bottom", "saved").unionByName(own.where("top = 0").select("rep", F.lit(None).cast("long").alias("parent_rep"), "top", "bottom", "saved")))
    lowest = hung.where("parent_rep is not null").groupBy(F.col("parent_rep").alias("rep")).agg(F.max(F.col("top") - 1).alias("lowest"))
    chains = written(hung.join(lowest, "rep", "left").select("rep", "parent_rep", "top", "bottom", "saved", F.when(F.coalesce("lowest", F.lit(-1)) < F.col("bottom"), 1).otherwise(0).cast("long").alias("leaves")))
    totals, levels = chain_totals(chains)
    passed = chains.where("parent_rep is not null").select("rep", "parent_rep", (F.col("top") - 1).alias("depth")).join(totals, "rep")
    hangs = passed.groupBy(F.col("parent_rep").alias("rep"), "depth").agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("below"), F.sum("saved").alias("passed"))
    block = F.expr(f"depth div {settings.long_turns}").alias("block")
    nothing = {"k1": "long", "k2": "long", "n": "long", "worth": "long", "ends_sha256": "string", "parent_rep": "long", "hung": "long", "below": "long", "passed": "long"}
    fields = lambda df: df.select("rep", block, "depth", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in nothing.items()])
    parts = [nodes.withColumn("worth", worth), hangs, chains.where("parent_rep is not null").select("rep", F.col("top").alias("depth"), "parent_rep")]
    every = functools.reduce(DataFrame.unionByName, map(fields, parts)).groupBy("rep", "block", "depth").agg(*[F.max(c).alias(c) for c in nothing])
    every = every.select("rep", "block", "depth", "k1", "k2", "n", "ends_sha256", "parent_rep", F.coalesce("hung", F.lit(0)).alias("hung"), F.coalesce("below", F.lit(0)).alias("below"), (F.col("worth") + F.coalesce("passed", F.lit(0))).alias("saved"))
    reach = chains.where(F.expr(f"bottom div {settings.long_turns} > top div {settings.long_turns}")).select("rep", "bottom")
    if reach.limit(1).count():
        # sums of the blocks below, for chains of several
        every = written(every)
        sums = every.join(reach, "rep").groupBy("rep", "block").agg(F.sum("saved").alias("saved"), F.sum(F.col("below") + F.when((F.col("depth") == F.col("bottom")) & (F.col("hung") == 0), 1).otherwise(0)).alias("below"))
        deeper = Window.partitionBy("rep").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        later = sums.select("rep", "block", F.sum("saved").over(deeper).alias("later_saved"), F.sum("below").over(deeper).alias("later_below"))
        every = every.join(later, ["rep", "block"], "left")
    else:
        every = every.select("*", *[F.lit(None).cast("long").alias(c) for c in ("later_saved", "later_below")])
    up = Window.partitionBy("rep", "block").orderBy(F.col("depth").desc())
    last = (F.row_number().over(up) == 1) & F.col("later_saved").isNull()
    every = every.withColumn("children", F.col("hung") + F.when(last, 0).otherwise(1))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    leaves = F.sum(F.col("below") + F.when(F.col("children") == 0, 1).otherwise(0)).over(so_far) + F.coalesce("later_below", F.lit(0))
    saved = F.sum("saved").over(so_far) + F.coalesce("later_saved", F.lit(0))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_rep", "rep"))
    out = every.select("k1", "k2", F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    result = written(out)
    discard(hung, chains, *levels)
    return result


def prefix_trie(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", graft: Graft = Graft(), settings: Settings = Settings()) -> Trie:
    """The trie of all conversations of ``turns``, each rebuilt by ``graft`` (``Graft(most=1)``: as they are).

    Turns are in order of ``turn``, null first; equal ones in order of a digest
    of their role and text.  Null roles and texts are empty.  Rows without a
    conversation (null) belong to none.  Repeated rows are turns of their own.
    Remainders have the sign of the id, as in SQL.  An empty table has no nodes.
    Columns are found by name, others are of no account.
    """
    spark = turns.sparkSession
    rows = written(turn_digests(turns, conv, turn, role, text))
    c = F.col("conv")
    known = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")).where(F.col("turns") > settings.long_turns))
    found = known.agg(F.count(F.lit(1)).alias("n"), F.sum("turns").alias("turns")).head()
    usual, used = rows.withColumn("silent", F.lit(False)), []
    if found["n"]:
        ids = known.select("conv")
        donors = known.select(graft.donor(c).alias("conv")).unionByName(ids).distinct()
        nth = F.row_number().over(Window.partitionBy("conv").orderBy(*_order()))
        heads = written(rows.join(donors, "conv", "left_semi").withColumn("nth", nth).where(F.col("nth") < graft.most))
        long_donors = ids.where(c == graft.donor(c))
        silent = heads.join(long_donors, "conv", "left_semi").drop("nth").withColumn("silent", F.lit(True))
        usual = rows.join(ids, "conv", "left_anti").withColumn("silent", F.lit(False)).unionByName(silent)
        used.append(heads)
    work = _Work(settings.long_turns, settings.buffer, settings.fan, settings.chunk, graft.most - 1)
    dealt = usual.withColumn("family", graft.donor(c)).withColumn("h", graft.turns(c)).repartition("family")
    ordered = dealt.sortWithinPartitions("family", c != F.col("family"), "conv", *_order()).select("family", "conv", "a", "b", "chars", "h", "silent")
    partial = ordered.mapInArrow(_partial_tries(work), PARTIAL)
    if found["n"]:
        more, tables = _long_partials(rows.join(known.select("conv"), "conv", "left_semi"), heads, known, graft, settings, found["turns"])
        partial, used = partial.unionByName(more), used + tables
    partial = written(partial)
    discard(rows, known, *used)
    ends = written(end_lists(partial, settings))
    parts = (partial.agg(F.max("part").alias("m")).head()["m"] or 0) + 1
    nodes = written(merged(partial, settings, parts).join(end_digests(ends), ["k1", "k2"], "left"))
    discard(partial)
    out = rolled_up(nodes, settings)
    discard(nodes)
    return Trie(out, ends)


#: The query in DuckDB's SQL; it has no CRC-32, which is therefore folded over the id's digits, a bit at a time.
SQL = """
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
    FROM (SELECT DISTINCT c FROM t)
), h AS (
    SELECT c, c - c % 100 AS donor, crc % 6 AS h FROM crc
), taken AS (
    SELECT h.c, t.p, t.r, t.x FROM h JOIN t ON t.c = h.donor AND t.p <= h.h
    UNION ALL
    SELECT t.c, t.p, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.p > h.h
), seq AS (
    SELECT h.c, coalesce(list({'r': r, 'x': x} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM h LEFT JOIN taken USING (c) GROUP BY h.c
), pre AS (
    SELECT c, d, s[1:d] AS k, s[1:d - 1] AS up, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars, d = len(s) AS ends FROM seq, unnest(range(0, len(s) + 1)) AS u(d)
), node AS (
    SELECT k, min(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM pre GROUP BY k
), kids AS (
    SELECT up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY up
), sub AS (
    SELECT pre.k, sum((node.n - 1) * node.chars) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
    FROM node JOIN seq ON seq.c = node.c JOIN pre ON pre.c = node.c AND pre.d <= node.d LEFT JOIN kids ON kids.k = node.k GROUP BY pre.k
)
SELECT node.c AS conv_id, node.d AS depth, CASE WHEN node.d > 0 THEN parent.c END AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
    sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN node AS parent ON parent.k = node.up
"""
