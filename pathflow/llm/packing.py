"""Packing documents into fixed windows by best-fit decreasing.

Documents become token ids; a document longer than a window is first cut into
full windows and a rest.  Pieces then go, longest first, each into the open
window with the least room that still holds it; a segment tree over the
remaining capacities finds that window.

Pieces of one length are interchangeable, so the packing of any number of
pieces is decided from their histogram: at most ``window`` lengths with a count
each, whatever the input's size.  The plan says for every range of ranks within
a length which range of windows takes it and where; Spark ranks the pieces and
joins the plan.  The result is the one that best-fit decreasing gives for all
pieces together.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec, read_added, read_ranks
from .shared import free_name, slices

#: Rows of a rank bucket: a length with more pieces is ranked in several tasks.
BUCKET_ROWS = 4_000


class RoomTree:
    """Segment tree over the capacities 0..most; each leaf counts open windows with that much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open window has."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if not at & 1 and self.sums[at + 1]:  # the right sibling holds larger rooms
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan_packing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of piece lengths.

    Rows ``(length, first rank, end rank, first window, pieces per window,
    offset of the first)``: the pieces of that length with ranks from the first
    up to the end fill windows of consecutive numbers, so many in each.
    """
    tree, groups, plan, opened = RoomTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} ids does not fit a window of {window}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                n = -(-left // per)
                groups.setdefault(window, []).append((opened, n))
                tree.add(window, n)
                opened += n
            per = room // length
            start, n = groups[room].pop()
            take = min(n, left // per)
            if not take:  # the last few pieces share one window
                take, per = 1, left
            if take < n:
                groups[room].append((start + take, n - take))
            elif not groups[room]:
                del groups[room]
            tree.add(room, -take)
            rest = room - per * length
            if rest:
                groups.setdefault(rest, []).append((start, take))
                tree.add(rest, take)
            plan.append((length, rank, rank + take * per, start, per, window - room))
            rank += take * per
            left -= take * per
    return plan


def pack_pieces(pieces: DataFrame, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "start"), window: int = 2048) -> DataFrame:
    """Add ``sequence_id`` (from 0, gapless) and ``offset`` to every piece.

    ``pieces`` is read twice, so it should be a written table.  Every row is
    placed; rows equal in ``order`` get places of their own.  An empty table
    stays empty.  Only the histogram, at most ``window`` rows, visits the
    driver; the plan's size depends on the window and not on the input.
    """
    spark = pieces.sparkSession
    size = F.col(f"`{length}`")
    counts = {r["l"]: r["n"] for r in pieces.groupBy(size.cast("int").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = pieces.columns
    own, sub, rank_, tie = (free_name(taken, c) for c in ("__l", "__sub", "__r", "__tie"))
    plan = spark.createDataFrame(plan_packing(counts, window) or [], "pl int, pfrom long, pto long, pfirst long, pper long, pat long").toDF(*(free_name(taken, c) for c in ("__pl", "__from", "__to", "__first", "__per", "__at")))
    pl, from_, to, first, per, at = (F.col(c) for c in plan.columns)
    keys = [F.col(f"`{c}`") for c in order]
    spread = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], "l int, subs long").toDF(own, free_name(taken, "__subs"))
    # rows equal in the order's columns differ by the place they were read from, so they spread over a length's parts too
    dealt = pieces.withColumn(own, size.cast("int")).withColumn(tie, F.monotonically_increasing_id()).join(F.broadcast(spread), own)
    dealt = dealt.withColumn(sub, F.pmod(F.xxhash64(*keys, tie), F.col(spread.columns[1]))).drop(spread.columns[1])
    count, base = free_name(taken, "__n"), free_name(taken, "__base")
    by_sub = dealt.groupBy(own, sub).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(own).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    bases = by_sub.select(own, sub, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    number = F.row_number().over(Window.partitionBy(own, sub).orderBy(*keys, tie)) - 1
    ranked = dealt.withColumn(rank_, number.cast("long")).join(bases, [own, sub]).withColumn(rank_, F.col(rank_) + F.col(base))
    placed = ranked.join(F.broadcast(plan), (F.col(own) == pl) & (F.col(rank_) >= from_) & (F.col(rank_) < to))
    step = F.col(rank_) - from_
    placed = placed.withColumn("sequence_id", first + F.floor(step / per).cast("long")).withColumn("offset", at + F.pmod(step, per) * F.col(own))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")


class Encoder:
    """Ids of whole texts by the tokenizer file at ``path``; with ``added`` its added tokens are found within a text."""

    def __init__(self, path: str, pattern: str, added: bool = True):
        import tiktoken

        self.pattern, self.ranks, self.added = pattern, read_ranks(path), read_added(path) if added else {}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.added)
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @functools.cached_property
    def codec(self) -> Codec:
        return Codec(self.ranks, self.pattern)

    def __call__(self, text: str) -> bytes:
        """The ids, packed as unsigned 32-bit numbers, lowest byte first."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # the library's pattern matching gives up on runs of a million white spaces
            parts = self.between.split(text) if self.between else [text]
            return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self.codec.encode_batch([p])[0] for p in parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added: bool = True) -> Encoder:
    """One encoder per worker process; a path that isn't there is looked for among the job's files."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), pattern, added)


def cut_documents(
    docs: DataFrame, *, path: str, pattern: str, window: int = 2048, end_id: int | None = 1, added: bool = True, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The pieces of every document: ``keep``, ``start``, ``length``, ``doc_tokens`` and ``ids``.

    A document's ids are those of its whole text and then ``end_id``; a string
    of an added token within a text gives that token's id, or without ``added``
    the ids of ordinary text, which keeps an end token out that somebody wrote
    into a text.  Pieces are full windows and then the rest.  ``ids`` holds unsigned 32-bit numbers,
    lowest byte first.  A null text is an empty one: it has the end id alone
    (and no piece where ``end_id`` is None).  Repeated rows give repeated
    pieces, an empty table none, further columns are left out.  No shuffle.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + ["start long, length long, doc_tokens long, ids binary"])
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, added)
        for batch in batches:
            for part in slices(batch, len(keep)):
                rows, starts, lengths, totals, ids = [], [], [], [], []
                for k, text in enumerate(part.column(len(keep)).to_pylist()):
                    packed = own(text) + end
                    total = len(packed) // 4
                    for a in range(0, total, window):
                        b = min(total, a + window)
                        rows.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        totals.append(total)
                        ids.append(packed[4 * a : 4 * b])
                taken = part.select(list(range(len(keep)))).take(pa.array(rows, pa.int32()))
                more = [pa.array(x, pa.int64()) for x in (starts, lengths, totals)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more, pa.array(ids, pa.binary())], names=[*keep, "start", "length", "doc_tokens", "ids"])

    return kept.mapInArrow(run, schema)
