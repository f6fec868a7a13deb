"""Jaccard join of word-shingle sets by count vectors in an R-tree.

Shingles are hashed into groups.  The numbers of a text's shingles in each of
some groups form a point; an R-tree indexes the points of a block of texts.
The overlap of two sets is at most the sum over groups of the smaller count,
and for a tree node of the smaller of the count and the node's upper bound, so
whole nodes and then single pairs are turned away.  What survives is verified
on the full sets.

The blocks come from the groups' contents.  A group in which two sets do not
differ has the same content on both sides, so texts of similar size, which use
the same number of groups, offer the contents of their non-empty groups as keys,
and texts that share a key are candidates.  If two sets differ in at most d
shingles, of any d + 1 non-empty groups one at least is the same; with fewer,
larger groups than d + 1, one still is with all but certainty, as differences
fall into groups by their hash.  The number of groups is the least that leaves
a chance below ``MISSED`` that a link shows no common key.  Texts joined by
candidate pairs, however indirectly, form a family; all its pairs are searched.

A passage that many texts share would give them keys in common and join them
into one huge family.  Shingles that occur in many texts are therefore counted
first, and keys are made of the sets without them: two sets that differ in at
most d shingles do so without any fixed list of shingles as well, so no link is
lost whatever the list holds.  A text that consists mostly of such shingles,
and one that may link with such a text, offers further keys from which only
more frequent shingles are taken out, and at last keys of its whole set.

A family of several blocks is searched by hubs first, texts of it that every
block has.  What a block doesn't join with most of the hubs meets the whole
family, or, where that takes fewer copies of texts, those with which it shares
one of its rarest shingles: of the shingles that two linking sets share, the
rarest is in both among the first, one more than a partner may lack.

Texts with equal sets are one class throughout; a class is searched once.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SLICE_BYTES, discard, parallelism, written
from .shingles import mix, text_sets

_U = np.uint64
#: Groups of a count vector, rows of an R-tree leaf, children of a node.
GROUPS, LEAF, FANOUT = 64, 16, 16
#: Bounds of a block: texts, and shingles of all its texts.
BLOCK_TEXTS, BLOCK_SHINGLES = 2000, 400_000
#: Texts of a large block family that every one of its blocks compares with.
HUBS = 16
#: Chance that a pair that links shares no key.
MISSED = 1e-9
#: Texts in which a shingle is counted for it to be left out of keys: of the first keys, of the second.
COMMON = (30, 1000)
#: Share of its set that a text must keep for keys without common shingles to serve it.
KEPT = 1 / 3
#: Counters of a task's list of frequent shingles, and entries of the whole list.
COUNTERS, LISTED = 1 << 19, 1 << 17


def most_different(n: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles by which a set of size n and any partner can differ."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def size_bands(most: int) -> np.ndarray:
    """Lower ends of bands of sizes; texts of a band use the same number of groups."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * 1.5)))
    return np.array(ends, np.int64)


def least_kept(n: int) -> int:
    """The least part of a set of n for which keys without common shingles serve."""
    return math.ceil(n * KEPT)


@functools.cache
def group_plan(low: int, high: int, percent: int, whole: bool = True) -> tuple[int, bool]:
    """Number of groups for sets of ``low`` to ``high`` shingles, and whether all non-empty groups give keys or the first d + 1.

    With all groups, a link of d differing and c common shingles is missed only
    if every group has a difference or nothing in common; as these events of
    different groups are negatively associated, the chance is at most their
    product.  With the first d + 1 non-empty groups it is missed only if all
    shingles of a set lie in d groups.  The plan with fewer groups is taken.
    Of sets that aren't ``whole`` the least part kept is counted on alone.
    """
    sizes = np.unique(np.geomspace(low, high, 64).astype(np.int64))
    pairs = list(zip(sizes.tolist(), most_different(sizes, percent).tolist(), strict=True))
    held = (lambda n: n) if whole else least_kept
    if any(d >= held(n) for n, d in pairs):
        raise ValueError(f"{percent} % is too low a similarity for common groups")
    least = math.log(MISSED)

    def unseen(g: int, n: int, m: int) -> float:
        d = (n + m) * (100 - percent) // (100 + percent)
        c = max(0, (held(n) + held(m) - d) // 2)
        same = (1 - 1 / g) ** d * (1 - (1 - 1 / g) ** c)
        return g * math.log1p(-same) if same < 1 else -math.inf

    def crowded(g: int, n: int, d: int) -> float:
        return math.lgamma(g + 1) - math.lgamma(d + 1) - math.lgamma(g - d + 1) + held(n) * math.log(d / g) if d else -math.inf

    first = max(d for _, d in pairs) + 1
    while any(crowded(first, n, d) > least for n, d in pairs):
        first += first // 16 + 1
    every = 8
    while every < first and any(unseen(every, n, m) > least for n, _ in pairs for m in (n, 100 * n // percent)):
        every += every // 16 + 1
    return (every, True) if every < first else (first, False)


@dataclass
class Frequent:
    """Sorted hashes of shingles that occur in many texts, and how often each was counted."""

    hashes: np.ndarray
    times: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """How often each hash was counted; 0 for one that isn't listed."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        # a table over 20 bits of the hash turns most others away
        near = np.flatnonzero(self._table[(hashes >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        out = np.zeros(len(hashes), np.int64)
        out[near] = np.where(self.hashes[at] == hashes[near], self.times[at], 0)
        return out

    @functools.cached_property
    def _table(self) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(self.hashes >> _U(44)).astype(np.int64)] = True
        return table


class Counter:
    """Counts of the most frequent of many values in bounded memory (Misra and Gries): no count is too high, and none too low by more than values / ``most``."""

    def __init__(self, most: int = COUNTERS):
        self.most = most
        self.values, self.counts = np.empty(0, _U), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.held += len(values)
        if self.held >= 2 * self.most:
            self.settle()

    def settle(self) -> None:
        new, n = np.unique(np.concatenate([*self.waiting, np.empty(0, _U)]), return_counts=True)
        self.waiting, self.held = [], 0
        both, counts = np.concatenate([self.values, new]), np.concatenate([self.counts, n])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
        self.values, self.counts = both[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.values) > self.most:
            self.counts = self.counts - np.partition(self.counts, -self.most - 1)[-self.most - 1]
            kept = self.counts > 0
            self.values, self.counts = self.values[kept], self.counts[kept]


def _keys(hashes: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, own: np.ndarray, percent: int, whole: bool, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts ``own``, of whole sizes ``sizes``, from what ``hashes`` holds of their sets."""
    keys, texts = [np.empty(0, _U)], [np.empty(0, np.int64)]
    bands = size_bands(2 * int(sizes.max(initial=0)) + 2)
    band = np.searchsorted(bands, sizes, side="right") - 1
    up = np.searchsorted(bands, 100 * sizes // percent, side="right") - 1
    have = np.diff(bounds)
    for ahead in range(int((up - band)[own].max(initial=-1)) + 1):
        # a partner of up to size * 100 / percent may lie in a higher band and use that band's groups
        now = own[(have[own] > 0) & (band[own] + ahead <= up[own])]
        if not len(now):
            continue
        at = band[now] + ahead
        # texts of the bands below that reach up to this one use its groups too
        plans = {x: group_plan(max(1, int(bands[x]) * percent // 100), int(bands[x + 1]) - 1, percent, whole) for x in np.unique(at).tolist()}
        groups = np.array([plans.get(x, (1, False))[0] for x in range(int(at.max()) + 1)], np.int64)[at]
        every = np.array([plans.get(x, (1, False))[1] for x in range(int(at.max()) + 1)], bool)[at]
        n = have[now]
        starts = np.concatenate(([0], np.cumsum(n)))
        where = np.arange(starts[-1]) + np.repeat(bounds[now] - starts[:-1], n)
        h = hashes[where]
        text = np.repeat(np.arange(len(now)), n)
        group = ((h >> _U(32)) * groups[text].astype(_U)) >> _U(32)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (text[1:] != text[:-1])))
        first = np.flatnonzero(new)
        content = np.add.reduceat(mix(h), first)
        group, text = group[first], text[first]
        nth = np.arange(len(first)) - np.searchsorted(text, np.arange(len(now)))[text]
        kept = np.flatnonzero(every[text] | (nth <= most_different(sizes[now], percent)[text]))
        keys.append(mix(content[kept] ^ mix(group[kept] * _U(4096) + (at[text[kept]] + 256 * salt).astype(_U))))
        texts.append(now[text[kept]])
    return np.concatenate(keys), np.concatenate(texts)


def group_keys(hashes: np.ndarray, bounds: np.ndarray, percent: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts, and the text of each; ``hashes`` holds each text's sorted set.

    With ``frequent`` the keys are those of the sets without common shingles,
    for texts that keep at least the share ``KEPT``.  Where a partner may keep
    less, keys with fewer shingles left out follow, and then keys of whole sets.
    """
    sizes = np.diff(bounds)
    if not len(hashes):
        return np.empty(0, _U), np.empty(0, np.int64)
    differ = most_different(sizes, percent)
    asked = sizes > 0
    keys, texts = [], []
    if frequent is not None and len(frequent.hashes) and (100 - percent) / percent < KEPT:
        times = frequent.of(hashes)
        least = np.array([least_kept(n) for n in sizes.tolist()])
        for salt, most in enumerate(COMMON, 1):
            rare = times < most
            before = np.concatenate(([0], np.cumsum(rare)))
            kept_bounds = before[bounds]
            kept = np.diff(kept_bounds)
            key, text = _keys(hashes[rare], kept_bounds, sizes, np.flatnonzero(asked & (kept >= least)), percent, False, salt)
            keys.append(key)
            texts.append(text)
            # a partner has at most differ shingles fewer, and a set of at most 100 / percent times the size
            asked = asked & (kept < (100 * sizes // percent) * KEPT + 1 + differ)
    key, text = _keys(hashes, bounds, sizes, np.flatnonzero(asked), percent, True, 0)
    return np.concatenate([*keys, key]), np.concatenate([*texts, text])


def rarest(hashes: np.ndarray, bounds: np.ndarray, percent: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of every text, one more than a partner may lack, and the text of each; two sets that link share one.

    Common shingles are among them only if a text has too few others, so a
    passage that many texts share doesn't bring those together that differ else.
    """
    sizes = np.diff(bounds)
    times = np.zeros(len(hashes), np.int64) if frequent is None else frequent.of(hashes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, times, text))
    kept = np.arange(len(hashes)) - bounds[:-1][text] <= (sizes * (100 - percent) // 100)[text]
    return hashes[order][kept], text[kept]


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each text's set; zeros for an empty one."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(salt)), dtype=_U)))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


class CountTree:
    """R-tree over count vectors in order of size.

    A node holds the upper corner of its rows and their least and largest size;
    lower corners don't matter to the bound.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((*points.T[:3], sizes))
        points, sizes = points[self.order], sizes[self.order]
        self.levels = [(points, sizes, sizes)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            corner, least, most = self.levels[-1]
            first = np.arange(0, len(least), width)
            self.levels.append((np.maximum.reduceat(corner, first, axis=0), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))
            width = FANOUT

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows that by their bound may share enough with a set of this point and size."""
        p = self.percent
        small, large = -(-p * size // 100), 100 * size // p
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[k]
            nodes = nodes[(most[nodes] >= small) & (least[nodes] <= large)]
            need = -(-p * (size + np.maximum(least[nodes], small)) // (100 + p))
            nodes = nodes[np.minimum(corner[nodes], point).sum(axis=1) >= need]
            if k:
                width = LEAF if k == 1 else FANOUT
                nodes = (nodes[:, None] * width + np.arange(width)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][0])]
        return self.order[nodes]


def link_block(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the texts of a block as all its links would, and each text's class in the block.

    With ``probes`` (a mask) only pairs of a probe and another text count.  A
    pair whose texts are joined already isn't looked at again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    links: list[tuple[int, int]] = []
    label = np.arange(n)
    indexed = np.flatnonzero((sizes > 0) & ~probes) if probes is not None else np.flatnonzero(sizes > 0)
    asked = np.flatnonzero((sizes > 0) & probes) if probes is not None else indexed
    if not len(indexed) or not len(asked):
        return links, label
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.bincount(owner * GROUPS + (flat & _U(GROUPS - 1)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)
    vocabulary, codes = np.unique(flat, return_inverse=True)
    tree = CountTree(counts[indexed], sizes[indexed], percent)
    mark = np.zeros(len(vocabulary), bool)
    for i in asked.tolist():
        a = sizes[i]
        near = indexed[tree.search(counts[i], int(a))]
        near = near[label[near] != label[i]] if probes is not None else near[(near > i) & (label[near] != label[i])]
        if not len(near):
            continue
        mark[codes[bounds[i] : bounds[i + 1]]] = True
        m = sizes[near]
        starts = np.concatenate(([0], np.cumsum(m)))
        where = np.arange(starts[-1]) + np.repeat(bounds[near] - starts[:-1], m)
        both = np.add.reduceat(mark[codes[where]].astype(np.int64), starts[:-1])
        mark[codes[bounds[i] : bounds[i + 1]]] = False
        for j in near[100 * both >= percent * (a + m - both)].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links, label


def _sets(texts: pa.Array, words: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingle sets of an array of texts in parts of bounded bytes: (first row, hashes, bounds)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, [len(texts)])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield a, *text_sets(texts.slice(a, b - a), words)


def describe_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows of three kinds from the rows of ``doc_id, text``.

    ``doc_id, n_shingles, ref``: every row, with the size of its set and a
    number for its set among those of its task (null without a set or an id).
    ``ref, n_shingles, s1, s2, doc_id``: every set of a task once, with its
    signature and the least id that has it there.  ``shingle, times``: a
    shingle, and in how many sets of a task it was counted, if in several.
    """

    def rows(ids, sizes, refs, s1, s2, shingles, times) -> pa.RecordBatch:
        names = ["doc_id", "n_shingles", "ref", "s1", "s2", "shingle", "times"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, refs, s1, s2, shingles, times)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen, epoch = Counter(), {}, TaskContext.get().taskAttemptId() << 20

        def met() -> Iterator[pa.RecordBatch]:
            for part in itertools.batched(seen.items(), 50_000):
                yield rows([v[1] for _, v in part], [k[0] for k, _ in part], [v[0] for _, v in part], [k[1] for k, _ in part], [k[2] for k, _ in part], *[[None] * len(part)] * 2)

        for batch in batches:
            for a, hashes, bounds in _sets(batch.column(1), words):
                s1, s2 = (s.tolist() for s in signatures(hashes, bounds))
                ids, sizes = batch.column(0).slice(a, len(bounds) - 1).to_pylist(), np.diff(bounds).tolist()
                if len(seen) > 1_000_000:
                    yield from met()
                    epoch += len(seen)
                    seen.clear()
                refs: list[int | None] = [None] * len(ids)
                new = np.zeros(len(ids), bool)
                for k, doc in enumerate(ids):
                    if sizes[k] and doc is not None:
                        mark = (sizes[k], s1[k], s2[k])
                        known = seen.get(mark)
                        if known is None:
                            known = seen[mark] = [epoch + len(seen), doc]
                            new[k] = True
                        known[1] = min(known[1], doc)
                        refs[k] = known[0]
                counter.add(hashes[np.repeat(new, np.diff(bounds))])
                yield rows(ids, sizes, refs, *[[None] * len(ids)] * 4)
        yield from met()
        counter.settle()
        often = np.flatnonzero(counter.counts > 1)
        for part in np.array_split(often, len(often) // 50_000 + 1):
            yield rows(*[[None] * len(part)] * 5, counter.values[part].view(np.int64), counter.counts[part])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, ref long, s1 long, s2 long, shingle long, times long")


def frequent_shingles(described: DataFrame) -> Frequent:
    """The shingles counted most often, ``LISTED`` at most; which of them are listed decides about speed alone."""
    sums = described.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON[0])
    rows = sums.orderBy(F.col("times").desc(), "shingle").limit(LISTED).toPandas()
    hashes, times = rows["shingle"].to_numpy(np.int64).view(_U), rows["times"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return Frequent(hashes[order], times[order])


def candidate_links(docs: DataFrame, words: int, percent: int, frequent: Frequent | None = None, flush: int = 1_000_000) -> DataFrame:
    """Distinct pairs ``a, b`` that connect all texts which share a key.

    Keys shared within a task are joined there, so a key leaves a task once for
    every ``flush`` keys at most, however common it is.
    """
    listed = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def out() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            hub = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            pairs = np.unique(np.stack([hub, doc], axis=1)[~new], axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            # a pair travels under a key of its own
            own = mix(pairs[:, 0].view(_U) * _U(0x9E3779B97F4A7C15) ^ mix(pairs[:, 1].view(_U)))
            hubs = pa.array(np.concatenate([np.zeros(int(new.sum()), np.int64), pairs[:, 0]]), pa.int64(), mask=np.arange(int(new.sum()) + len(pairs)) < new.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[new], own]).view(np.int64)), pa.array(np.concatenate([doc[new], pairs[:, 1]])), hubs], names=["key", "doc", "hub"])

        for batch in batches:
            for a, hashes, bounds in _sets(batch.column(1), words):
                s1, s2 = signatures(hashes, bounds)
                marks = list(zip(s1.tolist(), s2.tolist(), strict=True))
                first = np.array([m not in seen and not seen.add(m) for m in marks], bool)
                key, text = group_keys(hashes, bounds, percent, listed.value)
                kept = first[text]
                keys.append(key[kept])
                ids.append(batch.column(0).slice(a, len(bounds) - 1).to_numpy(zero_copy_only=False)[text[kept]])
                held += int(kept.sum())
                if held >= flush:
                    yield out()
                    keys, ids, held = [], [], 0
                    seen.clear()
        if held:
            yield out()

    rows = docs.where("doc_id is not null").mapInArrow(run, "key long, doc long, hub long")
    least = F.min("doc").over(Window.partitionBy("key"))
    return rows.select(F.coalesce("hub", least).alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()


def with_rarest(members: DataFrame, words: int, percent: int, frequent: Frequent | None = None) -> DataFrame:
    """``doc_id, family, n, asks, keyed, key`` of rows that have a text beside the first four: every text without a key, and with each of its ``rarest`` shingles."""
    listed = members.sparkSession.sparkContext.broadcast(frequent)
    names = ["doc_id", "family", "n", "asks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, bounds in _sets(batch.column(4), words):
                key, text = rarest(hashes, bounds, percent, listed.value)
                every = np.arange(len(bounds) - 1)
                own = batch.slice(a, len(every)).take(pa.array(np.concatenate([every, text])))
                keyed = np.repeat([False, True], [len(every), len(text)])
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(keyed), pa.array(np.concatenate([np.zeros(len(every), np.int64), key.view(np.int64)]))], names=[*names, "keyed", "key"])

    return members.select(*names, "text").mapInArrow(run, "doc_id long, family long, n long, asks boolean, keyed boolean, key long").distinct()


def search_blocks(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Search blocks of texts.

    ``rows`` holds ``family, block, role, doc, text``; the rows of a (family,
    block) are a block, and roles are 0 for a member, 1 for a hub lent to the
    block, 2 for a probe (then only pairs with probes are searched).  Returns
    links ``a, b``, and for blocks with hubs a row ``a, null`` for each member
    that the block doesn't join with the largest class of hubs.
    """
    lined = rows.repartition(parallelism(rows.sparkSession), "family", "block").sortWithinPartitions("family", "block", "doc", "role")

    def search(ids: np.ndarray, roles: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        links, label = link_block(sets, percent, roles == 2 if (roles == 2).any() else None)
        a, b = [int(ids[i]) for i, _ in links], [int(ids[j]) for _, j in links]
        hubs = np.flatnonzero(roles == 1)
        if len(hubs):
            # the hubs are the same in every block of a family, and so is their largest class by their own links
            among, _ = link_block([sets[h] for h in hubs], percent)
            own = np.arange(len(hubs))
            for i, j in among:
                own[own == own[j]] = own[i]
            classes, first, size = np.unique(own, return_index=True, return_counts=True)
            main = label[hubs[first[np.lexsort((ids[hubs[first]], -size))[0]]]]
            loose = ids[(label != main) & (roles == 0)]
            a += loose.tolist()
            b += [None] * len(loose)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, roles, sets = None, [], [], []
        for batch in batches:
            family, block, role, doc = (batch.column(c).to_pylist() for c in range(4))
            for at, hashes, bounds in _sets(batch.column(4), words):
                for k in range(len(bounds) - 1):
                    r = at + k
                    if (family[r], block[r]) != now:
                        if len(ids) > 1:
                            yield search(np.array(ids, np.int64), np.array(roles), sets)
                        now, ids, roles, sets = (family[r], block[r]), [], [], []
                    ids.append(doc[r])
                    roles.append(role[r])
                    sets.append(hashes[bounds[k] : bounds[k + 1]].copy())
        if len(ids) > 1:
            yield search(np.array(ids, np.int64), np.array(roles), sets)

    return lined.mapInArrow(run, "a long, b long")


def _blocks(share: int = 1, who: Column | None = None) -> Column:
    """Into how many blocks of a share of the bounds a group of texts of sizes ``n`` goes, or those of it that ``who`` names."""
    who = F.lit(True) if who is None else who
    return F.greatest(F.ceil(F.sum(F.when(who, F.col("n"))) * share / BLOCK_SHINGLES), F.ceil(F.count_if(who) * share / BLOCK_TEXTS)).cast("int")


def meetings(either: DataFrame) -> DataFrame:
    """``doc_id, family, asks, keyed, key, across, down``: the groups in which texts that ask meet the others.

    ``either`` is a table as ``with_rarest`` makes it.  A family is one group, or
    as many as its texts share keys, whichever takes fewer copies of texts.  A
    group of one block is searched as it is; in a larger one a part of those
    that ask meets a part of all at a time.
    """
    either = written(either)
    sizes = either.groupBy("family", "keyed", "key").agg(_blocks(2, F.col("asks")).alias("across"), _blocks(2).alias("down"), F.count(F.lit(1)).alias("texts"), F.count_if("asks").alias("n_ask")).where("texts > 1 and n_ask > 0")
    copies = F.when(F.col("down") == 1, F.col("texts")).otherwise(F.col("n_ask") * F.col("down") + F.col("texts") * F.col("across"))
    sizes = written(sizes.withColumn("copies", copies))
    sums = [F.coalesce(F.sum(F.when(F.col("keyed") == k, F.col("copies"))), F.lit(0)) for k in (True, False)]
    taken = sizes.groupBy("family").agg((sums[0] < sums[1]).alias("keyed"))
    out = written(either.join(sizes.drop("texts", "n_ask", "copies").join(taken, ["family", "keyed"]), ["family", "keyed", "key"]))
    discard(either, sizes)
    return out


def rows_near(rows: DataFrame, keys: DataFrame, key: str, *, most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose key is among ``keys``, and a few others.

    A bitmap over key hashes, of 16 to 32 bits for each key and 16 MB at most,
    goes to every executor; rows turned away there need no shuffle.
    """
    bits = min(most_bits, 1 << max(15, (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = keys.select(at.alias("__bit")).groupBy(F.expr("bitmap_bucket_number(__bit)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__bit))").alias("__bits"))
    asked = rows.withColumn("__bit", at).withColumn("__bucket", F.expr("bitmap_bucket_number(__bit)"))
    byte = "cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__bit) div 8 as int) + 1, 1)), 16, 10) as int)"
    found = asked.join(F.broadcast(marks), "__bucket").where(f"shiftright({byte}, cast(bitmap_bit_position(__bit) % 8 as int)) & 1 = 1")
    return found.select(*rows.columns)


def jaccard_components(docs: DataFrame, *, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two texts link when 100 times the size of the intersection of their sets is
    at least ``percent`` times that of the union; a component is all that links
    join, named by its smallest key.  Null and wordless texts have the empty
    set and link with nothing.  Keys are integers; a row with a null key gets
    its n_shingles and a null component.  Rows repeated under one key are one
    document; if their texts differ, its links are those of all of them.  An
    empty table gives an empty one; further columns are left out.
    """
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    described = written(describe_sets(slim, words))
    # the class of a set is the least doc_id that has it; a task offers each of its sets once
    least = F.min("doc_id").over(Window.partitionBy("n_shingles", "s1", "s2"))
    named = described.where("s1 is not null").select("ref", least.alias("class"))
    each = described.where("s1 is null and shingle is null").select("doc_id", "n_shingles", "ref")
    assigned = written(each.join(named, "ref", "left").select("doc_id", "n_shingles", "class"))
    frequent = frequent_shingles(described)
    discard(described)

    # candidates, and the families that they form
    families = connected_components(candidate_links(slim, words, percent, frequent))
    of = assigned.where("class is not null").select("doc_id", "class", "n_shingles")
    members = families.join(of, families["node"] == of["doc_id"]).groupBy("class").agg(F.min("component").alias("family"), F.max("n_shingles").alias("n"))
    members = written(members.withColumnRenamed("class", "doc_id"))
    discard(families)
    # written, such a table of one row for a family is sent to all if it is small, and else a family of very many rows is split in the join
    several = written(members.groupBy("family").agg(_blocks().alias("blocks"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    dealt = written(members.join(several, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
    discard(members, several)

    many = dealt.where("blocks > 1")
    nth = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    hubs = many.withColumn("nth", nth).where(F.col("nth") <= HUBS)
    lent = hubs.select("doc_id", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "block").where("to <> block")
    is_hub = hubs.select("doc_id", F.lit(1).alias("hub"))
    seats = dealt.join(is_hub, "doc_id", "left").select("doc_id", "family", F.col("block").cast("long"), F.coalesce("hub", F.lit(0)).alias("role"))
    seats = seats.unionByName(lent.select("doc_id", "family", F.col("to").cast("long").alias("block"), F.lit(1).alias("role")))

    def with_texts(seats: DataFrame, ids: DataFrame) -> DataFrame:
        # one row for each document first, so that the texts move once before they are lent
        packed = seats.groupBy("doc_id").agg(F.collect_list(F.struct("family", "block", "role")).alias("seats"))
        found = rows_near(slim, ids, "doc_id").join(packed, "doc_id").select("doc_id", "text", F.explode("seats").alias("s"))
        return found.select("s.family", "s.block", "s.role", F.col("doc_id").alias("doc"), "text")

    searched = written(search_blocks(with_texts(seats, dealt), words, percent))
    links = searched.where("b is not null")
    probes = many.join(searched.where("b is null").select(F.col("a").alias("doc_id")).distinct(), "doc_id")
    more = members = met = None
    if probes.limit(1).count():
        asks = probes.select("doc_id", "family", F.lit(True).alias("asks"))
        members = written(many.join(probes.select("family").distinct(), "family").join(asks, ["doc_id", "family"], "left").select("doc_id", "family", F.col("n").cast("long").alias("n"), F.coalesce("asks", F.lit(False)).alias("asks")))
        met = meetings(with_rarest(rows_near(slim, members, "doc_id").join(members, "doc_id"), words, percent, frequent))
        part = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(3)), n)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        group = F.when(F.col("keyed"), F.xxhash64("family", "key")).otherwise(F.col("family")).alias("family")
        asked = met.where("down > 1 and asks").select("doc_id", group, part("across").alias("i"), every("down").alias("j"), "down", F.lit(2).alias("role"))
        others = met.select("doc_id", group, every("across").alias("i"), part("down").alias("j"), "down", F.lit(0).alias("role"))
        seats = asked.unionByName(others).select("doc_id", "family", (F.col("i") * F.col("down") + F.col("j")).cast("long").alias("block"), "role")
        more = written(search_blocks(with_texts(seats, met.select("doc_id").distinct()), words, percent))
        links = links.unionByName(more.where("b is not null"))
    # rows of one doc_id with different sets
    both = of.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    links = links.select("a", "b").unionByName(of.join(both, "doc_id").select("a", F.col("class").alias("b")))
    joined = connected_components(links)
    discard(searched, more, dealt, members, met)
    out = assigned.join(joined, assigned["class"] == joined["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))
