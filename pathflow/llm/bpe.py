"""Byte-level BPE with a hierarchical-bitmap rank queue.

The merges of one pre-token are driven by a queue of merge ranks.  A bucket per
rank holds the linked-list positions of the pairs that merge with that rank;
a bitmap of two levels marks the non-empty buckets, so the next rank is found by
find-first-set at each level.  Entries are never removed when a neighbour
merges: a popped position whose pair no longer has the bucket's rank is stale
and is skipped.  Every merge costs a constant number of queue steps, so a
pre-token of n bytes takes time in proportion to n, however long it is.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, slices

#: Bytes, with what Python needs for an entry, that a generation of a worker's cache of chunks may hold; there are two of them, and two of a quarter for pre-tokens.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 220
#: Bytes of pre-tokens merged in one run of the queue; a longer one has a run of its own.
RUN_BYTES = 1 << 14


class Merger:
    """Merges pre-tokens under one table of ranks.

    Many pre-tokens share one run of the queue: their bytes lie one after the
    other, and no pair reaches across the border between two of them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.top = max(ranks.values(), default=0) + 1
        self.shift = max(1, (self.top.bit_length() + 1) // 2)
        self.wide = self.top.bit_length()
        self.bit = [1 << k for k in range(1 << self.shift)]
        self.bytes = np.full(256, -1, np.int64)  # ids of single bytes
        for token, rank in ranks.items():
            if len(token) == 1:
                self.bytes[token[0]] = rank
        # the rank of every pair of tokens whose bytes together are a token
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.wide | right] = rank
        self.first = np.full(1 << 16, -1, np.int32)  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of every pre-token, packed as unsigned 32-bit.

        Pairs merge in order of rank, equal ranks from left to right, as the
        byte-pair rule asks.  A byte without a rank of its own is a KeyError.
        """
        text = b"".join(pieces)
        n = len(text)
        if not n:
            return [b""] * len(pieces)
        get, wide = self.pairs.get, self.wide
        borders = np.cumsum([0] + [len(p) for p in pieces])
        border = bytearray(n + 1)
        np.frombuffer(border, np.uint8)[borders] = 1
        # a part is named by the position of its first byte
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        raw = np.frombuffer(text, np.uint8)
        single = self.bytes[raw]
        if single.min() < 0:
            raise KeyError(bytes(raw[single.argmin() :][:1]))
        token = single.tolist()
        first_pairs = np.full(n, -1, np.int32)
        first_pairs[:-1] = self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first_pairs[np.frombuffer(border, np.uint8)[1:] == 1] = -1
        pair = first_pairs.tolist()  # rank with which a part merges with the next one, -1 if it doesn't
        order = np.argsort(first_pairs, kind="stable")
        order = order[np.searchsorted(first_pairs[order], 0) :]
        queued, starts = np.unique(first_pairs[order], return_index=True)
        buckets = dict(zip(queued.tolist(), (x.tolist() for x in np.split(order, starts[1:])), strict=True)) if len(order) else {}
        bit, shift, mask = self.bit, self.shift, len(self.bit) - 1
        leaf, root = [0] * ((self.top >> shift) + 1), 0
        for r in buckets:
            leaf[r >> shift] |= bit[r & mask]
            root |= bit[r >> shift]
        while root:
            # find-first-set in the root, then in its leaf
            low = root & -root
            node = low.bit_length() - 1
            bits = leaf[node]
            first = bits & -bits
            rank = node << shift | first.bit_length() - 1
            leaf[node] = bits ^ first
            if bits == first:
                root ^= low
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort(reverse=True)
            as_left = rank << wide
            while positions:
                i = positions.pop()
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                end = after[i] = after[j]
                token[i] = rank
                pair[j] = pair[i] = -1
                sooner = False
                if not border[end]:
                    before[end] = i
                    r = get(as_left | token[end])
                    if r is not None:
                        pair[i] = r
                        if r < rank:
                            sooner = True
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            leaf[r >> shift] |= bit[r & mask]
                            root |= bit[r >> shift]
                if not border[i]:
                    h = before[i]
                    r = get(token[h] << wide | rank)
                    if r is None:
                        pair[h] = -1
                    else:
                        pair[h] = r
                        if r < rank:
                            sooner = True
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            leaf[r >> shift] |= bit[r & mask]
                            root |= bit[r >> shift]
                if sooner and positions:  # the lower rank goes first; the rest returns to its bucket
                    buckets[rank] = positions
                    leaf[node] |= first
                    root |= low
                    break
        # what is left of the list, and where each pre-token's ids begin
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i = after[i]
        at = np.array(starts)
        packed = np.array(token, np.uint32)[at].tobytes()
        edges = (4 * np.searchsorted(at, borders)).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:])]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``, or of a ``.json`` tokenizer file whose byte-level vocabulary is numbered in order of merging."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", ())}
        letters = byte_letters()
        return {bytes(map(letters.__getitem__, token)): rank for token, rank in spec["model"]["vocab"].items() if rank not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def read_added(path: str) -> dict[str, int]:
    """Strings and ids of the tokens that a ``.json`` tokenizer file adds to its vocabulary; none for a file of ranks."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


class Cache:
    """Encoded strings in two generations of bounded bytes.

    A full generation becomes the old one and what was old goes; an old entry
    that is asked for again is young once more, so common strings stay.
    """

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: Iterable[str]) -> list[str]:
        """Those of different strings that aren't known; those that are known are young afterwards."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        absent = [c for c in wanted if c not in young]
        if not old:
            return absent
        again = {c: old[c] for c in absent if c in old}
        self.update(again)
        return [c for c in absent if c not in again]

    def update(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)


class Codec:
    """Encoder and decoder of one table of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        self.uneven = re.compile(r" \s")
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pre_tokens, self.later = Cache(CACHE_BYTES // 4), Cache(CACHE_BYTES)

    @functools.cached_property
    def merge(self) -> Merger:
        return Merger(self.ranks)

    def _merged(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pre-tokens, in runs of bounded bytes."""
        out: dict[str, bytes] = {}
        coded = [p.encode("utf-8") for p in pieces]
        begin = held = 0
        for i, piece in enumerate(coded):
            held += len(piece)
            if held >= RUN_BYTES or i + 1 == len(coded):
                out.update(zip(pieces[begin : i + 1], self.merge(coded[begin : i + 1])))
                begin, held = i + 1, 0
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of the texts, each matched by the pattern as a whole."""
        found = [self.pattern.findall(t) for t in texts]
        self.pre_tokens.update(self._merged(self.pre_tokens.missing({p for f in found for p in f})))
        known = self.pre_tokens.young
        return [b"".join(map(known.__getitem__, f)) for f in found]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts, packed as unsigned 32-bit in the machine's order.

        The pattern never joins a space between two non-space characters to
        what stands before it, so a text is cut at such spaces and equal chunks
        are encoded once.  A text with a space before other white space is
        matched whole.
        """
        out: list[bytes] = [b""] * len(texts)
        whole, cut, chunks = [], [], set()
        for k, text in enumerate(texts):
            if self.uneven.search(text):
                whole.append((k, text))
            elif text:
                first, *rest = text.split(" ")
                whole.append((k, first))
                cut.append((k, rest))
                chunks.update(rest)
        missing = self.later.missing(chunks)
        # a space and ASCII letters are one match of the pattern
        plain = [c for c in missing if c.isascii() and c.isalpha()]
        found = self._merged([" " + c for c in plain])
        self.later.update(dict(zip(plain, found.values())))
        other = [c for c in missing if not (c.isascii() and c.isalpha())]
        self.later.update(dict(zip(other, self._pieces([" " + c for c in other]))))
        for (k, _), packed in zip(whole, self._pieces([t for _, t in whole]), strict=True):
            out[k] = packed
        later = self.later.young
        for k, rest in cut:
            out[k] += b"".join(map(later.__getitem__, rest))
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for."""
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; a path that isn't there is looked for among the job's files."""
    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    return Codec(read_ranks(path), pattern)


def _ids(packed: list[bytes]) -> pa.Array:
    """list<int32> from packed ids."""
    offsets = array("i", [0])
    total = 0
    for p in packed:
        total += len(p) // 4
        offsets.append(total)
    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode_texts(df: DataFrame, *, path: str, pattern: str, text: str = "text", into: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the token ids of every whole text (array<int>).

    A null or empty text has no ids.  Rows are independent: repeated rows give
    repeated rows, an empty table an empty one, further columns are left out.
    No shuffle.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, len(keep)):
                ids = _ids(own.encode_batch(part.column(len(keep)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], names=[*keep, into])

    return kept.mapInArrow(run, schema)


def decode_ids(df: DataFrame, *, path: str, pattern: str, ids: str = "ids", into: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the bytes that the ids of every row stand for (binary).

    Null or empty ids give empty bytes; an id outside the vocabulary or a null
    id is an error.  No shuffle.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(free_name(keep, "__ids")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            values, offsets = column.values.to_numpy(zero_copy_only=True), column.offsets.to_numpy()
            if len(values) and (values.min() < 0 or values.max() >= own.size):
                raise ValueError("an id lies outside the vocabulary")
            texts = pa.array([own.decode(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, into])

    return kept.mapInArrow(run, schema)
