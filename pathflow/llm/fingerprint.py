"""Bottom-k sketches of word shingles.

A text's fingerprint holds the k smallest of its distinct 64-bit shingle hashes
(all of them, if fewer).  The fingerprint of a union is the k smallest of both
fingerprints, so parts merge in any order.  From two fingerprints follow
estimates of resemblance and containment, from one the number of distinct
shingles; while neither is full the figures are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, parallelism, slices
from .shingles import shingle_hashes, text_bytes, word_hashes

#: Hashes kept by a fingerprint, and words of a shingle.
K, WORDS = 128, 5
_SPAN = float(2**64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # the k smallest distinct ones are among the values up to a bound that k distinct values reach
        small = np.unique(np.partition(hashes, 2 * k)[: 2 * k + 1])
        if len(small) >= k:
            return small[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for a sketch that isn't full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _SPAN)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sets."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """A fingerprint as text: base64 of its hashes, 8 bytes each, highest byte first."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode("ascii")


def from_text(text: str) -> np.ndarray:
    """The fingerprint that to_text() wrote."""
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Fingerprint of every text; nulls and texts without words have an empty one."""
    values, starts = shingle_hashes(*word_hashes(*text_bytes(texts)), words)
    return [sketch(values[a:b], k) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def fingerprint_texts(df: DataFrame, *, text: str = "text", into: str = "fingerprint", keep: tuple[str, ...] = ("doc_id",), k: int = K, words: int = WORDS) -> DataFrame:
    """The columns ``keep`` and the fingerprint of every whole text, as text; the empty string for null or wordless texts. No shuffle."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), rows=500):
                found = pa.array([to_text(s) for s in sketches(part.column(len(keep)), k, words)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], names=[*keep, into])

    return kept.mapInArrow(run, schema)


def merge_fingerprints(df: DataFrame, *, by: str, fingerprint: str = "fingerprint", k: int = K, held: int = 20_000) -> DataFrame:
    """``by, fingerprint, n_shingles``: the fingerprint of the union of every group's texts, and its estimated number of distinct shingles.

    Tasks merge their rows first, ``held`` groups at a time, so a group reaches
    the shuffle with about one fingerprint for each task, however many rows it
    has.  Null fingerprints count as empty, rows with a null ``by`` are a group
    of their own; an empty table gives an empty one.
    """
    kept = df.select(F.col(f"`{by}`").alias("by"), F.coalesce(F.col(f"`{fingerprint}`"), F.lit("")).alias("fp"))
    kind = dict(kept.dtypes)["by"]

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        keys = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(groups), keys), pa.array([to_text(x) for x in groups.values()], pa.string())], names=["by", "fp"])

        for batch in batches:
            keys = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups[key] = merge(groups[key], from_text(text), k) if key in groups else from_text(text)
                if len(groups) >= held:
                    yield out()
                    groups.clear()
        if groups:
            yield out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [sketch(np.concatenate([from_text(t) for t in parts]), k) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(m) for m in merged], pa.string()), pa.array([distinct_count(m, k) for m in merged], pa.float64())], names=["by", "fingerprint", "n_shingles"])

    parts = kept.mapInArrow(partly, f"by {kind}, fp string").groupBy("by").agg(F.collect_list("fp").alias("parts"))
    out = parts.mapInArrow(whole, f"by {kind}, fingerprint string, n_shingles double")
    return out.select(F.col("by").alias(by), "fingerprint", "n_shingles")


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lanes: int | None = None) -> DataFrame:
    """Rows ``lane, key, text`` such that the rows of a lane in order of (key,
    text) are neighbours in the order of the whole table, and its last row,
    marked ``borrowed``, is the first of the next lane (the first lane again
    after the last).

    Lanes are ranges of keys.  Their bounds are quantiles of the keys, one for
    each lane, and their first rows one text for each lane: both are bounded by
    ``lanes``.  The texts move once, to their lane.
    """
    spark = docs.sparkSession
    k = F.col(f"`{key}`")
    slim = docs.select(k.alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    lanes = lanes or 4 * parallelism(spark)
    quantiles = slim.select(F.percentile_approx("__key", F.lit([(i + 1) / lanes for i in range(lanes - 1)]) if lanes > 1 else F.lit([0.5]), 20 * lanes).alias("q")).head()["q"]
    bounds = sorted(set(quantiles or []))
    table = F.lit(bounds) if bounds else F.array().cast("array<long>")
    # a null key sorts first; the lane is the number of bounds below the key
    lane = F.when(F.col("__key").isNull(), 0).otherwise(F.size(F.filter(table, lambda b: b < F.col("__key"))))
    laned = slim.withColumn("__lane", lane.cast("int"))
    firsts = [(r["__lane"], r["k"]) for r in laned.groupBy("__lane").agg(F.min(F.struct(F.col("__key").isNotNull().alias("set"), F.col("__key").alias("key"))).alias("m")).select("__lane", F.col("m.key").alias("k")).orderBy("__lane").collect()]
    if not firsts:
        return laned.select("__lane", "__key", "__text", F.lit(False).alias("borrowed"))
    key_type = dict(laned.dtypes)["__key"]
    lends = spark.createDataFrame([(lane, key_, firsts[i - 1][0]) for i, (lane, key_) in enumerate(firsts)], f"__l int, __k {key_type}, __to int")
    # the smallest text among the rows with a lane's smallest key
    heads = laned.join(F.broadcast(lends), (F.col("__lane") == F.col("__l")) & F.col("__key").eqNullSafe(F.col("__k")))
    heads = heads.groupBy("__l").agg(F.min("__text").alias("__text"), F.first("__key").alias("__key"), F.first("__to").alias("__to"))
    borrowed = heads.select(F.col("__to").alias("__lane"), "__key", "__text", F.lit(True).alias("borrowed"))
    return laned.select("__lane", "__key", "__text", F.lit(False).alias("borrowed")).unionByName(borrowed)


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS, lanes: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text takes from the next document in order of (key, text), after
    the last one the first.  Null texts are empty.  Rows with equal keys follow
    each other by text; every row is returned once.  A table of one row is its
    own next.  An empty table gives an empty one; further columns are left out.
    """
    ordered = with_next(docs, key=key, text=text, lanes=lanes)
    spread = lanes or 4 * parallelism(docs.sparkSession)
    lined = ordered.repartition(spread, "__lane").sortWithinPartitions("__lane", "borrowed", F.col("__key").asc_nulls_first(), "__text")
    key_type = dict(lined.dtypes)["__key"]
    schema = f"`{key}` {key_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: lane, key, text, sketch
        for batch in batches:
            for part in slices(batch, 2, rows=300):
                lane, keys, texts, borrowed = (part.column(c) for c in range(4))
                rows = list(zip(lane.to_pylist(), keys.to_pylist(), texts.to_pylist(), sketches(texts, k, words), borrowed.to_pylist(), strict=True))
                pairs = []
                for row in rows:
                    if held is not None and held[0] == row[0]:
                        pairs.append((held, row))
                    held = None if row[4] else row
                if not pairs:
                    continue
                edits = [edited_text(a[2], b[2]) for a, b in pairs]
                marks = sketches(pa.array(edits, pa.string()), k, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[1] for a, _ in pairs], keys.type),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edits], pa.string()),
                        pa.array([to_text(a[3]) for a, _ in pairs], pa.string()),
                        pa.array([to_text(m) for m in marks], pa.string()),
                        pa.array([resemblance(a[3], m, k) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                        pa.array([resemblance(a[3], b[3], k) for a, b in pairs], pa.float64()),
                    ],
                    names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return lined.mapInArrow(run, schema)
