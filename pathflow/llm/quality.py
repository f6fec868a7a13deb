"""Document quality by supervised subword embeddings.

Words, pairs of words and character n-grams of a text are hashed to buckets,
each with a learned vector.  A text is the average of its features' vectors, and
a softmax layer turns that into class probabilities.  Vectors and output layer
are trained together in numpy by stochastic gradient descent on a bounded sample
of labelled texts.

Averages and the output layer are linear, so a trained model is applied through
one number for each bucket: the difference that the bucket's vector makes to the
two classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, slices, written
from .shingles import mix, text_bytes, word_hashes

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SEED = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and bounds of its training sample."""

    buckets: int = 1 << 17
    dims: int = 16
    grams: tuple[int, ...] = (3, 5)  # lengths of character n-grams, in bytes
    docs_per_class: int = 1_500  # labelled documents of a class that are learned from, at most
    epochs: int = 12
    rate: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: np.ndarray  # of every bucket
    bias: float  # of a text with features
    empty: float  # of a text without


def features(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, and the text of each.

    Words count without the case of A-Z, n-grams with it.  A pair of equal words
    is one feature, whatever the word.  N-grams lie within a word and the white
    space on either side of it.
    """
    raw, bounds = text_bytes(texts)
    n, most = len(raw), np.uint64(settings.buckets - 1)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words, first = word_hashes(raw, bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = words[pair], words[pair + 1]
    pairs = np.where(left == right, _SEED, mix(left * np.uint64(3) + right))
    found, owners = [words, pairs], [owner, owner[pair]]
    # a space before and after each text, and one for every white space
    sizes = np.diff(bounds)
    have = np.flatnonzero(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    shift = np.zeros(len(texts), np.int64)
    shift[have] = np.arange(1, len(have) + 1)
    line = np.full(n + len(have) + 1, 32, np.uint8)
    line[np.arange(n) + shift[text]] = np.where(_SPACE[raw], 32, raw)
    of = np.zeros(len(line), np.int64)
    of[np.arange(n) + shift[text]] = text
    blank = np.concatenate(([0], np.cumsum(line == 32)))
    value = line.astype(np.uint64) + _SEED
    for k, size in enumerate(settings.grams):
        m = len(line) - size + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        for i in range(size):
            code = code * np.uint64(0x100000001B3) + value[i : i + m]
        at = np.flatnonzero(blank[size - 1 : size - 1 + m] == blank[1 : 1 + m])  # no space but at the ends
        found.append(mix(code[at] + np.uint64(k + 1)))
        owners.append(of[at + 1])
    values, who = np.concatenate(found), np.concatenate(owners)
    return ((values ^ (values >> np.uint64(32))) & most).astype(np.int64), who


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, settings: Settings) -> Model:
    """Stochastic gradient descent over documents (buckets and their counts), labels 0 or 1.

    Both classes weigh alike in training; the bias then moves to ``prior``, the share
    of class 1, and by a scale and shift fitted to the last epoch's scores of
    documents before they were learned from.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dims, 1 / settings.dims, (settings.buckets, settings.dims)).astype(np.float32)
    out, bias = np.zeros((settings.dims, 2), np.float32), np.zeros(2, np.float32)
    # a tenth is left out of learning, to set the scale
    order = rng.permutation(len(docs))
    apart, learned = (order[: len(order) // 10], order[len(order) // 10 :]) if len(order) >= 40 else (order, order)
    share = np.bincount(labels[learned], minlength=2) / max(1, len(learned))
    weight = 0.5 / np.maximum(share, 1e-9)
    steps, step = settings.epochs * len(learned), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(learned):
            rate = settings.rate * (1 - step / steps)
            step += 1
            at, counts = docs[i]
            if not len(at):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[at]
            score = mean @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            delta = (rate * min(weight[labels[i]], 5.0)) * p
            back = out @ delta
            out -= np.outer(mean, delta)
            bias -= delta
            # by the largest share in the text, so that a long text moves its features as much as a short one
            vectors[at] -= np.outer(part / part.max(), back)
    weights = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    base = float(bias[1] - bias[0])
    raw = np.array([base + (docs[i][1] @ weights[docs[i][0]]) / docs[i][1].sum() if len(docs[i][0]) else 0.0 for i in apart])
    scale, shift = calibrated(raw, labels[apart], prior)
    return Model(settings, scale * weights, scale * base + shift, float(np.log(prior / (1 - prior))))


def calibrated(raw: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift that make raw scores log odds where a share ``prior`` is of class 1; Newton's method with a weak pull to scale 1."""
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    weight = np.where(labels == 1, prior / sizes[1], (1 - prior) / sizes[0]) * len(labels)
    target = np.where(labels == 1, (sizes[1] + 1) / (sizes[1] + 2), 1 / (sizes[0] + 2))
    ab = np.array([1.0, np.log(prior / (1 - prior))])
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        slope = x.T @ (weight * (p - target)) + np.array([ab[0] - 1, 0.0])
        curve = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag([1.0, 1e-6])
        move = np.linalg.solve(curve, slope)
        ab -= move * min(1.0, 2 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return float(max(ab[0], 0.05)), float(ab[1])


def train_on(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", learn: str = "true", settings: Settings = Settings()) -> Model | None:
    """Train on the documents whose key meets the SQL condition ``learn``, with what ``labels`` says of them (0 or 1).

    At most ``docs_per_class`` documents of each class are learned from, those of
    the smallest key hash, with their whole texts.  A key with labels of both
    kinds counts as 0, one with several texts as that of the smallest hash.
    Features are found on the executors; a document comes to the driver as at
    most one number for each bucket.  None if either class is absent.
    """
    k, mark = F.col(f"`{key}`"), F.col(f"`{label}`").cast("int")
    rows = docs.where(learn).where(k.isNotNull()).select(k.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = labels.where(learn).where(k.isNotNull() & mark.isin(0, 1)).groupBy(k.alias("key")).agg(F.min(mark).alias("label"))
    known = written(known.join(docs.select(k.alias("key")), "key", "left_semi"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        discard(known)
        return None
    smallest = lambda value: known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(settings.docs_per_class)
    gold = written(smallest(0).unionByName(smallest(1)))
    # bounded by the settings, hence the broadcast; the texts of a repeated key meet as their smallest
    sample = rows.join(F.broadcast(gold), "key").groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=200):
                buckets, who = features(part.column(1), settings)
                keys, counts = np.unique(who * settings.buckets + buckets, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * settings.buckets)
                at = (keys % settings.buckets).astype(np.int32)
                cols = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (at, counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["key", "label", "at", "counts"])

    key_type = dict(sample.dtypes)["key"]
    found = sample.select("key", "text", "label").mapInArrow(counted, f"key {key_type}, label int, at binary, counts binary").collect()
    discard(known, gold)
    found.sort(key=lambda r: r["key"])
    own = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in found]
    return train(own, np.array([r["label"] for r in found]), shares[1] / (shares[0] + shares[1]), settings)


def score_batch(model: Model | None, texts: pa.Array) -> np.ndarray:
    """Probability of class 1 for every text; 0.5 without a model, the share of class 1 among labels for texts without features."""
    if model is None:
        return np.full(len(texts), 0.5)
    buckets, who = features(texts, model.settings)
    total, n = np.bincount(who, model.weights[buckets], len(texts)), np.bincount(who, minlength=len(texts))
    logit = np.where(n > 0, total / np.maximum(n, 1) + model.bias, model.empty)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_texts(df: DataFrame, model: Model | None, *, text: str = "text", into: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the quality score of every whole text.

    Rows are independent: repeated rows give repeated rows, an empty table an
    empty one.  Null texts are empty.  ``into`` must not name a kept column.  No
    shuffle.
    """
    if into.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{into} is a kept column")
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), rows=500):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_batch(model, part.column(len(keep))), pa.float64())], names=[*keep, into])

    return kept.mapInArrow(run, schema)
