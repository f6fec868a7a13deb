"""Language identification with a byte convolutional network.

A text is cut into windows of a fixed number of bytes.  Filters of several
widths slide over the embedded bytes of a window, each filter keeps its largest
response (max pooling) and a softmax layer turns the responses into language
probabilities.  The network is trained in numpy on windows of a bounded sample
of labelled texts.  A text's probabilities are the mean over all its windows,
each weighted by the bytes it holds.

A filter over embedded bytes is a sum of per-byte table rows, so the trained
network is applied through tables for one and two bytes: a look-up in place of
a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, slices
from .shingles import text_bytes

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and bounds of its training sample."""

    window: int = 192
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    docs_per_language: int = 400  # labelled documents of a language that are learned from, at most
    windows_per_doc: int = 6  # windows of such a document, spread over all of it
    epochs: int = 8
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """Trained parameters and the languages of the outputs."""

    settings: Settings
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, embed, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _tables: list = field(default_factory=list, repr=False)

    def tables(self) -> list[list[np.ndarray]]:
        """Per width: summands of the responses, each a table over a byte pair (65536 rows) or a byte (256 rows)."""
        if not self._tables:
            for f in self.filters:
                rows = [self.embed @ part for part in f]
                pairs = [(a[:, None, :] + b[None, :, :]).reshape(65536, -1) for a, b in zip(rows[0::2], rows[1::2], strict=False)]
                self._tables.append(pairs + (rows[-1:] if len(rows) % 2 else []))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of windows, (n, window) bytes padded with zeros."""
        pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        pooled = []
        for width, tables in zip(self.settings.widths, self.tables(), strict=True):
            n = windows.shape[1] - width + 1
            total = None
            for k, table in enumerate(tables):
                at = (pair if len(table) == 65536 else windows)[:, 2 * k : 2 * k + n]
                rows = table.take(at, axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return softmax(hidden @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (the last one of a text padded with zeros), the text of each, and the bytes it holds."""
    lengths = np.diff(bounds)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = bounds[owner] + nth * size
    held = np.minimum(size, bounds[owner + 1] - begin)
    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    windows = padded[begin[:, None] + np.arange(size)] if len(owner) else np.zeros((0, size), np.uint8)
    windows[np.arange(size) >= held[:, None]] = 0
    return windows, owner, held


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings) -> Network:
    """Adam on the cross-entropy, classes weighted alike."""
    rng = np.random.default_rng(settings.seed)
    e, m, size = settings.embed, settings.filters, settings.window
    params = [rng.normal(0, 0.5, (256, e)).astype(np.float32)]
    params += [rng.normal(0, (2 / (w * e)) ** 0.5, (w * e, m)).astype(np.float32) for w in settings.widths]
    hidden = m * len(settings.widths)
    params += [np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, (hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    counts = np.bincount(labels, minlength=len(languages))
    share = (len(labels) / len(languages) / np.maximum(counts, 1)).astype(np.float32)
    step = 0
    for _ in range(settings.epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // settings.batch)):
            embed, filters, (bias, out, out_bias) = params[0], params[1:-3], params[-3:]
            x, y, n = windows[rows], labels[rows], len(rows)
            flat = embed[x].reshape(n, -1)
            pooled, best = [], []
            for w, f in zip(settings.widths, filters, strict=True):
                view = np.lib.stride_tricks.sliding_window_view(flat, w * e, axis=1)[:, ::e]
                response = view @ f
                at = response.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + bias
            active = np.maximum(raw, 0)
            delta = softmax(active @ out + out_bias)
            delta[np.arange(n), y] -= 1
            delta *= (share[y] / n)[:, None]
            back = (delta @ out.T) * (raw > 0)
            grads = [np.zeros_like(embed)]
            for k, (w, f) in enumerate(zip(settings.widths, filters, strict=True)):
                d, at = back[:, k * m : (k + 1) * m], best[k]
                used = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # (n, filters, w) bytes
                grads.append(np.einsum("nm,nmwe->wem", d, embed[used]).reshape(w * e, m))
                np.add.at(grads[0], used, np.einsum("nm,wem->nmwe", d, f.reshape(w, e, m)))
            grads += [back.sum(0), active.T @ delta, delta.sum(0)]
            step += 1
            for p, g, (first, second) in zip(params, grads, moments, strict=True):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    shaped = [f.reshape(w, e, m) for w, f in zip(settings.widths, params[1:-3], strict=True)]
    return Network(settings, languages, params[0], shaped, *params[-3:])


def train_on(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", learn: str = "true", settings: Settings = Settings()) -> Network | None:
    """Train on the rows of ``docs`` for which the SQL condition ``learn`` holds
    and whose language is known; None if there are none.

    The sample is bounded per language by ``docs_per_language`` documents, those
    of the smallest key hash, and ``windows_per_doc`` windows from each.
    """
    k, lg = F.col(f"`{key}`"), F.col(f"`{lang}`")
    known = docs.where(learn).where(lg.isNotNull() & F.col(f"`{text}`").isNotNull() & k.isNotNull()).select(k.alias("__key"), lg.alias("__lang"), F.col(f"`{text}`").alias("__text"))
    # rows of a language below the hash that about a half more than the sample lie under: so few meet in the window
    counts = known.groupBy("__lang").agg(F.count(F.lit(1)).alias("__all"))  # a row for each output of the network
    place = (F.shiftrightunsigned("__h", 11) + F.lit(0.5)) / F.lit(float(2**53))
    wanted = settings.docs_per_language
    low = known.select("__key", "__lang", F.xxhash64("__key").alias("__h")).join(F.broadcast(counts), "__lang").where(place * F.col("__all") < 1.5 * wanted + 50)
    nth = F.row_number().over(Window.partitionBy("__lang").orderBy("__h", "__key"))
    chosen = low.distinct().withColumn("__n", nth).where(F.col("__n") <= wanted).select("__key", "__lang")
    # at most docs_per_language rows for each language, hence the broadcast
    sample = known.join(F.broadcast(chosen), ["__key", "__lang"]).select("__key", "__lang", "__text")
    size, most = settings.window, settings.windows_per_doc

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, owner, held = cut_windows(*text_bytes(batch.column(2)), size)
            keep = []
            for rows in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []:
                rows = rows[held[rows] >= min(32, held[rows].max())]
                keep.extend(np.unique(rows[np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(int)]).tolist())
            at = pa.array(owner[keep], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([cut[i].tobytes() for i in keep], pa.binary())], names=["key", "lang", "bytes"])

    key_type = dict(sample.dtypes)["__key"]
    rows = sample.mapInArrow(windows, f"key {key_type}, lang string, bytes binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["key"], r["lang"], bytes(r["bytes"])))
    languages = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.uint8).reshape(len(rows), size)
    return train(x, np.array([languages.index(r["lang"]) for r in rows]), languages, settings)


def predict_batch(network: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of every text; ``und`` with score 0 where there is no letter or no network."""
    have = [t is not None and network is not None and _LETTER.search(t) is not None for t in texts.to_pylist()]
    if network is None or not any(have):
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    raw, bounds = text_bytes(texts)
    size, step = network.settings.window, 512
    total = np.zeros((len(texts), len(network.languages)))
    # whole texts at a time, so many that a few thousand windows are held at once
    cuts = np.searchsorted(np.cumsum(-(-np.diff(bounds) // size)), np.arange(4096, len(raw) // size + 4096, 4096))
    edges = np.unique(np.concatenate(([0], cuts + 1, [len(texts)])).clip(0, len(texts)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        windows, owner, held = cut_windows(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
        for i in range(0, len(owner), step):
            p = network.probabilities(windows[i : i + step]) * held[i : i + step, None]
            np.add.at(total, owner[i : i + step] + a, p)
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    best = total.argmax(axis=1)
    langs = [network.languages[b] if h else UNKNOWN for b, h in zip(best, have, strict=True)]
    scores = [float(min(1.0, total[i, b])) if h else 0.0 for i, (b, h) in enumerate(zip(best, have, strict=True))]
    return langs, scores


def predict_languages(df: DataFrame, network: Network | None, *, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the language and score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0.  Rows are
    independent: repeated rows give repeated rows, an empty table an empty one.
    Columns are found by name; ``into`` must not name a kept one.  No shuffle.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into[0]}` string, `{into[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), rows=500):
                langs, scores = predict_batch(network, part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *into])

    return kept.mapInArrow(run, schema)
