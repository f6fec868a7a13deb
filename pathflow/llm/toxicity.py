"""Toxicity by weak supervision.

Many weak voters look at a text: one for each entry of a lexicon of words and
of word beginnings, and a few for patterns.  The lexicon is mined from labelled
rows.  A generative model of the votes, fitted by expectation maximisation on
rows whose labels it does not see, estimates each voter's rate of voting in
either class and which voters go together: given the class, a vote depends on
that of one other voter, and these dependences form the tree of the largest
conditional mutual information.  Its posteriors are the labels from which a
linear classifier is trained.  Gold labels serve to mine the lexicon, as a weak
prior of the voters' rates, and to set the score's cut at the end.

Features are the distinct words of a text and the first 4 to 8 bytes of each,
lower-cased, as 64-bit hashes; they are found for a whole batch at once, on the
executors.  The driver gets the counts of the lexicon and the votes of a
bounded number of rows, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, slices, written
from .shingles import _BASE, _BASE_INVERSE, _M3, _powers, mix, text_bytes

PREFIXES = (4, 5, 6, 7, 8)
#: Pattern voters on shares and counts of a text; each a name and the least value for its vote.
PATTERNS = (("capitals", 0.5), ("exclamations", 0.02), ("repeats", 0.5), ("symbols", 0.1))
_BYTES = np.arange(256)
_WORD = (_BYTES >= 128) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES == 39)
_VALUES = mix(_BYTES.astype(np.uint64) * np.uint64(2) + _M3)


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of the model."""

    sample_toxic: int = 1500  # labelled rows of either class, at most
    sample_clean: int = 2500
    sample_unlabelled: int = 4000  # further rows, whose labels are not looked at
    voters: int = 400
    support: int = 4  # labelled toxic documents in which a lexicon entry must occur
    rounds: int = 30
    least_z: float = 4.0  # root of the likelihood ratio that it must reach
    gold_weight: float = 200.0  # rows for which each class's labelled rates count
    steps: int = 30
    ridge: float = 3e-5


@dataclass
class Model:
    """The linear classifier: sorted feature hashes, their weights, weights of the patterns, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    bias: float


def batch_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature hash) pairs of all words and word beginnings, and the pattern values of every text."""
    raw0, bounds0 = text_bytes(texts)
    n_texts = len(texts)
    patterns = np.zeros((n_texts, len(PATTERNS)), np.float32)
    size = np.maximum(np.diff(bounds0), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[bounds0[1:]] - sums[bounds0[:-1]]) / size

    if len(raw0):
        upper, lower = share((raw0 >= 65) & (raw0 <= 90)), share((raw0 >= 97) & (raw0 <= 122))
        patterns[:, 0] = upper / np.maximum(upper + lower, 1e-9)
        patterns[:, 1] = share(raw0 == 33)
        patterns[:, 3] = share((raw0 > 32) & (raw0 < 48))
    raw, bounds = text_bytes(pc.utf8_lower(texts.fill_null("")))
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), patterns
    inside = np.concatenate((_WORD[raw], [False]))
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    first = np.flatnonzero(begins)
    stops = np.flatnonzero(~inside)
    last = stops[np.searchsorted(stops, first)]
    owner = np.searchsorted(bounds, first, side="right") - 1
    last = np.minimum(last, bounds[owner + 1])
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * _powers(_BASE, n), out=sums[1:])
    back = _powers(_BASE_INVERSE, n)[first]
    words = mix((sums[last] - sums[first]) * back)
    owners, hashes = [owner], [words]
    for k in PREFIXES:
        long = np.flatnonzero(last - first >= k)
        owners.append(owner[long])
        hashes.append(mix((sums[first[long] + k] - sums[first[long]]) * back[long] + np.uint64(k)))
    same = np.concatenate((words[1:] == words[:-1], [False])) & np.concatenate((owner[1:] == owner[:-1], [False]))
    count = np.maximum(np.bincount(owner, minlength=n_texts), 1)
    patterns[:, 2] = np.bincount(owner, weights=same, minlength=n_texts) / count
    return np.concatenate(owners), np.concatenate(hashes), patterns


def presence(owner: np.ndarray, hashes: np.ndarray, features: np.ndarray, n_texts: int) -> np.ndarray:
    """Distinct (text, feature index) pairs of the known features, as text * len(features) + index, sorted."""
    if not len(features):
        return np.empty(0, np.int64)
    # a table over 16 bits of the hash turns nearly all others away
    table = np.zeros(1 << 16, bool)
    table[(features >> np.uint64(48)).astype(np.int64)] = True
    near = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(features, hashes[near]), len(features) - 1)
    hit = features[at] == hashes[near]
    return np.unique(owner[near][hit] * len(features) + at[hit])


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text index, feature hash) pairs, and the pattern values of every text."""
    owner, hashes, patterns = batch_features(texts)
    if not len(owner):
        return owner, hashes, patterns
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
    return owner[new], hashes[new], patterns


def mine_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> np.ndarray:
    """Sorted hashes of the features that tell toxic from clean rows best, by the root of their likelihood ratio.

    ``sample`` holds ``label, text``; rows with a null label don't count.
    Features are counted in every task and summed up by Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=250):
                owner, hashes, _ = distinct_features(part.column(1))
                toxic = part.column(0).to_numpy(zero_copy_only=False)[owner] == 1
                features, at = np.unique(hashes, return_inverse=True)
                pos = np.bincount(at[toxic], minlength=len(features))
                yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(features)) - pos)], names=["feature", "pos", "neg"])

    counts = sample.where("label is not null").select(F.col("label").cast("int"), "text").mapInArrow(count, "feature long, pos long, neg long")
    sums = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= settings.support)
    whole = float(n_toxic + n_clean)
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    cells = ((p, p + n, n_toxic), (n, p + n, n_clean), (n_toxic - p, whole - p - n, n_toxic), (n_clean - n, whole - p - n, n_clean))
    ratio = sum(F.when(cell > 0, cell * F.log(cell * whole / (row * float(column)))).otherwise(0.0) for cell, row, column in cells)
    good = sums.where(p * float(n_clean) > n * 4.0 * n_toxic).withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))).where(F.col("z") >= settings.least_z)
    best = good.orderBy(F.col("z").desc(), "feature").limit(settings.voters).collect()
    return np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))


def collect_votes(sample: DataFrame, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lexicon votes (rows x features), pattern values, and labels (-1 where null) of the sample's rows, in order of their keys."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, rows=250):
                owner, hashes, patterns = batch_features(part.column(2))
                found, m = presence(owner, hashes, features, part.num_rows), max(1, len(features))
                edges = np.searchsorted(found // m, np.arange(part.num_rows + 1))
                votes = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found % m, pa.int32()))
                shown = pa.FixedSizeListArray.from_arrays(pa.array(patterns.ravel().astype(np.float64)), len(PATTERNS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), votes, shown], names=["h", "label", "votes", "patterns"])

    rows = sample.select("h", F.col("label").cast("int"), "text").mapInArrow(look, "h long, label int, votes array<int>, patterns array<double>").collect()
    rows.sort(key=lambda r: (r["h"], r["votes"], r["patterns"]))
    words = np.zeros((len(rows), len(features)), np.float32)
    for k, r in enumerate(rows):
        words[k, r["votes"]] = 1
    patterns = np.array([r["patterns"] for r in rows], np.float32).reshape(len(rows), len(PATTERNS))
    return words, patterns, np.array([-1 if r["label"] is None else r["label"] for r in rows], np.int64)


@dataclass
class LabelModel:
    """Class prior, and each voter's chance to vote by class and by the vote of its parent (-1: none)."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray  # class x parent's vote x voter

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class 1 for every row of votes (rows x voters, 0/1)."""
        up = np.where(self.parent >= 0, votes[:, self.parent], 0.0)
        log, log_not = np.log(self.rates), np.log1p(-self.rates)
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for sign, c in ((1, 1), (-1, 0)):
            silent, step = log_not[c, 0], log_not[c, 1] - log_not[c, 0]
            vote, both = log[c, 0] - silent, log[c, 1] - log_not[c, 1] - (log[c, 0] - silent)
            logit += sign * (silent.sum() + votes @ vote + up @ step + (votes * up) @ both)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def dependence_tree(single: np.ndarray, both: np.ndarray, sizes: np.ndarray, least: float = 10.83) -> np.ndarray:
    """Parents of the voters in the tree of the largest conditional mutual information (-1: none).

    ``single`` (class x voter) and ``both`` (class x voter x voter) are weighted
    numbers of votes, ``sizes`` the classes' weights.  Dependences below
    ``least`` (as a likelihood ratio) are left out.
    """
    gain = np.zeros(both.shape[1:])
    for c in range(2):
        n = max(sizes[c], 1e-9)
        a, b = single[c][:, None], single[c][None, :]
        for cell, x, y in ((both[c], a, b), (a - both[c], a, n - b), (b - both[c], n - a, b), (n - a - b + both[c], n - a, n - b)):
            cell = np.maximum(cell, 0)
            gain += np.where(cell > 1e-9, cell * np.log(np.maximum(cell, 1e-12) * n / np.maximum(x * y, 1e-12)), 0.0)
    np.fill_diagonal(gain, -np.inf)
    n = len(gain)
    parent, inside = np.full(n, -1), np.zeros(n, bool)
    best, link = np.full(n, -np.inf), np.full(n, -1)
    for _ in range(n):  # Prim's rule; a voter without a strong enough tie starts a new tree
        k = int(np.where(inside, -np.inf, np.maximum(best, 0)).argmax())
        inside[k] = True
        if 2 * best[k] >= least:
            parent[k] = link[k]
        closer = ~inside & (gain[k] > best)
        best[closer], link[closer] = gain[k][closer], k
    return parent


def fit_label_model(votes: np.ndarray, told: np.ndarray, prior: float, settings: Settings) -> tuple[LabelModel, np.ndarray]:
    """The label model of votes (rows x voters, 0/1) whose labels are unknown, and its posteriors.

    ``told`` holds both classes' rates of voting among labelled rows (class x
    voter); they start the iteration and weigh in as ``gold_weight`` rows.  The
    share of class 1 stays that of the labelled rows.
    """
    votes = votes.astype(np.float64)
    m = votes.shape[1]
    told, gold = np.clip(told, 1e-4, 1 - 1e-4), settings.gold_weight
    model = LabelModel(prior, np.full(m, -1), np.repeat(told[:, None, :], 2, axis=1))
    # at first a vote counts by its evidence alone: a text uses few of the words that exist
    post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + votes @ (np.log(told[1]) - np.log(told[0])), -30, 30)))
    for turn in range(settings.rounds):
        weights = np.stack([1 - post, post])
        sizes, single = weights.sum(axis=1), weights @ votes
        if turn % 5 == 0:
            parent = dependence_tree(single, np.stack([(votes * w[:, None]).T @ votes for w in weights]), sizes)
            up = np.where(parent >= 0, votes[:, parent], 0.0)
        rates = np.empty((2, 2, m))
        for c in range(2):
            base = (single[c] + gold * told[c]) / (sizes[c] + gold)
            joint = weights[c] @ (votes * up)
            above = np.where(parent >= 0, single[c][parent], 0.0)
            rates[c, 1] = (joint + 4 * base) / (above + 4)
            rates[c, 0] = (np.maximum(single[c] - joint, 0) + gold * told[c] + 1e-3) / (np.maximum(sizes[c] - above, 0) + gold + 1)
        model = LabelModel(prior, parent, np.clip(rates, 1e-6, 1 - 1e-6))
        before, post = post, model.posterior(votes)
        if np.abs(post - before).max(initial=0) < 1e-4:
            break
    return model, post


def best_cut(scores: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """The score that parts the rows with the highest weighted F1, halfway between the two rows that it falls between."""
    order = np.argsort(-scores, kind="stable")
    s, good, all_ = scores[order], np.cumsum((weight * positive)[order]), np.cumsum(weight[order])
    f1 = 2 * good / np.maximum(all_ + good[-1], 1e-12)
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stay together
    k = int(f1.argmax())
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2


def train(words: np.ndarray, patterns: np.ndarray, labels: np.ndarray, features: np.ndarray, prior: float, settings: Settings = Settings()) -> Model:
    """Label model and linear classifier from votes; ``prior`` is the share of toxic rows among labelled ones.

    ``labels`` (-1: unknown) give the voters' rates among labelled rows and, at
    the end, the cut.  The classifier is trained on the label model's posteriors
    of all rows.
    """
    n, m = words.shape
    votes = np.concatenate([words, patterns >= np.array([least for _, least in PATTERNS])], axis=1)
    prior = min(max(prior, 1e-3), 0.5)
    told = np.stack([(votes[labels == c].sum(axis=0) + 0.5 * (c or prior)) / ((labels == c).sum() + 1) for c in (0, 1)])
    _, post = fit_label_model(votes, told, prior, settings)
    x = np.concatenate([words, patterns, np.ones((n, 1))], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.full(len(w), settings.ridge)
    ridge[-1] = 0
    for _ in range(settings.steps):  # Newton's method on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6) / n
        move = np.linalg.solve(x.T @ (x * curve[:, None]) + np.diag(ridge + 1e-9), x.T @ (p - post) / n + ridge * w)
        w -= move * min(1.0, 4 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    # labelled rows stand for their share of the table
    known = labels >= 0
    weight = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum()))[known]
    b = float(w[-1]) - best_cut(x[known] @ w, labels[known] == 1, weight / weight.sum())
    w = w[:-1]
    return Model(features, w[:m], w[m:], b)


def score_batch(model: Model | None, texts: pa.Array) -> np.ndarray:
    """Probability of being toxic, for every text; empty and null texts get the bias alone."""
    if model is None:
        return np.zeros(len(texts))
    owner, hashes, patterns = batch_features(texts)
    total = model.bias + patterns @ model.patterns
    m = len(model.features)
    if m:
        found = presence(owner, hashes, model.features, len(texts))
        total = total + np.bincount(found // m, weights=model.weights[found % m], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def draw_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, learn: str, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """A written table ``h, label, text`` of different rows, and the numbers of labels of either class that have a document.

    Labelled rows (0 or 1) are those of the smallest hash of their key; an id
    with labels of both kinds counts as toxic.  Further rows, with a null label,
    are those of the smallest hash of key and text among documents that meet
    ``learn``.  Only keys and hashes are sorted; texts move once they are chosen.
    """
    k, mark = F.col(f"`{key}`"), F.col(f"`{label}`").cast("int")
    rows = docs.where(learn).where(k.isNotNull()).select(k.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("key", "text"))
    known = labels.where(learn).where(k.isNotNull() & mark.isin(0, 1)).groupBy(k.alias("key")).agg(F.max(mark).alias("label"))
    known = known.join(docs.select(k.alias("key")), "key", "left_semi")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordered = lambda value, most: known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(most)
    gold = ordered(1, settings.sample_toxic).unionByName(ordered(0, settings.sample_clean))
    others = rows.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(settings.sample_unlabelled)
    # both lists are bounded by the settings, hence the broadcasts
    labelled = rows.join(F.broadcast(gold), "key").select("h", "label", "text")
    free = rows.join(F.broadcast(others), "h", "left_semi").join(F.broadcast(gold.select("key")), "key", "left_anti").select("h", F.lit(None).cast("int").alias("label"), "text")
    return written(labelled.unionByName(free).dropDuplicates(["h"])), shares


def train_on(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", learn: str = "true", settings: Settings = Settings()) -> Model | None:
    """Train on the documents whose key meets the SQL condition ``learn``, with what ``labels`` says of them (0 or 1).

    The sample is bounded by ``settings``; texts of all lengths take part, and
    repeated rows once.  None if either class is absent.
    """
    sample, shares = draw_sample(docs, labels, text, key, label, learn, settings)
    counts = {r["label"]: r["n"] for r in sample.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = None
    if counts.get(0) and counts.get(1):
        features = mine_lexicon(sample, counts[1], counts[0], settings)
        model = train(*collect_votes(sample, features), features, shares.get(1, 0) / max(1, sum(shares.values())), settings)
    discard(sample)
    return model


def score_texts(df: DataFrame, model: Model | None, *, text: str = "text", into: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the toxicity score of every whole text.

    Null and empty texts get the score of a text without evidence; without a
    model all scores are 0.  Rows are independent: repeated rows give repeated
    rows, an empty table an empty one.  No shuffle.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "__text")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), rows=500):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_batch(model, part.column(len(keep))), pa.float64())], names=[*keep, into])

    return kept.mapInArrow(run, schema)
