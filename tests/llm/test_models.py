"""Language, toxicity, page text and the pipeline: held-out accuracy, brute force and odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_joins import brute_components
from test_texts import check_pieces

from pathflow.llm import html_text, langid, queries, toxicity
from pathflow.llm.shared import written

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = [r for r in queries.op6_language_id(spark, MIDDLE).collect() if r["held_out"] and lang[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd_documents, no_documents):
    network = langid.train_on(odd_documents)
    rows = langid.predict_languages(odd_documents, network).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (2, 3, 4, -3))
    assert all(r["lang_pred"] in ("en", "de", "fr", "es") for r in rows if r["doc_id"] in (1, 5, 6, 7, 9))
    assert langid.train_on(no_documents) is None
    assert {r["lang_pred"] for r in langid.predict_languages(odd_documents, None).collect()} == {"und"}
    assert not langid.predict_languages(no_documents, network).count()


def test_tables_equal_convolution():
    rng = np.random.default_rng(2)
    s = langid.Settings(epochs=1)
    net = langid.train(rng.integers(0, 256, (64, s.window)).astype(np.uint8), np.arange(64) % 2, ["a", "b"], s)
    x = rng.integers(0, 256, (5, s.window)).astype(np.uint8)
    pooled = [np.max([np.einsum("nwe,wem->nm", net.embed[x[:, i : i + w]], f) for i in range(s.window - w + 1)], axis=0) for w, f in zip(s.widths, net.filters, strict=True)]
    direct = langid.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(direct, net.probabilities(x), atol=1e-4)


def test_toxicity_held_out(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, MIDDLE).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    y, p = np.array([toxic[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows])
    order = np.argsort(p)
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 5, 6, 7, 8, 9)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train_on(odd_documents, labels)
    rows = toxicity.score_texts(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.train_on(no_documents, labels) is None
    assert {r["score"] for r in toxicity.score_texts(odd_documents, None).collect()} == {0.0}
    assert not toxicity.score_texts(no_documents, model).count()


def test_toxicity_learns_a_lexicon(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, 30)) + (" vilething nastyword" if k % 5 == 0 else "") for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train_on(docs, spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int"))
    scores = toxicity.score_batch(model, pa.array([*texts[200:300], "", None]))
    assert all((s >= 0.5) == (k % 5 == 0) for k, s in enumerate(scores[:100])) and scores[100] < 0.5
    # ties: equal texts have equal scores, whatever stands beside them
    assert len({*toxicity.score_batch(model, pa.array([texts[0]] * 3)), toxicity.score_batch(model, pa.array([texts[0]]))[0]}) == 1


def test_label_posterior_by_brute_force():
    rng = np.random.default_rng(6)
    model = toxicity.LabelModel(0.2, np.array([-1, 0, 0, 2, -1]), rng.uniform(0.05, 0.95, (2, 2, 5)))
    votes = np.array([[(k >> j) & 1 for j in range(5)] for k in range(32)], float)
    for row, found in zip(votes, model.posterior(votes), strict=True):
        chance = []
        for c in (0, 1):
            p = 0.2 if c else 0.8
            for j, up in enumerate(model.parent):
                rate = model.rates[c, int(row[up]) if up >= 0 else 0, j]
                p *= rate if row[j] else 1 - rate
            chance.append(p)
        assert found == pytest.approx(chance[1] / sum(chance))
    for c in (0, 1):  # the model is a distribution over all votes
        total = sum(np.prod([model.rates[c, int(v[u]) if u >= 0 else 0, j] if v[j] else 1 - model.rates[c, int(v[u]) if u >= 0 else 0, j] for j, u in enumerate(model.parent)]) for v in votes)
        assert total == pytest.approx(1)


def test_label_model_sees_copies_of_a_voter():
    """Six voters of known rates, the first repeated eight times: its copies hang together and don't outvote the others."""
    rng = np.random.default_rng(8)
    n, prior = 6000, 0.3
    y = rng.random(n) < prior
    hit, false = np.array([0.6, 0.7, 0.65, 0.7, 0.6, 0.75]), np.array([0.25, 0.1, 0.12, 0.1, 0.15, 0.08])
    votes = (rng.random((n, 6)) < np.where(y[:, None], hit, false)).astype(float)
    votes = np.concatenate([np.repeat(votes[:, :1], 8, axis=1), votes[:, 1:]], axis=1)
    told = np.stack([np.concatenate([[x[0]] * 8, x[1:]]) for x in (false, hit)]) * np.array([[1.2], [0.8]])  # a rough guess
    model, post = toxicity.fit_label_model(votes, told, prior, toxicity.Settings())
    assert (model.parent[:8] >= 0).sum() == 7 and set(model.parent[:8]) <= {-1, *range(8)}
    naive = toxicity.LabelModel(model.prior, np.full(13, -1), np.repeat(np.stack([np.concatenate([[x[0]] * 8, x[1:]]) for x in (false, hit)])[:, None, :], 2, axis=1)).posterior(votes)
    assert np.mean((post > 0.5) == y) > np.mean((naive > 0.5) == y) + 0.03
    assert (model.rates[1, 0, 8:] > model.rates[0, 0, 8:] + 0.2).all()


def test_classifier_learns_posteriors(spark):
    """The labels of the classifier are the model's, not the gold ones: most rows have none, and wrong gold labels are overruled."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    settings = toxicity.Settings()
    sample, shares = toxicity.draw_sample(docs, labels, "text", "doc_id", "toxic", "true", settings)
    features = toxicity.mine_lexicon(sample, shares[1], shares[0], settings)
    words, patterns, gold = toxicity.collect_votes(sample, features)
    assert (gold < 0).sum() > 300 and set(gold) == {-1, 0, 1} and len(words) == sample.count()
    prior = shares[1] / sum(shares.values())
    votes = np.concatenate([words, patterns >= np.array([least for _, least in toxicity.PATTERNS])], axis=1)
    told = np.stack([(votes[gold == c].sum(axis=0) + 0.5 * (c or prior)) / ((gold == c).sum() + 1) for c in (0, 1)])
    _, post = toxicity.fit_label_model(votes, told, prior, settings)
    known = gold >= 0
    assert np.abs(post[known] - gold[known]).max() > 0.9  # some gold labels are overruled
    assert np.mean((post[known] > 0.5) == gold[known]) > 0.93
    wrong = gold.copy()
    flipped = np.flatnonzero(gold == 1)[:3]
    wrong[flipped] = 0
    told = np.stack([(votes[wrong == c].sum(axis=0) + 0.5 * (c or prior)) / ((wrong == c).sum() + 1) for c in (0, 1)])
    assert (toxicity.fit_label_model(votes, told, prior, settings)[1][flipped] > 0.5).any()


def test_long_texts_teach(spark):
    long = " ".join(["plain"] * 30_000)
    docs = spark.createDataFrame([(k, (long if k % 2 else "short") + (" vileword" if k % 3 == 0 else "")) for k in range(60)] * 2, "doc_id long, text string")
    model = toxicity.train_on(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int"))
    assert [s >= 0.5 for s in toxicity.score_batch(model, pa.array([long + " vileword", long, "a vileword", "a"]))] == [True, False, True, False]


PAGE = """<!doctype html><html><head><title>No</title><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>A &amp; B</h1><p>First  line<br>goes
on.</p><div class="ad">Buy</div><p>Second <b>bold</b> &eacute;&#x41;.</p><!-- no --><form><input></form></article></main>
<section class="comments"><p>Nice post</p></section><aside>More</aside><footer>End</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE, html_text.DEFAULT_WEIGHTS) == "A & B\n\nFirst line goes on.\n\nSecond bold éA."
    for page in (None, "", "   ", "<", "<p", "<script>", "<!--", "<div class='"):
        assert html_text.main_text(page, html_text.DEFAULT_WEIGHTS) in ("", "<")


@pytest.mark.parametrize("scores", [[], [-1.0], [1.0, -3.0, 2.0, 2.0, -1.0, 3.0, -9.0, 4.0], [0.0, 1.0, 0.0], [-1.0, 5.0, -2.0, 1.0]])
def test_best_region(scores):
    a, b = html_text.best_region(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert (b - a > 0) == (max(sums, default=0) > 0) and sum(scores[a:b]) == max([0, *sums])


def test_page_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = queries.op10_html_extraction(spark, SMALL).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.8 * len(rows)
    odd = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>one two</p>", None), (2, "u", "<p>" + "a b " * 200_000, "y"), (2, "u", "", "y")], "page_id long, url string, html string, page string")
    assert html_text.extract_main_text(odd).count() == 4
    assert not html_text.extract_main_text(odd.where("false")).count()


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").cache()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, MIDDLE)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.toPandas(), docs.schema) if kept.count() else kept
        assert not kept.select("doc_id").subtract(before.select("doc_id")).count()
        assert kept.count() > 0.5 * before.count()
    places = corpus_pipeline.STAGES[-1][1](spark, kept, MIDDLE)
    assert {r["doc_id"] for r in places.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    docs.unpersist()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_pipeline_of_odd_rows(spark, odd_documents, no_documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd_documents, no_documents):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, now, SMALL))
            assert after.columns == docs.columns
            assert not rows_of(after) - rows_of(now), name  # rows go, none comes or changes
            if name == "language ID":
                assert all(any(c.isalpha() for c in r["text"] or "") for r in after.collect())
            now = after
        texts = {}
        for r in now.collect():
            assert texts.setdefault(r["text"].lower().strip(), r["doc_id"]) == r["doc_id"]  # of equal texts one id stays
        tokens, totals = Counter(), {}
        for r in corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect():
            tokens[r["doc_id"]] += r["length"]
            totals[r["doc_id"]] = r["doc_tokens"]
        repeats = Counter(r["doc_id"] for r in now.collect())
        assert tokens == {k: totals[k] * n for k, n in repeats.items()}


def test_pipeline_by_brute_force(spark):
    """Every stage against its operator's brute-force version, on the stage's own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    network = langid.train_on(docs, learn=f"{queries.remainder(3)} <> 1")
    kept = {r["doc_id"] for r in docs.collect() if (found := brute_language(network, r["text"]))[0] != "und" and found[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    now = written(corpus_pipeline.keep_recognised_languages(spark, docs, SMALL))
    assert {r["doc_id"] for r in now.collect()} == kept
    model = toxicity.train_on(now, queries.table(spark, SMALL, "labels"), learn=f"{queries.remainder(5)} <> 0")
    kept = {r["doc_id"] for r in now.collect() if toxicity.score_batch(model, pa.array([r["text"]]))[0] < corpus_pipeline.TOXIC_SCORE}
    now = written(corpus_pipeline.drop_toxic(spark, now, SMALL))
    assert {r["doc_id"] for r in now.collect()} == kept
    found = brute_components([(r["doc_id"], r["text"]) for r in now.collect()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    kept = {d for (_, d), n, c in found if c == d or not n}
    now = written(corpus_pipeline.drop_near_duplicates(spark, now, SMALL))
    assert {r["doc_id"] for r in now.collect()} == kept
    check_pieces(corpus_pipeline.pack(spark, now, SMALL).collect(), [(r["doc_id"], r["text"]) for r in now.collect()])


def brute_language(network, text):
    """Language and score by the convolution itself, window after window."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    size, raw, total = network.settings.window, text.encode(), 0.0
    for at in range(0, len(raw), size):
        part = raw[at : at + size]
        x = np.frombuffer(part.ljust(size, b"\0"), np.uint8)
        pooled = [np.max([np.einsum("we,wem->m", network.embed[x[i : i + w]], f) for i in range(size - w + 1)], axis=0) for w, f in zip(network.settings.widths, network.filters, strict=True)]
        total = total + langid.softmax((np.maximum(np.concatenate(pooled) + network.bias, 0) @ network.out + network.out_bias)[None])[0] * len(part)
    return network.languages[int(total.argmax())], float(total.max() / total.sum())


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    network = langid.train_on(docs, learn=f"{queries.remainder(3)} <> 1")
    rows = queries.op6_language_id(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[:60]:
        lang, score = brute_language(network, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
