"""Tokens, packing, fingerprints, sharding: against other libraries and brute force."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathflow.llm import bpe, fingerprint, packing, queries, sharding


@pytest.fixture(scope="module")
def theirs():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(place, text):
    ids = array("I")
    ids.frombytes(bpe.codec(**place).encode_batch([text])[0])
    return list(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r  ab1'sé漢🙂.-\x1c"), max_size=40))
def test_bpe_white_space(place, theirs, text):
    assert ours(place, text) == theirs.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(place, theirs, text):
    assert ours(place, text) == theirs.encode_ordinary(text)


def test_bpe_long_pre_tokens(place, theirs):
    for text in ("ab" * 20_000, "the" * 9_999, "a" * 30_000, "=" * 5_000 + "x", "漢字" * 3_000):
        assert ours(place, text) == theirs.encode_ordinary(text)


def test_bpe_every_letter_class(place, theirs):
    letters = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for part in itertools.batched(letters, 400):
        text = " ".join(f"a{c}1{c} {c}b" for c in part)
        assert ours(place, text) == theirs.encode_ordinary(text)


def test_bpe_query(spark, theirs, odd_documents, no_documents, place):
    def expected(text):
        ids = theirs.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    rows = queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(texts[r["doc_id"]]) for r in rows)
    odd = bpe.encode_texts(odd_documents, **place).collect()
    assert sorted(len(r["ids"]) for r in odd) == sorted(len(theirs.encode_ordinary(r["text"] or "")) for r in odd_documents.collect())
    assert not bpe.encode_texts(no_documents, **place).count()


def brute_best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, a, b, first, per, at in packing.plan_packing(counts, 20):
        for r in range(a, b):
            used.setdefault(first + (r - a) // per, []).append((at + (r - a) % per * length, length))
    assert sorted(used) == list(range(len(used)))
    for places in used.values():
        edge = 0
        for at, length in sorted(places):
            assert at == edge
            edge += length
        assert edge <= 20
    assert sorted(20 - sum(n for _, n in p) for p in used.values()) == brute_best_fit(lengths, 20)


def check_pieces(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted([tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs], key=lambda x: (len(x), x))
    assert sum(r["length"] for r in rows) == sum(map(len, expected))
    for (doc, text), k in {(d, t): docs.count((d, t)) for d, t in docs}.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = [r for r in rows if r["doc_id"] == doc]
        assert sum(r["length"] for r in own) == k * len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for places in windows.values():
        edge = 0
        for at, n in sorted(places):
            assert at == edge
            edge += n
        assert edge <= 2048


def test_packing_query(spark, documents, odd_documents, no_documents):
    check_pieces(queries.op1_packing(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
    check_pieces(queries.pack_documents(odd_documents).collect(), [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert not queries.pack_documents(no_documents).count()


def test_packing_added_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftex", "plain", " " * 1_500_000 + "<|endoftext|> z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(queries.pack_documents(docs).collect(), list(enumerate(texts)))
    assert 50256 in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(texts[0], add_special_tokens=False).ids


def test_packing_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    rows = [(1, 0, 700, "x")] * 60 + [(2, 0, 1500, "y")] * 9
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, __l string").selectExpr("*", "__l AS __sub", "length AS __r", "start AS __n", "__l AS __from")
    packed = packing.pack_pieces(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    found = packed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 69 and all(r["__sub"] == ("x" if r["doc_id"] == 1 else "y") for r in found)


def test_packing_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.when(F.col("id") < 400, 100).otherwise(F.col("id") * 3).alias("length"))
    rows = packing.pack_pieces(pieces).collect()
    spots = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(spots) == 500
    assert len({r["sequence_id"] for r in rows}) == len(brute_best_fit([r["length"] for r in rows], 2048))


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**64, 1000, dtype=np.uint64)])
    sa, sb = fingerprint.sketch(a), fingerprint.sketch(b)
    assert (sa == np.unique(a)[: fingerprint.K]).all()
    assert abs(fingerprint.resemblance(sa, sb) - 0.6) < 0.15
    assert abs(fingerprint.containment(sa, sb) - 0.75) < 0.2
    assert abs(fingerprint.distinct_count(sa) / 4000 - 1) < 0.3
    parts = fingerprint.merge(fingerprint.sketch(a[:1000]), fingerprint.sketch(a[1000:]))
    assert (parts == sa).all() and (fingerprint.from_text(fingerprint.to_text(sa)) == sa).all()
    repeated = np.repeat(a[:200], 50)
    assert (fingerprint.sketch(repeated) == np.unique(a[:200])[: fingerprint.K]).all()


def test_merged_fingerprints(spark, odd_documents, no_documents):
    """The fingerprint of a group is that of all its shingles, however the rows lie."""
    whole = {}
    for r in odd_documents.collect():
        (own,) = fingerprint.sketches(pa.array([r["text"]], pa.string()), 10_000)
        whole[r["lang"]] = np.union1d(whole.get(r["lang"], own), own)
    parts = fingerprint.fingerprint_texts(odd_documents.repartition(5), keep=("lang",))
    for held in (1, 20_000):
        found = {r["lang"]: r for r in fingerprint.merge_fingerprints(parts, by="lang", held=held).collect()}
        assert set(found) == set(whole)
        for lang, r in found.items():
            assert (fingerprint.from_text(r["fingerprint"]) == whole[lang][: fingerprint.K]).all() and r["n_shingles"] == len(whole[lang])
    assert not fingerprint.merge_fingerprints(fingerprint.fingerprint_texts(no_documents, keep=("lang",)), by="lang").count()


def check_fingerprints(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    expected = []
    for k, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(text) // 2
        expected.append((doc is not None, doc or 0, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    by_text = {}
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t or "")
    for r in rows:
        if len(set(texts[r["doc_id"]])) == 1:
            by_text.setdefault(texts[r["doc_id"]][0], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_query(spark, documents, odd_documents, no_documents):
    check_fingerprints(queries.op4_fingerprints(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    for lanes in (1, 3, 50):
        check_fingerprints(fingerprint.compare_with_edits(odd_documents, lanes=lanes).collect(), odd)
    assert not fingerprint.compare_with_edits(no_documents).count()
    one = fingerprint.compare_with_edits(odd_documents.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def check_shards(rows, n):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], n)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())


def test_sharding_query(spark, documents, odd_documents, no_documents):
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, 16)
    assert 0.03 < sum(r["grown_shard"] == 16 for r in rows) / len(rows) < 0.1
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    for r in queries.op9_sharding(spark, "/root/testdata/sf0.001").collect():
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    odd = sharding.shard_documents(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    check_shards(odd, 16)
    assert not sharding.shard_documents(no_documents).count()


def python_xxhash64(parts):
    """Spark's xxhash64 of several values: each one's hash is the next one's seed."""
    seed = 42
    for raw in parts:
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def test_shards_by_brute_force(spark, documents):
    """Every shard's score anew for every document, from the 4 low bytes of the shard's number."""
    found = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_documents(documents).collect()}
    for doc, (shard, grown) in found.items():
        score = lambda n: -math.log(((python_xxhash64([str(doc).encode(), n.to_bytes(4, "little")]) >> 11) + 0.5) / 2**53)  # noqa: B023, E731
        assert shard == min(range(16), key=score) and grown == min(range(17), key=score)


def test_slots_of_clashing_names(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "'x' AS __sub", "1 AS __rank", "2 AS __base", "CAST(id % 3 AS INT) AS shard", "'y' AS __s")
    out = sharding.number_slots(df, "shard", ["doc_id"], sub_buckets=5)
    assert out.columns == [*df.columns, "slot"]
    rows = out.collect()
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(100)) for k in range(3)) and {r["__sub"] for r in rows} == {"x"}


def brute_sketch(text, k=128):
    """The k smallest hashes of the distinct 5-word shingles, each hashed on its own."""
    from pathflow.llm import shingles

    words = [w for w in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not words:
        return set()
    pieces = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    out = set()
    for p in pieces:
        h, b = shingles.text_sets(pa.array([p]), 5)
        assert len(h) == 1
        out.add(int(h[0]))
    return set(sorted(out)[:k])


def test_fingerprints_by_brute_force(documents):
    """Fingerprints, edited fingerprints and both likenesses, text by text."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    rows = {r["doc_id"]: r for r in fingerprint.compare_with_edits(documents).collect()}
    whole = {d: brute_sketch(t) for d, t in docs}
    like = lambda a, b: len(a & b & set(sorted(a | b)[:128])) / len(set(sorted(a | b)[:128])) if a | b else 1.0
    for k, (doc, text) in enumerate(docs[:60]):
        after = docs[(k + 1) % len(docs)]
        n = len(text) // 2
        edited = brute_sketch(text[: len(text) - n] + after[1][:n])
        r = rows[doc]
        assert set(fingerprint.from_text(r["fingerprint"]).tolist()) == whole[doc]
        assert set(fingerprint.from_text(r["edited_fingerprint"]).tolist()) == edited
        assert r["near_edited"] == pytest.approx(like(whole[doc], edited)) and r["near_next"] == pytest.approx(like(whole[doc], whole[after[0]]))


def test_shards_by_weight(spark):
    counts = sharding.assign_shards(spark.range(40_000), "id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    found = {r["shard"]: r["count"] for r in counts}
    assert set(found) == {0, 1} and abs(found[1] / 40_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_equal_rows_spread_over_sub_buckets(spark):
    df = spark.createDataFrame([(1, 0)] * 4_000, "doc_id long, shard int").repartition(4)
    out = sharding.number_slots(df, "shard", ["doc_id"], sub_buckets=8)
    assert sorted(r["slot"] for r in out.collect()) == list(range(4_000))
    spread = df.withColumn("tie", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(8))).count().toPandas()["count"]
    assert len(spread) == 8 and spread.max() < 2 * 4_000 / 8


def test_added_tokens_as_ordinary_text(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for added in (True, False):
        rows = packing.cut_documents(df, path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, added=added).collect()
        found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}
        assert (50256 in found[0]) == added and found[2] == [*own.encode("plain", add_special_tokens=False).ids, 1]
        if not added:
            assert all(found[k] == [*own.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts))
