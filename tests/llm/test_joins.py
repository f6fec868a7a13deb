"""The Jaccard join, components, URL rules and exact search against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathflow.llm import jaccard, queries, topk, url_filter
from pathflow.llm.components import connected_components


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert found == components_of({n for link in real for n in link}, real)


def test_no_links(spark):
    assert not connected_components(spark.createDataFrame([], "a long, b long")).count()


def shingle_set(text, words):
    lower = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    found = [w for w in lower.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not found:
        return set()
    return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or {tuple(found)}


def brute_components(docs, words, percent):
    sets = [(d, shingle_set(t, words)) for d, t in docs]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    found = components_of({d for d, _ in docs if d is not None}, links)
    return sorted(((d is not None, d or 0), len(x), found.get(d)) for d, x in sets)


def as_rows(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in df.collect())


def edited_texts(rng, n):
    """Families of texts, with a common passage and edits around the threshold."""
    vocabulary = [f"w{k}" for k in range(400)]
    common = rng.choices(vocabulary, k=25)
    texts = []
    while len(texts) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 6, 9, 12, 20, 40, 80, 150]))
        if rng.random() < 0.4:
            base = base + common
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("blocks", [(2000, 400_000), (8, 10_000)])
def test_jaccard_components(spark, monkeypatch, words, percent, blocks):
    # small blocks make families that need several of them
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", blocks[1])
    docs = edited_texts(random.Random(words), 350)
    rng = random.Random(9)
    near = rng.choices([f"n{k}" for k in range(90)], k=120)
    docs += [(1000 + k, " ".join([*near[:k % 118], "x", *near[k % 118 + 1 :]])) for k in range(60)]
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=words, percent=percent)
    assert as_rows(found) == brute_components(docs, words, percent)


def test_a_loose_family_grows_with_its_texts(spark, monkeypatch):
    # texts that are mostly one passage form a family of many blocks, in which few link
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 6)
    seen, search = [], jaccard.search_blocks
    monkeypatch.setattr(jaccard, "search_blocks", lambda rows, *a: search(seen.append(rows.count()) or rows, *a))
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    docs = [(k, [*passage, *(f"{rng.random()}" for _ in range(16)), *(["one", "two", "three", "four"] if k < 40 else [])]) for k in range(160)]
    docs += [(500 + k, [*docs[k][1][:-1], "changed"]) for k in range(0, 160, 10)]
    docs = [(k, " ".join(text)) for k, text in docs]
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), words=3, percent=80)
    assert as_rows(found) == brute_components(docs, 3, 80)
    assert len(seen) == 2 and seen[1] < 2_500  # 176 texts; every part against every part: 20,768 rows


def test_rarest_shingles_keep_links():
    rng = np.random.default_rng(2)
    kept = 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        base = np.unique(rng.integers(0, 300, 2 * n + 4).astype(np.uint64))
        a, b = (np.delete(base, rng.integers(0, len(base), int(rng.integers(0, len(base) // 8 + 2)))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            times = jaccard.Frequent(np.arange(0, 300, 3, dtype=np.uint64), rng.integers(2, 90, 100))
            keys, text = jaccard.rarest(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 80, times)
            assert set(keys[text == 0]) & set(keys[text == 1])
            kept += 1
    assert kept > 300


def test_jaccard_query(spark, documents, odd_documents, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert as_rows(queries.op2_jaccard_join(spark, "/root/testdata/sf0.001")) == brute_components(docs, 3, 90)
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert as_rows(jaccard.jaccard_components(odd_documents)) == brute_components(odd, 3, 90)
    assert not jaccard.jaccard_components(no_documents).count()


def test_group_plans_keep_links():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(1500):
            n = int(rng.integers(1, 400))
            base = rng.integers(0, 2**64, 2 * n + 2, dtype=np.uint64)
            a, b = base[:n], base[int(rng.integers(0, n // 8 + 2)) : n + int(rng.integers(0, n // 8 + 2))]
            both = len(np.intersect1d(a, b))
            if not both or 100 * both < percent * (len(a) + len(b) - both):
                continue
            keys, text = jaccard.group_keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), percent)
            assert set(keys[text == 0]) & set(keys[text == 1])
    with pytest.raises(ValueError):
        jaccard.group_plan(2, 3, 40)


def fits(host, path, rule_host, rule_path):
    return (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)


def test_url_rules(spark):
    rules = [*url_filter.RULES, ("block", "a.b.org", "/"), ("allow", "b.org", "/fr/x"), ("block", "b.org", "/fr/x"), (None, "org", "/"), ("block", None, "/")]
    hosts = ["net", "example.net", "en.example.net", "EXAMPLE.com", "xexample.com", "org", "a.b.org", "x.a.b.org", "ab.org", "", "net.org", "a..net", "net/"]
    paths = ["", "/", "/en/", "/en/x", "/de/", "/fr/x?y", "/fr", "?/fr/", "#/de/", "/fr/x#z"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "net/", "http:/net/", "://net/", "a://b://net/", "http://net:80/", "http://net\n/"]
    pages = spark.createDataFrame([(k, u, "x", u) for k, u in enumerate(urls * 2)], "page_id long, url string, stack string, host string")
    rows = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        url = urls[r["page_id"] % len(urls)]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        tail = rest[len(host) :]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        good = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if v and h is not None and fits(host, path, h, p)]
        best = max(good, default=(0, 0, "allow", None))
        assert (r["rule"], r["verdict"]) == (best[3], best[2]), url
    assert not url_filter.judge_urls(pages.where("false"), url_filter.rule_table(spark, rules)).count()
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}


def test_many_url_rules(spark, monkeypatch):
    """Nested hosts and paths, over several ranges of keys and lanes, against every rule tried on every URL."""
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 10)
    rng = random.Random(3)
    host = lambda: ".".join(rng.choices("abc", k=rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choices(["x", "y", "xy", "é"], k=rng.randrange(0, 4)))
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), path()) for _ in range(150))}.values()) + [("block", "a", ""), ("allow", "b.a", "x")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=1', '#f'])}" for _ in range(400)] + ["http://a.b.c/x/y"] * 300 + ["nothing", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    rows = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), lanes=6).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(len(urls)))
    for r in rows:
        good = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if fits(r["host"], r["path"], h, p)]
        best = max(good, default=(0, 0, "allow", None))
        assert (r["rule"], r["verdict"]) == (best[3], best[2]), urls[r["page_id"]]


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, theirs))


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted(((-int(np.dot(v, w)), c) for c, w in rows if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def test_proof_and_huge_components():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 9, (4000, 16)).astype(np.int64)
    x[::7] = 0
    ids = rng.permutation(len(x)).astype(np.int64)
    thin = np.where(rng.random(x.shape) < 0.1, x, 0)  # lists of rows by step of size
    for vectors, n_segments in ((x, 16), (thin, 200)):
        index = topk.ImpactIndex(ids, vectors)
        assert (n_segments == 16) == (len(index.segments) == 16) and len(index.segments) >= min(n_segments, 100)
        for q in (1, 5, 9, 7):
            scores = vectors @ vectors[q]
            best = np.lexsort((ids, -scores))
            kept = index.members(vectors[q], 20)
            tied = (scores >= scores[best[20]]).sum()
            assert (scores[kept] >= scores[best[20]]).sum() == tied and (len(kept) < 1500 or tied > 1000)
            best = best[best != q][:20]
            found = index.search(vectors[q], int(ids[q]), 20)
            assert list(found[0]) == list(ids[best]) and list(found[1]) == list(scores[best])
    big = np.array([[2**62, 1], [2**62, 2], [-(2**62), 3], [0, 4]])
    found = topk.ImpactIndex(np.arange(4), big).search(np.array([2, 1]), 9, 4)
    assert list(found[0]) == [0, 1, 3, 2] and list(found[1]) == [2**63 - 1, 2**63 - 1, 4, -(2**63) + 3]


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 12)).astype(np.float32)
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    if kind == "ties":
        x = np.round(x)
        x[50:250] = x[50]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(1000, None), (1020, [None] * 12), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([(a, b, "x", True) for a, b in rows + odd], "vec_id long, embedding array<float>, id string, asks boolean").repartition(4)
    exact = [(k, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for k, v in rows]
    found = sorted(tuple(r) for r in topk.top_k(df, query_block=7, block=90).collect())
    assert found == brute_top(exact, 20)
    # repeated rows are candidates each, and as queries count once
    twice = sorted(tuple(r) for r in topk.top_k(df.where("vec_id < 30").unionByName(df.where("vec_id < 30")), block=13).collect())
    both = [(q, v) for q, v in exact[:30] for _ in range(2)]
    assert twice == [(q, n + 1, c, -s) for q, v in exact[:30] if q % 20 == 0 for n, (s, c) in enumerate(sorted(((-int(np.dot(v, w)), c) for c, w in both if c != q))[:20])]
    few = sorted(tuple(r) for r in topk.top_k(df.where("vec_id < 15")).collect())
    assert few == brute_top(exact[:15], 20)
    assert not topk.top_k(df.where("false")).count()
    assert topk.top_k(df.where("vec_id = 20")).select(F.count("*")).head()[0] == 0
