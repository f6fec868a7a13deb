"""Fill-in-the-middle forms against brute force over code points."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathflow.llm import infill, queries

SMALL = "/root/testdata/sf0.001"


def by_hand(doc_id, text):
    """Units, form, code points of prefix and middle, and the output."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé漢🙂 \n<>PSM.1"), max_size=60), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.integers(1, 5), st.integers(1, 9))
def test_places_of_any_density(text, draws, every, block):
    index = infill.UnitIndex(np.frombuffer(text.encode(), np.uint8), every, block)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert (index.n_units, index.n_chars) == (len(units), len(text))
    assert index.units == list(range(0, len(units), every))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.place(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("text", ["x" * 600_000, "ab 漢" * 90_000, "é" * 300_000 + "word" * 5, "<" * 5_000 + "P" * 9])
def test_long_texts(text):
    index = infill.UnitIndex(np.frombuffer(text.encode(), np.uint8), 1024, 1 << 18)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for k in {0, 1, len(units) // 3, len(units) - 1, len(units)}:
        head = "".join(units[:k])
        assert index.place(k) == (len(head.encode()), len(head))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_fill_in_middle(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *head, output = by_hand(r["doc_id"], texts[r["doc_id"]] or "")
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"]] == head
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    theirs = sorted(con.execute(queries.ORACLE_SQL["op11_fill_in_middle"]).fetchall())
    assert sorted(tuple(r) for r in queries.op11_fill_in_middle(spark, SMALL).collect()) == theirs


def test_odd_rows(spark, odd_documents, no_documents):
    rows = infill.fill_in_middle(odd_documents, keep=("doc_id", "__text")).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        *head, output = by_hand(r["doc_id"], r["__text"] or "")
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]] == [*head, output, r["__text"] or ""]
    assert not infill.fill_in_middle(no_documents).count()
    with pytest.raises(ValueError):
        infill.fill_in_middle(odd_documents.withColumn("n", F.lit(1)), keep=("doc_id", "N"))


def test_sentinels_and_their_parts(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "<P", "<<P", "P> <S M>", "<", "end <S", "<M<S<P"] * 12
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = infill.fill_in_middle(df, keep=("doc_id", "text")).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in out)
    assert all(r["form"] == "plain" for r in out if any(x in r["text"] for x in ("<P>", "<S>", "<M>")))
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_settings(spark, documents):
    own = infill.Settings(prefix="[pre]", suffix="[suf]", middle="[mid]", plain_percent=0, suffix_first_percent=100, seed=9, every=3, block=64)
    out = infill.fill_in_middle(documents, keep=("doc_id", "text"), settings=own).withColumn("back", infill.restored(F.col("output"), F.col("form"), own)).collect()
    assert all(r["back"] == (r["text"] or "") for r in out) and {r["form"] for r in out} <= {"spm", "plain"}
