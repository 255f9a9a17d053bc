"""Fill-in-middle against a plain loop over tokens, on odd rows, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import brute
import pytest
from hypothesis import given, settings, strategies as st

from tapeworks.llm import infill


def plain(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, len(units))))
    if not units or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(7)
    texts = ["", None, "a", "1", "<P>", "x <S> y", "a<M>b", "<", ">", "<P", "P>", "<<>>", "a<P b<S c<M d", "é́ß 中文 🙂 x", "\n\t\r", "word" * 4000]
    rows = [(i, t) for i, t in enumerate(texts * 12)] + [(i, "".join(rng.choice("<>PSMab 1é🙂") for _ in range(rng.randrange(40)))) for i in range(1000, 1400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rows(spark, edges):
    odd = brute.odd_documents(spark)
    for frame in (edges, odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        filled = infill.fill_in_middle(frame).withColumn("back", infill.restored())
        rows = filled.collect()
        got = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in rows]
        want = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        assert sorted(got, key=key) == sorted((plain(*r) for r in want), key=key)
        assert sorted((r["doc_id"] is not None, r["doc_id"], r["back"]) for r in rows) == sorted((d is not None, d, t or "") for d, t in want)
    assert {r["form"] for r in infill.fill_in_middle(edges).collect()} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<P> é1", max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_pieces_change_nothing(text, first, second, size):
    assert infill.token_cuts(text, (first, second), size) == infill.token_cuts(text, (first, second))


def test_long_text():
    text = "word, " * 600_000 + "x" * 3_000_000 + "!"
    n, low, high = infill.token_cuts(text, (10**6, 1_800_001))
    assert (n, text[:low].count(","), high) == (1_800_002, 333_333, len(text) - 1)
