"""Periodic runs against a scan of every lag, on small alphabets, planted runs, odd rows and whole documents."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tapeworks.llm import periods, queries


def all_runs(words) -> list[tuple]:
    """Every lag on its own: maximal stretches that agree with themselves q words on, smallest period only."""
    found, n = {}, len(words)
    if n > 1000:
        _, ids = np.unique(np.array(words), return_inverse=True)
        for q in range(1, n // 4 + 1):
            differs = np.flatnonzero(np.concatenate(([True], ids[q:] != ids[:-q], [True]))) - 1
            for i in np.flatnonzero(np.diff(differs) - 1 + q >= max(6, 4 * q)):
                found.setdefault((int(differs[i]) + 1, int(differs[i + 1] - differs[i] - 1) + q), q)
        return sorted((start, length, q) for (start, length), q in found.items())
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def plain(doc_id, text, plant=True):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(doc_id, text):
    runs, kept = plain(doc_id, text)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept))


def key(row):
    return tuple((v is not None, v) for v in row)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 40), st.integers(0, 200))
def test_small_alphabets(seed, period, more):
    words = seed + [seed[-(i % min(period, len(seed))) - 1] for i in range(more)] if seed else []
    ids = np.array([*words, -1], dtype=np.int32)
    assert [tuple(r) for r in periods.runs_in(ids, len(words)).tolist()] == all_runs(words)


@pytest.mark.parametrize("seed", range(6))
def test_nested_and_long_periods(seed):
    """Roots of many lengths, some built of repeats themselves, behind and inside each other."""
    rng = random.Random(seed)
    words: list[int] = []
    for _ in range(12):
        root = [rng.randrange(2 + seed) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 31, 32, 33, 64, 65, 100]))]
        if rng.random() < 0.4:
            root = root * rng.randint(2, 5) + [rng.randrange(9)]
        words += (root * 9)[: len(root) * rng.randint(3, 6) + rng.randrange(len(root))] + [rng.randrange(50) for _ in range(rng.randrange(30))]
    ids = np.array([*words, -1], dtype=np.int32)
    assert [tuple(r) for r in periods.runs_in(ids, len(words)).tolist()] == all_runs(words)


def test_words_that_defeat_polynomial_hashes():
    word = [0]
    for _ in range(9):
        word += [1 - x for x in word]
    for words in (word, word * 5, (word[:300] + [2]) * 4):
        assert [tuple(r) for r in periods.runs_in(np.array([*words, -1], dtype=np.int32), len(words)).tolist()] == all_runs(words)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(300)]
    return spark.createDataFrame(rows + [(None, "a " * 50), (None, None), (7, ""), (7, " \t\n\x0b\x0c\r "), (8, "é " * 9 + "É é")], "doc_id long, text string")


def test_query(spark, many, tmp_path):
    for i, frame in enumerate((many, brute.odd_documents(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        frame.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = [tuple(r) for r in queries.op11_periodic_runs(spark, f"{tmp_path}/{i}").select(
            "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
        want = [digest(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert any(r[1] for r in got)


def test_unplanted_texts_and_empty_table(spark, many):
    got = sorted((r["n_words"], bytes(r["kept"]).decode()) for r in periods.periodic_runs(many).collect())
    texts = [r["text"] for r in many.select("text").collect()]
    assert got == sorted((len((t or "").split()), plain(None, t, False)[1]) for t in texts)
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_of_one_word():
    batch = periods._judge([(1, b"x " * 2_000_000), (2, b"y")], False)
    assert batch.column(2).to_pylist() == [[{"start": 0, "length": 2_000_000, "period": 1}], []]
    assert batch.column(3).to_pylist() == [b"x", b"y"]
