"""Passages of words against a dictionary of all windows; the index against plain search; splitting of crowded anchors."""

from __future__ import annotations

import hashlib
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import passages, queries, suffixes
from tapeworks.llm.fmindex import FMIndex


def plain(rows, length=50):
    low = lambda d: -math.inf if d is None else d
    first: dict[tuple, float] = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            first[window] = min(first.get(window, math.inf), low(doc))
    result = []
    for doc, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < low(doc):
                gone[i : i + length] = [True] * length
        result.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return result


def key(row):
    return tuple((v is not None, v) for v in row)


def check(frame):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in passages.drop_passages(frame).collect()]
    want = plain([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    return sum(r[2] for r in want)


def borrowed(spark, seed, docs=60):
    """Documents that share stretches of 30 to 120 words with others, at all offsets, some with a word changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["a", "b"] * 100
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(8)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
            part = list(rng.choice(pool))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "x"
            a = rng.randrange(len(part))
            words += part[a if rng.random() < 0.3 else 0 :]
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100, "x " * 400), (101, "x " * 90), (102, "y " + "x " * 60), (99, "a b " * 100), (98, "b a " * 49 + "b")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("seed", range(2))
def test_borrowed(spark, seed):
    assert check(borrowed(spark, seed)) > 100


def test_crowded_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", 1)
    monkeypatch.setattr(passages, "SHARD", 3)
    assert check(borrowed(spark, 5)) > 100


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(passages, "_SLICE", 64)
    monkeypatch.setattr(passages, "word_runs", lambda data: iter([data.split()[i : i + 37] for i in range(0, max(1, len(data.split())), 37)]))
    rows = [tuple(r) for r in borrowed(spark, 3).collect()]
    for doc, text in rows:
        parts = list(passages.slices((text or "").encode()))
        starts = [offset + i for _, offset, first, last, _ in parts for i in range(first, last + 1)]
        assert starts == list(range(max(0, len((text or "").split()) - 49)))
    hashes = passages._Hashes()
    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t in rows], pa.binary())], names=["t"])
    cut = {(r, int(a), int(h)) for r, _, o, _, at, _, _, around in passages._anchored(batch, 0, hashes) for a, h in zip(at + o, around)}
    monkeypatch.undo()
    whole = {(r, int(a), int(h)) for r, _, o, _, at, _, _, around in passages._anchored(batch, 0, hashes) for a, h in zip(at + o, around)}
    assert cut == whole


def test_query(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    assert check(spark.read.parquet(f"{folder}/documents.parquet")) > 0
    got = queries.op12_fm_passages(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == 200


def test_odd_rows_and_empty_table(spark):
    check(brute.odd_documents(spark))
    assert passages.drop_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark.createDataFrame([(1, None), (None, "a " * 70), (None, "a " * 70), (2, "a " * 60), (2, "A " * 60)], "doc_id long, text string"))


@pytest.mark.parametrize("depth", [2, 3, 7, 50])
def test_index(depth):
    rng = random.Random(depth)
    for kinds in (1, 2, 30):
        some = lambda: np.array([rng.randint(1, kinds) for _ in range(rng.randrange(90))], dtype=np.int64)  # noqa: B023, E731
        texts = [some() for _ in range(5)] + [np.ones(60, dtype=np.int64)]
        patterns = [some() for _ in range(4)] + texts + [np.concatenate([texts[0], [99], texts[-1]])]
        values = np.array([rng.randrange(50) for _ in texts])
        own: dict[tuple, int] = {}
        for t, v in zip(texts, values.tolist()):
            for i in range(len(t) - depth + 1):
                own[tuple(t[i : i + depth])] = min(own.get(tuple(t[i : i + depth]), 99), v)
        want = [(p, i, own[tuple(x[i : i + depth])]) for p, x in enumerate(patterns) for i in range(len(x) - depth + 1) if tuple(x[i : i + depth]) in own]
        index = FMIndex(texts, depth)
        pattern, start, low, high = index.windows(patterns)
        assert sorted(zip(pattern.tolist(), start.tolist(), index.least(low, high, values).tolist())) == sorted(want)


def test_halves_cover_each_window_once():
    rng = random.Random(0)
    for _ in range(300):
        core, lead, after = rng.randint(1, 49), rng.randint(0, 49), rng.randint(0, 49)
        words = [b"%d" % i for i in range(min(lead, 50 - core) + core + min(after, 50 - core))]
        lead = min(lead, 50 - core)
        want = [s for s in range(lead + 1) if s + 50 <= len(words) and s + 50 >= lead + core]
        got = [first + s for first, stop, *_ in passages.halves(words, lead, core) for s in range(stop - first - 49)]
        assert sorted(got) == want
        for first, stop, new_lead, begin, end in passages.halves(words, lead, core):
            assert end - begin > core and begin - first == new_lead
            assert all(first + s <= begin and first + s + 50 >= end for s in range(stop - first - 49))


def test_crowded_bytes_are_split(spark, monkeypatch):
    """The same splitting under the suffix arrays of bytes."""
    monkeypatch.setattr(suffixes, "CROWD", 1)
    monkeypatch.setattr(passages, "CROWD", 1)
    monkeypatch.setattr(passages, "SHARD", 3)
    rng = random.Random(2)
    line = "".join(rng.choice("abcd ") for _ in range(70))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(30))) + line[rng.randrange(12) :] + "".join(rng.choice("xyz") for _ in range(25))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.drop_repeats(frame).collect()]
    want = brute.repeats_cut(rows)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 500
