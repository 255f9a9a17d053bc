"""Long runs of one unit in decontamination, and words of every frequency in class models."""

import random
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import brown, qgram


@pytest.mark.parametrize("unit", [b"-", b"=-", b"abcdefgh"])
def test_shortened_keeps_every_passage(unit):
    rng = random.Random(len(unit))
    words = bytes(rng.choice(b"abcdefghij ") for _ in range(3000))
    text = words[:900] + unit * 2000 + words[900:2000] + unit * 90 + words[2000:] + unit * 700
    short, stood = qgram.shortened(text)
    passages = lambda t: {t[i : i + 143] for i in range(len(t) - 142)}
    assert len(text) - len(short) >= 2000 * len(unit) - 2 * 256 - 8 and passages(short) == passages(text)
    assert bytes(text[i] for i in stood) == short and (np.diff(stood) > 0).all()
    assert qgram.shortened(words) == (words, None)


def test_item_and_text_of_one_byte():
    """A megabyte of one byte on both sides takes neither the time nor the memory of its pairs."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = qgram.GramIndex([(1, b"-" * 10**6), (2, b"some words of another item " * 3)])
    got = list(index.find([b"x" * 300 + b"-" * 10**6 + b"y" * 300, b"no such thing at all"]))
    assert {(k, index.items[p], e) for k, p, e, _ in got} == {(0, 1, 0)}
    assert all(end <= 300 + 10**6 + 10 for *_, end in got)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_small_stretches_find_the_same(monkeypatch):
    rng = random.Random(8)
    items = [(i, bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(400))) for i in range(4)]
    rule = b"|" + b"-" * 60
    texts = [items[i][1][50 + i : 260] + rule * 20 + bytes(rng.choice(b"abcd ") for _ in range(500)) for i in range(4)]
    index = qgram.GramIndex([*items, (9, rule * 3)])
    whole = set(index.find(texts))
    monkeypatch.setattr(qgram, "_PAIRS", 50)
    assert {(k, index.items[p]) for k, p, *_ in whole} >= {(k, k) for k in range(4)}
    assert {r[:2] for r in index.find(texts)} == {r[:2] for r in whole}


def test_position_after_a_shortened_run():
    item = b"the quick brown fox jumps over the lazy dog and then walks home to sleep for a very long time indeed, sir"
    text = b"~" * 5000 + item + b" the end"
    index = qgram.GramIndex([(1, item)])
    assert max(end for *_, end in index.find([text])) == 5000 + len(item)


def _model_rows():
    rng = random.Random(5)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = []
    for doc in range(400):
        at, out = rng.randrange(3), []
        for _ in range(60):
            out.append(kinds[at][min(39, int(rng.expovariate(0.15)))])
            at = (at + 1) % 3
        rows.append((doc, " ".join(out)))
    return rows


def test_words_beyond_the_seeds_are_classed_by_neighbours(spark, monkeypatch):
    """With few seeds, and with words outside the head, the score stays that of a class model over all words, checked by a plain one."""
    monkeypatch.setattr(brown, "SEEDS", 12)
    frame = spark.createDataFrame(_model_rows(), "doc_id long, text string")
    wide = {r["doc_id"]: r for r in brown.brown_scores(frame).collect()}
    monkeypatch.setattr(brown, "HEAD", 40)
    narrow = {r["doc_id"]: r for r in brown.brown_scores(frame).collect()}
    assert wide.keys() == narrow.keys() and len(wide) == 400
    for doc, row in wide.items():
        other = narrow[doc]
        assert (row["n_tokens"], row["n_known"]) == (other["n_tokens"], other["n_known"]) == (61, other["n_known"])
        assert abs(row["base_score"] - other["base_score"]) < 1e-6
    for got in (wide, narrow):
        held = [r for r in got.values() if r["held_out"]]
        # Three kinds in turn: knowing the kind is worth log10(3) a token against the base.
        assert sum(r["score"] - r["base_score"] for r in held) > 0.3 * sum(r["n_tokens"] for r in held)


@pytest.mark.parametrize("together", [1 << 21, 150])
def test_neighbours_travel_once_a_word(spark, monkeypatch, together):
    """Neighbours go to the next stage as one row for each word and stretch of a task, in one shuffle, and the classes are those of plain counts."""
    monkeypatch.setattr(brown, "_TOGETHER", together)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(together)
    head = [f"w{i}".encode() for i in range(1, 13)]
    texts = [[rng.choice(head) if rng.random() < 0.6 else b"x" * 70 + b"%d" % int(rng.expovariate(0.2)) for _ in range(rng.randrange(40))] for _ in range(120)]
    texts += [[head[3], head[4]] * 700, [b"y" * 90] * 600, []]
    of = np.array([0, *(1 + i % 5 for i in range(12)), brown._OPEN], dtype=np.uint8)
    keyed = spark.createDataFrame([(w,) for w in sorted({w for t in texts for w in t})], "word binary").withColumn("key", F.xxhash64("word")).collect()
    key = {bytes(r["word"]): r["key"] for r in keyed}
    place, rows = {w: i + 1 for i, w in enumerate(head)}, []
    plain, pairs = defaultdict(Counter), np.zeros((brown._KINDS, brown._KINDS))
    for text in texts:
        rest = list(dict.fromkeys(w for w in text if w not in place))
        rows.append((np.array([place.get(w) or 13 + rest.index(w) for w in text], np.int32).tobytes(), rest))
        classes = [0, *(int(of[place.get(w, 13)]) for w in text), 0]
        np.add.at(pairs, (classes[:-1], classes[1:]), 1)
        for w, left, right in zip(text, classes, classes[2:]):
            plain[key[w]].update([left, brown._KINDS + right])
    training = spark.createDataFrame(rows, "numbers binary, rest array<binary>").repartition(3)
    keys = spark.sparkContext.broadcast(np.array([0, *(key[w] for w in head)]))
    try:
        found = training.select("numbers", F.transform("rest", lambda w: F.xxhash64(w)).alias("keys")).mapInArrow(brown._neighbours(keys, of), "key long, cells binary").collect()
        best = brown._best_classes(training, keys, of)
        got = {r["key"]: r["of"] for r in best.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the plan and its start, one each
    if together > 10**6:
        assert max(Counter(r["key"] for r in found).values()) <= 3  # a row for each of three tasks, whatever a word's neighbours
    met = defaultdict(Counter)
    for r in found:
        for cell, n in zip(r["cells"][::2], r["cells"][1::2]):
            met[r["key"]][cell] += n
    assert met == plain
    weights = brown.fit(pairs)
    often = {k: c for k, c in plain.items() if sum(c.values()) >= 2 * brown.LEAST}
    assert got.keys() == often.keys() and 0 < len(got) < len(plain)
    for k, c in often.items():
        gain = sum(n * weights[cell] for cell, n in c.items())
        assert gain[got[k] - 1] >= gain.max() - 1e-9
