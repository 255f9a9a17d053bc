"""Each operator against its plain version, on odd rows, on generated documents and on empty tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from tapeworks.llm import brown, crf, curves, lines, pivotal, qgram, shards, simhash, suffixes, urls

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_documents(spark).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 6)) for v in row)


def check_shards(frame, n=24):
    got = shards.hilbert_shards(frame, n).collect()
    sizes = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sizes
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    last = -1
    for s in sorted(by):
        rows = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        curve = [r["curve"] for r in rows]
        assert curve == sorted(curve) and curve[0] >= last  # shards are runs of one curve
        last = curve[-1]
        assert abs(sum(r["size"] for r in rows) - total / n) <= most


def test_shards(odd, docs):
    check_shards(odd)
    check_shards(docs)


def test_shards_narrow_boxes(docs):
    boxes = shards.box_overlap(shards.hilbert_shards(docs, carry=("lang",)), ("lang",)).collect()
    assert sum(r["lang_min"] == r["lang_max"] for r in boxes) >= len(boxes) / 2


def test_shard_files(spark, docs, tmp_path):
    shards.write_shards(shards.hilbert_shards(docs, 4, carry=("text",)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_lines(odd, docs):
    for frame in (odd, docs):
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(frame).collect()]
        assert sorted(got, key=key) == sorted(brute.lines_left(pairs(frame)), key=key)
    assert sum(r[2] for r in brute.lines_left(pairs(odd))) > 3


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_scores(which, request):
    frame = request.getfixturevalue(which)
    got = brown.brown_scores(frame).collect()
    plain = [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got]
    for a, b in zip(sorted(plain, key=key), sorted(brute.base_scores(pairs(frame)), key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
    if which == "docs":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 60)
    pairs_ = rng.poisson(np.where((truth[:, None] + 1) % 3 == truth[None, :], 8.0, 0.2)).astype(float)
    square = np.zeros((62, 62))
    square[1:-1, 1:-1] = pairs_
    of = brown.exchange(square, classes=3)[1:-1]
    assert all(len(set(of[truth == k])) == 1 for k in range(3)) and len(set(of)) == 3


def test_class_model_sums_to_at_most_one():
    """Emissions of a class with one place for unseen words, times smoothed transitions, leave no extra mass."""
    counts, grid = np.array([5, 3, 1]), np.array([[2.0, 3], [4, 1]])
    emission = (counts + 1) / (counts.sum() + len(counts) + 1)
    assert abs(emission.sum() + 1 / (counts.sum() + len(counts) + 1) - 1) < 1e-12
    shares = np.array([0.5, 0.5])
    moves = (grid + brown.PRIOR * shares) / (grid.sum(1, keepdims=True) + brown.PRIOR)
    assert np.allclose(moves.sum(1), 1)


def test_mix(odd, docs):
    for frame in (odd, docs):
        rows = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in frame.collect()]
        sizes: Counter = Counter()
        for _, source, n in rows:
            sizes[source] += n
        want = brute.targets(sizes)
        got = pivotal.mix(frame).collect()
        by_id = defaultdict(list)
        for r in got:
            by_id[(r["doc_id"], r["size"])].append(r)
        taken, most = Counter(), Counter()
        for doc, source, n in rows:
            r = by_id[(doc, n)].pop() if (doc, n) not in ((5, 30),) else by_id[(doc, n)].pop()
            assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
            assert 0 <= r["taken"] <= 3 * n and r["taken"] == r["copies"] * n
            taken[source] += r["taken"]
            most[source] = max(most[source], n)
        for source in sizes:
            assert abs(taken[source] - want[source]) <= most[source] + 1e-6
        assert sorted(map(key, got)) == sorted(map(key, pivotal.mix(frame.repartition(3)).collect()))
    mixed = pivotal.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in pivotal.mix(odd).collect())


def test_mix_tree(docs, monkeypatch):
    monkeypatch.setattr(pivotal, "LEAF", 2)
    monkeypatch.setattr(pivotal, "FAN_IN", 2)
    got = pivotal.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[(r["source_size"], r["target"])].append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)


def test_pivotal_keeps_expectations():
    import pandas as pd

    sums, runs = np.zeros(7), 3000
    for run in range(runs):
        group = pd.DataFrame({"_name": "a", "node": 0, "_id": np.arange(7), "size": [5, 3, 8, 2, 9, 4, 6], "tie": np.arange(7) + 100 * run, "copies": 0, "open": True})
        group["mass"] = group["size"] * 0.4
        done = pivotal._round_node(group).sort_values("_id")
        assert done["open"].sum() <= 1
        assert abs(done["mass"].sum() - group["mass"].sum()) < 1e-9
        sums += done["mass"] / done["size"]
    assert np.allclose(sums / runs, 0.4, atol=0.05)


def test_urls(spark):
    rows = [
        ("http://A.example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://xorg/en/2", "xorg", "/en/2", None, None), ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://b.com/de/?q=://z.org/", "b.com", "/de/", "com/de/", "block"), ("http://c.org", "c.org", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c.org/x", "b:", "//c.org/x", None, None),
    ]
    frame = spark.createDataFrame([(i, r[0], "host") for i, r in enumerate(rows)] + [(None, "http://d.org/x", None)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(frame).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert got[None]["verdict"] == "allow"


def test_urls_learn(spark):
    labelled = spark.createDataFrame([(f"h{i}.net", f"/{'spam' if i % 2 else 'news'}/{i}", 1 - i % 2) for i in range(200)], "host string, path string, label int")
    pages = spark.createDataFrame([(i, f"http://q{i}.net/{'spam' if i % 2 else 'news'}/x") for i in range(40)], "page_id long, url string")
    got = urls.judge_urls(pages, labelled)
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_leaks(spark, docs, odd):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    fold = lambda t: " ".join((t or "").lower().split())
    items = [(r["item_id"], fold(r["text"])) for r in benchmark.collect()]
    want = {(d, i) for d, t in pairs(docs) for i, p in items if p in fold(t)}
    got = {(r["doc_id"], r["item_id"]) for r in qgram.leaks(docs, benchmark).collect()}
    assert want and got >= want
    held = defaultdict(str)
    for d, t in pairs(docs):
        held[d] += fold(t)
    for d, i in got - want:  # partial: some 100 bytes must be there
        p = dict(items)[i]
        assert any(p[k : k + 60] in held[d] for k in range(len(p)))
    assert qgram.without_leaks(docs, benchmark).count() == docs.count() - len({d for d, _ in got})
    assert qgram.without_leaks(odd, benchmark).columns == odd.columns
    none = benchmark.limit(0)
    assert qgram.leaks(docs, none).count() == 0 and qgram.without_leaks(odd, none).count() == odd.count()


def test_leaks_with_edits(spark):
    import random

    rng = random.Random(5)
    item = brute.sentence(rng, 20)
    spoiled = list(item)
    for i in range(0, len(spoiled), 13):
        spoiled[i] = "#"
    far = [c if i % 4 else "#" for i, c in enumerate(item)]
    rows = [(1, "Before. " + "".join(spoiled) + " after."), (2, "".join(far)), (3, None), (None, item.upper() * 2), (4, brute.sentence(rng, 400)), (4, item), (5, ("y " * 600_000) + item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in qgram.leaks(frame, bench).collect()}
    assert got == {(d, i) for d in (1, None, 4, 5) for i in (7, None)}


def test_short_runs_at_every_offset():
    """Runs of 50 to 150 bytes of a longer item, verbatim and with two edits; runs of other items' words are none."""
    import random

    rng = random.Random(6)
    noise = lambda n: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    item, other = noise(317), noise(200)
    index = qgram.GramIndex([(7, item), (8, other), (9, b"tiny item")])
    for size in (50, 51, 73, 90, 99, 100, 110, 120, 131, 150):
        for spoiled in (False, True):
            texts, ends = [], []
            for at in range(len(item) - size + 1):
                run = bytearray(item[at : at + size])
                if spoiled:
                    run[size // 3] = 35
                    del run[2 * size // 3]
                before = noise(40)
                texts.append(before + b"#" + run + b"#" + noise(40))
                ends.append(41 + len(run))
            got = list(index.find(texts))
            assert {k for k, *_ in got} == set(range(len(texts)))
            assert {index.items[p] for _, p, _, _ in got} == {7}
            assert all(abs(end - ends[k]) <= size for k, _, _, end in got)
    assert not list(index.find([noise(60) + item[at : at + 34] + noise(60) for at in range(len(item) - 34)]))


def test_banded_distances():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 4000).astype(np.uint8)
    low = rng.integers(0, 3000, 300)
    rows = np.stack([raw[x + 3 : x + 33] for x in low])
    rows[rng.random(rows.shape) < 0.08] = 120
    edits, ends = qgram.banded_distances(rows, raw, low, 7, 4)
    want = [qgram.banded_distance(r.tobytes(), raw[x : x + 36].tobytes(), 4) for r, x in zip(rows, low)]
    assert [(e, z) for e, z in zip(edits, ends) if e <= 4] == [w for w in want if w[0] <= 4] and (edits > 4).tolist() == [w[0] > 4 for w in want]


def test_banded_distance():
    import random

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcd") for _ in range(20))
        text = bytearray(piece)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = bytes([rng.choice(b"abcd")])
        region = (b"zz" + bytes(text) + b"zzzzzzzz")[: len(piece) + 6]
        want, got = plain(piece, region), qgram.banded_distance(piece, region, 2)[0]
        assert got >= want and (want > 2 or got == want)


def test_blocks_of_benchmark(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = sorted(tuple(r) for r in qgram.leaks(docs, benchmark).collect())
    monkeypatch.setattr(qgram, "BLOCK_BYTES", 3000)
    assert sorted(tuple(r) for r in qgram.leaks(docs, benchmark).collect()) == whole


def test_neighbours(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = curves.neighbours(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), every=10).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r)
    hits = 0
    for q, i in enumerate(ids):
        if i % 10:
            continue
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [r["rank"] for r in found[i]] == list(range(1, 11))
        assert all(abs(d[ids.index(r["vec_id"])] - r["score"]) < 1e-12 for r in found[i])
        hits += len({ids[b] for b in best} & {r["vec_id"] for r in found[i]})
    assert hits >= 0.9 * 10 * len(found)


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "b"), (2, [1.0, 0.1], None), (3, None, "c"), (4, [0.0, 0.0], "c"), (5, [nan, 1.0], "c"), (6, [inf, 1.0], "c"), (7, [None, 1.0], "c"), (8, [1.0], "c"), (100, [0.0, 2.0], "c"), (None, [1.0, 1.0], "c"), (2, [5.0, 5.0], "d")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in curves.neighbours(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 2), (100, 1, 1), (100, 2, 2), (100, 3, 0), (100, 4, 2)]


def test_languages(odd, docs):
    got = {r["doc_id"]: r for r in crf.languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in got if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (brute.fold_of(d) % 5 == 0) for d in got)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.9 * len(held)
    rows = crf.languages(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 9):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert crf.in_a_language(odd).columns == odd.columns


def test_languages_of_long_texts_alone(spark):
    """A language that has only books is learned from runs of their words, also where most of a book has no letter."""
    import random

    rng = random.Random(4)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, text("abcde", 80), "a") for i in range(40)] + [(100 + i, text("vwxyzé", 3000), "v") for i in range(20)]
    rows += [(200 + i, "12 " * 20_000 + text("klmno", 40), "k") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = crf.labelled_sample(frame).collect()
    assert {r["l"] for r in sample} == {"a", "v", "k"} and all(len(r["t"].encode()) <= 1.1 * crf.SAMPLE_BYTES for r in sample)
    truth = {d: lang for d, _, lang in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in crf.languages(frame).collect()} == truth


def test_texts_in_several_languages_stay(spark):
    """Three known languages in one text score a third each and stay, as all clean texts do; words of none go."""
    import random

    rng = random.Random(12)
    letters = {"a": "abcde", "k": "klmno", "p": "pqrst", "v": "vwxyz"}
    text = lambda of, n: " ".join("".join(rng.choice(of) for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, text(letters[k], 60), k) for i, k in enumerate("akpv" * 30)]
    rows += [(900, " ".join(text(letters[k], 40) for k in "akp"), None), (901, text("αβγδε", 60), None), (902, "1 2 3", None), (903, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["score"] for r in crf.languages(frame).collect()}[900] < crf.MIN_SCORE
    assert {r["doc_id"] for r in crf.in_a_language(frame).collect()} == {*range(120), 900}


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    tagger = crf.Tagger(["a", "b", "c"], rng.normal(size=(crf._ZERO + 1, 3)).astype(np.float32), rng.normal(size=(3, 3)))
    tagger.weights[crf._ZERO] = 0
    texts = [b" ".join(b"abcdefgh"[i % 5 : i % 5 + 1 + i % 3] for i in range(n)) for n in (700, 3, 0, 257, 1000, 1)]
    monkeypatch.setattr(crf, "SEGMENT", 10_000)
    whole = tagger.judge(texts)
    monkeypatch.setattr(crf, "SEGMENT", 64)
    assert np.allclose(tagger.judge(texts), whole, atol=1e-9)


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    psi, moves, first = rng.random((1, 4, 3)), rng.random((3, 3)), np.full((1, 3), 1 / 3)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = (first[0] @ moves)[path[0]] * psi[0, 0, path[0]]
        for t in range(1, 4):
            p *= moves[path[t - 1], path[t]] * psi[0, t, path[t]]
        for t in range(4):
            want[t, path[t]] += p
    got, _ = crf._forward_backward(psi, np.array([4]), moves, first, np.full((1, 3), 1 / 3))
    assert np.allclose(got[0], want / want.sum(1, keepdims=True))


def test_code_switched_text():
    import random

    rng = random.Random(1)
    alphabets = {"x": "abcde", "y": "vwxyz"}
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(4))
    text = lambda k, n: " ".join(word(k) for _ in range(n)).encode()
    tagger = crf.fit_tagger([text(k, 60) for k in "xy" * 20], list("xy" * 20))
    shares = tagger.judge([text("x", 30) + b" " + text("y", 10), text("y", 5)])
    assert abs(shares[0][0] - 0.75) < 0.1 and shares[1][1] > 0.9


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, request):
    frame = request.getfixturevalue(which)
    rows = [(-(2**63) if d is None else d, t) for d, t in pairs(frame)]
    prints = [brute.fingerprint(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = brute.groups([d for d, _ in rows], links)
    none = lambda d: None if d == -(2**63) else d
    want = sorted(((none(d), format(p, "016x"), none(top[d])) for (d, _), p in zip(rows, prints)), key=key)
    assert sorted(map(tuple, simhash.near_groups(frame).collect()), key=key) == want
    stay = simhash.drop_near_copies(frame)
    assert stay.columns == frame.columns
    assert sorted([r["doc_id"] for r in stay.collect()], key=lambda v: (v is not None, v)) == sorted({none(t) for t in top.values()}, key=lambda v: (v is not None, v))


def test_tiles_link_as_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 40)
    values = sorted({int(s) ^ sum(1 << int(b) for b in rng.integers(0, 63, k)) for s in seeds for k in (0, 1, 2, 3, 5, 8) for _ in range(4)})
    monkeypatch.setattr(simhash, "TILE", 16)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "print long, low long")
    edges = [tuple(r) for r in simhash.links(frame).collect()]
    close = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert all((values[a] ^ values[b]).bit_count() <= 64 for a, b in edges)
    nodes = list(range(len(values)))
    assert brute.groups(nodes, edges) == brute.groups(nodes, close)


def test_components(spark):
    from tapeworks.llm.components import components

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute.groups(sorted({n for e in edges for n in e}), edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffixes(which, request):
    frame = request.getfixturevalue(which)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.drop_repeats(frame).collect()]
    assert sorted(got, key=key) == sorted(brute.repeats_cut(pairs(frame)), key=key)
    assert sum(r[2] for r in got) > 0


def test_suffixes_crowded_and_small_blocks(spark, monkeypatch):
    import random

    rng = random.Random(9)
    core = brute.sentence(rng, 12)
    rows = [(i, brute.sentence(rng, rng.randint(1, 8)) + core[rng.randint(0, 20) :] + brute.sentence(rng, 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.repeats_cut(rows))
    for name, value in (("CROWD", 3), ("BLOCK", 5), ("BUCKET_BYTES", 500), ("_SLICE", 64)):
        monkeypatch.setattr(suffixes, name, value)
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.drop_repeats(frame).collect()]
        assert sorted(got) == want


def test_suffixes_in_few_words(spark):
    """Contexts that recur whole beside others that share only their anchor, and every mixture of the two."""
    import random

    rng = random.Random(11)
    stock = [brute.sentence(rng, rng.randint(3, 14)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(stock) if rng.random() < 0.7 else brute.sentence(rng, 6) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute.repeats_cut(rows))


def test_suffixes_of_a_long_text(spark):
    """Beyond byte 2^24 a text is searched like before it: passages there are found first, and are taken out."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz  ", np.uint8)
    noise = lambda seed, n: letters[np.random.default_rng(seed).integers(0, len(letters), n)].tobytes().decode()
    one, two, long = noise(1, 300), noise(2, 400), (1 << 24) + 5000
    rows = [(1, noise(3, long) + one), (2, "A" + one + "B"), (3, "C" + two + "D"), (4, noise(4, long) + two + noise(5, 3_000_000))]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: len(one), 3: 0, 4: len(two)}
    with pytest.raises(ValueError):
        suffixes.anchors([(b"x" * (1 << 24), 0, 0)])


def test_suffix_array():
    import random

    from tapeworks.llm.lyndon import suffix_array

    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randrange(rng.choice((1, 2, 3, 26))) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    frames = [
        shards.hilbert_shards(empty), lines.dedup_lines(empty), brown.brown_scores(empty), pivotal.mix(empty), pivotal.mixed(empty),
        urls.judge_urls(spark.createDataFrame([], "page_id long, url string")), qgram.leaks(empty, benchmark), qgram.without_leaks(empty, benchmark),
        curves.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")), crf.languages(empty), crf.in_a_language(empty),
        simhash.near_groups(empty), simhash.drop_near_copies(empty), suffixes.drop_repeats(empty),
    ]
    assert all(f.count() == 0 for f in frames)
