"""The corpus pipeline, each stage on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.table(stage(spark, docs, FOLDER))
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        kept[name] = [r["doc_id"] for r in out.collect()]
        if name != "shard":
            assert out.columns == columns
        if name == "language_id":
            assert set(kept[name]) <= {d for d, _, _ in rows} and len(kept[name]) >= 0.95 * len(rows)
        if name == "near_dedup":
            prints = [brute.fingerprint(t) for _, t, _ in rows]
            links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
            assert sorted(kept[name]) == sorted(set(brute.groups([d for d, _, _ in rows], links).values()))
        if name == "decontaminate":
            fold = lambda t: " ".join((t or "").lower().split())
            items = [fold(r["text"]) for r in brute.table(spark, FOLDER, "benchmark")]
            held = {d for d, t, _ in rows if any(p in fold(t) for p in items)}
            assert held and not held & set(kept[name])
            clean = {d for d, t, _ in rows if not any(p[k : k + 40] in fold(t) for p in items for k in range(0, max(1, len(p) - 39)))}
            assert clean <= set(kept[name])
        if name == "mix_sources":
            sizes, most, taken = Counter(), Counter(), Counter()
            length = {d: len(brute.words(t)) for d, t, _ in rows}
            for d, _, source in rows:
                sizes[source] += length[d]
                most[source] = max(most[source], length[d])
            for r in out.collect():
                taken[r["source"]] += length[r["doc_id"]]
            want = brute.targets(sizes)
            assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
            assert max(Counter(kept[name]).values()) <= 3
        if name == "shard":
            assert sorted(kept[name]) == sorted(d for d, _, _ in rows)
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: t for d, t, _ in rows}
        docs = out
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(kept["shard"])


def test_rows_without_an_id_are_documents(spark):
    """A third of the rows has no id, others share one: unrelated texts stay, near copies go, equal rows stay once."""
    import random

    rng = random.Random(8)
    texts = [brute.sentence(rng, 60) for _ in range(60)]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else 100 + i, t) for i, t in enumerate(texts)]
    copies = [(1000 + i, t) for i, t in enumerate(texts)] + rows[:9] + [(None, texts[2])]
    frame = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, FOLDER).collect())
    prints = [brute.fingerprint(t) for t in texts]
    assert all((prints[i] ^ prints[j]).bit_count() > 4 for i in range(60) for j in range(i))
    assert got == Counter([(None, texts[2]), *rows[:2], *rows[3:]])


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path):
    """Null and repeated ids, null texts and extra columns pass through all stages but the last, which has its own columns."""
    docs = brute.odd_documents(spark)
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.table(stage(spark, docs, str(tmp_path)))
        if name != "shard":
            assert out.columns == docs.columns
            docs = out
    assert {"doc_id", "shard", "slot", "text"} <= set(out.columns)
