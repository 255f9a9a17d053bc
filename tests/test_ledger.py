"""Publishing by id: what an append reads, two writers at once, and claims that were never signed."""

import pytest
from pyspark.sql import functions as F

from tapeworks.sources.ledger import Ledger


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "news"), buckets=8)


def articles(spark, ids, note="a"):
    return spark.createDataFrame([(i, note) for i in ids], "article_id long, note string")


def test_each_id_is_published_once(spark, ledger):
    assert ledger.rows() is None
    assert ledger.publish(articles(spark, [*range(100), 5, 5])) == 100
    assert ledger.publish(articles(spark, range(50, 160), "b")) == 60
    assert ledger.publish(articles(spark, range(160), "c")) == 0
    got = ledger.rows()
    assert got.count() == 160 and got.select("article_id").distinct().count() == 160
    assert got.filter("note = 'b'").agg(F.min("article_id")).first()[0] == 100
    assert len(ledger.versions()) == 2


def test_an_append_reads_only_folders_that_may_hold_its_ids(spark, ledger):
    for first in range(0, 4000, 1000):
        ledger.publish(articles(spark, range(first, first + 1000)))
    versions = ledger.versions()
    known = ledger.may_hold(articles(spark, [7]).select("article_id"), versions)
    assert any(f"/{versions[0]}/" in folder for folder in known) and len(known) <= 2
    assert len(spark.read.parquet(*known).inputFiles()) <= 2  # of 32 files
    assert len(ledger.may_hold(articles(spark, range(10**6, 10**6 + 20)).select("article_id"), versions)) <= 3
    every = ledger.may_hold(articles(spark, range(4000)).select("article_id"), versions)
    assert len(every) == 32  # a filter never misses an id that is there


def test_the_second_of_two_writers_starts_again(spark, ledger, monkeypatch):
    ledger.publish(articles(spark, range(10)))
    other = Ledger(spark, ledger.path, buckets=8)
    claim, calls = ledger._claim, []

    def late(number, version):
        if not calls:
            assert other.publish(articles(spark, range(5, 20), "other")) == 10
        calls.append(number)
        return claim(number, version)

    monkeypatch.setattr(ledger, "_claim", late)
    assert ledger.publish(articles(spark, range(15, 30), "own")) == 10  # 15 to 19 came from the other writer
    assert calls == [1, 2]
    got = ledger.rows()
    assert got.count() == 30 and got.select("article_id").distinct().count() == 30 and got.filter("note = 'own'").count() == 10


def test_unsigned_claims_and_unclaimed_folders_are_not_read(spark, ledger):
    ledger.publish(articles(spark, range(3)))
    articles(spark, range(50)).write.parquet(f"{ledger.path}/rows/v-lost")
    (open(f"{ledger.path}/claims/000000001", "w")).close()
    assert ledger.rows().count() == 3 and ledger.publish(articles(spark, range(2, 6))) == 3
    assert ledger.rows().count() == 6
