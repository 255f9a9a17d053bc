import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from frames import DAY, bars, instants
from tapeworks.functions.text import EVENT_HINTS, EVENT_PATTERNS, FEATURED_EVENTS, classify_event, folded, normalize_title
from tapeworks.operators import news
from tapeworks.sources.calendar import session_calendar

UTC = dt.timezone.utc
ARTICLE = "article_id string, published_ts timestamp, available_ts timestamp, publisher string, title string, description string"


def articles(spark, rows):
    """rows: (id, published, title[, publisher[, description]])"""
    full = []
    for i, published, title, *rest in rows:
        at = published.replace(tzinfo=UTC)
        publisher, description = (*rest, *[None] * 2)[:2]
        full.append((i, at, at + dt.timedelta(minutes=15), publisher or "Wire", title, description))
    return spark.createDataFrame(full, ARTICLE)


def tags(spark, rows):
    return spark.createDataFrame(rows, "article_id string, ticker string, sentiment string")


def chained(rows):
    """Copy by copy, in publish order: the plain reading of the clustering rule."""
    seen, out = {}, {}
    for i, at, title in sorted(rows, key=lambda r: (r[1], r[0])):
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split())
        first, last = seen.get(key, (None, None))
        story = first if key and last is not None and at - last <= dt.timedelta(hours=72) else i
        seen[key] = (story, at)
        out[i] = story
    return out


def test_titles(spark):
    rows = spark.createDataFrame([("Kite -- RISES  Q3!",), (None,), ("***",)], "t string")
    assert [r[0] for r in rows.select(normalize_title(F.col("t"))).collect()] == ["kite rises q3", "", ""]


def test_clusters_match_sequential_chaining_even_for_a_hot_title(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    titles = ["Hot story"] * 6 + ["Other", "", "hot STORY!"]
    rows = [(f"a{i:04d}", start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 60)), rng.choice(titles)) for i in range(300)]
    rows += [("b1", dt.datetime(2024, 6, 1), "edge"), ("b2", dt.datetime(2024, 6, 4), "edge"), ("b3", dt.datetime(2024, 6, 7, 0, 1), "edge")]
    got = {r["article_id"]: (r["cluster_id"], r["is_cluster_start"]) for r in news.cluster_articles(articles(spark, rows)).collect()}
    want = chained(rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(start == (cluster == k) for k, (cluster, start) in got.items())
    assert got["b2"][0] == "b1" and got["b3"][0] == "b3"


def test_clusters_do_not_change_when_later_articles_arrive(spark):
    rows = [(f"a{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=50 * i), "Same") for i in range(8)]
    full, early = (
        {r["article_id"]: r["cluster_id"] for r in news.cluster_articles(articles(spark, part)).collect()} for part in (rows, rows[:5])
    )
    assert all(full[k] == v for k, v in early.items())


def test_priority_description_and_missing_text(spark):
    rows = spark.createDataFrame(
        [("An analyst looks at the quarterly results of Northwind", None), ("Morning note", "The firm cuts its outlook for the fiscal year"), (None, None), ("CFO\nretires", None), ("CFO of Northwind retires", None)],
        "t string, d string",
    )
    got = [r[0] for r in rows.select(classify_event(F.col("t"), F.col("d"))).collect()]
    assert got == ["earnings", "guidance", "other", "other", "management"]
    assert set(FEATURED_EVENTS) <= {name for name, _ in EVENT_PATTERNS}


def test_two_hour_window_is_open_below_and_closed_above(spark):
    bar = instants(bars(spark, [(720, 1.0, 1.0, 1.0, 1.0, 1.0)]))  # ends 12:05 exchange time = 16:05 UTC
    end = dt.datetime(2024, 3, 18, 16, 5)
    offsets = {"at": 0, "inside": 119, "edge": 120, "old": 24 * 60 - 1, "gone": 24 * 60, "late": -1}
    rows = [(k, end - dt.timedelta(minutes=m + 15), f"{k} earnings") for k, m in offsets.items()]
    tagged = news.tagged_news(articles(spark, rows), tags(spark, [(k, "AAA", "positive" if k == "at" else None) for k in offsets]))
    got = news.bar_news(bar, tagged).first()
    assert (got["news_articles_2h"], got["news_articles_24h"], got["news_sent_signed_2h"]) == (2.0, 4.0, 1.0)
    assert got["news_evt_earnings_2h"] == 2.0 and got["news_evt_mna_2h"] == 0.0
    other = news.bar_news(bar.withColumn("ticker", F.lit("ZZZ")), tagged).first()
    assert other["news_articles_24h"] == 0.0


def test_snapshot_counts_stories_not_copies(spark):
    cutoff = dt.datetime(2024, 3, 18, 13, 0)  # 09:00 exchange time
    rows = [
        ("n1", cutoff - dt.timedelta(hours=30), "Northwind quarterly results are out", "W1"),
        ("n2", cutoff - dt.timedelta(hours=6), "Northwind quarterly results are out", "W2"),
        ("n3", cutoff - dt.timedelta(hours=5), "Something else", "W2"),
        ("n4", cutoff - dt.timedelta(minutes=10), "Too late to be seen", "W3"),
    ]
    tagged = news.tagged_news(articles(spark, rows), tags(spark, [("n1", "AAA", "positive"), ("n2", "AAA", None), ("n3", "AAA", "negative"), ("n4", "AAA", None)]))
    grid = spark.createDataFrame([("AAA", DAY), ("QQQ", DAY)], "ticker string, date date")
    got = {r["ticker"]: r for r in news.snapshot_news(tagged, session_calendar(spark, "2024-03-01", "2024-03-31"), grid).collect()}
    row = got["AAA"]
    assert (row["news_clusters_24h"], row["news_clusters_7d"], row["news_source_diversity"], row["news_novelty_frac"]) == (2.0, 2.0, 1.0, 1.0)
    old, new = 2 ** (-(30 - 0.25) / 24), 2 ** (-(5 - 0.25) / 24)
    assert row["news_decayed_weight"] == pytest.approx(old + new)
    assert row["news_sent_signed"] == pytest.approx(old - new) and row["news_evt_earnings_w"] == pytest.approx(old)
    assert row["news_burst"] is None and got["QQQ"]["news_clusters_7d"] == 0.0


# One phrase for each way a category's pattern can match.
PHRASES = {
    "earnings": "earnings|quarterly results|quarterly report|Q1 results|q4\tRevenue|q2  earnings|beat estimates|misses expectations|tops wall street|eps|revenue fell",
    "guidance": "guidance|outlook|raises forecast|cut full-year view|lowers its guidance|slashes annual\noutlook",
    "mna": "merger|mergers|acquisition|acquires|takeover|buyout|to buy|deal to acquire|going private|tender offer",
    "clinical": "fda|clinical trial|phase ii|phase  3|drug approval|breakthrough therapy|nda|biologics license",
    "regulatory_legal": "lawsuit|sued|settlements|probe|investigation|sec charges|antitrust|fined|court rules|regulator|doj",
    "management": "ceo resigns|cfo: he steps down|coo was named, names|chairman retires|executive hires|president departs|appoints a new ceo|names the chairman",
    "financing": "share offering|share repurchase|share buyback|buybacks|dividend|secondary offering|notes offering|convertible|dilutive|ipo|stock split|capital raise",
    "analyst": "upgrade|downgraded|price target|initiates coverage|overweight|underweight|buy rating|sell rating|analysts",
    "product": "launches|unveiled|recall|new product|announces new|introducing",
    "partnership": "partnership|collaborations|wins deal|wins contract|contract win|contract award|awarded|sign deal|signs agreement|joint venture",
    "macro": "fed|federal reserve|inflation|cpi|jobs report|payrolls|tariff|interest rates|treasury yield|recession|gdp",
}


def test_hints_lose_no_match_of_the_patterns(spark):
    """The category is that of the plain patterns, whichever of their branches matches and however its letters are written."""
    phrases = [f"{before}{p}{after}" for ps in PHRASES.values() for p in ps.split("|") for before, after in (("", ""), ("the ", " now"), ("un", "s"))]
    written = [w for p in phrases for w in (p, p.upper(), p.replace("s", "ſ").replace("k", "K"), p.replace("i", "İ"), p.replace("i", "ı"))]
    rows = spark.createDataFrame([(w,) for w in written], "t string")
    plain = F.coalesce(*[F.when(F.concat(F.lit(" "), F.col("t")).rlike(r"(?idU)\b(?:%s)" % p), F.lit(n)) for n, p in EVENT_PATTERNS], F.lit("other"))
    got = rows.select("t", classify_event(F.lit(""), F.col("t")).alias("got"), plain.alias("want"))
    assert got.filter("got <> want").collect() == []
    assert {r[0] for r in got.select("want").distinct().collect()} == {*PHRASES, "other"}


def test_folding_covers_all_letters_that_a_case_blind_pattern_takes_for_ascii(spark):
    letters = "|".join("abcdefghijklmnopqrstuvwxyz")
    points = spark.range(1, 0x10FFFF).filter("id NOT BETWEEN 55296 AND 57343")  # without surrogates
    points = points.withColumn("x", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')"))
    lost = points.filter(F.col("x").rlike(rf"(?idU)^(?:{letters})$")).filter(~folded(F.col("x")).rlike("^[a-z]$"))
    assert lost.collect() == []


def test_each_pattern_stands_behind_its_hints(spark):
    plan = spark.range(1).select(classify_event(F.lit("x"), F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString().lower()
    for hints in EVENT_HINTS.values():
        assert all(f"contains(namedlambdavariable().folded, {h})" in plan or f", {h})" in plan for h in hints)
    assert list(EVENT_HINTS) == [n for n, _ in EVENT_PATTERNS]


def ways(parsed):
    """A text for each way through a parsed pattern: every branch and character of a set, optional parts present and absent."""
    texts = [""]
    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                found = [chr(value)]
            case "AT":
                found = [""]
            case "ANY":
                found = [" "]
            case "CATEGORY":
                assert str(value) == "CATEGORY_SPACE"
                found = ["\t"]
            case "RANGE":
                found = [chr(c) for c in range(value[0], value[1] + 1)]
            case "IN":
                found = [w for one in value for w in ways([one])]
            case "BRANCH":
                found = [w for branch in value[1] for w in ways(branch)]
            case "SUBPATTERN":
                found = ways(value[-1])
            case "MAX_REPEAT":
                low, high, part = value
                times = range(low, (high if isinstance(high, int) and high < 9 else max(low, 1)) + 1)
                found = ["".join(ws) for n in times for ws in itertools.product(ways(part), repeat=n)]
            case other:
                raise ValueError(other)
        texts = [t + w for t in texts for w in found]
    return texts


def test_every_way_through_a_pattern_is_classified(spark):
    """Not only the phrases above: a branch whose text holds no hint, like 'announce new', would never meet its pattern."""
    texts = sorted({w for _, p in EVENT_PATTERNS for w in ways(re._parser.parse(p))} | {"Two firms announce new plants"})
    want = {t: next((n for n, p in EVENT_PATTERNS if re.search(p, t, re.IGNORECASE)), "other") for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["got"] for r in rows.select("t", classify_event(F.col("t")).alias("got")).collect()}
    assert {t: (got[t], n) for t, n in want.items() if got[t] != n} == {}
    assert want["announce new"] == want["Two firms announce new plants"] == "product"
