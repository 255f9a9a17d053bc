"""Story clustering and point-in-time news features, built on availability times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import BAR_MINUTES
from ..functions.clock import local_time, shift_minutes
from ..functions.rolling import SESSION, day_order, rolling_mean
from ..functions.scalars import ratio
from ..functions.text import FEATURED_EVENTS, classify_event, normalize_title, sentiment_value
from ..sources.calendar import small_calendar
from .asof import by_session

# Story window, decay half-life and look-backs of the news features.
STORY_HOURS = 72
HALF_LIFE_HOURS = 24.0
DAY_MINUTES, WEEK_MINUTES = 24 * 60, 7 * 24 * 60
BURST_EPS = 1e-9
SNAPSHOT_NEWS = (
    "news_clusters_24h", "news_clusters_7d", "news_decayed_weight", "news_sent_signed", "news_sent_magnitude",
    "news_source_diversity", "news_novelty_frac", "news_burst", *(f"news_evt_{t}_w" for t in FEATURED_EVENTS),
)
# Output column names.
BAR_NEWS = (
    "news_articles_2h", "news_articles_24h", "news_sent_signed_2h", *(f"news_evt_{t}_2h" for t in FEATURED_EVENTS),
)

MICROS_PER_HOUR = 3_600_000_000
STORY, SOURCE = "story", "source"


def cluster_articles(articles: DataFrame) -> DataFrame:
    """Add cluster_id and is_cluster_start: syndicated copies chain while each follows the last within 72 hours.

    Copies of one title inside a fixed 72-hour bucket always chain, so each (title, bucket) first collapses to one
    row with map-side combine. Gaps-and-islands then runs over buckets: a title's window holds one row per three
    days of history, however often the story was copied. The join back is keyed by (title, bucket), where AQE
    splits an oversized side. An untitled article is its own story: a key of its own spreads it over the cluster.
    """
    width = STORY_HOURS * MICROS_PER_HOUR
    title = normalize_title(F.col("title"))
    own = F.concat(F.lit("#"), F.col("article_id").cast("string"))  # '#' never occurs in a normalised title
    keyed = articles.withColumns(
        {
            "title_key": F.when(title == "", own).otherwise(title),
            "bucket": F.floor(F.unix_micros("published_ts") / width).cast("bigint"),
        }
    )
    first = F.min(F.struct("published_ts", "article_id"))
    buckets = keyed.groupBy("title_key", "bucket").agg(first.alias("first"), F.max("published_ts").alias("last_ts"))
    order = Window.partitionBy("title_key").orderBy("bucket")
    silence = F.unix_micros("first.published_ts") - F.unix_micros(F.lag("last_ts", 1).over(order))
    fresh = F.coalesce(silence > width, F.lit(True))
    # The story of a bucket is the first article of the latest fresh bucket up to it.
    start = F.last(F.when(fresh, F.col("first.article_id")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    stories = buckets.select("title_key", "bucket", start.alias("cluster_id"))
    chained = keyed.join(stories, ["title_key", "bucket"]).drop("title_key", "bucket")
    return chained.withColumn("is_cluster_start", F.col("cluster_id") == F.col("article_id"))


def classify_articles(articles: DataFrame) -> DataFrame:
    return articles.withColumn("event_type", classify_event(F.col("title"), F.col("description")))


def tagged_news(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Clustered, classified articles joined to their ticker tags, with the sentiment as a number.

    Texts are classified where they are read and dropped at once: only keys and short columns reach the shuffles.
    """
    typed = classify_articles(articles).select(
        "article_id", "published_ts", "available_ts", "publisher", "title", "event_type"
    )
    stories = cluster_articles(typed).drop("title", "published_ts")
    known = tags.select("article_id", "ticker", sentiment_value(F.col("sentiment")).alias("sentiment_value"))
    return stories.join(known, "article_id")


def cutoff_articles(tagged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Pair each article with every session cutoff it precedes by less than seven days: (T - 7d, T].

    An article lists its own candidate days (at most nine) and meets the broadcast calendar on the date, so the
    range condition costs no shuffle and no ticker becomes a join key.
    """
    since = F.to_date(local_time(F.col("available_ts")))
    candidate = F.explode(F.sequence(since, F.date_add(since, 8))).alias("date")
    dated = tagged.select("*", candidate)
    cut = dated.join(small_calendar(calendar, "cutoff_ts"), "date")
    return cut.filter(
        (F.col("available_ts") <= F.col("cutoff_ts"))
        & (F.col("available_ts") > shift_minutes(F.col("cutoff_ts"), -WEEK_MINUTES))
    ).withColumn("in_24h", F.col("available_ts") > shift_minutes(F.col("cutoff_ts"), -DAY_MINUTES))


def cluster_events(visible: DataFrame, *keys: str) -> DataFrame:
    """One row per (ticker, date, story) visible at the cutoff: first arrival, mean known sentiment, novelty, type.

    Other ``keys`` than the story may be given to summarise by.
    """
    earliest = F.min(F.struct("available_ts", "article_id", "event_type"))
    return visible.groupBy(*SESSION, "cutoff_ts", *(keys or ("cluster_id",))).agg(
        F.min("available_ts").alias("first_avail"),
        F.avg("sentiment_value").alias("sent"),
        F.bool_or("is_cluster_start").alias("started_recently"),
        F.bool_or("in_24h").alias("in_24h"),
        earliest["event_type"].alias("event_type"),
    )


def _stories_and_sources(visible: DataFrame) -> DataFrame:
    """Each article once under its story and once under its publisher, so one pass counts both."""
    kinds = F.array(
        F.struct(F.lit(STORY).alias("kind"), F.col("cluster_id").cast("string").alias("key")),
        F.struct(F.lit(SOURCE).alias("kind"), F.col("publisher").alias("key")),
    )
    return visible.select("*", F.inline(kinds)).filter(F.col("key").isNotNull())


def _decay() -> Column:
    age_hours = (F.unix_micros("cutoff_ts") - F.unix_micros("first_avail")) / MICROS_PER_HOUR
    return F.exp(-F.ln(F.lit(2.0)) / HALF_LIFE_HOURS * age_hours)


def session_news(tagged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Pre-market news features of the (ticker, date) that have news."""
    visible = _stories_and_sources(cutoff_articles(tagged, calendar))
    story = F.col("kind") == STORY
    weighted = cluster_events(visible, "kind", "key").withColumns(
        {"decay": F.when(story, _decay()), "known": F.coalesce("sent", F.lit(0.0))}
    )
    recent = F.col("first_avail") >= shift_minutes(F.col("cutoff_ts"), -DAY_MINUTES)
    novelty = F.avg(F.when(story & recent, F.col("started_recently").cast("double")))
    by_type = [
        F.sum(F.when(F.col("event_type") == t, F.col("decay"))).alias(f"news_evt_{t}_w") for t in FEATURED_EVENTS
    ]
    return weighted.groupBy(*SESSION).agg(
        F.count_if(story & F.col("in_24h")).alias("news_clusters_24h"),
        F.count_if(story).alias("news_clusters_7d"),
        F.count_if(~story & F.col("in_24h")).alias("news_source_diversity"),
        F.sum("decay").alias("news_decayed_weight"),
        F.sum(F.col("decay") * F.col("known")).alias("news_sent_signed"),
        F.sum(F.col("decay") * F.abs("known")).alias("news_sent_magnitude"),
        novelty.alias("news_novelty_frac"),
        *by_type,
    )


def with_session_news(rows: DataFrame, news: DataFrame) -> DataFrame:
    """Add the news features to one row for each session; sessions without news get zeros.

    The burst ratio compares with the ticker's previous 20 rows (at least five).
    """
    own = [F.col(c) for c in rows.columns]
    plain = [c for c in SNAPSHOT_NEWS if c != "news_burst"]
    filled = rows.join(news, list(SESSION), "left").select(*own, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in plain])
    usual = rolling_mean(F.col("news_clusters_24h"), day_order().rowsBetween(-20, -1), 5)
    return filled.withColumn("news_burst", ratio("news_clusters_24h", usual + BURST_EPS))


def snapshot_news(tagged: DataFrame, calendar: DataFrame, grid: DataFrame) -> DataFrame:
    """Pre-market news features for every (ticker, date) of ``grid``."""
    return with_session_news(grid.select(*SESSION), session_news(tagged, calendar))


def news_cells(tagged: DataFrame, minutes: int = BAR_MINUTES) -> DataFrame:
    """Article counts per (ticker, five-minute cell), a cell being named by the grid instant that ends it.

    Bars end on the grid, so an article counts for a bar exactly when its cell does; folding articles into cells
    first leaves at most 288 rows per ticker-day, whatever the article volume.
    """
    width = minutes * 60_000_000
    cell = F.ceil(F.unix_micros("available_ts") / width).cast("bigint")
    signed = F.sum(F.coalesce("sentiment_value", F.lit(0.0)))
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in FEATURED_EVENTS]
    return tagged.groupBy("ticker", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), signed.alias("signed"), *counts
    )


def bar_news(bars: DataFrame, tagged: DataFrame, minutes: int = BAR_MINUTES) -> DataFrame:
    """Add the news features of (T - 2h, T] and (T - 24h, T] to every bar, T being the bar's end.

    Bars and news cells share one union sorted by cell, read with RANGE frames: no range join. A cell is repeated
    on its own and the next two dates, so frames stay inside a (ticker, date) partition.
    """
    width = minutes * 60_000_000
    day_of = F.to_date(local_time(F.timestamp_micros((F.col("cell") - 1) * width)))
    cells = news_cells(tagged, minutes).withColumn("date", F.explode(F.sequence(day_of, F.date_add(day_of, 2))))
    rows = by_session(bars).withColumns({"cell": (F.unix_micros("event_ts") / width).cast("bigint") + 1, "is_bar": F.lit(True)})
    # Both sides are laid out by session, so the union keeps that layout and the frames need no further shuffle.
    both = rows.unionByName(by_session(cells.withColumn("is_bar", F.lit(False))), allowMissingColumns=True)
    order = Window.partitionBy(*SESSION).orderBy("cell")
    two_hours = order.rangeBetween(1 - 120 // minutes, 0)
    one_day = order.rangeBetween(1 - DAY_MINUTES // minutes, 0)

    def total(column: str, frame) -> Column:
        return F.coalesce(F.sum(column).over(frame).cast("double"), F.lit(0.0))

    features = {
        "news_articles_2h": total("n", two_hours),
        "news_articles_24h": total("n", one_day),
        "news_sent_signed_2h": total("signed", two_hours),
        **{f"news_evt_{t}_2h": total(f"n_{t}", two_hours) for t in FEATURED_EVENTS},
    }
    return both.withColumns(features).filter("is_bar").select(*bars.columns, *features)


def unknown_news(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Without a news table the features are unknown, not zero."""
    return rows.withColumns({c: F.lit(None).cast("double") for c in columns})
