"""Opening-range breakout: range, prior-session ATR, volume confirmation, one signal per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LONG, OPEN_MINUTE, SHORT, BreakoutConfig, CostModel
from ..functions.rolling import SESSION, day_order, rolling_median, running, session_order, whole_session
from ..functions.scalars import holds
from .asof import by_session
from .barriers import first_touch

SIGNAL_COLUMNS = ("direction", "signal_minute", "range_high", "range_low", "atr", "entry_ref", "stop", "target")


def opening_range(bars: DataFrame, config: BreakoutConfig = BreakoutConfig()) -> DataFrame:
    """Add range_high and range_low of the first minutes; any unknown high or low leaves the session rangeless."""
    inside = F.col("minute").between(OPEN_MINUTE, OPEN_MINUTE + config.range_minutes - 1)
    session = whole_session()
    gaps = F.count_if(inside & (F.col("high").isNull() | F.col("low").isNull())).over(session)
    return bars.withColumns(
        {
            "range_high": F.when(gaps == 0, F.max(F.when(inside, F.col("high"))).over(session)),
            "range_low": F.when(gaps == 0, F.min(F.when(inside, F.col("low"))).over(session)),
        }
    )


def true_range(prev_close: Column) -> Column:
    """Largest of the bar's span and its distances from the previous close; unknown parts are skipped."""
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def prior_session_atr(bars: DataFrame, sessions: int = 1) -> DataFrame:
    """Per session: mean true range over the bars of the previous ``sessions`` stored sessions.

    The previous-close chain starts fresh at the look-back's first bar and runs on across its sessions. Each session
    therefore needs its true-range sum twice: with its first bar unchained, and chained to the prior session's close.
    Everything ticker-level works on one row per ticker-day.
    """
    return _with_atr(_ranged(bars).groupBy(*SESSION).agg(*_range_sums()), sessions).select(*SESSION, "atr")


def _ranged(bars: DataFrame) -> DataFrame:
    order = session_order()
    return bars.withColumns({"tr": true_range(F.lag("close", 1).over(order)), "is_first": F.row_number().over(order) == 1})


def _range_sums() -> list[Column]:
    """What a session leaves behind for the ATR of later ones."""
    first = F.col("is_first")
    return [
        F.sum("tr").alias("tr_sum"),
        F.count("tr").alias("tr_n"),
        F.max(F.when(first, F.col("tr"))).alias("tr_open"),
        F.max(F.when(first, F.struct("high", "low"))).alias("opening"),
        F.max_by("close", "minute").alias("last_close"),
    ]


def _with_atr(days: DataFrame, sessions: int) -> DataFrame:
    by_day = day_order()
    prev = F.lag("last_close", 1).over(by_day)
    high, low = F.col("opening.high"), F.col("opening.low")
    chained_open = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    zero = F.lit(0.0)
    linked = days.withColumns(
        {
            "chained_sum": F.coalesce("tr_sum", zero) - F.coalesce("tr_open", zero) + F.coalesce(chained_open, zero),
            "chained_n": F.col("tr_n")
            - F.when(F.col("tr_open").isNotNull(), 1).otherwise(0)
            + F.when(chained_open.isNotNull(), 1).otherwise(0),
        }
    )
    total = F.coalesce(F.lag("tr_sum", sessions).over(by_day), zero)
    count = F.lag("tr_n", sessions).over(by_day)
    if sessions > 1:
        later = by_day.rowsBetween(1 - sessions, -1)
        total = total + F.sum("chained_sum").over(later)
        count = count + F.sum("chained_n").over(later)
    return linked.withColumn("atr", F.try_divide(total, count))


def running_volume_median(bars: DataFrame) -> DataFrame:
    """Median volume from the session's first bar up to the current one, unknown volumes skipped."""
    return bars.withColumn("median_volume", rolling_median(F.col("volume"), running(session_order()), 1))


def stop_and_target(entry: Column, direction: Column, config: BreakoutConfig) -> tuple[Column, Column, Column]:
    """Stop, target and risk for an entry price and a +1/-1 direction."""
    if config.stop_mode == "boundary":
        stop = F.when(direction == 1, F.col("range_low")).otherwise(F.col("range_high"))
    else:
        stop = entry - direction * config.stop_atr_mult * F.col("atr")
    risk = F.abs(entry - stop)
    return stop, entry + direction * config.rr * risk, risk


def breakout_signals(rth: DataFrame, config: BreakoutConfig = BreakoutConfig(), atr: DataFrame | None = None) -> DataFrame:
    """First confirmed breakout of each session.

    ``atr`` (ticker, date, atr) defaults to the prior-session ATR of the same bars; sessions without one are out.
    """
    scale = prior_session_atr(rth, config.atr_lookback_sessions) if atr is None else atr
    rows = running_volume_median(opening_range(by_session(rth), config))
    scaled = rows.join(scale.filter(F.col("atr") > 0), list(SESSION))
    hits = scaled.select(*SESSION, _hit(config).alias("hit")).filter(F.col("hit").isNotNull())
    return hits.groupBy(*SESSION).agg(F.min("hit").alias("hit")).select(*SESSION, *(f"hit.{c}" for c in SIGNAL_COLUMNS))


def _hit(config: BreakoutConfig) -> Column:
    """The signal of a bar, NULL if it gives none; the session's first is the least."""
    reach = config.min_break_atr * F.col("atr")
    direction = (
        F.when(F.col("close") >= F.col("range_high") + reach, 1)
        .when(F.col("close") <= F.col("range_low") - reach, -1)
    )
    stop, target, risk = stop_and_target(F.col("close"), direction, config)
    confirmed = (F.col("minute") >= OPEN_MINUTE + config.range_minutes) & holds(
        F.col("volume") >= config.vol_mult * F.col("median_volume")
    )
    signal = F.struct(
        F.col("minute").alias("signal_minute"),
        direction.alias("direction"),
        "range_high",
        "range_low",
        "atr",
        F.col("close").alias("entry_ref"),
        stop.alias("stop"),
        target.alias("target"),
    )
    return F.when(confirmed & direction.isNotNull() & (risk > 0), signal)


def run_breakout(
    rth: DataFrame,
    config: BreakoutConfig = BreakoutConfig(),
    costs: CostModel = CostModel(),
    gate: DataFrame | None = None,
) -> DataFrame:
    """Signals to trades: fill at the next bar's open, exit at stop, target or the session's last close.

    ``gate`` (ticker, date) restricts which sessions may trade; the ATR still sees every stored session. Bars are read and
    shuffled once, by ticker (a history that the calendar bounds): a session is folded to one row with its bars, takes its
    ATR from the rows before it, and is unfolded again for its signal and its exit.
    """
    known = rth.dropna(subset=list(SESSION)).repartition("ticker")
    rows = _ranged(running_volume_median(opening_range(known, config)))
    bar = F.struct("minute", "open", "high", "low", "close", "volume", "median_volume", "range_high", "range_low")
    days = rows.groupBy(*SESSION).agg(*_range_sums(), F.collect_list(bar).alias("bars"))
    scaled = _with_atr(days, config.atr_lookback_sessions).filter(F.col("atr") > 0).select(*SESSION, "atr", F.inline("bars"))
    signalled = scaled.withColumn("hit", F.min(_hit(config)).over(whole_session()))
    later = signalled.filter(F.col("minute") > F.col("hit.signal_minute"))
    trades = _exits(later.select(*SESSION, "hit.*", "minute", "open", "high", "low", "close"), config, costs)
    return trades if gate is None else trades.join(gate.select(*SESSION).distinct(), list(SESSION), "left_semi")


def breakout_trades(signals: DataFrame, rth: DataFrame, config: BreakoutConfig, costs: CostModel) -> DataFrame:
    bars = rth.select(*SESSION, "minute", "open", "high", "low", "close")
    later = signals.select(*SESSION, *SIGNAL_COLUMNS).join(bars, list(SESSION)).filter(
        F.col("minute") > F.col("signal_minute")
    )
    return _exits(later, config, costs)


def _exits(later: DataFrame, config: BreakoutConfig, costs: CostModel) -> DataFrame:
    """Trades from each session's signal, repeated on the bars after it."""
    session = whole_session()
    entered = later.withColumn("entry_minute", F.min("minute").over(session)).withColumn(
        "entry", F.max(F.when(F.col("minute") == F.col("entry_minute"), F.col("open"))).over(session)
    )
    stop, target, risk = stop_and_target(F.col("entry"), F.col("direction"), config)
    armed = entered.withColumns({"risk": risk, "stop": stop, "target": target}).filter(F.col("risk") > 0)
    keys = (*SESSION, "signal_minute", "direction", "entry_minute", "entry", "stop", "target", "risk")
    closed = first_touch(armed, keys).filter(F.col("exit").isNotNull())
    gross = F.col("direction") * (F.col("exit") - F.col("entry")) / F.col("entry")
    return closed.select(
        *SESSION,
        F.col("signal_minute").alias("minute"),
        F.when(F.col("direction") == 1, LONG).otherwise(SHORT).alias("direction"),
        gross.alias("gross_ret"),
        (gross - costs.round_trip_cost).alias("net_ret"),
        (-F.col("risk") / F.col("entry")).alias("q10"),
        "entry_minute",
        "exit_minute",
        "entry",
        "stop",
        "target",
        "exit",
        "exit_reason",
    )
