"""Liquidity-sweep reversal: swings, fair-value gaps, sweep -> reclaim -> structure shift -> entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..config import SweepConfig
from ..functions.clock import in_killzone
from ..functions.rolling import SESSION, before, day_order, running, whole_session
from ..functions.scalars import holds
from .barriers import limit_then_touch

# Fixed value: one-way cost per unit of a stock.
STOCK_COST = 0.01
SETUP_COLUMNS = ("direction", "signal_minute", "entry", "stop", "target", "used_fvg")


def index_order() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy("idx")


def bar_index(bars: DataFrame) -> DataFrame:
    """Zero-based position of each bar within its session."""
    order = Window.partitionBy(*SESSION).orderBy("minute")
    return bars.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def _extreme(column: str, wing: int, centre: int, above: bool) -> Column:
    """Strictly above (or below) ``wing`` neighbours on each side of the bar ``centre`` rows back."""
    order = index_order()
    middle = F.lag(column, centre).over(order)
    sides = [F.lag(column, centre + k).over(order) for k in range(-wing, wing + 1) if k]
    return holds(reduce(lambda a, b: a & b, [(middle > s) if above else (middle < s) for s in sides]))


def swings(indexed: DataFrame, wing: int = 2) -> DataFrame:
    """Flag fractal swing highs and lows (each known only ``wing`` bars later)."""
    return indexed.withColumns(
        {
            "is_swing_high": _extreme("high", wing, 0, True),
            "is_swing_low": _extreme("low", wing, 0, False),
        }
    )


def fair_value_gaps(indexed: DataFrame) -> DataFrame:
    """Three-bar gaps, reported on their middle bar: kind, bottom and top (NULL when the bar has none)."""
    before_high, before_low = F.lag("high", 1).over(index_order()), F.lag("low", 1).over(index_order())
    after_high, after_low = F.lead("high", 1).over(index_order()), F.lead("low", 1).over(index_order())
    bull, bear = after_low > before_high, after_high < before_low
    return indexed.withColumns(
        {
            "fvg": F.when(bull, "bull").when(bear, "bear"),
            "fvg_bottom": F.when(bull, before_high).when(bear, after_high),
            "fvg_top": F.when(bull, after_low).when(bear, before_low),
        }
    )


def last_swing_before(flagged: DataFrame) -> DataFrame:
    """Index of the latest swing high and low strictly before each bar."""
    past = before(index_order())
    return flagged.withColumns(
        {
            f"last_{side}": F.last(F.when(F.col(f"is_{side}"), F.col("idx")), ignorenulls=True).over(past)
            for side in ("swing_high", "swing_low")
        }
    )


def prior_day_levels(daily: DataFrame) -> DataFrame:
    """High and low of each ticker's previous traded day."""
    order = day_order()
    return daily.select(
        *SESSION, F.lag("high", 1).over(order).alias("pdh"), F.lag("low", 1).over(order).alias("pdl")
    )


def with_prior_levels(bars: DataFrame, daily: DataFrame) -> DataFrame:
    levels = prior_day_levels(daily).filter(F.col("pdh").isNotNull() & F.col("pdl").isNotNull())
    return bars.join(levels, list(SESSION))


def fresh_sweeps(indexed: DataFrame) -> DataFrame:
    """Add ``sweep``: +1 on a fresh poke below the prior-day low, else -1 on one above its high, else NULL."""
    prev_low, prev_high = F.lag("low", 1).over(index_order()), F.lag("high", 1).over(index_order())
    first = F.col("idx") == 0
    below = (F.col("low") < F.col("pdl")) & (first | (prev_low >= F.col("pdl")))
    above = (F.col("high") > F.col("pdh")) & (first | (prev_high <= F.col("pdh")))
    return indexed.withColumn("sweep", F.when(below, 1).when(above, -1))


def _structure(indexed: DataFrame, wing: int) -> DataFrame:
    """Per bar and side, what a reader standing on that bar may use: the last confirmed swing, whether the close
    breaks it, and the last three-bar gap completed so far."""
    past, upto = before(index_order()), running(index_order())
    two_back_high, two_back_low = F.lag("high", 2).over(index_order()), F.lag("low", 2).over(index_order())
    bull = holds(F.col("low") > two_back_high)
    bear = holds(F.col("high") < two_back_low) & ~bull
    # A swing `wing` rows back is confirmed by the bar it is read on.
    marked = indexed.withColumns(
        {
            "swing_up": F.when(
                _extreme("high", wing, wing, True),
                F.struct((F.col("idx") - wing).alias("at"), F.lag("high", wing).over(index_order()).alias("px")),
            ),
            "swing_down": F.when(
                _extreme("low", wing, wing, False),
                F.struct((F.col("idx") - wing).alias("at"), F.lag("low", wing).over(index_order()).alias("px")),
            ),
            "gap_up": F.when(bull, F.struct(F.col("idx").alias("at"), two_back_high.alias("px"))),
            "gap_down": F.when(bear, F.struct(F.col("idx").alias("at"), two_back_low.alias("px"))),
        }
    )
    return marked.withColumns(
        {
            "ref_up": F.last("swing_up", ignorenulls=True).over(past),
            "ref_down": F.last("swing_down", ignorenulls=True).over(past),
            "gap_up": F.last("gap_up", ignorenulls=True).over(upto),
            "gap_down": F.last("gap_down", ignorenulls=True).over(upto),
        }
    )


def sweep_entries(bars: DataFrame, daily: DataFrame, config: SweepConfig = SweepConfig()) -> DataFrame:
    """Every sweep that completes into an entry: direction, signal bar, entry and stop, before any target.

    Works inside one (ticker, date) partitioning. The bars that shift structure are gathered per session into an
    array the killzone bounds (31 five-minute bars by default); each sweep then looks up the first one it may use.
    """
    zone = bar_index(bars.filter(in_killzone(config.killzone_start, config.killzone_end)))
    enough = F.count(F.lit(1)).over(whole_session()) >= 2 * config.wing + 3
    full = with_prior_levels(zone.withColumn("enough", enough).filter("enough"), daily)
    rows = _structure(fresh_sweeps(full), config.wing)
    ahead = index_order().rowsBetween(0, config.sweep_lookback)

    def shift(side: str, broken: Column) -> Column:
        ref, gap = F.col(f"ref_{side}"), F.col(f"gap_{side}")
        return F.when(
            holds(broken),
            F.struct(
                F.col("idx").alias("at"),
                ref["at"].alias("ref"),
                F.col("minute").alias("minute"),
                F.col("close").alias("close"),
                F.when(gap["at"] >= ref["at"] + 2, gap["px"]).alias("gap_px"),
            ),
        )

    up = shift("up", F.col("close") > F.col("ref_up.px"))
    down = shift("down", F.col("close") < F.col("ref_down.px"))
    session = whole_session()
    reclaim_up = F.min(F.when(F.col("close") > F.col("pdl"), F.col("idx"))).over(ahead)
    reclaim_down = F.min(F.when(F.col("close") < F.col("pdh"), F.col("idx"))).over(ahead)
    direction = F.col("sweep")
    long = direction == 1
    gathered = rows.withColumns(
        {
            "reclaim": F.when(long, reclaim_up).otherwise(reclaim_down),
            "ups": F.collect_list(up).over(session),
            "downs": F.collect_list(down).over(session),
        }
    ).filter(direction.isNotNull() & F.col("reclaim").isNotNull())
    shifts = F.sort_array(F.when(long, F.col("ups")).otherwise(F.col("downs")))
    usable = F.filter(shifts, lambda s: (s["at"] > F.col("reclaim")) & (s["ref"] >= F.col("idx")))
    found = gathered.withColumn("s", F.get(usable, F.lit(0))).filter(F.col("s").isNotNull())
    if config.require_fvg:
        found = found.filter(F.col("s.gap_px").isNotNull())

    extreme = F.when(long, F.col("low")).otherwise(F.col("high"))
    entry = F.coalesce("s.gap_px", "s.close")
    risk = F.abs(entry - extreme)
    return found.filter(risk > 0).select(
        *SESSION,
        "idx",
        direction.alias("direction"),
        F.col("s.minute").alias("signal_minute"),
        entry.alias("entry"),
        (extreme - direction * config.stop_buffer_frac * risk).alias("stop"),
        F.col("s.gap_px").isNotNull().alias("used_fvg"),
        "pdh",
        "pdl",
    )


def sweep_setups(entries: DataFrame, configs: tuple[SweepConfig, ...] = (SweepConfig(),)) -> DataFrame:
    """First entry of each session whose target lies beyond it, once per target setting.

    ``configs`` differ in their target only; the entries are computed once and each is tried under every setting.
    """
    choices = [
        F.struct(F.lit(c.setting).alias("setting"), F.lit(c.rr if c.target_mode == "fixed_rr" else None).cast("double").alias("rr"))
        for c in configs
    ]
    direction = F.col("direction")
    level = F.when(direction == 1, F.col("pdh")).otherwise(F.col("pdl"))
    multiple = F.col("entry") + direction * F.col("rr") * F.abs(F.col("entry") - F.col("stop"))
    tried = entries.select("*", F.inline(F.array(*choices))).withColumn("target", F.coalesce(multiple, level))
    valid = tried.filter(direction * (F.col("target") - F.col("entry")) > 0)
    first = Window.partitionBy("setting", *SESSION).orderBy("idx")
    ranked = valid.withColumn("nth", F.row_number().over(first))
    return ranked.filter(F.col("nth") == 1).select("setting", *SESSION, *SETUP_COLUMNS)


def sweep_trades(
    bars: DataFrame,
    daily: DataFrame,
    configs: tuple[SweepConfig, ...] = (SweepConfig(),),
    costs: DataFrame | float = STOCK_COST,
) -> DataFrame:
    """Setups filled and closed within the day under each setting, with their result in risk multiples."""
    setups = sweep_setups(sweep_entries(bars, daily, configs[0]), configs)
    closed = limit_then_touch(setups, bars, ("setting", *SESSION, *SETUP_COLUMNS))
    return with_r_multiple(closed, costs)


def with_r_multiple(closed: DataFrame, costs: DataFrame | float = STOCK_COST) -> DataFrame:
    """r = (price move - cost both ways) / initial risk; the equity at risk cancels out.

    ``costs`` is one cost per unit, or a table (ticker, unit_cost); a ticker that it does not list costs STOCK_COST.
    """
    cost = F.lit(costs) if not isinstance(costs, DataFrame) else F.coalesce("unit_cost", F.lit(STOCK_COST))
    if isinstance(costs, DataFrame):
        closed = closed.join(costs.select("ticker", "unit_cost"), "ticker", "left")
    stop_dist = F.abs(F.col("entry") - F.col("stop"))
    move = F.col("direction") * (F.col("exit") - F.col("entry")) - 2 * cost
    return closed.filter(stop_dist > 0).withColumn("r_multiple", move / stop_dist).drop("unit_cost")


def compound_r(
    trades: DataFrame, start_equity: float = 10_000.0, risk_frac: float = 0.01, keys: tuple[str, ...] = ("setting", "ticker")
) -> DataFrame:
    """Equity after each trade when a fixed fraction is risked: a running product over the ticker's days."""
    order = Window.partitionBy(*keys).orderBy("date")
    growth = 1 + risk_frac * F.col("r_multiple")
    after = start_equity * F.product(growth).over(running(order))
    start = F.coalesce(start_equity * F.product(growth).over(before(order)), F.lit(start_equity))
    return trades.withColumns({"equity": after, "pnl": after - start})
