"""Non-overlapping trades from a stream of decisions: what ``thin_events`` does with a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BAR_MINUTES, HOLD, HORIZON_BARS, LONG, CostModel
from ..functions.clock import exchange_instant
from ..functions.rolling import SESSION
from ..operators.intraday import TARGET

WAIT = BAR_MINUTES * HORIZON_BARS
_DAY_MS = 24 * 60 * 60 * 1000
_SIGNAL = "minute int, direction string, fwd double, q10 double"
_KEPT = f"ticker string, date date, {_SIGNAL}"
# Timers need a state store that keeps several column families.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OnePosition(StatefulProcessor):
    """Per session: the minute of the last kept signal, and the signals that an earlier one could still precede.

    A signal is judged once the watermark has passed its bar, so the order of arrival does not matter; both states are
    dropped a day after the session's last signal. A session has at most one signal for each five-minute bar.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "minute int")
        self.waiting = handle.getMapState("waiting", "at long", _SIGNAL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, minute, direction, fwd, q10 in zip(frame["at"], frame["minute"], frame["direction"], frame["fwd"], frame["q10"]):
                if at > passed and not self.waiting.containsKey((int(at),)):
                    self.waiting.updateValue((int(at),), (int(minute), direction, float(fwd), None if pd.isna(q10) else float(q10)))
                    self.handle.registerTimer(int(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, kept = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted((at[0], tuple(signal)) for at, signal in self.waiting.iterator() if at[0] <= passed)
        for at, signal in due:
            self.waiting.removeKey((at,))
            if not self.last.exists() or signal[0] >= self.last.get()[0] + WAIT:
                self.last.update((signal[0],))
                kept.append((*key, *signal))
        if due:
            self.handle.registerTimer(due[-1][0] + _DAY_MS)
        elif not list(self.waiting.keys()):
            self.last.clear()
        if kept:
            yield pd.DataFrame(kept, columns=[c.split()[0] for c in _KEPT.split(", ")])


def stream_thin_events(decided: DataFrame, costs: CostModel = CostModel(), delay: str = "1 hour") -> DataFrame:
    """Trades of ``thin_events`` as a stream: ticker, date, minute, direction, gross_ret, net_ret, q10.

    Holds and rows without a forward return drop out; a bar that arrives twice counts once; a row later than the
    watermark (``delay`` behind the newest bar) is lost. Each session is one key, so no ticker meets one task alone.
    """
    q10 = F.col("q10") if "q10" in decided.columns else F.lit(None).cast("double")
    signals = decided.filter((F.col("decision") != HOLD) & F.col(TARGET).isNotNull()).select(
        *SESSION, "minute", F.col("decision").alias("direction"), F.col(TARGET).alias("fwd"), q10.alias("q10"),
        exchange_instant(F.col("date"), F.col("minute")).alias("bar_ts"),
    )
    timed = signals.withWatermark("bar_ts", delay).withColumn("at", F.unix_millis("bar_ts"))
    kept = timed.groupBy(*SESSION).transformWithStateInPandas(
        statefulProcessor=OnePosition(), outputStructType=_KEPT, outputMode="Append", timeMode="EventTime"
    )
    gross = F.when(F.col("direction") == LONG, F.col("fwd")).otherwise(-F.col("fwd"))
    return kept.select(*SESSION, "minute", "direction", gross.alias("gross_ret"), (gross - costs.round_trip_cost).alias("net_ret"), "q10")
