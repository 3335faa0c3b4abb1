"""Stateful streams: price alerts, deferred alerts, what is new in feeds, weekly accumulators, position ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.text import market_session
from barloom.operators.alerts import CLOSE_HOUR, LEAST, MORNING_HOUR, STEP, TAILS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _local(ts: pd.Timestamp) -> pd.Timestamp:
    """In the zone whose calendar day counts."""
    return ts + pd.Timedelta(hours=9)


class _Alerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "period string, direction string, top double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # the rows of one key and micro-batch, in order: what the caller's trigger lets in
        every = pd.concat(list(rows)).sort_values(["ts", "change_pct"])
        period, direction, top = self.state.get() if self.state.exists() else ("", "", 0.0)
        fired = []
        for ts, change in zip(every["ts"], every["change_pct"], strict=True):
            at = _local(ts)
            now, way, size = f"{at.date()} {int(at.hour >= CLOSE_HOUR)}", "up" if change > 0 else "down", abs(change)
            if now < period:  # a late row of a day or session that is over changes nothing
                continue
            if now != period:
                period, direction, top = now, "", 0.0
            if size >= LEAST and (way != direction or size >= top + STEP):
                direction, top = way, size
                fired.append((key[0], str(at.date()), ts, change, way))
        self.state.update((period, direction, top))
        yield pd.DataFrame(fired, columns=["symbol", "day", "ts", "change_pct", "direction"])

    def close(self) -> None:
        pass


def price_alerts(changes: DataFrame) -> DataFrame:
    """The stream's twin of operators.alerts.price_alerts; rows of one micro-batch may come in any order, those of earlier days are ignored."""
    told = changes.filter((F.abs("change_pct") >= LEAST) & (market_session(F.col("ts")) != "CLOSED"))
    return told.groupBy("symbol").transformWithStateInPandas(_Alerts(), "symbol string, day string, ts timestamp, change_pct double, direction string", "Append", "None")


_DEFERRED = ["symbol", "d", "alert_at", "change_pct", "abs_pct", "direction"]


class _Deferred(StatefulProcessor):
    """One pending alert for each symbol, which its morning takes: by a later row of the same batch, or else by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")
        self.pending = handle.getValueState("pending", "closed long, morning long, change double")

    def _told(self, key) -> tuple:
        closed, morning, change = self.pending.get()
        self.pending.clear()
        return (key[0], str(pd.Timestamp(closed, unit="ms").date()), pd.Timestamp(morning, unit="ms"), round(change, 1), round(abs(change), 1), "up" if change > 0 else "down")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("ts")
        last, out = self.last.get()[0] if self.last.exists() else -1, []
        for ts, change in zip(every["ts"], every["change_pct"].tolist(), strict=True):
            ms = int(ts.value // 1_000_000)
            if ms <= last:  # closes come once each, in order: a late or repeated one changes nothing
                continue
            last = ms
            if self.pending.exists() and self.pending.get()[1] <= ms:
                out.append(self._told(key))
            if self.pending.exists():
                self.handle.deleteTimer(self.pending.get()[1])
                self.pending.clear()
            if abs(round(change, 2)) >= LEAST:
                at = _local(ts)
                morning = at.normalize() + pd.Timedelta(hours=MORNING_HOUR)
                morning = int(((morning if morning > at else morning + pd.Timedelta(days=1)) - pd.Timedelta(hours=9)).value // 1_000_000)
                self.pending.update((ms, morning, float(round(change, 2))))
                self.handle.registerTimer(morning)
        self.last.update((last,))
        yield pd.DataFrame(out, columns=_DEFERRED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.pending.exists() and self.pending.get()[1] <= expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([self._told(key)] if due else [], columns=_DEFERRED)

    def close(self) -> None:
        pass


def deferred_alerts(closes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Large closes (symbol, ts, change_pct), told once, at the next MORNING_HOUR, unless another close comes before it.

    The pending alert and its timer are in the state store, so a restarted stream tells neither twice nor not at all.
    """
    kinds = "symbol string, d string, alert_at timestamp, change_pct double, abs_pct double, direction string"
    return closes.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(_Deferred(), kinds, "Append", "EventTime")


class _Latest(StatefulProcessor):
    """The hashes of each feed's latest reading that had anything new."""

    def __init__(self, sizes: dict[str, int], size: int):
        self.sizes, self.size = sizes, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["read_at", "position"])
        seen, out = [r[0] for r in self.seen.get()], []
        for _, reading in every.groupby("read_at", sort=True):
            fresh = reading[~reading["hash"].isin(seen)]
            if len(fresh):
                out.append(fresh)
                seen = reading["hash"].head(self.sizes.get(key[0], self.size)).tolist()
        self.seen.put([(h,) for h in seen])
        yield pd.concat(out)[["feed", "read_at", "position", "hash"]] if out else every.head(0)[["feed", "read_at", "position", "hash"]]

    def close(self) -> None:
        pass


#: How many of a reading's hashes are kept, by feed.
KEPT_HASHES = {"news": 20, "insider": 30, "filings": 15}


def new_in_feed(readings: DataFrame, sizes: dict[str, int] = KEPT_HASHES, size: int = 20) -> DataFrame:
    """feed, read_at, position, hash of what is new in each reading of a feed (feed, read_at, position, hash).

    New is what the latest reading with anything new didn't have among its first hashes: an old item that comes back is new again.
    """
    told = readings.select("feed", "read_at", "position", "hash")
    return told.groupBy("feed").transformWithStateInPandas(_Latest(sizes, size), "feed string, read_at timestamp, position int, hash string", "Append", "None")


class _Weekly(StatefulProcessor):
    """A week's accumulators of one reading: number, sum and the last values, which a new week empties."""

    def __init__(self, tails: dict[str, int], tail: int):
        self.tails, self.tail = tails, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "week string, n long, total double")
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        week, n, total = self.totals.get() if self.totals.exists() else ("", 0, 0.0)
        ring, most, out = [r[0] for r in self.ring.get()] if n else [], self.tails.get(key[0], self.tail), []
        told = lambda: (week, key[0], n, round(total / n, 2), ",".join(str(round(v, 2)) for v in ring))
        every = pd.concat(list(rows)).sort_values(["ts", "value"])
        for ts, value in zip(every["ts"], every["value"], strict=True):
            now = str((ts - pd.Timedelta(days=ts.weekday())).date())
            if now < week:  # that week has been told
                continue
            if now != week:
                if n:
                    out.append(told())
                week, n, total, ring = now, 0, 0.0, []
            n, total, ring = n + 1, total + value, [*ring, value][-most:]
        if n:
            out.append(told())
            self.totals.update((week, n, total))
            self.ring.put([(v,) for v in ring])
        yield pd.DataFrame(out, columns=["week", "name", "n", "average", "last"])

    def close(self) -> None:
        pass


def weekly_readings(readings: DataFrame, tails: dict[str, int] = TAILS, tail: int = 5) -> DataFrame:
    """The stream's twin of operators.alerts.weekly_readings: a week's values after each micro-batch, and once more when it ends."""
    return readings.groupBy("name").transformWithStateInPandas(_Weekly(tails, tail), "week string, name string, n long, average double, last string", "Update", "None")


class _Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "shares double, paid double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        shares, paid = self.state.get() if self.state.exists() else (0.0, 0.0)
        for part in rows:
            shares += float(part["shares"].sum())
            paid += float((part["shares"] * part["price"]).sum())
        self.state.update((shares, paid))
        yield pd.DataFrame([(key[0], shares, round(paid / shares, 4) if shares else None)], columns=["symbol", "shares", "avg_price"])

    def close(self) -> None:
        pass


def ledger(trades: DataFrame) -> DataFrame:
    """Each symbol's position after every micro-batch of trades (symbol, shares, price)."""
    return trades.groupBy("symbol").transformWithStateInPandas(_Ledger(), "symbol string, shares double, avg_price double", "Update", "None")


def seen_once(news: DataFrame, delay: str = "7 days") -> DataFrame:
    """News (ts, hash, ...) whose hash hasn't come before within the delay."""
    return news.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])
