"""Purchase histories as state: what is known of each item after every micro-batch, in whatever order receipts arrive.

State is keyed by item: the days it was bought on, and a summary that a new latest day only
adds to. A day that arrives late changes the gaps around it, so then the summary is worked
out again from the item's days. No watermark drops anything: a receipt counts whenever it
comes. Copies of a receipt are told by a state of their own, whose entries live for a
stated time from the first copy's arrival.

Both need the RocksDB state store: see state_session.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basketry.operators import recency as R

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000

HISTORY = "item_id {}, first_d date, last_d date, purchases long, qty long, avg_gap double, ewma double, due boolean, changes long"


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with the state store that keyed state needs; the given one stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(PROVIDER, ROCKSDB)
    return own


def folded(days: list[int], alpha: float) -> tuple[int, int, int, float | None]:
    """First and last of sorted days, their number, and the exponentially weighted gap."""
    ewma = None
    for a, b in zip(days, days[1:]):
        ewma = float(b - a) if ewma is None else alpha * (b - a) + (1 - alpha) * ewma
    return days[0], days[-1], len(days), ewma


class ItemHistory(StatefulProcessor):
    """(item_id, d, qty) to a row of HISTORY for each item in a batch. With reminders, a timer runs out when the next purchase is to be expected, and gives a row that is due."""

    def __init__(self, alpha: float = 0.3, reminders: bool = False):
        self.alpha, self.reminders = alpha, reminders

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "qty long")
        self.summary = handle.getValueState("summary", "first int, last int, n long, qty long, ewma double, changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for df in rows:
            for d, qty in zip(df["d"], df["qty"]):
                if d is not None and not pd.isna(d):
                    day = (d - _EPOCH).days
                    new[day] = new.get(day, 0) + (0 if pd.isna(qty) else int(qty))
        if not new:
            return
        first, last, n, total, ewma, changes = self.summary.get() if self.summary.exists() else (None, None, 0, 0, None, 0)
        late = False
        for day in sorted(new):
            known = bool(n) and day <= last and self.days.containsKey((day,))
            total += new[day]
            self.days.updateValue((day,), (new[day] + (self.days.getValue((day,))[0] if known else 0),))
            if known:
                continue
            if not n:
                first = day
            elif day < last:
                late = True
            else:
                ewma = float(day - last) if ewma is None else self.alpha * (day - last) + (1 - self.alpha) * ewma
            last, n = max(day, last) if n else day, n + 1
        if late:
            first, last, n, ewma = folded(sorted(k[0] for k in self.days.keys()), self.alpha)
        state = (first, last, n, total, ewma, changes + 1)
        self.summary.update(state)
        if self.reminders:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, (tuple, list)) else at)
            if n > 1:
                self.handle.registerTimer(max(int((last + (last - first) / (n - 1)) * DAY_MS), timerValues.getCurrentProcessingTimeInMs() + 1))
        yield self._row(key, *state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.summary.exists():
            yield self._row(key, *self.summary.get(), True)

    def _row(self, key, first, last, n, total, ewma, changes, due) -> pd.DataFrame:
        gap = (last - first) / (n - 1) if n > 1 else 0.0
        date = lambda day: _EPOCH + dt.timedelta(int(day))
        return pd.DataFrame({"item_id": [key[0]], "first_d": [date(first)], "last_d": [date(last)], "purchases": [int(n)], "qty": [int(total)], "avg_gap": [gap], "ewma": [0.0 if ewma is None or pd.isna(ewma) else float(ewma)], "due": [due], "changes": [int(changes)]})

    def close(self) -> None:
        pass


class FirstArrival(StatefulProcessor):
    """The first row to arrive of each key, of those in one batch the least source; the key is known for `keep` milliseconds from then."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "row_known boolean", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = min(((s or "", r) for df in rows for s, r in zip(df["source"], df["row"])), default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame({"row": [first[1]]})

    def close(self) -> None:
        pass


def histories(events: DataFrame, alpha: float = 0.3, reminders: bool = False) -> DataFrame:
    """Of a stream (item_id, d, qty), after every batch the items in it as they stand: first_d, last_d, purchases (days), qty, avg_gap, ewma; due only from reminders. Rows without an item or a date go. Output mode: update."""
    rows = events.where("item_id IS NOT NULL AND d IS NOT NULL").select("item_id", F.col("d").cast("date").alias("d"), F.col("qty").cast("long").alias("qty"))
    schema = HISTORY.format(rows.schema["item_id"].dataType.simpleString())
    return rows.groupBy("item_id").transformWithStateInPandas(ItemHistory(alpha, reminders), schema, "update", "processingTime" if reminders else "none")


def batch_histories(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The same of all events at once, without state."""
    rows = events.where("item_id IS NOT NULL AND d IS NOT NULL").groupBy("item_id", "d").agg(F.coalesce(F.sum("qty"), F.lit(0)).cast("long").alias("qty")).withColumn("buy", F.lit(1))
    known = R.with_ewma_gap(R.with_gaps(rows), alpha)
    ends = known.groupBy("item_id").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("purchases"), F.sum("qty").alias("qty"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap"), F.max_by("ewma", "d").alias("ewma"))
    return ends


def latest_histories(updates: DataFrame) -> DataFrame:
    """Of all rows that a stream of histories has written, each item's last."""
    columns = [c for c in updates.columns if c not in ("item_id", "due", "changes")]
    last = updates.where("NOT due").groupBy("item_id").agg(F.max_by(F.struct(*columns), "changes").alias("s"))
    return last.select("item_id", "s.*")


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", timed: bool = False, most_seconds: float = 3600):
    """Run over all that has arrived; each batch is written to a folder of its own, again over what a broken run may have left there. timed is for streams with timers or times to live: those always have a next batch, so the run is stopped after one that finds no new rows. Returns the ended query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    if not timed:
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
        return run
    run, end = writer.trigger(processingTime="0 seconds").start(), time.monotonic() + most_seconds
    # The batches without rows that follow the last one with rows.
    idle: set[int] = set()
    while run.isActive and time.monotonic() < end and len(idle) < 3:
        for now in run.recentProgress:
            idle = idle | {now["batchId"]} if not now["numInputRows"] else {x for x in idle if x > now["batchId"]}
        run.awaitTermination(0.5)
    run.stop()
    if run.exception() is not None:
        raise run.exception()
    return run


def first_arrivals(parsed: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Of a stream with a source, the rows whose keys didn't arrive within that time before (such as "30 days"), by arrival and not by any date in the rows. Output mode: append."""
    n, unit = keep.split()
    ms = int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}[unit.rstrip("s")]
    slim = parsed.select(*keys, "source", F.to_json(F.struct(*parsed.columns), {"ignoreNullFields": "false"}).alias("row"))
    found = slim.groupBy(*keys).transformWithStateInPandas(FirstArrival(ms), "row string", "append", "processingTime")
    return found.select(F.from_json("row", parsed.schema).alias("r")).select("r.*")
