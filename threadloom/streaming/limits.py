"""Limits that remember: cooldowns, caps and quotas over a stream, decided in the order of event time.

Rows wait in the first limit's state until the watermark has passed them; then they go on marked as ``decided`` at that
watermark, and no earlier row can follow. So what limits let through depends neither on how the input was cut into batches
nor on restarts: state and timers come back from the checkpoint. State goes when it can no longer matter. Limits follow one
another as stateful operators of one query, and each counts what it lets through itself.

Keys share ``BUCKETS`` states by their hash, each with one timer: a call to the state store serves all keys of a bucket, not
one key, and rows wait as frames, not one by one. In frames a row is JSON, as pandas has no integers with nulls.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where a session's streams must keep the state of this kind of operator.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: States of an operator; a checkpoint keeps to the number it was begun with.
BUCKETS = 256


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, streams of the session keep their state in RocksDB, as limits need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: The time at which a row was decided: the watermark of that moment.
DECIDED = "decided"

#: Times in rows as JSON keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: What limits need of a row: itself, its key as text, its time in microseconds, and what decides between equal times.
FRAME = ["row", "key", "at", "id"]


class _InOrder(StatefulProcessor):
    """Rows of each key of a bucket in the order of (time, id): once the watermark has passed them, or at once if they are decided already."""

    def __init__(self, waits: bool, cooldown: int | None, most: int | None):
        self.waits, self.cooldown, self.most = waits, cooldown, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.waits:
            self.waiting = handle.getListState("waiting", "rows binary")
        self.passed = handle.getValueState("passed", "keys binary")
        self.timer = handle.getValueState("timer", "at long")

    def _sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["at", "id"], kind="stable")

    def _let_through(self, due: pd.DataFrame, now: int) -> tuple[pd.DataFrame, int | None]:
        """The rows that pass, marked; the time, in milliseconds, when nothing of what was kept of the keys matters any more."""
        known: dict[str, tuple[int, int]] = pickle.loads(self.passed.get()[0]) if self.passed.exists() else {}
        cooldown, kept = None if self.cooldown is None else self.cooldown * 1_000_000, []
        for key, t in zip(due["key"].tolist(), due["at"].tolist(), strict=True):
            last, n = known.get(key, (None, 0))
            passes = (cooldown is None or last is None or t - last >= cooldown) and (self.most is None or n < self.most)
            if passes:
                known[key] = t, n + 1
            kept.append(passes)
        # a cooldown that is over, or a day that is, needs no memory
        live = cooldown if cooldown is not None else 2 * 86_400_000_000
        known = {k: v for k, v in known.items() if v[0] + live > now * 1000}
        if known:
            self.passed.update((pickle.dumps(known),))
        elif self.passed.exists():
            self.passed.clear()
        rows = due["row"][kept].reset_index(drop=True)
        passed = pd.DataFrame({"row": rows, DECIDED: pd.Series(pd.Timestamp(now, unit="ms", tz="UTC"), index=rows.index, dtype="datetime64[ns, UTC]")})
        return passed, max(t for t, _ in known.values()) // 1000 + live // 1000 + 1 if known else None

    def _wake(self, at: int | None) -> None:
        """One timer a bucket: whatever else is due is handled with it. Others that were set before are passed over."""
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.waits:
            frames = [f if self.most is None else self._sorted(f).groupby("key", sort=False).head(self.most) for f in rows]
            passed, end = self._let_through(self._sorted(pd.concat(frames)), now)
            before = self.timer.get()[0] if self.timer.exists() else None
            if end is not None and (before is None or before <= now):
                self._wake(end)
            yield passed
            return
        first = None
        for frame in rows:
            least = int(frame["at"].min())
            first = least if first is None else min(first, least)
            self.waiting.appendValue((pickle.dumps(frame[FRAME]),))
        before = self.timer.get()[0] if self.timer.exists() else None
        at = max(first // 1000, now) + 1
        if before is None or at < before:
            self._wake(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        held = [pickle.loads(f) for (f,) in self.waiting.get()] if self.waits and self.waiting.exists() else []
        own = pd.concat(held) if held else pd.DataFrame(columns=FRAME)
        is_due = own["at"] // 1000 < now
        rest = own[~is_due]
        passed, end = self._let_through(self._sorted(own[is_due]), now)
        if len(rest):
            self.waiting.put([(pickle.dumps(rest),)])
            self._wake(int(rest["at"].min()) // 1000 + 1)
        else:
            if held:
                self.waiting.clear()
            self._wake(end)
        if len(passed):
            yield passed


def _limited(stream: DataFrame, keys: Sequence[str], at: str, order: str, cooldown: int | None, most: int | None) -> DataFrame:
    waits = DECIDED not in stream.columns
    row = F.struct(*[c for c in stream.columns if c != DECIDED])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    own = stream.select(F.col(at if waits else DECIDED).alias("time"), F.to_json(row, _JSON).alias("row"), F.to_json(F.struct(*keys)).alias("key"), F.unix_micros(at).alias("at"), F.col(order).alias("id"), bucket.alias("bucket"))
    out = T.StructType([own.schema["row"], T.StructField(DECIDED, T.TimestampType())])
    shape = T.StructType([f for f in stream.schema.fields if f.name != DECIDED])
    limited = own.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_InOrder(waits, cooldown, most), outputStructType=out, outputMode="append", timeMode="eventTime", eventTimeColumnName=DECIDED
    )
    return limited.select(F.from_json("row", shape, _JSON).alias("row"), DECIDED).select("row.*", DECIDED)


def cooled_down(stream: DataFrame, key: str, at: str, order: str, seconds: int) -> DataFrame:
    """Rows of a key that lie at least so many seconds after the last row of that key that was let through, and when they were decided."""
    return _limited(stream, [key], at, order, seconds, None)


def capped_per_day(stream: DataFrame, key: str | None, at: str, order: str, most: int, spread: int = 16) -> DataFrame:
    """The first rows of each key (or of all, without one) and UTC day, up to the cap, and when they were decided.

    Rows are capped in ``spread`` parts of a key first, so that what meets in one place is that many times the cap at most.
    """
    own = stream.withColumns({"__day": F.to_date(at), "__part": F.pmod(F.xxhash64(order), F.lit(spread)).cast("int")})
    keys = [*([key] if key else []), "__day"]
    parts = _limited(own, [*keys, "__part"], at, order, None, most) if spread > 1 else own
    return _limited(parts, keys, at, order, None, most).drop("__day", "__part")
