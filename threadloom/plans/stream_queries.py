"""Streams over the events: written as files that arrive one after another, some rows out of order, late or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.registry import query
from threadloom.scratch import Scratch
from threadloom.streaming import incremental, limits

ARRIVALS = 4
DELAY = "12 hours"


def _events(table) -> DataFrame:
    return table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _arrivals(events: DataFrame, folder: str) -> list[DataFrame]:
    """Parts of a month in the order in which they arrive, rows up to six hours too late; written one after another."""
    at = F.floor((F.day(F.col("ts") - F.make_interval(hours=(F.col("event_id") % 7).cast("int"))) - 1) / 8)
    parts = [events.where(at == k) for k in range(ARRIVALS)]
    for part in parts:
        part.write.mode("append").parquet(folder)
    return parts


def _stream(spark: SparkSession, folder: str, events: DataFrame, files: int = 8) -> DataFrame:
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


#: What the watermark has passed at the end, to the millisecond.
PASSED = "epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 43200000"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, (props->>'$.k')::BIGINT AS k FROM events WHERE {PASSED}), r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
UNION ALL SELECT e.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR GROUP BY 1), c AS (SELECT e.* FROM e JOIN r USING (user_id, ts) QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, ts::DATE ORDER BY ts, event_id) <= 1) SELECT event_id, user_id, k FROM v QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 20""")
def stream_limits(spark, table):
    """A user's cooldown of six hours, one row a k and day, twenty rows a day: three limits in one stream."""
    with Scratch(spark, "limits") as scratch, limits.rocksdb(spark):
        events = _events(table).select("event_id", "user_id", "k", "ts")
        _arrivals(events, f"{scratch.root}/in")
        stream = _stream(spark, f"{scratch.root}/in", events).withWatermark("ts", DELAY)
        cooled = limits.cooled_down(stream, "user_id", "ts", "event_id", 6 * 3600)
        kept = limits.capped_per_day(limits.capped_per_day(cooled, "k", "ts", "event_id", 1), None, "ts", "event_id", 20)
        incremental.run_available(kept, f"{scratch.root}/out", f"{scratch.root}/checkpoint")
        return scratch.result(spark.read.parquet(f"{scratch.root}/out").select("event_id", "user_id", "k"))


@query(f"""SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ts::DATE, 2 HAVING epoch_ms((ts::DATE + INTERVAL 1 DAY)::TIMESTAMP) <= (SELECT max(epoch_ms(ts)) FROM events) - 43200000""")
def stream_windows(spark, table):
    """Events per day and type, once the watermark has passed the day; then the first days' rows come again, too late, to a second run."""
    with Scratch(spark, "windows") as scratch:
        events = _events(table)
        _arrivals(events, f"{scratch.root}/in")
        for late in (False, True):
            if late:
                events.where(F.day("ts") <= 3).write.mode("append").parquet(f"{scratch.root}/in")
            counts = incremental.windowed_counts(_stream(spark, f"{scratch.root}/in", events), "ts", "1 day", "event_type", delay=DELAY)
            incremental.run_available(counts.select(F.col("window.start").alias("start"), "event_type", "n"), f"{scratch.root}/out", f"{scratch.root}/checkpoint")
        return scratch.result(spark.read.parquet(f"{scratch.root}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"))


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedupe(spark, table):
    """Every third event arrives again with the next part, every seventh at the end: each comes out once."""
    with Scratch(spark, "dedupe") as scratch:
        events = _events(table)
        for part in _arrivals(events, f"{scratch.root}/in"):
            part.where("event_id % 3 = 0").write.mode("append").parquet(f"{scratch.root}/in")
        events.where("event_id % 7 = 0").write.mode("append").parquet(f"{scratch.root}/in")
        kept = incremental.first_seen(_stream(spark, f"{scratch.root}/in", events, 16), "event_id", "ts", DELAY)
        incremental.run_available(kept.select("event_id", "user_id", "event_type"), f"{scratch.root}/out", f"{scratch.root}/checkpoint")
        return scratch.result(spark.read.parquet(f"{scratch.root}/out"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_merge(spark, table):
    """Files that arrive in any order, merged batch by batch, then read by key: the last row of each user."""
    with Scratch(spark, "merge") as scratch:
        events = table("events").select("user_id", "event_id")
        for k in (1, 0, 2):
            events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{scratch.root}/in")
        stream = _stream(spark, f"{scratch.root}/in", events, 4)
        incremental.merge_available(stream, f"{scratch.root}/table", f"{scratch.root}/checkpoint")
        return scratch.result(incremental.merged(spark, f"{scratch.root}/table", "user_id", "event_id"))
