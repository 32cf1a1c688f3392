"""Streams: limits that do not depend on batches or restarts, windows, dedupe and merge."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadloom.streaming import incremental, limits

SHAPE = "id long, user string, at timestamp"


def arrivals(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def one_by_one(rows, seconds, most):
    """What a cooldown by user, then a cap a day, let through of rows in their order."""
    last, days, out = {}, {}, []
    for i, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if user in last and (at - last[user]).total_seconds() < seconds:
            continue
        last[user] = at
        if days.get(at.date(), 0) < most:
            days[at.date()] = days.get(at.date(), 0) + 1
            out.append(i)
    return out


def test_limits_with_restarts_equal_one_walk(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 3, 1)
    rows = sorted(((i, rng.choice("aabc"), start + timedelta(minutes=rng.randint(0, 6 * 1440))) for i in range(400)), key=lambda r: r[2])
    rows += [(1000, "a", rows[50][2]), (1001, "a", rows[50][2])]  # equal times
    late = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randint(0, 100)))  # out of order by less than the delay
    parts = [late[k : k + 80] for k in range(0, len(late), 80)]
    final = max(r[2] for r in rows) - timedelta(hours=2)
    want = one_by_one([r for r in rows if r[2] < final], 3 * 3600, 4)

    def run(name, deliveries):
        folder = f"{tmp_path}/{name}"
        for delivery in deliveries:
            arrivals(spark, f"{folder}/in", delivery)
            stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in").withWatermark("at", "2 hours")
            kept = limits.capped_per_day(limits.cooled_down(stream, "user", "at", "id", 3 * 3600), None, "at", "id", 4, spread=3)
            incremental.run_available(kept, f"{folder}/out", f"{folder}/checkpoint")
        return sorted(r["id"] for r in spark.read.parquet(f"{folder}/out").collect())

    with limits.rocksdb(spark):
        assert run("whole", [parts]) == sorted(want)
        assert run("restarted", [[p] for p in parts]) == sorted(want)


def test_windows_drop_late_rows_and_dedupe_repeats(spark, tmp_path):
    base = datetime(2024, 3, 1)
    first = [(i, "u", base + timedelta(hours=i)) for i in range(60)]
    arrivals(spark, f"{tmp_path}/in", [first])
    for late in ([], first[:5]):
        if late:
            arrivals(spark, f"{tmp_path}/in", [late])
        stream = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        counts = incremental.windowed_counts(stream, "at", "1 day", delay="1 hour").select(F.col("window.start").alias("start"), "n")
        incremental.run_available(counts, f"{tmp_path}/windows", f"{tmp_path}/w")
        incremental.run_available(incremental.first_seen(stream, "id", "at", "2 hours"), f"{tmp_path}/once", f"{tmp_path}/o")
    assert sorted((r["start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/windows").collect()) == [(base, 24), (base + timedelta(days=1), 24)]
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == list(range(60))


def test_merge_by_stream(spark, tmp_path):
    for k in (0, 1):
        arrivals(spark, f"{tmp_path}/in", [[(k, "a", datetime(2024, 1, 1 + k)), (5, "b", datetime(2024, 1, 1))]])
        stream = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        incremental.merge_available(stream, f"{tmp_path}/table", f"{tmp_path}/c")
    incremental.compact(spark, f"{tmp_path}/table", f"{tmp_path}/compact", "user", "at")
    for path in ("table", "compact"):
        assert sorted((r["user"], r["id"]) for r in incremental.merged(spark, f"{tmp_path}/{path}", "user", "at").collect()) == [("a", 1), ("b", 5)]


def test_keys_share_states_and_rows_keep_their_values(spark, tmp_path):
    """calls to the state store grew with the keys. Large numbers beside nulls must not become floats."""
    base, n = datetime(2024, 3, 1), 2_000
    rows = [(2**60 + i, f"u{i}", base + timedelta(seconds=i), None if i % 3 else 2**60 + 1) for i in range(n)]
    rows += [(n, "end", base + timedelta(days=2), None)]
    shape = f"{SHAPE}, k long"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in").withWatermark("at", "1 hour")
    with limits.rocksdb(spark):
        kept = limits.cooled_down(stream, "user", "at", "id", 3600)
        run = kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 3 * 256
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "user", "at", "k").collect()) == sorted(rows[:n])
