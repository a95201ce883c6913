import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.sources import store
from gridtide.streaming import monitor, runs

START = datetime(2024, 1, 1)


def stream_of(spark, df, folder, files=1):
    df.repartition(files).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def minutes(*offsets):
    return [START + timedelta(minutes=m) for m in offsets]


def quantile(bounds, counts, q):
    """Reference form: linear inside the first bucket that reaches the rank."""
    total = counts[-1]
    if total == 0:
        return np.nan
    rank = q * total
    i = next(k for k, c in enumerate(counts) if c >= rank)
    if i == len(bounds):
        return bounds[-1]
    if i == 0 and bounds[0] <= 0:
        return bounds[0]
    low, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
    return low if counts[i] == below else low + (bounds[i] - low) * (rank - below) / (counts[i] - below)


@pytest.mark.parametrize("bounds", [monitor.ENERGY_BUCKETS, monitor.SHIFT_BUCKETS])
def test_bucket_quantiles(spark, rng, bounds):
    for v in (rng.normal(0.5, 1, 200), np.full(9, 99.0), np.full(9, bounds[0] - 1), np.array([])):
        counts = [int((v <= b).sum()) for b in bounds] + [len(v)]
        df = spark.createDataFrame([(counts,)], "c array<long>")
        for q in (0.05, 0.5, 0.95):
            got = df.select(monitor.bucket_quantile(F.col("c"), bounds, q)).first()[0]
            np.testing.assert_allclose(got, quantile(bounds, counts, q))


def test_sliding_windows_equal_direct_ones(spark, rng):
    times = [START + timedelta(seconds=float(s)) for s in rng.uniform(0, 7200, 300)]
    df = spark.createDataFrame([(t, "ab"[i % 3 == 0], 1) for i, t in enumerate(times)], "ts timestamp, k string, one int")
    got = monitor.sliding(df, ["k"], {"n": F.col("one")}, "15 minutes")
    want = df.groupBy(F.window("ts", "15 minutes", "1 minute"), "k").agg(F.sum("one").alias("n")).select(
        F.unix_timestamp("window.start").alias("start"), "k", "n"
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def requests(spark, rows):
    full = [(t, "/f", "POST", s, s == 1, 0.1, 5, p) for t, s, p in rows]
    return spark.createDataFrame(full, "ts timestamp, route string, method string, status int, failed boolean, latency double, frames int, probe boolean")


def test_alerts_fire_only_when_they_should(spark):
    t = minutes(*range(10))
    quiet = requests(spark, [(x, 503 if i < 2 else 200, False) for i, x in enumerate(t)])
    loud = requests(spark, [(x, 503 if i < 4 else 200, False) for i, x in enumerate(t)])
    probes = requests(spark, [(x, 503, True) for x in t] + [(x, 200, False) for x in t])
    whole = int(START.timestamp()) - 5 * 60
    for df, share in ((quiet, 0.2), (loud, 0.4), (probes, 0.0)):
        row = monitor.saturation_alert(df).filter(F.col("start") == whole).first()
        assert row.share == pytest.approx(share) and row.firing == (share > 0.2)
    ratio = lambda *v: spark.createDataFrame(list(zip(minutes(*range(len(v))), v)), "ts timestamp, ratio double")
    assert not monitor.blow_up_alert(ratio(2.0, 1.0)).filter("firing").count()
    assert monitor.blow_up_alert(ratio(1.0, 2.1)).filter("firing").count()
    assert monitor.blow_up_alert(ratio(float("nan"))).filter("firing").count()
    fall = monitor.collapse_alert(ratio(*[0.4] * 9)).filter("total = 9")
    assert {r.firing for r in fall.collect()} == {True}
    drift = spark.createDataFrame([(t, "u_x", 0.3, 1.0) for t in minutes(*range(9))], "ts timestamp, channel string, shift double, scale double")
    fired = {(r.alert, r.firing) for r in monitor.drift_alerts(drift).filter(F.col("start") == whole).collect()}
    assert fired == {("shift", True), ("scale", False)}


def test_stream_and_batch_agree(spark, tmp_path, rng):
    times = [START + timedelta(seconds=float(s)) for s in np.sort(rng.uniform(0, 4 * 3600, 400))]
    df = requests(spark, [(t, [200, 503, 1][i % 3], i % 7 == 0) for i, t in enumerate(times)])
    stream = stream_of(spark, df, tmp_path / "in")
    got = runs.run_to_table(monitor.request_counts(stream), "counts")
    closed = int(times[-1].timestamp()) - 600 - 60
    keep = F.col("start") + 900 < closed
    want = monitor.request_counts(df).filter(keep)
    got = got.filter(keep)
    assert want.count() > 500 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_energy_ratio_joins_two_streams(spark, tmp_path):
    schema = "ts timestamp, request_id string, block int, u_x double, u_y double"
    rows = [(START + timedelta(days=d, hours=h), f"r{r}", h // 6, 1.0 + h, 0.0) for d in range(4) for h in (1, 7, 13) for r in range(3)]
    df = spark.createDataFrame(rows, schema)
    stream = stream_of(spark, df, tmp_path / "in")
    ratio = lambda s: monitor.energy_ratio(s.filter("block = 0"), s.filter("block > 0"))
    got = {(r.start, r.request_id, r.block): r.ratio for r in runs.run_to_table(ratio(stream), "ratio").collect()}
    want = {(r.start, r.request_id, r.block): r.ratio for r in ratio(df).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    first = int(START.timestamp())
    assert got[first, "r0", 1] == pytest.approx(64 / 4) and len({k[0] for k in got}) >= 2


def test_running_moments_over_many_batches(spark, tmp_path, rng):
    v = rng.normal(5, 2, 90)
    df = spark.createDataFrame([(["a", "b"][i % 2], float(x)) for i, x in enumerate(v)], "k string, value double")
    stream = stream_of(spark, df, tmp_path / "in", files=4)
    got = {r.k: r for r in runs.run_updates(monitor.running_moments(stream, ["k"], "value"), ["k"], "moments").collect()}
    for i, k in enumerate("ab"):
        part = v[i::2]
        assert (got[k].n, got[k].mean) == (45, pytest.approx(part.mean()))
        assert got[k].m2 == pytest.approx(((part - part.mean()) ** 2).sum())


def test_block_monitor_takes_blocks_in_any_order(spark, tmp_path):
    blocks = [("d", 0, b, q, v) for b, (e, w) in enumerate([(1, 1), (1, 5), (1, 1), (9, 1)]) for q, v in (("energy", float(e)), ("enstrophy", float(w)))]
    df = spark.createDataFrame(blocks[::-1], "dataset string, member int, block int, quantity string, value double")
    tops = spark.createDataFrame([("d", "energy", 1.0), ("d", "enstrophy", 2.0)], "dataset string, quantity string, top double")
    stream = stream_of(spark, df, tmp_path / "in", files=3)
    row = runs.run_updates(monitor.block_monitor(stream, tops, 100, 2.0), ["dataset", "member"], "blocks").first()
    assert (row.blocks, row.first_failing_step, row.energy_peak_ratio) == (4, 100, 9.0)


def test_absence_gaps_cross_seconds_and_days(spark, rng):
    at = np.sort(rng.choice(3 * 86400 * 10, 500, replace=False)) / 10.0
    df = spark.createDataFrame([(START + timedelta(seconds=float(s)), "a") for s in at], "ts timestamp, source string")
    gaps = sorted(r.gap for r in monitor.absence_gaps(df, "source").collect())
    want = sorted(g for g in np.diff(at) if g > 300)
    np.testing.assert_allclose(gaps, want, atol=1e-6)


def test_absence_monitor_reports_silence_on_processing_time(spark, tmp_path):
    df = spark.createDataFrame([(t, "a") for t in minutes(0, 1)], "ts timestamp, source string")
    stream = stream_of(spark, df, tmp_path / "in")
    query = (
        monitor.absence_monitor(stream, "source", 1).writeStream.format("memory").queryName("absence")
        .outputMode("append").trigger(processingTime="1 second").start()
    )
    try:
        for _ in range(60):
            states = [r.state for r in spark.table("absence").collect()]
            if "absent" in states:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert states[:2] == ["present", "absent"]


def test_silences_in_any_order_of_arrival(spark, tmp_path, rng):
    at = np.sort(rng.choice(4000, 60, replace=False)) / 10.0
    at = at[(at < 100) | (at > 130)]
    rows = [(START + timedelta(seconds=float(s)), name) for name in "ab" for s in (at if name == "a" else at[:5])]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "ts timestamp, source string")
    stream = stream_of(spark, df, tmp_path / "in", files=3)
    found = runs.run_until_silent(monitor.silences(stream, "source", 8, 1000), "silences", 2, 120).collect()
    base = int(START.timestamp() * 1e6)
    for name, some in (("a", at), ("b", at[:5])):
        want = [(x, y) for x, y in zip(some, some[1:]) if y - x > 8]
        got = sorted(((r.last_us - base) / 1e6, (r.next_us - base) / 1e6) for r in found if r.source == name and r.next_us is not None)
        np.testing.assert_allclose(got, want) if want else None
        assert len(got) == len(want)
        assert [(r.last_us - base) / 1e6 for r in found if r.source == name and r.next_us is None] == [pytest.approx(some[-1])]


def test_a_closed_stream_emits_every_window(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=int(37 * i)), 10 * i % 70, "click", float(i % 7), None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "sf/events.parquet"))
    day = lambda s: s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
    stream = runs.closed_event_stream(spark, str(tmp_path / "sf/events.parquet"), "*.parquet")
    got = {tuple(r) for r in runs.run_to_table(day(monitor._timed(stream)), "closed").collect()}
    assert got == {tuple(r) for r in day(df).collect()} and len(got) == 2


def test_context_verdicts_and_diverted_rows(spark, tmp_path):
    def frame(name, t, bad=None, n=4):
        return [(START, name, t, i // 2, i % 2, bad if bad is not None and i == 0 else 1.0, 0.0) for i in range(n)]
    rows = frame("ok", 0) + frame("ok", 1) + frame("short", 0) + frame("nan", 0, float("nan")) + frame("nan", 1)
    rows += frame("hole", 0, n=3) + frame("hole", 1) + frame("outside", 0) + [(START, "outside", 0, 7, 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, request_id string, t int, x int, y int, u_x double, u_y double")
    got = {r.request_id: r.reason for r in monitor.context_verdicts(df, 2, 2, 2, 5).collect()}
    assert got == {"ok": None, "short": "too few frames", "nan": "values not finite", "hole": "incomplete frames", "outside": "cells outside the grid"}
    stream = stream_of(spark, df, tmp_path / "in", files=2)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    monitor.divert_invalid(stream, 2, 2, good, bad, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(good).count() == len(rows) - 2
    assert {r.reason for r in spark.read.parquet(bad).collect()} == {"value not finite", "cell outside the grid"}


# --- stores ---------------------------------------------------------------------------------------


def test_array_files_are_read_in_slices(spark, tmp_path, rng):
    arrays = {"a": rng.normal(size=(7, 2, 3, 4)).astype("float32"), "b": rng.normal(size=(3, 2, 3, 4)).astype("float32")}
    for name, a in arrays.items():
        np.save(tmp_path / f"{name}.npy", a)
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.npy"),) for n in arrays], "path string")
    assert store.array_tasks(paths, 3).count() == 4
    rows = store.ingest_arrays(paths, 3).collect()
    assert len(rows) == 10 * 3
    for r in rows:
        np.testing.assert_array_equal(np.array(r.u_y, dtype="float32"), arrays[r.dataset][r.t, 1, r.x])


def test_store_appends_are_idempotent_and_pruned(spark, make_field, tmp_path, rng):
    field = make_field({"a": rng.normal(size=(10, 2, 2, 2)), "b": rng.normal(size=(6, 2, 2, 2))})
    path = str(tmp_path / "store")
    store.write_store(field, path, 4, overwrite=True)
    for _ in range(2):
        store.write_store(field.filter("dataset = 'b'"), path, 4)
    assert store.read_store(spark, path).count() == 16 * 2
    plan = store.read_steps(spark, path, 4, 8, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "t_chunk" in plan.split("PartitionFilters")[1]
    store.write_store(field.filter("dataset = 'a'"), path, 4, overwrite=True)
    assert store.read_store(spark, path).select("dataset").distinct().count() == 1


def test_summaries_newest_run_wins_and_old_rows_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    table = lambda *rows: spark.createDataFrame(list(rows), "dataset string, score double")
    store.write_summaries(table(("a", 1.23456), ("b", 2.0)), "check", path, run=0)
    store.write_summaries(table(("a", 5.0)), "check", path, run=1)
    got = store.comparison_table(store.read_summaries(spark, path), {"s": ("check", "score", 2), "z": ("other", "score", 2)})
    assert {(r.dataset, r.s, r.z) for r in got.collect()} == {("a", 5.0, None), ("b", 2.0, None)}
    merged = store.merge_comparison(got, got.filter("dataset = 'a'").withColumn("s", F.lit(9.0)))
    assert {(r.dataset, r.s) for r in merged.collect()} == {("a", 9.0), ("b", 2.0)}


def test_scores_keep_six_digits_and_report_what_they_drop(spark):
    values = {"a": 123456.789, "b": -0.00123456789, "c": 0.0, "d": float("nan"), "e": float("-inf")}
    df = spark.createDataFrame([("g", k, v) for k, v in values.items()], "grp string, metric string, value double")
    kept = {r.metric: r.value for r in store.finite_scores(df).collect()}
    assert kept == pytest.approx({"a": 123457.0, "b": -0.00123457, "c": 0.0})
    assert store.dropped_scores(df, ["grp"]).first().dropped == ["d", "e"]


def test_digest_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame([(i % 5, None if i == 3 else f"v{i}") for i in range(40)], "a int, b string")
    digest = lambda d: store.table_digest(d, ["a", "b"]).first().digest
    assert digest(df) == digest(df.orderBy(F.desc("b")).repartition(7))
    assert digest(df) != digest(df.unionByName(df.limit(1)))
    assert digest(df) != digest(df.withColumn("b", F.coalesce("b", F.lit("v3"))))
