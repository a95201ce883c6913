"""Monitoring of a forecast service: the same functions take a batch table or a stream.

Input rows carry an event time `ts`. On a stream every windowed function sets its watermark and can
run in append mode; on a batch table the watermark does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridtide.operators.derive import energy_density
from gridtide.operators.stats import prefix_sums

# Histogram bounds and alert thresholds of the service.
ENERGY_BUCKETS = (0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 5.0, 10.0)
SHIFT_BUCKETS = (-1.0, -0.5, -0.25, -0.1, -0.05, -0.025, 0.0, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
SCALE_BUCKETS = (0.5, 0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0)
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
DURATION_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
REFUSED_SHARE = 0.2
BLOW_UP_RATIO = 2.0
COLLAPSE_RATIO = 0.5
SHIFT_LIMIT = 0.1
SCALE_LIMITS = (0.7, 1.5)
ABSENT_SECONDS = 300
REFUSED = 503

WATERMARK = "10 minutes"
PANE = "1 minute"


def _timed(rows: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return rows.withWatermark("ts", delay) if rows.isStreaming else rows


def _seconds(column: str = "window.start") -> Column:
    return F.unix_timestamp(F.col(column))


def sliding(rows: DataFrame, keys: list[str], sums: dict[str, Column], length: str, slide: str = PANE) -> DataFrame:
    """Sums over sliding windows, (start, keys, sums); `start` in seconds since the epoch.

    Rows are summed once per pane of `slide`, and only panes are copied into the windows they
    belong to: a busy key costs one row per pane, not one per event and window.
    """
    panes = _timed(rows).groupBy(F.window("ts", slide), *keys).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    at = panes.withColumn("at", F.window_time("window")).drop("window")
    return at.groupBy(F.window("at", length, slide), *keys).agg(
        *[F.sum(n).alias(n) for n in sums]
    ).select(_seconds().alias("start"), *keys, *sums)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


def no_probes(rows: DataFrame) -> DataFrame:
    """Synthetic requests stay out of the metrics."""
    return rows.filter(~F.coalesce(F.col("probe"), F.lit(False)))


# --- drift of contexts, energy of blocks ----------------------------------------------------------


def context_drift(contexts: DataFrame, reference: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, request_id, channel, shift, scale) of contexts against training statistics.

    `reference` is one row (m_u_x, s_u_x, m_u_y, s_u_y), static on a stream.
    """
    per = _timed(contexts).groupBy(F.window("ts", window), "request_id").agg(
        *[F.avg(c).alias(f"a_{c}") for c in ("u_x", "u_y")],
        *[F.stddev_pop(c).alias(f"d_{c}") for c in ("u_x", "u_y")],
    )
    both = per.join(F.broadcast(reference))  # one row
    entry = lambda c: F.struct(
        F.lit(c).alias("channel"),
        ((F.col(f"a_{c}") - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("shift"),
        (F.col(f"d_{c}") / F.col(f"s_{c}")).alias("scale"),
    )
    return both.select(
        _seconds().alias("start"), F.window_time("window").alias("ts"), "request_id",
        F.explode(F.array(entry("u_x"), entry("u_y"))).alias("e"),
    ).select("start", "ts", "request_id", "e.channel", "e.shift", "e.scale")


def energy_ratio(contexts: DataFrame, blocks: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, request_id, block, ratio): a block's mean energy over its context's.

    Both sides are reduced per window and request, then meet in an equi-join; a context without
    energy gives no ratio. On streams both reductions keep their watermarks and the join is one of two streams: a
    window's ratios come out, in append mode, once both watermarks have passed it.
    """
    before = _timed(contexts).groupBy(F.window("ts", window), "request_id").agg(
        F.avg(energy_density()).alias("context_energy")
    )
    after = _timed(blocks).groupBy(F.window("ts", window), "request_id", "block").agg(
        F.avg(energy_density()).alias("block_energy")
    )
    return (
        after.join(before, ["window", "request_id"])
        .filter("context_energy > 0")
        .select(
            _seconds().alias("start"), F.window_time("window").alias("ts"), "request_id", "block",
            (F.col("block_energy") / F.col("context_energy")).alias("ratio"),
        )
    )


# --- histograms -----------------------------------------------------------------------------------


def _at_most(value: Column, bounds) -> dict[str, Column]:
    """One 0/1 column per upper bound, and one for all."""
    return {
        **{f"le_{i}": _flag(value <= bound) for i, bound in enumerate(bounds)},
        "le_inf": F.lit(1).cast("long"),
    }


def _packed(counts: DataFrame, bounds) -> Column:
    return F.array(*[F.col(f"le_{i}") for i in range(len(bounds))], F.col("le_inf"))


def bucket_counts(rows: DataFrame, value: str, bounds, keys: list[str], window: str) -> DataFrame:
    """(start, keys, le, count): cumulative bucket counts per tumbling window, +Inf last."""
    steps = _at_most(F.col(value), bounds)
    wide = _timed(rows).groupBy(F.window("ts", window), *keys).agg(
        *[F.sum(c).alias(n) for n, c in steps.items()]
    )
    edges = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    return wide.select(
        _seconds().alias("start"), *keys,
        F.explode(F.arrays_zip(edges.alias("le"), _packed(wide, bounds).alias("count"))).alias("b"),
    ).select("start", *keys, "b.le", "b.count")


def bucket_quantile(counts: Column, bounds, q: float) -> Column:
    """Quantile from cumulative counts, linear inside the bucket.

    In the open last bucket it is the largest finite bound; a first bucket with a positive bound
    starts at 0, one without has no width. NaN without observations.
    """
    total = F.element_at(counts, -1)
    rank = q * total
    i = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    upper = F.element_at(edges, i)
    lower = F.when(i > 1, F.element_at(edges, F.greatest(i - 1, F.lit(1)))).otherwise(
        0.0 if bounds[0] > 0 else float(bounds[0])
    )
    below = F.when(i > 1, F.element_at(counts, F.greatest(i - 1, F.lit(1)))).otherwise(0)
    inside = F.element_at(counts, i) - below
    estimate = F.when(inside > 0, lower + (upper - lower) * (rank - below) / inside).otherwise(lower)
    return (
        F.when(total <= 0, float("nan"))
        .when(i > len(bounds), float(bounds[-1]))
        .otherwise(estimate)
    )


def quantile_windows(
    rows: DataFrame, value: str, bounds, quantiles: dict[str, float], keys: list[str], length: str, slide: str = PANE
) -> DataFrame:
    """(start, keys, total, one column per quantile) over sliding windows, from mergeable buckets."""
    counts = sliding(rows, keys, _at_most(F.col(value), bounds), length, slide)
    packed = counts.select("start", *keys, F.col("le_inf").alias("total"), _packed(counts, bounds).alias("c"))
    return packed.select(
        "start", *keys, "total",
        *[bucket_quantile(F.col("c"), bounds, q).alias(n) for n, q in quantiles.items()],
    )


# --- counts and alerts ----------------------------------------------------------------------------


def request_counts(requests: DataFrame, length: str = "15 minutes") -> DataFrame:
    keys = ["route", "method", "status"]
    return sliding(no_probes(requests), keys, {"requests": F.lit(1).cast("long")}, length)


def saturation_alert(requests: DataFrame, length: str = "15 minutes", limit: float = REFUSED_SHARE) -> DataFrame:
    """Share of refused requests per route, firing above the limit."""
    sums = {"requests": F.lit(1).cast("long"), "refused": _flag(F.col("status") == REFUSED)}
    share = F.col("refused") / F.col("requests")
    return sliding(no_probes(requests), ["route"], sums, length).select(
        "start", "route", share.alias("share"), (share > limit).alias("firing")
    )


def failure_alert(requests: DataFrame, length: str = "15 minutes") -> DataFrame:
    """Fires while a window holds a request whose row is marked `failed`."""
    sums = {"failures": _flag(F.col("failed"))}
    return sliding(no_probes(requests), ["route"], sums, length).withColumn("firing", F.col("failures") > 0)


def blow_up_alert(ratios: DataFrame, length: str = "15 minutes", limit: float = BLOW_UP_RATIO) -> DataFrame:
    """Any block above `limit` times its context's energy (NaN counts)."""
    sums = {"blocks": F.lit(1).cast("long"), "blown_up": _flag(~(F.col("ratio") <= limit))}
    return sliding(ratios, [], sums, length).withColumn("firing", F.col("blown_up") > 0)


def collapse_alert(ratios: DataFrame, length: str = "1 hour", limit: float = COLLAPSE_RATIO, slide: str = PANE) -> DataFrame:
    """Median block ratio below `limit`."""
    table = quantile_windows(ratios, "ratio", ENERGY_BUCKETS, {"median": 0.5}, [], length, slide)
    return table.withColumn("firing", F.coalesce(F.col("median") < limit, F.lit(False)))


def drift_alerts(drift: DataFrame, length: str = "1 hour", slide: str = PANE) -> DataFrame:
    """(start, channel, alert, low, high, firing): mean shift and scale beyond their limits."""
    tails = {"low": 0.05, "high": 0.95}
    shift = quantile_windows(drift, "shift", SHIFT_BUCKETS, tails, ["channel"], length, slide)
    scale = quantile_windows(drift, "scale", SCALE_BUCKETS, tails, ["channel"], length, slide)
    return shift.select(
        "start", "channel", F.lit("shift").alias("alert"), "low", "high",
        ((F.col("high") > SHIFT_LIMIT) | (F.col("low") < -SHIFT_LIMIT)).alias("firing"),
    ).unionByName(
        scale.select(
            "start", "channel", F.lit("scale").alias("alert"), "low", "high",
            ((F.col("high") > SCALE_LIMITS[1]) | (F.col("low") < SCALE_LIMITS[0])).alias("firing"),
        )
    )


def absence_gaps(samples: DataFrame, source: str, limit_seconds: int = ABSENT_SECONDS) -> DataFrame:
    """(source, last_ts, next_ts, gap): silences longer than the limit in a finished table.

    Only the first and last sample of a second can bound a silence, so seconds are reduced first;
    neighbours are found inside days, and the days' ends close the gaps between.
    """
    if limit_seconds < 1:
        raise ValueError(f"limit_seconds must be >= 1, got {limit_seconds}")
    us = F.unix_micros("ts")
    seconds = samples.groupBy(F.col(source).alias("source"), F.floor(us / 1_000_000).alias("second")).agg(
        F.min(us).alias("first"), F.max(us).alias("last")
    ).withColumn("day", F.floor(F.col("second") / 86400))
    inside = Window.partitionBy("source", "day").orderBy("second")
    days = seconds.groupBy("source", "day").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    between = Window.partitionBy("source").orderBy("day")
    gaps = seconds.select(
        "source", F.lag("last").over(inside).alias("last_us"), F.col("first").alias("next_us")
    ).unionByName(
        days.select("source", F.lag("last").over(between).alias("last_us"), F.col("first").alias("next_us"))
    )
    gap = (F.col("next_us") - F.col("last_us")) / 1e6
    return gaps.select("source", "last_us", "next_us", gap.alias("gap")).filter(F.col("gap") > limit_seconds)


def absence_monitor(samples: DataFrame, source: str, limit_seconds: int = ABSENT_SECONDS) -> DataFrame:
    """Stream of (source, state, last_us): "absent" once a source is silent for the limit, "present"
    when it is first heard or comes back.

    The timer runs on processing time: with every source silent no event moves event time on.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, _ = state.get
            state.update((last, True))
            yield pd.DataFrame({"source": [key[0]], "state": ["absent"], "last_us": [last]})
            return
        last, absent = state.get if state.exists else (-1, True)
        for batch in batches:
            last = max(last, int(batch["us"].max()))
        if absent:
            yield pd.DataFrame({"source": [key[0]], "state": ["present"], "last_us": [last]})
        state.update((last, False))
        state.setTimeoutDuration(limit_seconds * 1000)

    return (
        samples.select(F.col(source).alias("source"), F.unix_micros("ts").alias("us"))
        .groupBy("source")
        .applyInPandasWithState(
            step, "source string, state string, last_us long", "last_us long, absent boolean",
            "append", "ProcessingTimeTimeout",
        )
    )


class _Silences(StatefulProcessor):
    """Per source the spans in which it was heard, apart by more than the limit, and a timer for its next silence.

    A silence is final, and given, once samples `lateness_seconds` later have come or the source has fallen silent itself;
    what arrives for it later changes nothing. The state holds the spans that are not final and the last one.
    """

    def __init__(self, limit_seconds: int, lateness_seconds: int, clock_seconds: int) -> None:
        self.limit, self.lateness, self.clock = limit_seconds * 1_000_000, lateness_seconds * 1_000_000, clock_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "firsts array<bigint>, lasts array<bigint>, final bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        firsts, lasts, final, timer = self._state() if self.spans.exists() else ([], [], -(2**63), None)
        for batch in rows:
            us = np.sort(batch["us"].to_numpy())
            us = us[us >= final]
            if len(us):
                cut = np.flatnonzero(np.diff(us) > self.limit)
                firsts += us[np.concatenate(([0], cut + 1))].tolist()
                lasts += us[np.concatenate((cut, [len(us) - 1]))].tolist()
                firsts, lasts = self._merged(firsts, lasts)
        if not firsts:
            return
        done = [i for i in range(len(firsts) - 1) if firsts[i + 1] <= lasts[-1] - self.lateness]
        out = self._rows(key, [(lasts[i], firsts[i + 1]) for i in done])
        firsts, lasts = firsts[len(done):], lasts[len(done):]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.clock
        self.handle.registerTimer(timer)
        self.spans.update((firsts, lasts, firsts[0] if done else final, timer))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        firsts, lasts, final, _ = self._state()
        self.spans.update((firsts[-1:], lasts[-1:], firsts[-1] if len(firsts) > 1 else final, None))
        yield self._rows(key, [*zip(lasts[:-1], firsts[1:], strict=True), (lasts[-1], None)])

    def _state(self) -> tuple[list[int], list[int], int, int | None]:
        firsts, lasts, final, timer = self.spans.get()
        return list(firsts), list(lasts), final, timer

    def _merged(self, firsts: list[int], lasts: list[int]) -> tuple[list[int], list[int]]:
        a, b = [], []
        for first, last in sorted(zip(firsts, lasts, strict=True)):
            if b and first - b[-1] <= self.limit:
                b[-1] = max(b[-1], last)
            else:
                a.append(first)
                b.append(last)
        return a, b

    def _rows(self, key, gaps: list[tuple]) -> pd.DataFrame:
        # Plain objects: a column of pandas' own strings would reach Arrow in chunks.
        return pd.DataFrame({
            "source": pd.Series([key[0]] * len(gaps), dtype=object), "last_us": pd.Series([g[0] for g in gaps], dtype="int64"), "next_us": pd.Series([g[1] for g in gaps], dtype=object),
        })

    def close(self) -> None:
        pass


def silences(
    samples: DataFrame, source: str, limit_seconds: int = ABSENT_SECONDS, lateness_seconds: int = 600, clock_seconds: int | None = None
) -> DataFrame:
    """Stream of (source, last_us, next_us): silences longer than the limit.

    A silence that has ended has both its ends, in event time, whatever the order of arrival within `lateness_seconds`. One
    that lasts has no `next_us`: it is given when nothing came for `clock_seconds` (the limit, unless samples are replayed
    faster than they were taken), as no event moves event time on while every source is silent. It needs a state store
    that keeps timers, see `runs.run_until_silent`.
    """
    if limit_seconds < 1:
        raise ValueError(f"limit_seconds must be >= 1, got {limit_seconds}")
    return (
        samples.select(F.col(source).alias("source"), F.unix_micros("ts").alias("us"))
        .groupBy("source")
        .transformWithStateInPandas(
            _Silences(limit_seconds, lateness_seconds, limit_seconds if clock_seconds is None else clock_seconds), "source string, last_us bigint, next_us bigint", "update", "processingTime",
        )
    )


# --- running state --------------------------------------------------------------------------------


def running_moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and M2 per key; on a stream, kept up to date in update mode."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")
    )


def block_monitor(blocks: DataFrame, reference: DataFrame, block_steps: int, max_ratio: float) -> DataFrame:
    """Running stability per (dataset, member) as block means arrive, in any order.

    `blocks` is (dataset, member, block, quantity, value), `reference` (dataset, quantity, top). The
    state is a minimum and maxima, so a late or repeated block changes nothing it shouldn't.
    """
    ratio = F.col("value") / F.col("top")
    failing = F.min(F.when(~(ratio <= max_ratio), F.col("block")))
    return blocks.join(reference, ["dataset", "quantity"]).groupBy("dataset", "member").agg(
        (F.max("block") + 1).alias("blocks"),
        (failing * block_steps).cast("double").alias("first_failing_step"),
        F.max(F.when(F.col("quantity") == "energy", ratio)).alias("energy_peak_ratio"),
        F.max(F.when(F.col("quantity") == "enstrophy", ratio)).alias("enstrophy_peak_ratio"),
    )


# --- validity -------------------------------------------------------------------------------------


def context_verdicts(contexts: DataFrame, nx: int, ny: int, min_frames: int, max_frames: int, window: str = "1 day") -> DataFrame:
    """(start, request_id, frames, reason): NULL reason for a usable context."""
    cell = F.struct("t", "x", "y")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    facts = _timed(contexts).groupBy(F.window("ts", window), "request_id").agg(
        F.count("*").alias("cells"),
        (F.max("t") - F.min("t") + 1).alias("frames"),
        F.count_if(bad("u_x") | bad("u_y")).alias("bad_values"),
        F.count_if(~(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))).alias("outside"),
        F.max(cell).alias("_last"),
    )
    reason = (
        F.when(F.col("outside") > 0, "cells outside the grid")
        .when(F.col("cells") != F.col("frames") * nx * ny, "incomplete frames")
        .when(F.col("bad_values") > 0, "values not finite")
        .when(F.col("frames") < min_frames, "too few frames")
        .when(F.col("frames") > max_frames, "too many frames")
    )
    return facts.select(_seconds().alias("start"), "request_id", "frames", reason.alias("reason"))


def row_reason(nx: int, ny: int) -> Column:
    """Why a single row can't be used, NULL if it can: decided on arrival, without state."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(
        ~(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)), "cell outside the grid"
    ).when(bad("u_x") | bad("u_y"), "value not finite")


def divert_invalid(stream: DataFrame, nx: int, ny: int, good: str, quarantine: str, checkpoint: str):
    """Start a stream that splits rows into two tables. A batch is written under its id, so a
    repeated batch replaces itself."""

    def split(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("reason", row_reason(nx, ny)).persist()
        try:
            marked.filter("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            marked.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        finally:
            marked.unpersist()

    return (
        stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- panels ---------------------------------------------------------------------------------------


def rate_panel(requests: DataFrame, length: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """(start, status, per_second, frames_per_second)."""
    sums = {"requests": F.lit(1).cast("long"), "frames": F.col("frames").cast("long")}
    table = sliding(no_probes(requests), ["status"], sums, length)
    return table.select(
        "start", "status", (F.col("requests") / seconds).alias("per_second"), (F.col("frames") / seconds).alias("frames_per_second")
    )


def trouble_panel(requests: DataFrame, length: str = "1 hour") -> DataFrame:
    """(start, failures, refusals) per hour."""
    sums = {"failures": _flag(F.col("failed")), "refusals": _flag(F.col("status") == REFUSED)}
    return sliding(no_probes(requests), [], sums, length)


def in_flight(requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minute, in_flight): forecasts running at each minute's end, where it changes.

    Starts and ends are netted per minute first; a running sum follows over minutes only.
    """
    minute = lambda us: F.floor(us / 60_000_000)
    start = F.unix_micros("ts")
    end = start + F.round(F.col("latency") * 1_000_000).cast("long")
    change = F.explode(
        F.array(
            F.struct(minute(start).alias("t"), F.lit(1.0).alias("value")),
            F.struct(minute(end).alias("t"), F.lit(-1.0).alias("value")),
        )
    )
    net = requests.select(*keys, change.alias("c")).groupBy(*keys, F.col("c.t").alias("t")).agg(
        F.sum("c.value").alias("value")
    )
    return prefix_sums(net, keys, block=1440).select(
        *keys, F.col("t").alias("minute"), F.col("prefix").cast("long").alias("in_flight")
    )
