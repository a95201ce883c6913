"""Queries on monitoring: events read as requests, contexts and forecast blocks of a service."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import evaluate
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.registry import query
from gridtide.plans.scoring import BLOCK, pred_physics, true_physics
from gridtide.session import materialize, work_path
from gridtide.sources import adapters as src
from gridtide.streaming import monitor, runs

NX, NY = 11, 9


def as_requests(events):
    v = F.col("value")
    return events.select(
        "ts",
        F.col("event_type").alias("route"),
        F.lit("POST").alias("method"),
        F.when(v > 60, 503).when(v > 50, 500).otherwise(200).alias("status"),
        ((v > 45) & (v <= 50)).alias("failed"),
        (F.round(v * 100).cast("long") / 1000).alias("latency"),
        F.floor("value").cast("int").alias("frames"),
        (F.col("user_id") % 10 == 0).alias("probe"),
    )


def _cells(events):
    cents = F.round(F.col("value") * 100).cast("long")
    group = F.floor(F.col("user_id") / src.USERS_PER_SERIES).cast("long").cast("string")
    return events.select(
        "ts",
        F.concat_ws("-", "event_type", group).alias("request_id"),
        F.hour("ts").alias("t"),
        (F.col("user_id") % 12).cast("int").alias("x"),
        (cents % 9).cast("int").alias("y"),
        (cents / 100).alias("u_x"),
        ((cents % 1000) / 100).alias("u_y"),
    )


def as_contexts(events):
    """Cells of the morning hours."""
    return _cells(events).filter("t < 12")


def as_blocks(events):
    """Cells of the afternoon, in three-hour blocks."""
    return _cells(events).filter("t >= 12").withColumn("block", F.floor(F.col("t") / 3).cast("int"))


def requests(spark, sf):
    return as_requests(src.events(spark, sf))


def reference(spark, sf):
    """Pooled statistics of all contexts, one row."""
    return as_contexts(src.events(spark, sf)).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("u_x", "u_y")], *[F.stddev_pop(c).alias(f"s_{c}") for c in ("u_x", "u_y")]
    )


def drift(spark, sf):
    return monitor.context_drift(as_contexts(src.events(spark, sf)), reference(spark, sf))


def ratios(spark, sf):
    events = src.events(spark, sf)
    return monitor.energy_ratio(as_contexts(events), as_blocks(events))


add_view(
    "reqs",
    """SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, epoch_us(ts) AS us, event_type AS route, 'POST' AS method,
              CASE WHEN value > 60 THEN 503 WHEN value > 50 THEN 500 ELSE 200 END AS status, value > 45 AND value <= 50 AS failed,
              CAST(round(value * 100) AS BIGINT) / 1000 AS latency, CAST(floor(value) AS INTEGER) AS frames, user_id % 10 = 0 AS probe
       FROM events""",
)
add_view(
    "cells",
    """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type || '-' || (user_id // 50) AS request_id,
              CAST(hour(ts) AS INTEGER) AS t, user_id % 12 AS x, cents % 9 AS y, cents / 100 AS u_x, (cents % 1000) / 100 AS u_y
       FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
)
add_view(
    "drift",
    """SELECT start, start + 86399 AS sec, request_id, c.channel,
              CASE c.channel WHEN 'u_x' THEN (ax - mx) / sx ELSE (ay - my) / sy END AS shift,
              CASE c.channel WHEN 'u_x' THEN dx / sx ELSE dy / sy END AS scale
       FROM (SELECT start, request_id, avg(u_x) AS ax, avg(u_y) AS ay, stddev_pop(u_x) AS dx, stddev_pop(u_y) AS dy
             FROM cells WHERE t < 12 GROUP BY 1, 2),
            (SELECT avg(u_x) AS mx, avg(u_y) AS my, stddev_pop(u_x) AS sx, stddev_pop(u_y) AS sy FROM cells WHERE t < 12),
            (VALUES ('u_x'), ('u_y')) AS c(channel)""",
)
add_view(
    "ratios",
    """SELECT b.start, b.start + 86399 AS sec, b.request_id, block, be / ce AS ratio
       FROM (SELECT start, request_id, t // 3 AS block, avg(0.5 * (u_x * u_x + u_y * u_y)) AS be FROM cells WHERE t >= 12 GROUP BY 1, 2, 3) b
       JOIN (SELECT start, request_id, avg(0.5 * (u_x * u_x + u_y * u_y)) AS ce FROM cells WHERE t < 12 GROUP BY 1, 2) c
       USING (start, request_id) WHERE ce > 0""",
)


def sql_sliding(source: str, keys: str, sums: str, minutes: int, slide: int = 1) -> str:
    """Sliding sums over rows with a second `sec`; `keys` is '' or 'a, b, '."""
    width, step = minutes // slide, slide * 60
    return f"""SELECT CAST(w.s * {step} AS BIGINT) AS start, {keys}{sums}
               FROM (SELECT *, sec // {step} AS pane FROM {source}) p, unnest(range(pane - {width - 1}, pane + 1)) AS w(s)
               GROUP BY ALL"""


def sql_quantile(source: str, value: str, bounds, keys: str, minutes: int, quantiles: dict[str, float]) -> str:
    """Bucket quantiles per sliding window."""
    edges = ", ".join(f"({float(b)}::DOUBLE)" for b in bounds) + ", ('inf'::DOUBLE)"
    low = 0.0 if bounds[0] > 0 else float(bounds[0])
    counts = f"""SELECT p.start, {keys}e.le, count(*) FILTER (WHERE v <= e.le) AS c, count(*) AS total
                 FROM (SELECT CAST(w.s * 60 AS BIGINT) AS start, {keys}{value} AS v
                       FROM (SELECT *, sec // 60 AS pane FROM {source}) q, unnest(range(pane - {minutes - 1}, pane + 1)) AS w(s)) p,
                      (VALUES {edges}) AS e(le) GROUP BY ALL"""
    picks = ", ".join(
        f"""arg_min(CASE WHEN isinf(le) THEN {float(bounds[-1])} WHEN c > below THEN lo + (le - lo) * ({q} * total - below) / (c - below) ELSE lo END, le)
            FILTER (WHERE c >= {q} * total) AS {name}"""
        for name, q in quantiles.items()
    )
    return f"""SELECT start, {keys}max(total) AS total, {picks} FROM (
                 SELECT *, coalesce(lag(c) OVER w, 0) AS below, coalesce(lag(le) OVER w, {low}) AS lo FROM ({counts})
                 WINDOW w AS (PARTITION BY {keys}start ORDER BY le)) GROUP BY ALL"""


@query(
    "context_drift",
    "J1",
    f"SELECT start, request_id, channel, {R('shift')} AS shift, {R('scale')} AS scale FROM drift",
)
def _(spark, sf):
    return rounded(drift(spark, sf).drop("ts"), "shift", "scale")


@query(
    "block_energy_ratio",
    "J2",
    f"SELECT start, request_id, CAST(block AS INTEGER) AS block, {R('ratio')} AS ratio FROM ratios",
)
def _(spark, sf):
    return rounded(ratios(spark, sf).drop("ts"), "ratio")


@query(
    "block_energy_ratio_stream",
    "J2",
    f"SELECT start, request_id, CAST(block AS INTEGER) AS block, {R('ratio')} AS ratio FROM ratios",
)
def _(spark, sf):
    # Contexts and blocks as two streams, joined in append mode; all windows of the events are closed.
    ratio = monitor.energy_ratio(as_contexts(runs.closed_event_stream(spark, sf)), as_blocks(runs.closed_event_stream(spark, sf)))
    return rounded(runs.run_to_table(ratio, "ratios").drop("ts"), "ratio")


HISTOGRAMS = {
    "latency": monitor.LATENCY_BUCKETS, "duration": monitor.DURATION_BUCKETS, "energy": monitor.ENERGY_BUCKETS,
    "shift": monitor.SHIFT_BUCKETS, "scale": monitor.SCALE_BUCKETS,
}
OBSERVED = {
    "latency": "SELECT sec, latency AS v FROM reqs", "duration": "SELECT sec, latency AS v FROM reqs",
    "energy": "SELECT sec, ratio AS v FROM ratios", "shift": "SELECT sec, shift AS v FROM drift",
    "scale": "SELECT sec, scale AS v FROM drift",
}


def observations(spark, sf):
    latency = requests(spark, sf).select("ts", F.col("latency").alias("v"))
    d = drift(spark, sf)
    return {
        "latency": latency, "duration": latency,
        "energy": ratios(spark, sf).select("ts", F.col("ratio").alias("v")),
        "shift": d.select("ts", F.col("shift").alias("v")), "scale": d.select("ts", F.col("scale").alias("v")),
    }


@query(
    "bucket_counters",
    "J3",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS name, sec // 86400 * 86400 AS start, b.le, count(*) FILTER (WHERE v <= b.le) AS count
            FROM ({OBSERVED[name]}), (VALUES {', '.join(f'({float(x)}::DOUBLE)' for x in bounds)}, ('inf'::DOUBLE)) AS b(le) GROUP BY 1, 2, 3"""
        for name, bounds in HISTOGRAMS.items()
    ),
)
def _(spark, sf):
    parts = None
    for name, rows in observations(spark, sf).items():
        one = monitor.bucket_counts(rows, "v", HISTOGRAMS[name], [], "1 day").withColumn("name", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "request_counts",
    "J4",
    sql_sliding("(SELECT * FROM reqs WHERE NOT probe)", "route, method, status, ", "CAST(count(*) AS BIGINT) AS requests", 15),
)
def _(spark, sf):
    return monitor.request_counts(requests(spark, sf))


@query(
    "saturation_alert",
    "J4",
    f"""SELECT start, route, {R('refused / requests')} AS share, refused / requests > 0.2 AS firing FROM ({sql_sliding(
        '(SELECT * FROM reqs WHERE NOT probe)', 'route, ',
        'CAST(count(*) AS DOUBLE) AS requests, count(*) FILTER (WHERE status = 503) AS refused', 15)})""",
)
def _(spark, sf):
    return rounded(monitor.saturation_alert(requests(spark, sf)), "share")


@query(
    "failure_alert",
    "J5",
    f"""SELECT *, failures > 0 AS firing FROM ({sql_sliding(
        '(SELECT * FROM reqs WHERE NOT probe)', 'route, ', 'count(*) FILTER (WHERE failed) AS failures', 15)})""",
)
def _(spark, sf):
    return monitor.failure_alert(requests(spark, sf))


@query(
    "blow_up_alert",
    "J6",
    f"""SELECT *, blown_up > 0 AS firing FROM ({sql_sliding(
        'ratios', '', 'count(*) AS blocks, count(*) FILTER (WHERE NOT ratio <= 2) AS blown_up', 15).replace('SELECT *, sec //', 'SELECT sec, ratio, sec //')})""",
)
def _(spark, sf):
    return monitor.blow_up_alert(ratios(spark, sf))


@query(
    "collapse_alert",
    "J7 J14",
    f"""SELECT start, total, {R('median')} AS median, median < 0.5 AS firing FROM (
        {sql_quantile('(SELECT sec, ratio FROM ratios)', 'ratio', monitor.ENERGY_BUCKETS, '', 60, {'median': 0.5})})""",
)
def _(spark, sf):
    return rounded(monitor.collapse_alert(ratios(spark, sf)), "median")


TAILS = {"low": 0.05, "high": 0.95}


@query(
    "drift_alerts",
    "J8 J14",
    f"""SELECT start, channel, 'shift' AS alert, {R('low')} AS low, {R('high')} AS high, high > 0.1 OR low < -0.1 AS firing FROM (
          {sql_quantile('(SELECT sec, channel, shift FROM drift)', 'shift', monitor.SHIFT_BUCKETS, 'channel, ', 60, TAILS)})
        UNION ALL
        SELECT start, channel, 'scale', {R('low')}, {R('high')}, high > 1.5 OR low < 0.7 FROM (
          {sql_quantile('(SELECT sec, channel, scale FROM drift)', 'scale', monitor.SCALE_BUCKETS, 'channel, ', 60, TAILS)})""",
)
def _(spark, sf):
    return rounded(monitor.drift_alerts(drift(spark, sf)), "low", "high")


@query(
    "absence_gaps",
    "J9",
    f"""SELECT source, last_us, next_us, {R('(next_us - last_us) / 1e6')} AS gap FROM (
          SELECT route AS source, lag(us) OVER (PARTITION BY route ORDER BY us) AS last_us, us AS next_us FROM (SELECT DISTINCT route, us FROM reqs))
        WHERE (next_us - last_us) / 1e6 > 300""",
)
def _(spark, sf):
    return rounded(monitor.absence_gaps(requests(spark, sf), "route"), "gap")


@query(
    "absence_stream",
    "J9",
    f"""SELECT source, last_us, coalesce(next_us, -1) AS next_us, coalesce({R('(next_us - last_us) / 1e6')}, -1) AS gap FROM (
          SELECT route AS source, us AS last_us, lead(us) OVER (PARTITION BY route ORDER BY us) AS next_us FROM (SELECT DISTINCT route, us FROM reqs))
        WHERE next_us IS NULL OR (next_us - last_us) / 1e6 > 300""",
)
def _(spark, sf):
    # The alert on the stream of requests, replayed, until timers have found every source silent.
    stream = as_requests(runs.event_stream(spark, sf))
    sources = requests(spark, sf).select("route").distinct().count()
    found = runs.run_until_silent(monitor.silences(stream, "route", clock_seconds=3), "absence", sources)
    # A silence that lasts has no end: -1.
    gaps = rounded(found.withColumn("gap", (F.col("next_us") - F.col("last_us")) / 1e6), "gap")
    return gaps.withColumns({"next_us": F.coalesce("next_us", F.lit(-1).cast("bigint")), "gap": F.coalesce("gap", F.lit(-1.0))})


MOMENTS_SQL = f"""SELECT event_type AS source, count(value) AS n, {R('avg(value)')} AS mean, {R('var_pop(value) * count(value)', 3)} AS m2
                  FROM events GROUP BY 1"""


@query("running_moments", "J10", MOMENTS_SQL)
def _(spark, sf):
    events = src.events(spark, sf).withColumnRenamed("event_type", "source")
    return rounded(rounded(monitor.running_moments(events, ["source"], "value"), "mean"), "m2", digits=3)


@query("running_moments_stream", "J10", MOMENTS_SQL)
def _(spark, sf):
    # The same function on the events as a stream, drained to its end.
    stream = runs.event_stream(spark, sf).withColumnRenamed("event_type", "source")
    table = runs.run_updates(monitor.running_moments(stream, ["source"], "value"), ["source"], "moments")
    return rounded(rounded(table, "mean"), "m2", digits=3)


@query(
    "request_counts_stream",
    "J4",
    sql_sliding("(SELECT * FROM reqs WHERE NOT probe)", "route, method, status, ", "CAST(count(*) AS BIGINT) AS requests", 15),
)
def _(spark, sf):
    # Append mode emits a window once the watermark has passed it; the closing events carry it past all of them.
    stream = runs.closed_event_stream(spark, sf)
    return runs.run_to_table(monitor.request_counts(as_requests(stream)), "requests")


BLOCKS_SQL = f"""SELECT dataset, member, CAST(max(block) + 1 AS INTEGER) AS blocks,
               CAST(min(CASE WHEN NOT (e / te <= 1.02 AND n / tn <= 1.02) THEN block END) * {BLOCK} AS DOUBLE) AS first_failing_step,
               {R('max(e / te)')} AS energy_peak_ratio, {R('max(n / tn)')} AS enstrophy_peak_ratio
        FROM (SELECT dataset, member, (lead - 1) // {BLOCK} AS block, avg(energy) AS e, avg(enstrophy) AS n FROM pred_phys GROUP BY 1, 2, 3)
        JOIN (SELECT dataset, max(e) AS te, max(n) AS tn FROM (
                SELECT dataset, (lead - 1) // {BLOCK} AS block, avg(energy) AS e, avg(enstrophy) AS n FROM true_phys GROUP BY 1, 2) GROUP BY 1)
        USING (dataset) GROUP BY 1, 2"""


def block_tables(data):
    """Block means of the forecast, and the largest of the truth."""
    blocks = evaluate.quantity_blocks(pred_physics(data), ["dataset", "member"], BLOCK)
    tops = evaluate.quantity_blocks(true_physics(data), ["dataset"], BLOCK).groupBy("dataset", "quantity").agg(
        F.max("value").alias("top")
    )
    return blocks, tops


@query("block_monitor", "J11", BLOCKS_SQL)
def _(spark, sf):
    found = monitor.block_monitor(*block_tables(src.Tables(spark, sf)), BLOCK, 1.02)
    return rounded(found, "energy_peak_ratio", "enstrophy_peak_ratio")


@query("block_monitor_stream", "J11", BLOCKS_SQL)
def _(spark, sf):
    # Block means arrive as files; the newest row of every member is the batch result.
    blocks, tops = block_tables(src.Tables(spark, sf, stored=True))
    path = work_path(spark, "arriving")
    blocks.write.parquet(path)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 4).parquet(path)
    found = runs.run_updates(monitor.block_monitor(stream, materialize(tops, "tops"), BLOCK, 1.02), ["dataset", "member"], "monitor")
    return rounded(found, "energy_peak_ratio", "enstrophy_peak_ratio")


@query(
    "context_verdicts",
    "J12",
    f"""SELECT start, request_id, CAST(max(t) - min(t) + 1 AS INTEGER) AS frames,
              CASE WHEN count(*) FILTER (WHERE x > {NX - 1}) > 0 THEN 'cells outside the grid'
                   WHEN count(*) <> (max(t) - min(t) + 1) * {NX * NY} THEN 'incomplete frames'
                   WHEN max(t) - min(t) + 1 < 2 THEN 'too few frames' WHEN max(t) - min(t) + 1 > 8 THEN 'too many frames' END AS reason
       FROM cells GROUP BY 1, 2""",
)
def _(spark, sf):
    return monitor.context_verdicts(_cells(src.events(spark, sf)), NX, NY, 2, 8)


@query(
    "dense_context_verdicts",
    "J12",
    f"""SELECT start, dataset AS request_id, CAST(max(t) - min(t) + 1 AS INTEGER) AS frames,
              CASE WHEN max(t) - min(t) + 1 < 12 THEN 'too few frames' WHEN max(t) - min(t) + 1 > 23 THEN 'too many frames' END AS reason
       FROM (SELECT dataset, t, CAST(epoch(TIMESTAMP '1995-01-01 00:00:00') AS BIGINT) + (t // 24) * 86400 AS start FROM field) GROUP BY 1, 2""",
)
def _(spark, sf):
    # Whole frames of a dense field as contexts: a day holds 24 of them, the last day the rest.
    start = F.unix_timestamp(F.to_timestamp(F.lit("1995-01-01 00:00:00")))
    cells = src.field(spark, sf).withColumn("ts", (start + F.col("t") * 3600).cast("timestamp")).withColumnRenamed("dataset", "request_id")
    return monitor.context_verdicts(cells, NX, NY, 12, 23)


@query(
    "row_validity",
    "J12",
    """SELECT CASE WHEN x > 10 THEN 'cell outside the grid' ELSE 'ok' END AS reason, count(*) AS n FROM cells GROUP BY 1""",
)
def _(spark, sf):
    marked = _cells(src.events(spark, sf)).withColumn("reason", F.coalesce(monitor.row_reason(NX, NY), F.lit("ok")))
    return marked.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "diverted_rows",
    "J12",
    """SELECT CASE WHEN x > 10 THEN 'cell outside the grid' ELSE 'ok' END AS reason, count(*) AS n,
              CAST(sum(CAST(t AS BIGINT)) AS BIGINT) AS steps FROM cells GROUP BY 1""",
)
def _(spark, sf):
    # The sink that splits a stream in two, drained; both tables are read back whole.
    path = work_path(spark, "diverted")
    stream = _cells(runs.event_stream(spark, sf))
    monitor.divert_invalid(stream, NX, NY, f"{path}/good", f"{path}/bad", f"{path}/checkpoint").awaitTermination()
    good = spark.read.schema(stream.schema).parquet(f"{path}/good").withColumn("reason", F.lit("ok"))
    bad = spark.read.schema(stream.schema.add("reason", "string")).parquet(f"{path}/bad")
    both = good.select("reason", "t").unionByName(bad.select("reason", "t"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.col("t").cast("bigint")).alias("steps"))


@query(
    "rate_panel",
    "J13",
    f"""SELECT start, status, {R('n / 300')} AS per_second, {R('f / 300')} AS frames_per_second FROM ({sql_sliding(
        '(SELECT * FROM reqs WHERE NOT probe)', 'status, ', 'CAST(count(*) AS DOUBLE) AS n, CAST(sum(frames) AS DOUBLE) AS f', 5)})""",
)
def _(spark, sf):
    return rounded(monitor.rate_panel(requests(spark, sf)), "per_second", "frames_per_second")


@query(
    "trouble_panel",
    "J13",
    sql_sliding(
        "(SELECT * FROM reqs WHERE NOT probe)", "",
        "count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE status = 503) AS refusals", 60,
    ).replace("SELECT *, sec //", "SELECT failed, status, sec //"),
)
def _(spark, sf):
    return monitor.trouble_panel(requests(spark, sf))


@query(
    "in_flight",
    "J13",
    """SELECT route, CAST(t AS BIGINT) AS minute, CAST(sum(d) OVER (PARTITION BY route ORDER BY t) AS BIGINT) AS in_flight FROM (
         SELECT route, t, sum(d) AS d FROM (
           SELECT route, us // 60000000 AS t, 1 AS d FROM reqs
           UNION ALL SELECT route, (us + CAST(round(latency * 1000000) AS BIGINT)) // 60000000, -1 FROM reqs) GROUP BY 1, 2)""",
)
def _(spark, sf):
    return monitor.in_flight(requests(spark, sf), ["route"])


@query(
    "latency_quantiles",
    "J14",
    f"""SELECT start, route, total, {R('p50')} AS p50, {R('p95')} AS p95 FROM (
        {sql_quantile('(SELECT sec, route, latency FROM reqs)', 'latency', monitor.LATENCY_BUCKETS, 'route, ', 60, {'p50': 0.5, 'p95': 0.95})})""",
)
def _(spark, sf):
    table = monitor.quantile_windows(
        requests(spark, sf), "latency", monitor.LATENCY_BUCKETS, {"p50": 0.5, "p95": 0.95}, ["route"], "1 hour"
    )
    return rounded(table, "p50", "p95")
