"""Queries on field tables: scans and checks, derived fields, statistics, normalization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators import derive, moments, scans, stats
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.registry import query
from gridtide.session import materialize
from gridtide.sources import adapters as src

# --- scans and checks -----------------------------------------------------------------------


@query(
    "dataset_catalog",
    "A3",
    """SELECT dataset, CAST(max(t) + 1 AS INTEGER) AS n_steps, CAST(max(x) + 1 AS INTEGER) AS nx,
              CAST(max(y) + 1 AS INTEGER) AS ny, 'u_x,u_y' AS channel_names,
              dataset || '.npy' AS source_file, 'monthly cells' AS description
       FROM field GROUP BY dataset""",
)
def _(spark, sf):
    return scans.dataset_catalog(src.field(spark, sf), "monthly cells")


@query(
    "time_scan",
    "A4",
    f"""SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM field
        WHERE t >= 6 AND t < 60 AND (t - 6) % 3 = 0""",
)
def _(spark, sf):
    return rounded(scans.time_scan(src.field(spark, sf), 6, 60, 3), "u_x", "u_y")


PROBES = "wall:0:4,core:5:4,outlet:10:8"


@query(
    "point_probe",
    "A5",
    f"""SELECT dataset, label, t, {R('u_x')} AS u_x, {R('u_y')} AS u_y
        FROM field JOIN (VALUES ('wall', 0, 4), ('core', 5, 4), ('outlet', 10, 8)) AS p(label, px, py)
        ON x = px AND y = py""",
)
def _(spark, sf):
    return rounded(scans.point_probe(src.field(spark, sf), PROBES), "u_x", "u_y")


@query(
    "dataset_selection",
    "A6",
    """SELECT dataset, position, count(*) AS cells FROM field JOIN (
         SELECT dataset, CAST(-CAST(substr(dataset, 2) AS INTEGER) AS INTEGER) AS position FROM roles WHERE role <> 'test') USING (dataset)
       GROUP BY dataset, position""",
)
def _(spark, sf):
    # Asked for in falling order of their numbers.
    only = src.roles(spark, sf).filter("role <> 'test'")
    only = only.select("dataset", (-F.substring("dataset", 2, 6).cast("int")).alias("position"))
    chosen = scans.select_datasets(src.field(spark, sf), src.catalog(spark, sf), only)
    return chosen.groupBy("dataset", "position").agg(F.count("*").alias("cells"))


@query(
    "role_guard",
    "A7",
    """SELECT dataset, 'train overlaps ' || role AS reason FROM roles WHERE role IN ('val', 'test')
       UNION ALL
       SELECT dataset, 'test dataset' FROM roles WHERE role = 'test'""",
)
def _(spark, sf):
    # The worst setup, everything as train and train-eval: reports each val and test dataset.
    roles = src.roles(spark, sf)
    every = roles.select("dataset")
    return scans.role_violations(every, every, roles)


@query(
    "raw_profile",
    "A8",
    f"""SELECT dataset, channel, count(*) AS size, {R('min(u)')} AS min, {R('max(u)')} AS max,
               {R('avg(u)')} AS mean, {R('stddev_pop(u)')} AS std,
               count(*) FILTER (WHERE isnan(u)) AS n_nan, count(*) FILTER (WHERE isinf(u)) AS n_inf
        FROM vel GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(scans.raw_profile(src.field(spark, sf)), "min", "max", "mean", "std")


@query(
    "contract_check",
    "A9",
    """SELECT dataset, 'range' AS rule, CAST(CAST(floor(max(greatest(abs(u_x), abs(u_y)))) AS BIGINT) AS VARCHAR) AS detail
       FROM field GROUP BY dataset HAVING max(greatest(abs(u_x), abs(u_y))) >= 20
       UNION ALL
       SELECT dataset, 'dense', CAST(count(*) AS VARCHAR) FROM field GROUP BY dataset
       HAVING count(*) <> (max(t) + 1) * 11 * 9""",
)
def _(spark, sf):
    return scans.contract_violations(src.field(spark, sf), src.catalog(spark, sf), src.NX, src.NY, 20.0)


@query(
    "snapshot_pick",
    "A10",
    f"""SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM field JOIN catalog USING (dataset)
        WHERE t IN (0, n_steps // 2, n_steps - 1)""",
)
def _(spark, sf):
    return rounded(scans.snapshot_pick(src.field(spark, sf), src.catalog(spark, sf)), "u_x", "u_y")


# --- derived fields ---------------------------------------------------------------------------


@query(
    "grid_spacing",
    "B1",
    f"SELECT dataset, nx, ny, {R('dx')} AS dx, {R('dy')} AS dy FROM grid",
)
def _(spark, sf):
    return rounded(
        derive.grid_spacing(src.catalog(spark, sf), src.NX, src.NY, src.LX, src.LY), "dx", "dy"
    )


GRADS = ("dux_dx", "duy_dx", "dux_dy", "duy_dy")


@query(
    "gradient",
    "B2",
    f"""SELECT dataset, t, x, y, {', '.join(f'{R(g)} AS {g}' for g in GRADS)} FROM grads""",
)
def _(spark, sf):
    g = derive.gradients(src.field(spark, sf), src.grid(spark, sf))
    return rounded(g.drop("u_x", "u_y"), *GRADS)


@query(
    "vorticity_divergence",
    "B3 B4",
    f"""SELECT dataset, t, x, y, {R('duy_dx - dux_dy')} AS vorticity,
               {R('dux_dx + duy_dy')} AS divergence FROM grads""",
)
def _(spark, sf):
    g = derive.gradients(src.field(spark, sf), src.grid(spark, sf))
    return g.select(
        "dataset", "t", "x", "y",
        r(derive.vorticity()).alias("vorticity"),
        r(derive.divergence()).alias("divergence"),
    )


@query(
    "speed",
    "B5",
    f"SELECT dataset, t, x, y, {R('sqrt(u_x * u_x + u_y * u_y)')} AS speed FROM field",
)
def _(spark, sf):
    return src.field(spark, sf).select("dataset", "t", "x", "y", r(derive.speed()).alias("speed"))


@query(
    "field_selector",
    "B6",
    f"""SELECT name, dataset, t, {R('avg(v)')} AS mean, {R('max(v)')} AS max FROM (
          SELECT 'vorticity' AS name, dataset, t, duy_dx - dux_dy AS v FROM grads
          UNION ALL SELECT 'u_x', dataset, t, u_x FROM field
          UNION ALL SELECT 'u_y', dataset, t, u_y FROM field
          UNION ALL SELECT 'speed', dataset, t, sqrt(u_x * u_x + u_y * u_y) FROM field)
        GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    parts = None
    for name in derive.FIELDS:
        one = derive.select_field(src.field(spark, sf), src.grid(spark, sf), name).groupBy("dataset", "t")
        one = one.agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("max"))
        one = one.withColumn("name", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(
    "kinetic_energy",
    "B7",
    f"SELECT dataset, t, {R('avg(0.5 * (u_x * u_x + u_y * u_y))')} AS energy FROM field GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(derive.kinetic_energy(src.field(spark, sf)), "energy")


ENSTROPHY_SQL = f"""SELECT dataset, t, {R('avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy))')} AS enstrophy
                    FROM grads GROUP BY 1, 2"""


@query("enstrophy", "B8", ENSTROPHY_SQL)
def _(spark, sf):
    return rounded(derive.enstrophy(src.field(spark, sf), src.grid(spark, sf)), "enstrophy")


@query("enstrophy_on_lines", "B2 B8", ENSTROPHY_SQL)
def _(spark, sf):
    lines = derive.to_lines(src.field(spark, sf))
    return rounded(derive.line_enstrophy(lines, src.grid(spark, sf)), "enstrophy")


@query(
    "physics_on_lines",
    "B2 B3 B4 B7 B8 B9 B10 B11",
    f"""SELECT dataset, t, {R('avg(0.5 * (u_x * u_x + u_y * u_y))')} AS energy, {R('avg(duy_dx - dux_dy)')} AS mean_vorticity,
               {R('avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy))')} AS enstrophy,
               {R('sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy)))')} AS rms_divergence,
               {R('sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy))) / (sqrt(avg(dux_dx * dux_dx + duy_dy * duy_dy)) + 1e-12)')} AS normalized,
               {R('avg(u_x)')} AS mean_u_x, {R('avg(u_y)')} AS mean_u_y
        FROM grads GROUP BY 1, 2""",
)
def _(spark, sf):
    # The field at rest as lines; every line is summed where it lies.
    lines = materialize(derive.to_lines(src.field(spark, sf)), "lines")
    found = derive.line_physics(lines, src.grid(spark, sf))
    return rounded(found, *[c for c in found.columns if c not in ("dataset", "t")])


@query(
    "fields_on_lines",
    "B5 B6 B3",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, dataset, t, x, {R(f'sum({sql})')} AS total, {R(f'max({sql})')} AS top FROM grads GROUP BY ALL"
        for name, sql in (("vorticity", "duy_dx - dux_dy"), ("speed", "sqrt(u_x * u_x + u_y * u_y)"), ("u_x", "u_x"), ("u_y", "u_y"))
    ),
)
def _(spark, sf):
    lines = materialize(derive.to_lines(src.field(spark, sf)), "lines")
    parts = [derive.line_field(lines, src.grid(spark, sf), name).withColumn("name", F.lit(name)) for name in derive.FIELDS]
    return reduce(DataFrame.unionByName, parts).select(
        "name", "dataset", "t", "x", r(F.expr("aggregate(value, 0D, (s, v) -> s + v)")).alias("total"), r(F.array_max("value")).alias("top")
    )


@query(
    "rms_divergence",
    "B9",
    f"""SELECT dataset, t, {R('sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy)))')} AS rms_divergence
        FROM grads GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(derive.rms_divergence(src.field(spark, sf), src.grid(spark, sf)), "rms_divergence")


@query(
    "normalized_divergence",
    "B10",
    f"""WITH s AS (SELECT dataset, t, sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy))) AS rms,
                   sqrt(avg(dux_dx * dux_dx + duy_dy * duy_dy)) AS sc FROM grads GROUP BY 1, 2)
        SELECT dataset, {R('avg(rms)')} AS rms_mean, {R('max(rms)')} AS rms_max,
               {R('avg(rms / (sc + 1e-12))')} AS normalized_mean,
               {R('max(rms / (sc + 1e-12))')} AS normalized_max FROM s GROUP BY 1""".replace("WITH s AS (", "SELECT * FROM (WITH s AS (", 1) + ")",
)
def _(spark, sf):
    report = derive.divergence_report(src.field(spark, sf), src.grid(spark, sf))
    return rounded(report, "rms_mean", "rms_max", "normalized_mean", "normalized_max")


@query(
    "vorticity_report",
    "B11",
    f"""SELECT dataset, {R('avg(mv)')} AS vorticity_mean, {R('stddev_pop(mv)')} AS vorticity_std,
               {R('avg(en)')} AS enstrophy_mean, {R('stddev_pop(en)')} AS enstrophy_std
        FROM (SELECT dataset, t, avg(duy_dx - dux_dy) AS mv,
                     avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy)) AS en FROM grads GROUP BY 1, 2)
        GROUP BY 1""",
)
def _(spark, sf):
    report = derive.vorticity_report(src.field(spark, sf), src.grid(spark, sf))
    return rounded(report, *report.columns[1:])


@query(
    "value_range",
    "B12",
    f"""SELECT name, dataset, {R('lo')} AS lo, {R('hi')} AS hi, {R('(hi - lo) / 2')} AS diff_limit FROM (
          SELECT 'speed' AS name, dataset, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
          FROM (SELECT dataset, sqrt(u_x * u_x + u_y * u_y) AS v FROM field) GROUP BY 1, 2
          UNION ALL
          SELECT name, dataset, -greatest(abs(lo), abs(hi)), greatest(abs(lo), abs(hi)) FROM (
            SELECT 'vorticity' AS name, dataset, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
            FROM (SELECT dataset, duy_dx - dux_dy AS v FROM grads) GROUP BY 1, 2))""",
)
def _(spark, sf):
    lines = materialize(derive.to_lines(src.field(spark, sf)), "lines")
    parts = [
        derive.value_range(lines, src.grid(spark, sf), name).withColumn("name", F.lit(name))
        for name in ("speed", "vorticity")
    ]
    return rounded(parts[0].unionByName(parts[1]), "lo", "hi", "diff_limit")


# --- statistics -------------------------------------------------------------------------------

add_view(
    "stepstats",
    """SELECT dataset, t, channel, avg(u) AS mean, stddev_pop(u) AS std, min(u) AS mn, max(u) AS mx,
              avg(0.5 * u * u) AS energy FROM vel GROUP BY 1, 2, 3""",
)


@query(
    "step_stats",
    "C1",
    f"""SELECT dataset, t, channel, {R('mean')} AS mean, {R('std')} AS std, {R('mn')} AS min,
               {R('mx')} AS max, {R('energy')} AS energy FROM stepstats""",
)
def _(spark, sf):
    return rounded(stats.step_stats(src.field(spark, sf)), "mean", "std", "min", "max", "energy")


@query(
    "energy_proxy",
    "C2",
    f"""SELECT dataset, t, {R('avg(0.5 * u_x * u_x)')} AS energy_u_x, {R('avg(0.5 * u_y * u_y)')} AS energy_u_y,
               {R('avg(0.5 * u_x * u_x) + avg(0.5 * u_y * u_y)')} AS energy FROM field GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(stats.energy_proxy(src.field(spark, sf)), "energy_u_x", "energy_u_y", "energy")


@query(
    "channel_correlation",
    "C3",
    f"""SELECT dataset, t, {R('covar_pop(u_x, u_y) / (stddev_pop(u_x) * stddev_pop(u_y) + 1e-12)')} AS correlation
        FROM field GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(stats.channel_correlation(src.field(spark, sf)), "correlation")


add_view(
    "spans",
    "SELECT dataset, channel, min(u) AS lo, max(u) AS hi, count(*) AS n FROM vel GROUP BY 1, 2",
)
add_view(
    "binned",
    """SELECT dataset, channel, CAST(b.bin AS INTEGER) AS bin, n,
              lo + b.bin * ((hi - lo) / 60) AS l, lo + (b.bin + 1) * ((hi - lo) / 60) AS r, hi
       FROM spans, range(60) AS b(bin)""",
)


@query(
    "histogram",
    "C4",
    f"""SELECT b.dataset, b.channel, b.bin, count(v.u) AS count, {R('b.l')} AS left, {R('b.r')} AS right,
               {R('count(v.u) / (b.n * (b.r - b.l))', 5)} AS density
        FROM binned b LEFT JOIN vel v ON v.dataset = b.dataset AND v.channel = b.channel
             AND v.u >= b.l AND (v.u < b.r OR b.bin = 59)
        GROUP BY b.dataset, b.channel, b.bin, b.n, b.l, b.r""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'),
)
def _(spark, sf):
    bins = stats.histogram(src.field(spark, sf))
    return rounded(rounded(bins, "left", "right"), "density", digits=5)


def channel_mean_series(spark, sf):
    s = stats.step_stats(src.field(spark, sf))
    return s.select("dataset", F.col("channel").alias("name"), "t", F.col("mean").alias("value"))


@query(
    "rolling_mean",
    "C5",
    f"""SELECT dataset, name, CAST(t - 7 + 1 + 3 AS INTEGER) AS t, 7 AS window, {R('m')} AS value FROM (
          SELECT dataset, channel AS name, t, avg(mean) OVER w AS m, count(*) OVER w AS c, n_steps
          FROM stepstats JOIN catalog USING (dataset)
          WINDOW w AS (PARTITION BY dataset, channel ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        WHERE c = 7 AND n_steps // 11 = 7""".replace("AS window", 'AS "window"'),
)
def _(spark, sf):
    # The default of 50 parts gives one-step windows on 83 steps; 11 parts give 7.
    series = channel_mean_series(spark, sf)
    lengths = series.groupBy("dataset", "name").agg((F.max("t") + 1).alias("n_steps"))
    means = stats.rolling_mean(series, ["dataset", "name"], lengths, parts=11)
    return rounded(means, "value")


@query(
    "dataset_summary",
    "C6",
    f"""SELECT dataset, channel, {R('avg(mean)')} AS mean, {R('avg(std)')} AS std, {R('min(mn)')} AS min,
               {R('max(mx)')} AS max, {R('avg(energy)')} AS energy_mean, {R('stddev_pop(energy)')} AS energy_std
        FROM stepstats GROUP BY 1, 2""",
)
def _(spark, sf):
    s = stats.dataset_summary(src.field(spark, sf))
    return rounded(s, *s.columns[2:])


add_view(
    "spatial_series",
    """SELECT dataset, 'mean_' || channel AS name, t, mean AS value FROM stepstats
       UNION ALL SELECT dataset, 'energy_' || channel, t, energy FROM stepstats""",
)


@query(
    "spatial_series",
    "C7",
    f"SELECT dataset, name, t, {R('value')} AS value FROM spatial_series",
)
def _(spark, sf):
    return rounded(stats.spatial_series(src.field(spark, sf)), "value")


@query(
    "mean_field",
    "C8",
    f"SELECT x, y, {R('avg(u_x)')} AS u_x, {R('avg(u_y)')} AS u_y FROM field GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(stats.mean_field(src.field(spark, sf)), "u_x", "u_y")


add_view(
    "fluct",
    """SELECT dataset, t, x, y, u_x - avg(u_x) OVER w AS u_x, u_y - avg(u_y) OVER w AS u_y FROM field
       WINDOW w AS (PARTITION BY dataset, x, y)""",
)


@query(
    "fluctuation",
    "C9",
    f"SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM fluct",
)
def _(spark, sf):
    return rounded(stats.fluctuation(src.field(spark, sf)), "u_x", "u_y")


@query(
    "half_windows",
    "C10",
    """SELECT dataset, t, CASE WHEN t < n_steps // 2 THEN 'first' ELSE 'second' END AS half,
              CAST(CASE WHEN t < n_steps // 2 THEN t ELSE t - n_steps // 2 END AS INTEGER) AS step,
              CAST(CASE WHEN t < n_steps // 2 THEN n_steps // 2 ELSE n_steps - n_steps // 2 END AS INTEGER) AS n_half,
              count(*) AS cells
       FROM field JOIN catalog USING (dataset) GROUP BY ALL""",
)
def _(spark, sf):
    steps = src.field(spark, sf).groupBy("dataset", "t").agg(F.count("*").alias("cells"))
    return stats.with_halves(steps, src.catalog(spark, sf))


@query(
    "half_change",
    "C11",
    f"""WITH h AS (SELECT dataset, channel, {', '.join(
            f"avg({q}) FILTER (WHERE t {op} n_steps // 2) AS {q}_{half}"
            for q in ('mean', 'std', 'energy') for half, op in (('first', '<'), ('second', '>=')))}
          FROM stepstats JOIN catalog USING (dataset) GROUP BY 1, 2)
        SELECT dataset, channel, {', '.join(f"{R(f'{q}_{half}')} AS {q}_{half}"
            for q in ('mean', 'std', 'energy') for half in ('first', 'second'))},
          {R('mean_second - mean_first')} AS mean_delta,
          {R('(std_second - std_first) / abs(std_first)')} AS std_change,
          {R('(energy_second - energy_first) / abs(energy_first)')} AS energy_change FROM h""".replace("WITH h AS (", "SELECT * FROM (WITH h AS (", 1) + ")",
)
def _(spark, sf):
    report = stats.half_change(src.field(spark, sf), src.catalog(spark, sf))
    return rounded(report, *report.columns[2:])


# --- normalization ----------------------------------------------------------------------------

add_view(
    "moments",
    """SELECT dataset, channel, count(u) AS n, avg(u) AS mean, var_pop(u) * count(u) AS m2
       FROM vel GROUP BY 1, 2""",
)
add_view(
    "train_stats",
    """SELECT channel, avg(u) AS mean, stddev_pop(u) AS std, count(*) AS n_samples
       FROM vel WHERE dataset IN (SELECT dataset FROM roles WHERE role = 'train') GROUP BY 1""",
)


def train_stats(spark, sf):
    train = src.roles(spark, sf).filter("role = 'train'").select("dataset")
    return moments.normalization_stats(src.field(spark, sf), train)


@query(
    "channel_moments",
    "D1",
    f"SELECT dataset, channel, n, {R('mean')} AS mean, {R('m2', 5)} AS m2 FROM moments",
)
def _(spark, sf):
    m = moments.channel_moments(src.field(spark, sf))
    return rounded(rounded(m, "mean"), "m2", digits=5)


@query(
    "moment_merge",
    "D2",
    f"""SELECT channel, count(u) AS n, {R('avg(u)')} AS mean, {R('var_pop(u) * count(u)', 3)} AS m2
        FROM vel GROUP BY 1""",
)
def _(spark, sf):
    m = moments.merge_moments(moments.channel_moments(src.field(spark, sf)))
    return rounded(rounded(m.withColumn("n", F.col("n").cast("long")), "mean"), "m2", digits=3)


@query(
    "pooled_stats",
    "D3",
    f"""SELECT channel, {R('mean')} AS mean, {R('std')} AS std, n_samples,
               (SELECT count(*) FROM roles WHERE role = 'train') AS n_sources FROM train_stats""",
)
def _(spark, sf):
    return rounded(train_stats(spark, sf).drop("n_distinct_sources"), "mean", "std")


@query(
    "stats_validation",
    "D4",
    """SELECT dataset, channel, CASE WHEN NOT isfinite(m) THEN 'mean not finite' ELSE 'std not finite and > 0' END AS rule
       FROM (SELECT dataset, channel, avg(u) / CASE WHEN min(u) > 0 THEN 1 ELSE 0 END AS m0,
                    CASE WHEN min(u) > 0 THEN avg(u) ELSE CAST('nan' AS DOUBLE) END AS m,
                    CASE WHEN max(u) > 10 THEN stddev_pop(u) ELSE 0.0 END AS s
             FROM vel GROUP BY 1, 2) WHERE NOT isfinite(m)
       UNION ALL
       SELECT dataset, channel, 'std not finite and > 0' FROM vel GROUP BY 1, 2 HAVING max(u) <= 10""",
)
def _(spark, sf):
    # Statistics spoiled by rule from the data: no mean where a hole is, no std for the small channel.
    m = src.field(spark, sf).transform(scans.raw_profile)
    spoiled = m.select(
        F.concat_ws("/", "dataset", "channel").alias("channel"),
        F.when(F.col("min") > 0, F.col("mean")).otherwise(float("nan")).alias("mean"),
        F.when(F.col("max") > 10, F.col("std")).otherwise(0.0).alias("std"),
        F.col("size").alias("n_samples"),
        F.lit(1).alias("n_sources"),
        F.lit(1).alias("n_distinct_sources"),
    )
    parts = F.split("channel", "/")
    return moments.stats_violations(spoiled).select(
        parts[0].alias("dataset"), parts[1].alias("channel"), "rule"
    )


@query(
    "effective_std",
    "D5",
    f"""SELECT channel, 'per_channel' AS mode, {R('std')} AS effective_std FROM train_stats
        UNION ALL SELECT channel, 'shared', {R('sqrt(avg(std * std) OVER ())')} FROM train_stats""",
)
def _(spark, sf):
    parts = [
        moments.effective_std(train_stats(spark, sf), mode).select(
            "channel", F.lit(mode).alias("mode"), r("effective_std").alias("effective_std")
        )
        for mode in moments.STD_MODES
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stats_compatibility",
    "D6",
    """SELECT dataset, 'test dataset in sources' AS reason FROM roles WHERE role = 'test'
       UNION ALL SELECT dataset, 'source is not a train dataset' FROM roles WHERE role <> 'train'""",
)
def _(spark, sf):
    # Statistics of every dataset, so val and test must be reported.
    sources = moments.stats_sources(moments.channel_moments(src.field(spark, sf)))
    return moments.compatibility_violations(sources, src.roles(spark, sf))


@query(
    "normalize",
    "D7",
    f"""SELECT dataset, t, x, y, {R('(u_x - (SELECT mean FROM train_stats WHERE channel = ~u_x~)) / (SELECT std FROM train_stats WHERE channel = ~u_x~)')} AS u_x,
               {R('(u_y - (SELECT mean FROM train_stats WHERE channel = ~u_y~)) / (SELECT std FROM train_stats WHERE channel = ~u_y~)')} AS u_y
        FROM field""".replace("~", "'"),
)
def _(spark, sf):
    return rounded(moments.normalize(src.field(spark, sf), train_stats(spark, sf)), "u_x", "u_y")


@query(
    "denormalize",
    "D7",
    f"SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM field",
)
def _(spark, sf):
    s = train_stats(spark, sf)
    there = moments.normalize(src.field(spark, sf), s, "shared")
    return rounded(moments.denormalize(there, s, "shared"), "u_x", "u_y")


add_view(
    "pooled_fluct",
    """SELECT dataset, t, x, y, u_x - avg(u_x) OVER w AS u_x, u_y - avg(u_y) OVER w AS u_y FROM field
       WINDOW w AS (PARTITION BY x, y)""",
)
add_view(
    "znorm",
    """SELECT dataset, t, x, y, u_x / (SELECT sqrt(avg(u_x * u_x)) FROM pooled_fluct) AS u_x,
              u_y / (SELECT sqrt(avg(u_y * u_y)) FROM pooled_fluct) AS u_y FROM pooled_fluct""",
)


@query(
    "snapshot_normalize",
    "D8",
    f"SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM znorm",
)
def _(spark, sf):
    return rounded(moments.snapshot_normalize(src.field(spark, sf)), "u_x", "u_y")


@query(
    "constant_pixels",
    "D9",
    f"""WITH p AS (SELECT x, y, channel, avg(u) AS m, stddev_pop(u) AS s FROM vel GROUP BY 1, 2, 3),
             w AS (SELECT channel, stddev_pop(u) AS sd FROM vel GROUP BY 1)
        SELECT x, y, p.channel, s <= 0.35 * sd AS constant,
               {R('CASE WHEN s <= 0.35 * sd THEN m ELSE 0.0 END')} AS value
        FROM p JOIN w ON p.channel = w.channel""".replace("WITH p", "SELECT * FROM (WITH p", 1) + ")",
)
def _(spark, sf):
    # No pixel of this field is constant at 1e-6; a wide tolerance splits them.
    return rounded(moments.constant_pixels(src.field(spark, sf), 0.35), "value")


@query(
    "latent_scales",
    "D10",
    f"""SELECT name AS mode, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std,
               {R('sqrt(avg((value - b) * (value - b)))')} AS step_rms, (stddev_pop(value) = 0) AS constant
        FROM (SELECT *, lag(value) OVER (PARTITION BY dataset, name ORDER BY t) AS b FROM series)
        GROUP BY 1""",
)
def _(spark, sf):
    latents = src.series(spark, sf).withColumnRenamed("name", "mode")
    return rounded(moments.latent_scales(latents), "mean", "std", "step_rms")
