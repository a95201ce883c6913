"""Forecast evaluation: pointwise and ensemble scores, physics comparison, stability.

Forecast rows are (model, dataset, member, lead, x, y, u_x, u_y), truth rows (dataset, lead, x, y,
u_x, u_y), lead 1 the first step after the context. Both may be held as lines, without y and with arrays u_x, u_y along it. NaN means blown up and fails every comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.functions.batches import group_stacks
from gridtide.operators import derive, spectra
from gridtide.schema import Grid
from gridtide.session import materialize, measured

RUN = ["model", "dataset", "member"]
CELL = ["dataset", "lead", "x", "y"]
# The skill threshold, reported leads and stability check of the default evaluation.
SKILL_THRESHOLD = 0.32
REPORT_LEADS = (1, 10, 40, 100)
BLOCK_STEPS = 100
MAX_RATIO = 2.0
NPERSEG = 200


def _met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two tables of cells side by side. Both sides are dealt: a forecast repeats few frames, so its files are small and the
    size of its rows is guessed far too low; sent whole, it fills the driver. Tables of lines meet line by line."""
    return a.hint("merge").join(b.hint("merge"), [c for c in CELL if c in b.columns], how)


def shape_violations(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, dataset, member, missing, extra): runs whose cells are not exactly the truth's."""
    wanted = truth.groupBy("dataset").agg(F.count("*").alias("wanted"))
    known = truth.select(*CELL, F.lit(1).alias("hit"))
    found = _met(forecast, known, "left").groupBy(*RUN).agg(
        F.count("*").alias("cells"), F.count("hit").alias("hits")
    )
    return (
        found.join(wanted, "dataset", "left")
        .select(
            *RUN,
            (F.coalesce("wanted", F.lit(0)) - F.col("hits")).alias("missing"),
            (F.col("cells") - F.col("hits")).alias("extra"),
        )
        .filter("missing <> 0 OR extra <> 0")
    )


def align(forecast: DataFrame, truth: DataFrame, scales: DataFrame) -> DataFrame:
    """Forecast and truth side by side, both in units of `scales` (one row: s_u_x, s_u_y); both are cells or both lines."""
    if derive.is_lines(forecast):
        unit = lambda c, s: F.transform(F.col(c), lambda v: v / F.col(s))
        lines = truth.select("dataset", "lead", "x", F.col("u_x").alias("q_x"), F.col("u_y").alias("q_y"))
        return _met(forecast, lines).join(F.broadcast(scales)).select(  # scales: one row
            *RUN, "lead", "x", unit("u_x", "s_u_x").alias("p_x"), unit("u_y", "s_u_y").alias("p_y"),
            unit("q_x", "s_u_x").alias("q_x"), unit("q_y", "s_u_y").alias("q_y"),
        )
    t = truth.select(*CELL, F.col("u_x").alias("q_x"), F.col("u_y").alias("q_y"))
    return (
        _met(forecast, t)
        .join(F.broadcast(scales))  # one row
        .select(
            *RUN, "lead", "x", "y",
            (F.col("u_x") / F.col("s_u_x")).alias("p_x"), (F.col("u_y") / F.col("s_u_y")).alias("p_y"),
            (F.col("q_x") / F.col("s_u_x")).alias("q_x"), (F.col("q_y") / F.col("s_u_y")).alias("q_y"),
        )
    )


def _both(f) -> Column:
    """Mean of an expression over the two channels."""
    return (f("x") + f("y")) / 2


def _square(c: Column) -> Column:
    return c * c


def rmse_per_lead(aligned: DataFrame) -> DataFrame:
    if "y" not in aligned.columns:
        total = lambda c: F.aggregate(
            F.zip_with(f"p_{c}", f"q_{c}", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
        )
        mean = F.sum(_both(total)) / F.sum(F.size("p_x"))
        return aligned.groupBy(*RUN, "lead").agg(F.sqrt(mean).alias("rmse"))
    error = _both(lambda c: _square(F.col(f"p_{c}") - F.col(f"q_{c}")))
    return aligned.groupBy(*RUN, "lead").agg(F.sqrt(F.avg(error)).alias("rmse"))


def ensemble_scores(aligned: DataFrame) -> DataFrame:
    """(model, dataset, lead, size, crps, spread, mean_rmse, spread_skill).

    Members meet in one window per cell, already partitioned by the alignment join. Pairs follow
    the cycle of members: consecutive ones, and the closing pair from three members on. Lines are
    summed where their members meet.
    """
    if "y" not in aligned.columns:
        return _scores(_line_sums(aligned).groupBy("model", "dataset", "lead").agg(
            F.max("m").alias("size"),
            (F.sum("miss") / F.sum("n")).alias("miss"),
            F.coalesce(F.try_divide(F.sum("apart"), F.sum("pairs")), F.lit(0.0)).alias("apart"),
            F.coalesce(F.try_divide(F.sum("apart_sq"), F.sum("pairs")), F.lit(0.0)).alias("apart_sq"),
            F.sqrt(F.sum("mean_sq") / F.sum("n")).alias("mean_rmse"),
        ))
    cell = Window.partitionBy("model", *CELL)
    ring = cell.orderBy("member")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = aligned.withColumn("m", F.count("*").over(cell))
    for c in ("x", "y"):
        p = f"p_{c}"
        closing = F.when(F.col("m") >= 3, F.first(p).over(whole))
        near = near.withColumn(f"next_{c}", F.coalesce(F.lead(p).over(ring), closing)).withColumn(
            f"mean_{c}", F.avg(p).over(whole)
        )
    miss = _both(lambda c: F.abs(F.col(f"p_{c}") - F.col(f"q_{c}")))
    apart = _both(lambda c: F.abs(F.col(f"p_{c}") - F.col(f"next_{c}")))
    apart_sq = _both(lambda c: _square(F.col(f"p_{c}") - F.col(f"next_{c}")))
    mean_sq = _both(lambda c: _square(F.col(f"mean_{c}") - F.col(f"q_{c}")))
    sums = near.groupBy("model", "dataset", "lead").agg(
        F.max("m").cast("int").alias("size"),
        F.avg(miss).alias("miss"),
        F.coalesce(F.avg(apart), F.lit(0.0)).alias("apart"),
        F.coalesce(F.avg(apart_sq), F.lit(0.0)).alias("apart_sq"),
        F.sqrt(F.avg(mean_sq)).alias("mean_rmse"),
    )
    return _scores(sums)


def _line_sums(aligned: DataFrame) -> DataFrame:
    """(model, dataset, lead, m, n, pairs, miss, apart, apart_sq, mean_sq): sums over the members' cells of one line.

    The window orders the members where the alignment has dealt them, and keeps the runtime from splitting that partition."""
    keys = ["model", "dataset", "lead", "x"]
    sums = ("miss", "apart", "apart_sq", "mean_sq")
    types = T.StructType(
        [aligned.schema[k] for k in keys[:3]] + [T.StructField("m", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("n", "pairs")] + [T.StructField(n, T.DoubleType()) for n in sums]
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        for first, (px, py, qx, qy) in group_stacks(batches, keys, ["p_x", "p_y", "q_x", "q_y"]):
            m, length = px.shape[1:]
            total = lambda f: sum(f(p, q).sum(axis=(1, 2)) for p, q in ((px, qx), (py, qy))) / 2
            near = lambda p: (np.roll(p, -1, axis=1) - p)[:, : m if m >= 3 else m - 1]
            values = [
                total(lambda p, q: np.abs(p - q)), total(lambda p, _: np.abs(near(p))), total(lambda p, _: near(p) ** 2),
                m * total(lambda p, q: (p.mean(axis=1, keepdims=True) - q[:, :1]) ** 2),
            ]
            whole = lambda n: np.full(len(px), n)
            columns = [*[first[k] for k in keys[:3]], whole(m), whole(m * length), whole((m if m >= 3 else m - 1) * length), *values]
            yield from pa.table(columns, names=schema.names).cast(schema).to_batches()

    ring = aligned.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("member")))
    return ring.sortWithinPartitions(*keys, "member").mapInArrow(add, types)


def _scores(sums: DataFrame) -> DataFrame:
    spread = F.sqrt(0.5 * F.col("apart_sq"))
    return sums.select(
        "model", "dataset", "lead", "size",
        (F.col("miss") - 0.5 * F.col("apart")).alias("crps"),
        spread.alias("spread"),
        "mean_rmse",
        F.when(
            F.col("size") > 1, F.sqrt((F.col("size") + 1) / F.col("size")) * spread / F.col("mean_rmse")
        ).otherwise(float("nan")).alias("spread_skill"),
    )


def median_of(values: Column) -> Column:
    """Median of a collected member array; NaN sorts last, so it counts as the worst."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.element_at(ordered, (F.floor((n - 1) / 2) + 1).cast("int"))
    high = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return (low + high) / 2


def member_median(scores: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Median over an ensemble's members, a handful of values per key."""
    return scores.groupBy(*keys).agg(median_of(F.collect_list(column)).alias(column))


def skill_horizon(curve: DataFrame, keys: list[str], column: str, threshold: float) -> DataFrame:
    """Leading steps at or below the threshold; NaN is above it."""
    above = F.min(F.when(~(F.col(column) <= threshold), F.col("lead")))
    return curve.groupBy(*keys).agg(
        F.coalesce(above - 1, F.max("lead")).cast("int").alias("skill_horizon")
    )


def report_leads(curve: DataFrame, keys: list[str], column: str, prefix: str, leads=REPORT_LEADS) -> DataFrame:
    """(keys, metric, value) at the reported leads; leads past the end don't appear."""
    return curve.filter(F.col("lead").isin(*leads)).select(
        *keys, F.concat(F.lit(f"{prefix}_lead_"), F.col("lead").cast("string")).alias("metric"),
        F.col(column).alias("value"),
    )


# --- physics --------------------------------------------------------------------------------------


def physics(frames: DataFrame, grid: Grid | DataFrame, *extra: str, dealt: bool = False) -> DataFrame:
    """Per-step energy, enstrophy, RMS divergence, mean velocity of frames keyed by lead."""
    return derive.frame_physics(frames.withColumnRenamed("lead", "t"), grid, *extra, dealt=dealt).withColumnRenamed(
        "t", "lead"
    )


def line_spectra(frames: DataFrame, grid: Grid | DataFrame, *extra: str) -> DataFrame:
    """(extra, dataset, axis, channel, k, power): time-mean spectra along x and y. The frames may be held as lines."""
    field = frames.withColumnRenamed("lead", "t")
    if derive.is_lines(field):
        return spectra.frame_spectra(field, grid, (*extra, "dataset"))
    both = [
        spectra.line_spectrum(field, grid, axis, (*extra, "dataset")).withColumn("axis", F.lit(axis))
        for axis in ("x", "y")
    ]
    return both[0].unionByName(both[1])


def mean_velocity(table: DataFrame, *extra: str) -> DataFrame:
    """Domain-mean velocity series (extra, dataset, name, t, value), t from 0."""
    long = table.select(*extra, "dataset", (F.col("lead") - 1).alias("t"), "mean_u_x", "mean_u_y")
    return long.unpivot(
        [*extra, "dataset", "t"], ["mean_u_x", "mean_u_y"], "name", "value"
    ).withColumn("name", F.substring("name", 6, 3))


def physics_scores(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(model, dataset, member, metric, value): relative errors of time means, divergence ratio."""
    means = lambda df, keys, p: df.groupBy(*keys).agg(
        *[F.avg(q).alias(f"{p}_{q}") for q in ("energy", "enstrophy", "rms_divergence")]
    )
    both = means(pred, RUN, "p").join(means(true, ["dataset"], "q"), "dataset")
    relative = lambda q: F.abs(F.col(f"p_{q}") - F.col(f"q_{q}")) / F.col(f"q_{q}")
    wide = both.select(
        *RUN,
        relative("energy").alias("energy_rel_error"),
        relative("enstrophy").alias("enstrophy_rel_error"),
        (F.col("p_rms_divergence") / F.col("q_rms_divergence")).alias("divergence_ratio"),
    )
    return wide.unpivot(RUN, wide.columns[3:], "metric", "value")


def spectrum_scores(pred: DataFrame, true: DataFrame) -> DataFrame:
    """spectrum_x_lsd, spectrum_y_lsd per run."""
    runs = pred.select(*RUN).distinct()
    repeated = runs.join(true, "dataset")
    lsd = spectra.log_spectral_distance(pred, repeated, [*RUN, "axis"], ["channel"])
    return lsd.select(
        *RUN, F.concat(F.lit("spectrum_"), F.col("axis"), F.lit("_lsd")).alias("metric"), F.col("lsd").alias("value")
    )


def drift_scores(pred: DataFrame, true: DataFrame) -> DataFrame:
    """|mean difference| and std ratio of mean-velocity series, in the truth's std over time."""
    moments = lambda df, keys, p: df.groupBy(*keys, "name").agg(
        F.avg("value").alias(f"{p}_mean"), F.stddev_pop("value").alias(f"{p}_std")
    )
    both = moments(pred, RUN, "p").join(moments(true, ["dataset"], "q"), ["dataset", "name"])
    long = both.select(
        *RUN, "name",
        (F.abs(F.col("p_mean") - F.col("q_mean")) / F.col("q_std")).alias("mean_offset"),
        (F.col("p_std") / F.col("q_std")).alias("mean_std_ratio"),
    ).unpivot([*RUN, "name"], ["mean_offset", "mean_std_ratio"], "metric", "value")
    return long.select(*RUN, F.concat_ws("_", "name", "metric").alias("metric"), "value")


def temporal_scores(pred: DataFrame, true: DataFrame, nperseg: int = NPERSEG) -> DataFrame:
    """Welch comparison of mean-velocity series: distance per channel, u_y period and peak power.

    The period is undefined (NaN) without power, or when the forecast peaks in the lowest bin and
    the truth doesn't: a drift, not an oscillation.
    """
    p = spectra.welch(pred, [*RUN, "name"], nperseg)
    q = spectra.welch(true, ["dataset", "name"], nperseg)
    runs = pred.select(*RUN).distinct()
    lsd = spectra.log_spectral_distance(p, runs.join(q, "dataset"), [*RUN, "name"], []).select(
        *RUN, F.concat(F.lit("temporal_"), F.col("name"), F.lit("_lsd")).alias("metric"), F.col("lsd").alias("value")
    )
    peak_p = spectra.interpolated_peak(p.filter("name = 'u_y'"), RUN)
    peak_q = spectra.interpolated_peak(q.filter("name = 'u_y'"), ["dataset"]).withColumnsRenamed(
        {"peak_k": "true_k", "omega": "true_omega", "power": "true_power"}
    )
    drifting = (F.col("peak_k") == 1) & (F.col("true_k") > 1)
    silent = F.col("power") <= spectra.SPECTRUM_FLOOR_RATIO * F.col("true_power")
    wide = peak_p.join(peak_q, "dataset").select(
        *RUN,
        F.when(silent | drifting, float("nan"))
        .otherwise(F.abs(F.col("true_omega") / F.col("omega") - 1.0))
        .alias("u_y_period_error"),
        (F.col("power") / F.col("true_power")).alias("u_y_peak_power_ratio"),
    )
    return lsd.unionByName(wide.unpivot(RUN, wide.columns[3:], "metric", "value"))


# --- stability ------------------------------------------------------------------------------------


def quantity_blocks(table: DataFrame, keys: list[str], block_steps: int) -> DataFrame:
    """(keys, quantity, block, value): block means of energy and enstrophy."""
    if block_steps < 1:
        raise ValueError(f"block_steps must be >= 1, got {block_steps}")
    means = table.groupBy(*keys, F.floor((F.col("lead") - 1) / block_steps).cast("int").alias("block")).agg(
        F.avg("energy").alias("energy"), F.avg("enstrophy").alias("enstrophy")
    )
    return means.unpivot([*keys, "block"], ["energy", "enstrophy"], "quantity", "value")


def stability(pred: DataFrame, true: DataFrame, block_steps: int, max_ratio: float) -> DataFrame:
    """(model, dataset, member, forecast_steps, stable_steps, energy_peak_ratio, enstrophy_peak_ratio).

    A block fails when a mean over the truth's largest block mean exceeds `max_ratio` or is NaN.
    The forecast may be longer than the truth (a rollout).
    """
    reference = quantity_blocks(true, ["dataset"], block_steps).groupBy("dataset", "quantity").agg(
        F.max("value").alias("top")
    )
    ratios = quantity_blocks(pred, RUN, block_steps).join(reference, ["dataset", "quantity"]).withColumn(
        "ratio", F.col("value") / F.col("top")
    )
    lengths = pred.groupBy(*RUN).agg(F.max("lead").alias("forecast_steps"))
    failing = F.min(F.when(~(F.col("ratio") <= max_ratio), F.col("block")))
    peak = lambda q: F.max(F.when(F.col("quantity") == q, F.col("ratio")))
    found = ratios.groupBy(*RUN).agg(
        failing.alias("failing"),
        peak("energy").alias("energy_peak_ratio"),
        peak("enstrophy").alias("enstrophy_peak_ratio"),
    )
    return found.join(lengths, RUN).select(
        *RUN, "forecast_steps",
        F.coalesce(F.col("failing") * block_steps, F.col("forecast_steps")).cast("double").alias("stable_steps"),
        "energy_peak_ratio", "enstrophy_peak_ratio",
    )


def stable_fraction(table: DataFrame, keys: list[str]) -> DataFrame:
    """Share of members stable over their whole forecast."""
    return table.groupBy(*keys).agg(
        F.avg((F.col("stable_steps") >= F.col("forecast_steps")).cast("double")).alias("stable_fraction")
    )


def parity(a: DataFrame, b: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """(dataset, difference, within): the largest gap between two forecasts of a dataset, divided by the standard deviation
    of its true values, and whether that stays within `tolerance`."""
    other = b.select(*CELL, F.col("u_x").alias("v_x"), F.col("u_y").alias("v_y"))
    apart = _met(a, other).groupBy("dataset").agg(
        F.max(F.greatest(F.abs(F.col("u_x") - F.col("v_x")), F.abs(F.col("u_y") - F.col("v_y")))).alias("apart")
    )
    spread = truth.select("dataset", F.explode(F.array("u_x", "u_y")).alias("u")).groupBy("dataset").agg(
        F.stddev_pop("u").alias("std")
    )
    ratio = F.col("apart") / F.col("std")
    return apart.join(spread, "dataset").select(
        "dataset", ratio.alias("difference"), (ratio <= tolerance).alias("within")
    )


# --- everything -----------------------------------------------------------------------------------


def evaluate(
    forecast: DataFrame,
    truth: DataFrame,
    grid: Grid | DataFrame,
    scales: DataFrame,
    *,
    threshold: float = SKILL_THRESHOLD,
    leads=REPORT_LEADS,
    block_steps: int = BLOCK_STEPS,
    max_ratio: float = MAX_RATIO,
    nperseg: int = NPERSEG,
) -> DataFrame:
    """All scores as (model, dataset, grp, metric, value): grp "all" is the median over members plus
    the ensemble's scores, "member_<k>" each member's own."""
    aligned = align(forecast, truth, scales)
    # Per-lead and per-frame tables feed many scores: written once, the cells are read once each.
    rmse = materialize(rmse_per_lead(aligned), "rmse")
    curves = materialize(ensemble_scores(aligned), "ensemble")
    pred = materialize(physics(forecast, grid, "model", "member"), "physics")
    true = materialize(physics(truth, grid), "physics")
    stable = stability(pred, true, block_steps, max_ratio).select(
        *RUN, "stable_steps", "energy_peak_ratio", "enstrophy_peak_ratio"
    )
    pred_velocity, true_velocity = mean_velocity(pred, "model", "member"), mean_velocity(true)
    members = (
        rmse.groupBy(*RUN).agg(F.avg("rmse").alias("value")).withColumn("metric", F.lit("rmse_mean"))
        .unionByName(report_leads(rmse, RUN, "rmse", "rmse", leads))
        .unionByName(physics_scores(pred, true))
        .unionByName(
            spectrum_scores(line_spectra(forecast, grid, "model", "member"), line_spectra(truth, grid))
        )
        .unionByName(temporal_scores(pred_velocity, true_velocity, nperseg))
        .unionByName(drift_scores(pred_velocity, true_velocity))
        .unionByName(stable.unpivot(RUN, stable.columns[3:], "metric", "value"))
    )
    key = ["model", "dataset"]
    members = materialize(members, "members")
    medians = member_median(members, [*key, "metric"])
    facts = curves.groupBy(*key).agg(
        F.avg("crps").alias("crps_mean"), F.max("size").cast("double").alias("ensemble_size")
    )
    horizon = skill_horizon(curves, key, "crps", threshold).select(
        *key, F.lit("crps_skill_horizon").alias("metric"), F.col("skill_horizon").cast("double").alias("value")
    )
    ensemble = (
        facts.unpivot(key, ["crps_mean", "ensemble_size"], "metric", "value")
        .unionByName(horizon)
        .unionByName(report_leads(curves, key, "crps", "crps", leads))
        .unionByName(
            report_leads(curves.filter("size > 1"), key, "spread_skill", "spread_skill", leads)
        )
    )
    own = members.select(
        *key, F.concat(F.lit("member_"), F.col("member").cast("string")).alias("grp"), "metric", "value"
    )
    return medians.unionByName(ensemble).select(*key, F.lit("all").alias("grp"), "metric", "value").unionByName(own)


def by_role(table: DataFrame, roles: DataFrame, scored: DataFrame) -> DataFrame:
    """The scores of `evaluate` under the names that decisions use: `val`, `val.member_<k>`, `train.<dataset>`.

    Validation also gets `stable_fraction`, the share of members that are stable over all of their scored steps
    (`scored`: dataset, n_scored), and, with more than one member, each member's own scores. A test dataset or one
    without a role fails the job: it must not have been read.
    """
    known = table.join(measured(roles.select("dataset", "role"), "roles"), "dataset", "left")
    # The message names the score too: a filter on roles alone would be checked before the join.
    said = F.concat_ws(" ", F.lit("not a validation or training dataset:"), "dataset", "metric")
    known = known.filter(F.when(F.col("role").isin("val", "train"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    val, whole = F.col("role") == "val", F.col("grp") == "all"
    members = known.filter(val & ~whole)
    several = members.groupBy("model", "dataset").agg((F.count_distinct("grp") > 1).alias("several"))
    stable = (
        members.filter("metric = 'stable_steps'").join(scored.select("dataset", "n_scored"), "dataset")
        .groupBy("model", "dataset")
        .agg(F.avg((F.coalesce("value", F.lit(0.0)) >= F.col("n_scored")).cast("double")).alias("value"))
    )
    names = ["model", "dataset", "grp", "metric", "value"]
    own = members.join(several.filter("several"), ["model", "dataset"], "left_semi")
    return (
        known.filter(val & whole).withColumn("grp", F.lit("val")).select(names)
        .unionByName(known.filter(~val & whole).withColumn("grp", F.concat(F.lit("train."), "dataset")).select(names))
        .unionByName(own.withColumn("grp", F.concat(F.lit("val."), "grp")).select(names))
        .unionByName(stable.select("model", "dataset", F.lit("val").alias("grp"), F.lit("stable_fraction").alias("metric"), "value"))
    )
