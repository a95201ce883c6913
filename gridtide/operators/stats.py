"""Field statistics per step, per dataset and per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.layout import channels
from gridtide.session import measured

TINY = 1e-12
HISTOGRAM_BINS = 60


def step_stats(field: DataFrame) -> DataFrame:
    """Spatial mean, population std, min, max and energy proxy per (dataset, t, channel)."""
    u = F.col("u")
    return (
        channels(field, "dataset", "t")
        .groupBy("dataset", "t", "channel")
        .agg(
            F.avg(u).alias("mean"),
            F.stddev_pop(u).alias("std"),
            F.min(u).alias("min"),
            F.max(u).alias("max"),
            F.avg(0.5 * u * u).alias("energy"),
        )
    )


def energy_proxy(field: DataFrame) -> DataFrame:
    """0.5 u^2 per channel and their total, per step."""
    return (
        field.groupBy("dataset", "t")
        .agg(
            F.avg(0.5 * F.col("u_x") * F.col("u_x")).alias("energy_u_x"),
            F.avg(0.5 * F.col("u_y") * F.col("u_y")).alias("energy_u_y"),
        )
        .withColumn("energy", F.col("energy_u_x") + F.col("energy_u_y"))
    )


def channel_correlation(field: DataFrame) -> DataFrame:
    """Spatial correlation of the two channels per step; 0, not NULL, for a constant field."""
    scale = F.stddev_pop("u_x") * F.stddev_pop("u_y") + TINY
    return field.groupBy("dataset", "t").agg(
        (F.covar_pop("u_x", "u_y") / scale).alias("correlation")
    )


def histogram(field: DataFrame, n_bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over each channel's own range, last bin closed, empty bins kept.

    Counting compares with the bin edges, so a value on an edge falls where the edge says.
    """
    values = channels(field, "dataset")
    span = measured(
        values.groupBy("dataset", "channel").agg(
            F.min("u").alias("lo"), F.max("u").alias("hi"), F.count("*").alias("n")
        ),
        "span",
    )
    edge = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / n_bins)
    guess = F.when(
        F.col("hi") > F.col("lo"),
        F.least(
            F.floor((F.col("u") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n_bins)),
            F.lit(n_bins - 1),
        ),
    ).otherwise(F.lit(n_bins // 2))
    counts = (
        values.join(span, ["dataset", "channel"])
        .withColumn("g", guess)
        .withColumn(
            "bin",
            F.when(F.col("u") < edge(F.col("g")), F.col("g") - 1)
            .when((F.col("g") < n_bins - 1) & (F.col("u") >= edge(F.col("g") + 1)), F.col("g") + 1)
            .otherwise(F.col("g"))
            .cast("int"),
        )
        .groupBy("dataset", "channel", "bin")
        .agg(F.count("*").alias("count"))
    )
    bins = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return bins.join(counts, ["dataset", "channel", "bin"], "left").select(
        "dataset",
        "channel",
        "bin",
        F.coalesce("count", F.lit(0)).alias("count"),
        edge(F.col("bin")).alias("left"),
        edge(F.col("bin") + 1).alias("right"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * width)).alias("density"),
    )


def prefix_sums(series: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Running sum per series: within blocks of `block` steps, plus the blocks' own running sum.

    A series of any length is spread over its blocks; only one row per block is ordered per series.
    """
    cut = series.withColumn("_blk", F.floor(F.col("t") / block))
    totals = cut.groupBy(*keys, "_blk").agg(F.sum("value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_run", F.sum("value").over(inside))
        .join(offsets, [*keys, "_blk"])
        .select(*keys, "t", (F.col("_run") + F.col("_offset")).alias("prefix"))
    )


def rolling_mean(
    series: DataFrame, keys: list[str], lengths: DataFrame, parts: int = 50, block: int = 4096
) -> DataFrame:
    """Mean over windows of n // `parts` steps wholly inside a series, at their centred step.

    `lengths` holds (*keys, n_steps); a window below two steps leaves the series as it is. Windows
    are differences of prefix sums, so the cost doesn't grow with the window.
    """
    width = F.greatest(F.floor(F.col("n_steps") / parts), F.lit(1)).cast("int")
    sums = prefix_sums(series, keys, block).join(
        lengths.select(*keys, width.alias("window")), keys
    )
    starts = sums.select(
        *keys, (F.col("t") + F.col("window")).cast("int").alias("t"), F.col("prefix").alias("_start")
    )
    # Of the window ending at step t, the first position is t - w + 1; centred, it moves up by
    # (n - (n - w + 1)) // 2 = (w - 1) // 2.
    return (
        sums.join(starts, [*keys, "t"], "left")
        .filter(F.col("t") >= F.col("window") - 1)
        .select(
            *keys,
            (F.col("t") - F.col("window") + 1 + F.expr("(window - 1) div 2")).cast("int").alias("t"),
            "window",
            ((F.col("prefix") - F.coalesce("_start", F.lit(0.0))) / F.col("window")).alias("value"),
        )
    )


def dataset_summary(field: DataFrame) -> DataFrame:
    return (
        step_stats(field)
        .groupBy("dataset", "channel")
        .agg(
            F.avg("mean").alias("mean"),
            F.avg("std").alias("std"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.avg("energy").alias("energy_mean"),
            F.stddev_pop("energy").alias("energy_std"),
        )
    )


def spatial_series(field: DataFrame) -> DataFrame:
    """Four series per dataset: both channel means and both channel energies."""
    means = field.groupBy("dataset", "t").agg(
        F.avg("u_x").alias("mean_u_x"),
        F.avg("u_y").alias("mean_u_y"),
        F.avg(0.5 * F.col("u_x") * F.col("u_x")).alias("energy_u_x"),
        F.avg(0.5 * F.col("u_y") * F.col("u_y")).alias("energy_u_y"),
    )
    return means.unpivot(
        ["dataset", "t"], ["mean_u_x", "mean_u_y", "energy_u_x", "energy_u_y"], "name", "value"
    ).select("dataset", "name", "t", "value")


def mean_field(field: DataFrame, *keys: str) -> DataFrame:
    """Temporal mean per cell: per dataset with keys=('dataset',), pooled (by steps) without."""
    return field.groupBy(*keys, "x", "y").agg(
        F.avg("u_x").alias("u_x"), F.avg("u_y").alias("u_y")
    )


def fluctuation(field: DataFrame, pooled: bool = False) -> DataFrame:
    """u minus its temporal mean per cell. The mean table has one row per cell and is joined,
    so a long dataset never sorts inside one window."""
    on = ["x", "y"] if pooled else ["dataset", "x", "y"]
    mean = mean_field(field, *([] if pooled else ["dataset"])).withColumnsRenamed(
        {"u_x": "m_x", "u_y": "m_y"}
    )
    return field.join(mean, on).select(
        "dataset",
        "t",
        "x",
        "y",
        (F.col("u_x") - F.col("m_x")).alias("u_x"),
        (F.col("u_y") - F.col("m_y")).alias("u_y"),
    )


def with_halves(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds half = first/second (an odd step goes to the second) and the step within it."""
    split = rows.join(catalog.select("dataset", "n_steps"), "dataset").withColumn(
        "mid", F.expr("cast(n_steps div 2 as int)")
    )
    first = F.col("t") < F.col("mid")
    return split.select(
        *rows.columns,
        F.when(first, "first").otherwise("second").alias("half"),
        F.when(first, F.col("t")).otherwise(F.col("t") - F.col("mid")).cast("int").alias("step"),
        F.when(first, F.col("mid")).otherwise(F.col("n_steps") - F.col("mid")).cast("int").alias("n_half"),
    )


def half_change(field: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mean, std and energy of both halves; mean change absolute, the others relative."""
    halves = (
        with_halves(step_stats(field), catalog)
        .groupBy("dataset", "channel")
        .agg(
            *[
                F.avg(F.when(F.col("half") == half, F.col(q))).alias(f"{q}_{half}")
                for q in ("mean", "std", "energy")
                for half in ("first", "second")
            ]
        )
    )
    relative = lambda q: (
        (F.col(f"{q}_second") - F.col(f"{q}_first")) / F.abs(f"{q}_first")
    ).alias(f"{q}_change")
    return halves.select(
        "*",
        (F.col("mean_second") - F.col("mean_first")).alias("mean_delta"),
        relative("std"),
        relative("energy"),
    )
