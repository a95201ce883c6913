"""Normalization statistics: moments, deterministic pooling, validation, normalizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.layout import channels
from gridtide.operators.stats import mean_field

# Fixed value: a pixel whose std is below this share of its channel's is constant.
CONSTANT_TOLERANCE = 1e-6
STD_MODES = ("per_channel", "shared")


def channel_moments(field: DataFrame) -> DataFrame:
    """(dataset, channel, n, mean, m2) with m2 the summed squared deviation."""
    return (
        channels(field, "dataset")
        .groupBy("dataset", "channel")
        .agg(
            F.count("u").alias("n"),
            F.avg("u").alias("mean"),
            (F.var_pop("u") * F.count("u")).alias("m2"),
        )
    )


def merge_moments(moments: DataFrame, *keys: str) -> DataFrame:
    """Combine any number of moment rows per key; rows with n = 0 change nothing.

    The between-group term uses each row's distance to the pooled mean, which a first aggregation
    supplies: two partial aggregations, no ordering.
    """
    keys = keys or ("channel",)
    used = moments.filter("n > 0")
    pooled = used.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"))
    shift = F.col("mean") - F.col("mu")
    return (
        used.join(pooled, list(keys))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.first("mu").alias("mean"),
            (F.sum("m2") + F.sum(F.col("n") * shift * shift)).alias("m2"),
        )
    )


MERGE_BUCKETS = 1024


def _fold(rows: str) -> str:
    """Ordered pairwise merging of an array of (.., n, mean, m2) structs."""
    step = (
        "named_struct('n', a.n + b.n,"
        " 'mean', a.mean + (b.mean - a.mean) * (b.n / (a.n + b.n)),"
        " 'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * (a.n * b.n / (a.n + b.n)))"
    )
    return f"aggregate({rows}, named_struct('n', 0D, 'mean', 0D, 'm2', 0D), (a, b) -> {step})"


def pooled_stats(moments: DataFrame) -> DataFrame:
    """Pooled (channel, mean, std, n_samples, n_sources, n_distinct_sources).

    Merged in a fixed order, so every layout gives the same bits: datasets by name inside buckets of
    their names' checksum, then the buckets in order. Neither step holds the whole catalog.
    """
    n = F.col("n").cast("double").alias("n")
    inside = (
        moments.filter("n > 0")
        .withColumn("bucket", F.pmod(F.crc32(F.col("dataset").cast("binary")), F.lit(MERGE_BUCKETS)))
        .groupBy("channel", "bucket")
        .agg(
            F.array_sort(F.collect_list(F.struct("dataset", n, "mean", "m2"))).alias("rows"),
            F.count("*").alias("sources"),
            F.size(F.collect_set("dataset")).cast("long").alias("distinct_sources"),
        )
        .select("channel", "bucket", "sources", "distinct_sources", F.expr(_fold("rows")).alias("p"))
    )
    merged = inside.groupBy("channel").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "p.n", "p.mean", "p.m2"))).alias("rows"),
        F.sum("sources").alias("n_sources"),
        F.sum("distinct_sources").alias("n_distinct_sources"),
    ).withColumn("p", F.expr(_fold("rows")))
    return merged.select(
        "channel",
        F.col("p.mean").alias("mean"),
        F.sqrt(F.col("p.m2") / F.col("p.n")).alias("std"),
        F.col("p.n").cast("long").alias("n_samples"),
        "n_sources",
        "n_distinct_sources",
    )


def stats_sources(moments: DataFrame) -> DataFrame:
    """The datasets behind pooled statistics, as a table: it grows with the catalog."""
    return moments.filter("n > 0").select("dataset").distinct()


def normalization_stats(field: DataFrame, train: DataFrame) -> DataFrame:
    """Pooled statistics of the training datasets only."""
    return pooled_stats(channel_moments(field.join(train, "dataset", "left_semi")))


def stats_violations(stats: DataFrame) -> DataFrame:
    """Broken rules of a statistics table, (channel, rule)."""
    bad_number = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull()
    rule = lambda broken, name: F.when(broken, F.lit(name))
    per_channel = stats.select(
        "channel",
        F.explode(
            F.array_compact(
                F.array(
                    rule(bad_number("mean"), "mean not finite"),
                    rule(bad_number("std") | ~(F.col("std") > 0), "std not finite and > 0"),
                    rule(~(F.col("n_samples") > 0), "n_samples not > 0"),
                    rule(F.col("n_sources") == 0, "no source datasets"),
                    rule(
                        F.col("n_distinct_sources") != F.col("n_sources"), "duplicate source datasets"
                    ),
                )
            )
        ).alias("rule"),
    )
    repeated = (
        stats.groupBy("channel")
        .count()
        .filter("count > 1")
        .select("channel", F.lit("duplicate channel").alias("rule"))
    )
    return per_channel.unionByName(repeated)


def effective_std(stats: DataFrame, mode: str) -> DataFrame:
    """Adds the std divided by: each channel's own, or the RMS over channels."""
    if mode not in STD_MODES:
        raise ValueError(f"unknown std mode {mode!r}, expected one of {STD_MODES}")
    if mode == "per_channel":
        return stats.withColumn("effective_std", F.col("std"))
    rms = stats.agg(F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("effective_std"))
    # One row against one row per channel.
    return stats.join(F.broadcast(rms))


def compatibility_violations(sources: DataFrame, roles: DataFrame) -> DataFrame:
    """Why statistics of `sources` don't fit a setup: test data used, or not the train set."""
    tested = sources.join(roles.filter("role = 'test'"), "dataset").select(
        "dataset", F.lit("test dataset in sources").alias("reason")
    )
    train = roles.filter("role = 'train'").select("dataset")
    extra = sources.join(train, "dataset", "left_anti").select(
        "dataset", F.lit("source is not a train dataset").alias("reason")
    )
    absent = train.join(sources, "dataset", "left_anti").select(
        "dataset", F.lit("train dataset not in sources").alias("reason")
    )
    return tested.unionByName(extra).unionByName(absent)


def channel_order_matches(stats: DataFrame, expected: tuple[str, ...]) -> bool:
    found = [row.channel for row in stats.select("channel").take(len(expected) + 1)]
    return found == list(expected)


def _wide(stats: DataFrame) -> DataFrame:
    """One row: m_u_x, s_u_x, m_u_y, s_u_y."""
    pick = lambda c, q: F.max(F.when(F.col("channel") == c, F.col(q)))
    return stats.agg(
        *[pick(c, "mean").alias(f"m_{c}") for c in ("u_x", "u_y")],
        *[pick(c, "effective_std").alias(f"s_{c}") for c in ("u_x", "u_y")],
    )


def normalize(field: DataFrame, stats: DataFrame, mode: str = "per_channel") -> DataFrame:
    one = F.broadcast(_wide(effective_std(stats, mode)))  # exactly one row
    keys = [c for c in field.columns if c not in ("u_x", "u_y")]
    return field.join(one).select(
        *keys, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in ("u_x", "u_y")]
    )


def denormalize(field: DataFrame, stats: DataFrame, mode: str = "per_channel") -> DataFrame:
    one = F.broadcast(_wide(effective_std(stats, mode)))  # exactly one row
    keys = [c for c in field.columns if c not in ("u_x", "u_y")]
    return field.join(one).select(
        *keys, *[(F.col(c) * F.col(f"s_{c}") + F.col(f"m_{c}")).alias(c) for c in ("u_x", "u_y")]
    )


def snapshot_scales(field: DataFrame) -> DataFrame:
    """RMS of the fluctuation about the pooled per-pixel mean, one row (s_u_x, s_u_y).

    Per pixel, the summed squared fluctuation is var_pop times the count: one pass over the field.
    """
    pixels = field.groupBy("x", "y").agg(
        F.count("*").alias("n"), F.var_pop("u_x").alias("v_x"), F.var_pop("u_y").alias("v_y")
    )
    return pixels.agg(
        F.sqrt(F.sum(F.col("n") * F.col("v_x")) / F.sum("n")).alias("s_u_x"),
        F.sqrt(F.sum(F.col("n") * F.col("v_y")) / F.sum("n")).alias("s_u_y"),
    )


def snapshot_normalize(field: DataFrame) -> DataFrame:
    """Subtract the pooled per-pixel mean, divide each channel by its fluctuation's RMS."""
    mean = mean_field(field).withColumnsRenamed({"u_x": "m_x", "u_y": "m_y"})
    return (
        field.join(mean, ["x", "y"])
        .join(F.broadcast(snapshot_scales(field)))  # exactly one row
        .select(
            "dataset",
            "t",
            "x",
            "y",
            ((F.col("u_x") - F.col("m_x")) / F.col("s_u_x")).alias("u_x"),
            ((F.col("u_y") - F.col("m_y")) / F.col("s_u_y")).alias("u_y"),
        )
    )


def constant_pixels(field: DataFrame, tolerance: float = CONSTANT_TOLERANCE) -> DataFrame:
    """Per pixel and channel: whether it never varies, and its value (0 where it does)."""
    pixels = (
        channels(field, "x", "y")
        .groupBy("x", "y", "channel")
        .agg(
            F.count("*").alias("n"),
            F.avg("u").alias("pixel_mean"),
            F.sqrt(F.greatest(F.var_pop("u"), F.lit(0.0))).alias("pixel_std"),
        )
    )
    whole = pixels.groupBy("channel").agg(F.avg("pixel_mean").alias("mu"))
    shift = F.col("pixel_mean") - F.col("mu")
    spread = (
        pixels.join(whole, "channel")
        .groupBy("channel")
        .agg(F.sqrt(F.avg(F.col("pixel_std") * F.col("pixel_std") + shift * shift)).alias("std"))
    )
    constant = F.col("pixel_std") <= tolerance * F.col("std")
    return pixels.join(spread, "channel").select(
        "x",
        "y",
        "channel",
        constant.alias("constant"),
        F.when(constant, F.col("pixel_mean")).otherwise(0.0).alias("value"),
    )


def latent_scales(latents: DataFrame) -> DataFrame:
    """Per mode: mean, std and RMS one-step change of latents (dataset, t, mode, value).

    The step before comes from an equi-join on t, never across datasets.
    """
    before = latents.select(
        "dataset", (F.col("t") + 1).alias("t"), "mode", F.col("value").alias("before")
    )
    change = F.col("value") - F.col("before")
    return (
        latents.join(before, ["dataset", "t", "mode"], "left")
        .groupBy("mode")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.sqrt(F.avg(change * change)).alias("step_rms"),
        )
        .withColumn("constant", (F.col("std") == 0) | (F.col("step_rms") == 0))
    )


def checked_latent_scales(latents: DataFrame) -> DataFrame:
    scales = latent_scales(latents)
    still = scales.filter("constant").select("mode").take(10)
    if still:
        raise ValueError(f"latent modes {[row.mode for row in still]} don't vary over the training data")
    return scales.drop("constant")
