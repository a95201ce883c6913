"""Windowed samples, context splits, pairs, lagged features, shuffled window index, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.layout import core_rows, halo_blocks, halo_window


def sample_index(
    catalog: DataFrame,
    window: int,
    horizon: int,
    stride: int = 1,
    start: int = 0,
    end: int | None = None,
) -> DataFrame:
    """(dataset, sample, role, offset, t): which frames each sample reads.

    Sample i reads `window` inputs from start + i * stride and the `horizon` targets after them. A
    region too short for one sample fails the job.
    """
    if min(window, horizon, stride) < 1:
        raise ValueError("window, horizon and stride must be >= 1")
    span = window + horizon
    last = F.col("n_steps") if end is None else F.least(F.lit(end), F.col("n_steps"))
    count = F.floor((last - start - span) / stride).cast("int") + 1
    message = F.concat(F.lit("too few steps for one sample in "), F.col("dataset"))
    checked = F.when(last - start >= span, count).otherwise(F.raise_error(message).cast("int"))
    samples = catalog.select(
        "dataset", F.explode(F.sequence(F.lit(0), checked - 1)).alias("sample")
    )
    return samples.select(
        "dataset", "sample", F.explode(F.sequence(F.lit(0), F.lit(span - 1))).alias("i")
    ).select(
        "dataset",
        "sample",
        F.when(F.col("i") < window, "input").otherwise("target").alias("role"),
        F.when(F.col("i") < window, F.col("i")).otherwise(F.col("i") - window).alias("offset"),
        (F.lit(start) + F.col("sample") * stride + F.col("i")).cast("int").alias("t"),
    )


def windowed_samples(frames: DataFrame, catalog: DataFrame, **kwargs) -> DataFrame:
    """The samples' rows; frames are joined by (dataset, t), never copied ahead of need."""
    return sample_index(catalog, **kwargs).join(frames, ["dataset", "t"])


def check_window(window: int, context_steps: int) -> None:
    if not 0 <= window <= context_steps:
        raise ValueError(f"window {window} must be in [0, {context_steps}]")


def split_context(rows: DataFrame, context_steps: int) -> tuple[DataFrame, DataFrame]:
    """(context, targets); targets get lead = 1 for the first step after the context."""
    if context_steps < 0:
        raise ValueError(f"context_steps must be >= 0, got {context_steps}")
    context = rows.filter(F.col("t") < context_steps)
    targets = rows.filter(F.col("t") >= context_steps).withColumn(
        "lead", (F.col("t") - context_steps + 1).cast("int")
    )
    return context, targets.drop("t")


def context_counts(catalog: DataFrame, context_steps: int) -> DataFrame:
    """Scored steps per dataset; a dataset without one fails the job."""
    scored = F.col("n_steps") - context_steps
    message = F.concat(F.lit("no step left to score in "), F.col("dataset"))
    return catalog.select(
        "dataset",
        F.when(scored >= 1, scored).otherwise(F.raise_error(message).cast("int")).alias("n_scored"),
    )


def snapshot_pairs(series: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each row with its successor in the same dataset: an equi-join on t, no ordered window."""
    after = series.select(
        *keys, (F.col("t") - 1).cast("int").alias("t"), *[F.col(c).alias(f"{c}_after") for c in columns]
    )
    return series.select(*keys, "t", *columns).join(after, [*keys, "t"])


def delay_pairs(catalog: DataFrame, delays: int) -> DataFrame:
    """(dataset, before, after): newest frames of consecutive delay states; a dataset without a pair fails the job."""
    if delays < 1:
        raise ValueError(f"delays must be >= 1, got {delays}")
    message = F.concat(F.lit(f"fewer than {delays + 1} steps in "), F.col("dataset"))
    newest = F.when(F.col("n_steps") >= delays + 1, F.expr(f"sequence({delays - 1}, n_steps - 2)"))
    pairs = newest.otherwise(F.raise_error(message).cast("array<int>"))
    return catalog.select("dataset", F.explode(pairs).alias("before")).withColumn("after", F.col("before") + 1)


def lagged_features(
    latents: DataFrame, window: int, keys: tuple[str, ...] = ("dataset",), block: int = 4096
) -> DataFrame:
    """(keys, t, features, target): the `window` latents before t, newest first, and the one at t."""
    if window < 1:
        raise ValueError(f"window must be >= 1, got {window}")
    parts = halo_blocks(latents, "t", before=window, after=0, block=block)
    near = halo_window(list(keys), "t")
    lags = [F.lag("z", k).over(near) for k in range(1, window + 1)]
    rows = parts.select(
        *keys,
        "t",
        F.flatten(F.array(*lags)).alias("features"),
        F.col("z").alias("target"),
        "_core",
        "_block",
    )
    # A missing lag makes the flattened array NULL.
    return core_rows(rows).filter("features IS NOT NULL")


def epoch_batches(
    catalog: DataFrame, span: int, seed: int, epoch: int, batch_size: int, samples: int | None = None
) -> DataFrame:
    """(position, batch, dataset, start): a seeded order of all windows of `span` frames, in full
    batches; more samples than windows cycle through further permutations.

    The order is by an md5 of (seed, epoch, cycle, dataset, start). Its leading hex digits make
    4096 even buckets, so positions come from bucket offsets plus ranks inside small buckets.
    """
    base = catalog.filter(F.col("n_steps") >= span).select(
        "dataset", F.explode(F.expr(f"sequence(0, n_steps - {span})")).alias("start")
    )
    size = base.agg(F.count("*").alias("n"))
    wanted = F.col("n") if samples is None else F.lit(samples).cast("long")
    cycles = F.sequence(F.lit(0), (F.ceil(wanted / F.col("n")) - 1).cast("int"))
    key = F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("cycle").cast("string"), "dataset",
                    F.col("start").cast("string")).cast("binary")
    )
    hashed = (
        base.join(F.broadcast(size))  # one row
        .withColumn("cycle", F.explode(cycles))
        .withColumn("_key", key)
        .withColumn("_bucket", F.substring("_key", 1, 3))
    )
    counts = hashed.groupBy("cycle", "_bucket").agg(F.count("*").alias("_c"))
    # At most 4096 rows per cycle.
    before = Window.partitionBy("cycle").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    inside = Window.partitionBy("cycle", "_bucket").orderBy("_key")
    position = F.col("cycle") * F.col("n") + F.col("_offset") + F.col("_rank") - 1
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets.drop("_c"), ["cycle", "_bucket"])
        .withColumn("position", position.cast("long"))
        .filter(F.col("position") < F.floor(wanted / batch_size) * batch_size)
        .select("position", F.floor(F.col("position") / batch_size).cast("long").alias("batch"), "dataset", "start")
    )


def block_means(series: DataFrame, keys: list[str], block_steps: int, step: str = "t") -> DataFrame:
    """Means of consecutive blocks; the last may be shorter. `step` counts from 0."""
    if block_steps < 1:
        raise ValueError(f"block_steps must be >= 1, got {block_steps}")
    return series.groupBy(
        *keys, F.floor(F.col(step) / block_steps).cast("int").alias("block")
    ).agg(F.avg("value").alias("value"))
