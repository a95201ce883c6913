"""Autocorrelation of fields and series, decorrelation metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.batches import map_stacks, stacks, sums_by_key
from gridtide.functions.fourier import at_most, split_fft
from gridtide.functions.layout import halo_blocks
from gridtide.operators.spectra import series_lengths
from gridtide.operators.stats import fluctuation
from gridtide.session import measured

MAX_FIELD_LAG = 150
BLOCK = 1024
# Decorrelation thresholds.
ONE_OVER_E = 1 / np.e
SMALL = 0.05


def _lag_sums(rows: np.ndarray, core: int, max_lag: int) -> np.ndarray:
    """Per row, sums over the first `core` positions of v[t] v[t + lag], v 0 past its end."""
    n = rows.shape[1]
    size = 1 << int(np.ceil(np.log2(n + core)))
    product = np.conj(np.fft.rfft(rows[:, :core], size, axis=1)) * np.fft.rfft(rows, size, axis=1)
    sums = np.fft.irfft(product, size, axis=1)
    if max_lag >= sums.shape[1]:
        sums = np.pad(sums, ((0, 0), (0, max_lag + 1 - sums.shape[1])))
    sums[:, n:] = 0.0  # no overlap is left
    return sums[:, : max_lag + 1]


def field_autocorrelation(
    field: DataFrame, max_lag: int = MAX_FIELD_LAG, block: int = BLOCK, lengths: DataFrame | None = None
) -> DataFrame:
    """(dataset, channel, lag, rho): lagged products of u' summed over space, then normalized.

    Each cell's series is cut into blocks with `max_lag` following steps, so no group grows with
    the dataset's length; Arrow batches are summed before the shuffle. Lags reach half the length.
    `lengths` is a catalog (dataset, n_steps), looked up from the field when there is none.
    """
    cut = halo_blocks(fluctuation(field), "t", before=0, after=max_lag, block=block)
    lines = (
        cut.groupBy("dataset", "x", "y", "_block")
        .agg(
            F.array_sort(F.collect_list(F.struct("t", "u_x", "u_y"))).alias("s"),
            F.count_if("_core").cast("int").alias("core"),
        )
        .filter("core > 0")
        .select("dataset", "core", F.col("s.u_x").alias("u_x"), F.col("s.u_y").alias("u_y"))
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for core in batch["core"].unique():
                part = batch[batch["core"] == core]
                for channel in ("u_x", "u_y"):
                    for at, rows in stacks(part[channel]):
                        found, _, total = sums_by_key(part[["dataset"]].iloc[at], _lag_sums(rows, core, max_lag))
                        yield found.assign(channel=channel, s=list(total))

    total = (
        lines.mapInPandas(sums, "dataset string, channel string, s array<double>")
        .select("dataset", "channel", F.posexplode("s").alias("lag", "s"))
        .groupBy("dataset", "channel", "lag")
        .agg(F.sum("s").alias("s"))
    )
    if lengths is None:
        lengths = field.groupBy("dataset").agg((F.max("t") + 1).cast("int").alias("n_steps"))
    return _normalized(
        total.join(lengths, "dataset").filter("lag <= n_steps div 2"), ["dataset", "channel"]
    )


def _normalized(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Unbiased sums over lag 0's; a key has at most as many rows as there are lags."""
    cov = sums.withColumn("c", F.col("s") / (F.col("n_steps") - F.col("lag")))
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy(*keys))
    return cov.select(*keys, "n_steps", "lag", (F.col("c") / zero).alias("rho"))


def series_autocorrelation(
    series: DataFrame, keys: list[str], limit: int = 1 << 14, longest: int | None = None
) -> DataFrame:
    """(keys, n_steps, lag, rho), lags to a third of the length.

    Series up to `limit` steps are one array each; longer ones go through a zero-padded
    power-of-two transform that is split over tasks.
    """
    # Lag 0 is the variance, so no product has to be looked up among the sums.
    facts = measured(
        series.groupBy(*keys).agg(
            F.count("*").cast("int").alias("n_steps"), F.avg("value").alias("_mean"), F.var_pop("value").alias("c0")
        ),
        "series",
    )
    centred = series.join(facts, keys).withColumn("v", F.col("value") - F.col("_mean"))
    if longest is None:
        longest = facts.agg(F.max("n_steps").alias("n")).first().n or 0
    else:
        centred = centred.filter(at_most("n_steps", longest))
    short = centred.filter(F.col("n_steps") <= limit)
    packed = short.groupBy(*keys, "n_steps", "c0").agg(
        F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")
    ).select(*keys, "n_steps", "c0", F.col("s.v").alias("v"))

    @F.pandas_udf("array<double>")
    def lags(values: pd.Series) -> pd.Series:
        return map_stacks(values, lambda rows: _lag_sums(rows, rows.shape[1], rows.shape[1] // 3))

    sums = packed.select(*keys, "n_steps", "c0", F.posexplode(lags("v")).alias("lag", "s"))
    if longest > limit:
        m = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n_steps")))).cast("long")
        long = centred.filter(F.col("n_steps") > limit).select(
            *keys, m.alias("m"), F.col("t").cast("long").alias("t"), F.col("v").alias("re"), F.lit(0.0).alias("im")
        )
        power = split_fft(long, keys).select(
            *keys, "m", F.col("k").alias("t"),
            (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"),
        )
        back = split_fft(power, keys, inverse=True).join(facts, keys).filter("k <= n_steps div 3")
        sums = sums.unionByName(
            back.select(*keys, "n_steps", "c0", F.col("k").cast("int").alias("lag"), F.col("re").alias("s"))
        )
    rho = F.col("s") / (F.col("n_steps") - F.col("lag")) / F.when(F.col("c0") > 0, F.col("c0"))
    return sums.select(*keys, "n_steps", "lag", rho.alias("rho"))


def decorrelation(acf: DataFrame, keys: list[str]) -> DataFrame:
    """lag1, first lags below 1/e, 0.05 and 0, integral time scale, effective samples."""
    first = lambda level: F.min(F.when(F.col("rho") <= level, F.col("lag")))
    marks = acf.groupBy(*keys).agg(
        F.max(F.when(F.col("lag") == 1, F.col("rho"))).alias("lag1"),
        first(ONE_OVER_E).alias("one_over_e"),
        first(SMALL).alias("below_005"),
        first(0.0).alias("zero"),
        F.max("n_steps").alias("n_steps"),
    )
    before_zero = (
        acf.join(marks.select(*keys, "zero"), keys)
        .filter("lag >= 1 AND lag < zero")
        .groupBy(*keys)
        .agg(F.sum("rho").alias("s"))
    )
    tau = F.when(F.col("zero").isNotNull(), 0.5 + F.coalesce("s", F.lit(0.0)))
    return marks.join(before_zero, keys, "left").select(
        *keys,
        "lag1",
        "one_over_e",
        "below_005",
        "zero",
        tau.alias("tau_int"),
        F.when(tau != 0, F.col("n_steps") / (2 * tau)).alias("n_eff"),
    )


def white_noise_band(series: DataFrame, keys: list[str]) -> DataFrame:
    return series_lengths(series, keys).select(*keys, (1.96 / F.sqrt("n_steps")).alias("band"))
