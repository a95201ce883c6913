"""Spectra: periodogram, Welch, peaks, line and 2-D wavenumber spectra, space-time spectrum.

One convention throughout: mean removed, symmetric Hann window, divided by the window's power and
2 pi, bins 1.. doubled except the Nyquist bin of an even length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.functions.batches import group_stacks, map_stacks, stacks, starts_of, sums_by_key
from gridtide.functions.fourier import DIRECT_LIMIT, dft
from gridtide.functions.layout import channels, core_rows, halo_blocks, halo_window
from gridtide.operators.derive import whole_frames
from gridtide.schema import Grid, with_grid
from gridtide.session import measured

TWO_PI = 2 * np.pi
# Points of a packed line that one group takes of every line of a frame.
Y_SPAN = 64
# From so many series on, their lengths are dealt with the series instead of sent to every task.
MANY_SERIES = 100_000
# Fixed value: power below this share of the true peak counts as zero.
SPECTRUM_FLOOR_RATIO = 1e-10


def hann(i: Column, n: Column) -> Column:
    """Symmetric Hann window (1 for a single point)."""
    return F.when(n > 1, 0.5 - 0.5 * F.cos(TWO_PI * i / (n - 1))).otherwise(1.0)


def hann_power(n: Column) -> Column:
    """Summed square of the symmetric Hann window: 3 (n - 1) / 8 from four points on."""
    return F.when(n > 3, 3.0 * (n - 1) / 8.0).when(n == 2, 0.0).otherwise(1.0)


def one_sided(k: Column, n: Column) -> Column:
    return F.when((k == 0) | ((n % 2 == 0) & (k == F.floor(n / 2))), 1.0).otherwise(2.0)


def _half_power(rows: np.ndarray, spacing: float) -> np.ndarray:
    """Power of each row of a (m, n) array."""
    n = rows.shape[1]
    window = np.hanning(n)
    z = np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * window, axis=1)
    power = (z.real**2 + z.imag**2) * spacing / (window**2).sum() / TWO_PI
    power[:, 1 : (n + 1) // 2] *= 2
    return power


@pandas_udf(T.ArrayType(T.DoubleType()))
def _segment_power(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield map_stacks(batch, lambda rows: _half_power(rows, 1.0))


def series_lengths(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.groupBy(*keys).agg((F.max("t") + 1).cast("int").alias("n_steps"))


def periodogram(
    series: DataFrame,
    keys: list[str],
    limit: int = DIRECT_LIMIT,
    longest: int | None = None,
) -> DataFrame:
    """(keys, k, omega, power) of series (keys, t, value), t dense from 0, unit spacing."""
    facts = measured(
        series.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.avg("value").alias("mean")),
        "series",
    )
    if longest is None:
        longest = facts.agg(F.max("n").alias("n")).first().n or 0
    rows = series.join(facts, keys).select(
        *keys,
        "n",
        "t",
        ((F.col("value") - F.col("mean")) * hann(F.col("t"), F.col("n"))).alias("re"),
        F.lit(0.0).alias("im"),
    )
    n, k = F.col("n"), F.col("k")
    norm = hann_power(n) * TWO_PI
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / norm * one_sided(k, n)
    return (
        dft(rows, keys, limit, longest)
        .join(facts.select(*keys, "n"), keys)
        .filter(k <= F.floor(n / 2))
        .select(*keys, "k", (TWO_PI * k / n).alias("omega"), power.alias("power"))
    )


def check_segments(nperseg: int, noverlap: int) -> None:
    if nperseg < 2 or not 0 <= noverlap < nperseg:
        raise ValueError(f"noverlap ({noverlap}) must be in [0, nperseg), nperseg is {nperseg}")


def segments(series: DataFrame, keys: list[str], nperseg: int, noverlap: int) -> DataFrame:
    """(keys, seg, values): overlapping segments, each one bounded array in time order.

    A series shorter than one segment fails the job.
    """
    check_segments(nperseg, noverlap)
    step = nperseg - noverlap
    lengths = series_lengths(series, keys)
    message = F.concat(F.lit(f"series shorter than nperseg {nperseg}: "), F.concat_ws("/", *keys))
    last = F.when(
        F.col("n_steps") >= nperseg, F.floor((F.col("n_steps") - nperseg) / step).cast("long")
    ).otherwise(F.raise_error(message).cast("long"))
    ends = measured(lengths.select(*keys, last.alias("_last")), "series")
    if ends.count() > MANY_SERIES:  # alike in all but their keys, they are small as files only
        ends = ends.hint("merge")
    placed = series.join(ends, keys).withColumn(
        "seg",
        F.explode(
            F.filter(
                F.sequence(
                    F.greatest(F.ceil((F.col("t") - nperseg + 1) / F.lit(step)), F.lit(0)).cast("long"),
                    F.floor(F.col("t") / F.lit(step)).cast("long"),
                ),
                lambda s: s <= F.col("_last"),
            )
        ),
    )
    return placed.groupBy(*keys, "seg").agg(
        F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p")
    ).select(*keys, "seg", F.col("p.value").alias("values"))


def welch(series: DataFrame, keys: list[str], nperseg: int, noverlap: int | None = None) -> DataFrame:
    """(keys, k, omega, power): mean periodogram of overlapping segments."""
    noverlap = nperseg // 2 if noverlap is None else noverlap
    power = segments(series, keys, nperseg, noverlap).withColumn("p", _segment_power("values"))
    return (
        power.select(*keys, F.posexplode("p").alias("k", "power"))
        .groupBy(*keys, "k")
        .agg(F.avg("power").alias("power"))
        .select(*keys, "k", (TWO_PI * F.col("k") / nperseg).alias("omega"), "power")
    )


def _neighbours(spectrum: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Adds the powers of bins k - 1 and k + 1; blocks of bins keep a long spectrum off one task."""
    near = halo_window(keys, "k")
    parts = halo_blocks(spectrum, "k", before=1, after=1, block=block)
    return core_rows(
        parts.withColumn("below", F.lag("power").over(near)).withColumn("above", F.lead("power").over(near))
    )


def _top(rows: DataFrame, keys: list[str], by: str, n: int, order: str = "k") -> DataFrame:
    """The n largest per key with their rank. The rank filter right on the window lets the
    optimizer keep n rows per key on the map side, before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(order))
    return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def dominant_periods(spectrum: DataFrame, keys: list[str], n_peaks: int) -> DataFrame:
    """(keys, rank, period, omega, power_fraction): strict local maxima by power."""
    total = spectrum.filter("k >= 1").groupBy(*keys).agg(F.sum("power").alias("total"))
    peaks = _neighbours(spectrum, keys).filter(
        "k >= 1 AND power > below AND power > above"
    )
    return (
        _top(peaks, keys, "power", n_peaks)
        .join(total, keys)
        .select(
            *keys,
            "rank",
            (TWO_PI / F.col("omega")).alias("period"),
            "omega",
            (F.col("power") / F.col("total")).alias("power_fraction"),
        )
    )


def interpolated_peak(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak_k, omega, power) of the highest bin k >= 1, refined by a log parabola."""
    best = (
        spectrum.filter("k >= 1")
        .groupBy(*keys)
        .agg(
            F.max_by("k", F.struct("power", -F.col("k"))).alias("k"),
            F.max("k").alias("last"),
            F.min("omega").alias("d_omega"),
        )
    )
    at = _neighbours(spectrum, keys).join(best, [*keys, "k"])
    a = F.ln(F.col("below") + F.lit(1e-300))
    b = F.ln("power")
    c = F.ln(F.col("above") + F.lit(1e-300))
    bend = a - 2 * b + c
    refine = (F.col("k") > 1) & (F.col("k") < F.col("last")) & (F.col("power") > 0) & (bend != 0)
    delta = 0.5 * (a - c) / bend
    return at.select(
        *keys,
        F.col("k").alias("peak_k"),
        F.when(refine, F.col("omega") + delta * F.col("d_omega")).otherwise(F.col("omega")).alias("omega"),
        F.when(refine, F.exp(b - 0.25 * (a - c) * delta)).otherwise(F.col("power")).alias("power"),
    )


def line_spectrum(
    field: DataFrame, grid: Grid | DataFrame, axis: str, keys: tuple[str, ...] = ("dataset",), mean: bool = True
) -> DataFrame:
    """(keys, channel, k, power): spectrum along `axis`, averaged over the other axis.

    Summed over time, or its time mean. Lines are packed per frame; each Arrow batch is summed
    before anything is shuffled again.
    """
    if axis not in ("x", "y"):
        raise ValueError(f"axis must be x or y, got {axis!r}")
    other = "y" if axis == "x" else "x"
    lines = (
        field.groupBy(*keys, "t", other)
        .agg(F.array_sort(F.collect_list(F.struct(axis, "u_x", "u_y"))).alias("line"))
        .select(*keys, F.col("line.u_x").alias("u_x"), F.col("line.u_y").alias("u_y"))
    )
    return _packed_spectrum(lines, dict(field.dtypes), grid, axis, keys, mean)


def spectrum_of_lines(
    lines: DataFrame, grid: Grid | DataFrame, axis: str, keys: tuple[str, ...] = ("dataset",), mean: bool = True
) -> DataFrame:
    """`line_spectrum` of a field at rest as lines (keys, t, x, u_x, u_y), y packed.

    Along y each line is transformed where it lies. Along x whole lines of a frame meet, a block of `Y_SPAN` points of each,
    and are turned there.
    """
    if axis == "y":
        return _packed_spectrum(lines.select(*keys, "u_x", "u_y"), dict(lines.dtypes), grid, axis, keys, mean)
    if axis != "x":
        raise ValueError(f"axis must be x or y, got {axis!r}")
    spans = F.explode(F.expr(
        f"transform(sequence(0, (size(u_x) - 1) div {Y_SPAN}), b -> struct(b, slice(u_x, b * {Y_SPAN} + 1, {Y_SPAN}) as u_x,"
        f" slice(u_y, b * {Y_SPAN} + 1, {Y_SPAN}) as u_y))"
    ))
    met = lines.select(*keys, "t", "x", spans.alias("s")).groupBy(*keys, "t", "s.b").agg(
        F.array_sort(F.collect_list(F.struct("x", "s.u_x", "s.u_y"))).alias("l")
    )
    turned = met.select(*keys, F.explode(F.expr(
        "transform(sequence(0, size(l[0].u_x) - 1), j -> struct(transform(l, e -> e.u_x[j]) as u_x, transform(l, e -> e.u_y[j]) as u_y))"
    )).alias("v")).select(*keys, "v.u_x", "v.u_y")
    return _packed_spectrum(turned, dict(lines.dtypes), grid, axis, keys, mean)


def _packed_spectrum(
    lines: DataFrame, types: dict[str, str], grid: Grid | DataFrame, axis: str, keys: tuple[str, ...], mean: bool
) -> DataFrame:
    names = list(keys)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for channel in ("u_x", "u_y"):
                for at, rows in stacks(batch[channel]):
                    found, counts, power = sums_by_key(batch[names].iloc[at], _half_power(rows, 1.0))
                    yield found.assign(channel=channel, s=list(power), lines=counts)

    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", channel string, s array<double>, lines long"
    spacing = F.col("dx") if axis == "x" else F.col("dy")
    n_other = F.col("ny") if axis == "x" else F.col("nx")
    total = (
        lines.mapInPandas(sums, schema)
        .select(*names, "channel", "lines", F.posexplode("s").alias("k", "s"))
        .groupBy(*names, "channel", "k")
        .agg(F.sum("s").alias("s"), F.sum("lines").alias("lines"))
    )
    per = F.col("lines") if mean else n_other
    n_axis = F.col("nx") if axis == "x" else F.col("ny")
    return with_grid(total, grid, "nx", "ny", "dx", "dy").select(
        *names,
        "channel",
        "k",
        (TWO_PI * F.col("k") / (n_axis * spacing)).alias("omega"),
        (F.col("s") / per * spacing).alias("power"),
    )


def frame_spectra(lines: DataFrame, grid: Grid | DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """(keys, channel, k, omega, power, axis): the time-mean `line_spectrum` along both axes of frames held as lines
    (keys, t, x, u_x, u_y). Whole frames meet once; each batch of them is summed before anything is shuffled again."""
    names = list(keys)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        for first, stacked in group_stacks(batches, [*names, "t"], ["u_x", "u_y"]):
            starts = starts_of(first, names)
            own, frames = first.select(names).take(pa.array(starts)), np.diff(np.r_[starts, len(first)])
            for channel, stack in zip(("u_x", "u_y"), stacked):
                for axis, turned in (("x", stack.transpose(0, 2, 1)), ("y", stack)):
                    power = _half_power(turned.reshape(-1, turned.shape[2]), 1.0)
                    power = np.add.reduceat(power.reshape(*turned.shape[:2], -1).sum(axis=1), starts, axis=0)
                    # A NaN stays one: as a NULL the sums would pass over it.
                    ends = pa.array(np.arange(len(power) + 1, dtype=np.int32) * power.shape[1], pa.int32())
                    facts = [pa.array([axis] * len(power)), pa.array([channel] * len(power)), pa.ListArray.from_arrays(ends, pa.array(power.ravel()))]
                    columns = [*[own[n] for n in names], *facts, pa.array(frames * turned.shape[1])]
                    yield from pa.table(columns, names=schema.names).cast(schema).to_batches()

    extra = (("axis", T.StringType()), ("channel", T.StringType()), ("s", T.ArrayType(T.DoubleType())), ("lines", T.LongType()))
    types = T.StructType([lines.schema[n] for n in names] + [T.StructField(n, t) for n, t in extra])
    total = (
        whole_frames(lines, [*names, "t"]).mapInArrow(sums, types)
        .select(*names, "axis", "channel", "lines", F.posexplode("s").alias("k", "s"))
        .groupBy(*names, "axis", "channel", "k")
        .agg(F.sum("s").alias("s"), F.sum("lines").alias("lines"))
    )
    along_x = F.col("axis") == "x"
    spacing, n_axis = F.when(along_x, F.col("dx")).otherwise(F.col("dy")), F.when(along_x, F.col("nx")).otherwise(F.col("ny"))
    return with_grid(total, grid, "nx", "ny", "dx", "dy").select(
        *names, "channel", "k",
        (TWO_PI * F.col("k") / (n_axis * spacing)).alias("omega"),
        (F.col("s") / F.col("lines") * spacing).alias("power"),
        "axis",
    )


def spectrum_summary(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Variance, and the interior peak's wavenumber and wavelength (NULL at the lowest bin)."""
    s = spectrum.filter("k >= 1").groupBy(*keys).agg(
        F.sum("power").alias("total"),
        F.min("omega").alias("dk"),
        F.max_by(F.struct("k", "omega"), F.struct("power", -F.col("k"))).alias("peak"),
    )
    peak = F.when(F.col("peak.k") != 1, F.col("peak.omega"))
    return s.select(
        *keys,
        (F.col("total") * F.col("dk")).alias("variance"),
        peak.alias("peak_k"),
        (TWO_PI / peak).alias("peak_wavelength"),
    )


def wavenumber_axes(grid: DataFrame) -> DataFrame:
    """(dataset, axis, i, k): one-sided axes of x and y, and the centred full x axis."""
    def one_sided_axis(axis, n, d):
        return grid.select(
            "dataset", F.lit(axis).alias("axis"), F.col(d).alias("d"), F.col(n).alias("n"),
            F.explode(F.expr(f"sequence(0, cast({n} div 2 as int))")).alias("i"),
        ).select("dataset", "axis", "i", (TWO_PI * F.col("i") / (F.col("n") * F.col("d"))).alias("k"))

    full = grid.select(
        "dataset", F.lit("x_centred").alias("axis"), F.col("dx").alias("d"), F.col("nx").alias("n"),
        F.explode(F.expr("sequence(0, nx - 1)")).alias("i"),
    ).select(
        "dataset", "axis", "i",
        (TWO_PI * (F.col("i") - F.floor(F.col("n") / 2)) / (F.col("n") * F.col("d"))).alias("k"),
    )
    return one_sided_axis("x", "nx", "dx").unionByName(one_sided_axis("y", "ny", "dy")).unionByName(full)


def _frames(field: DataFrame) -> DataFrame:
    """One row per frame and channel: the grid's values in (x, y) order, with its shape."""
    return (
        field.groupBy("dataset", "t")
        .agg(
            F.array_sort(F.collect_list(F.struct("x", "y", "u_x", "u_y"))).alias("c"),
            (F.max("x") + 1).alias("nx"),
            (F.max("y") + 1).alias("ny"),
        )
        .select("dataset", "t", "nx", "ny", F.col("c.u_x").alias("u_x"), F.col("c.u_y").alias("u_y"))
    )


def _frame_transforms(part: pd.DataFrame, channel: str, nx: int, ny: int) -> np.ndarray:
    block = np.stack(part[channel].to_list()).reshape(-1, nx, ny)
    window = np.outer(np.hanning(nx), np.hanning(ny))
    return np.fft.rfft2(block * window, axes=(1, 2))


def wavenumber_spectrum(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """(dataset, channel, ikx, iky, kx, ky, power): time-mean 2-D spectrum of the fluctuation about
    the time-mean field, ikx centred. Frames are transformed where they lie and summed per batch.

    The transform of the mean is the mean of the transforms, so the field is shuffled once: a batch gives each bin's mean and
    squares about it, and the means' own squares are added when the batches meet.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dataset, nx, ny), part in batch.groupby(["dataset", "nx", "ny"], sort=False):
                for channel in ("u_x", "u_y"):
                    z = _frame_transforms(part, channel, nx, ny)
                    mean = z.mean(axis=0)
                    apart = z - mean
                    power = (apart.real**2 + apart.imag**2).sum(axis=0)
                    i, j = np.indices(power.shape)
                    yield pd.DataFrame({
                        "dataset": dataset, "channel": channel, "frames": len(part),
                        "i": i.ravel(), "iky": j.ravel(), "s": power.ravel(), "re": mean.real.ravel(), "im": mean.imag.ravel(),
                    })

    parts = _frames(field).mapInPandas(
        sums, "dataset string, channel string, frames long, i int, iky int, s double, re double, im double"
    )
    weighed = lambda c: F.sum(F.col("frames") * c)
    total = parts.groupBy("dataset", "channel", "i", "iky").agg(
        F.sum("s").alias("s"), F.sum("frames").alias("frames"), weighed(F.col("re")).alias("re"), weighed(F.col("im")).alias("im"),
        weighed(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("means"),
    )
    # Squares of the batches' means about the mean of all; rounding may leave less than nothing.
    between = F.greatest(F.col("means") - (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("frames"), F.lit(0.0))
    shift = F.expr("(i + nx div 2) % nx")
    norm = hann_power(F.col("nx")) * hann_power(F.col("ny"))
    return with_grid(total, grid, "nx", "ny", "dx", "dy").select(
        "dataset",
        "channel",
        shift.cast("int").alias("ikx"),
        "iky",
        (TWO_PI * (shift - F.floor(F.col("nx") / 2)) / (F.col("nx") * F.col("dx"))).alias("kx"),
        (TWO_PI * F.col("iky") / (F.col("ny") * F.col("dy"))).alias("ky"),
        (
            (F.col("s") + between) / F.col("frames") * one_sided(F.col("iky"), F.col("ny"))
            * F.col("dx") * F.col("dy") / norm / TWO_PI**2
        ).alias("power"),
    )


def wavenumber_peak(spectrum: DataFrame) -> DataFrame:
    """Largest bin except the zero wavenumber."""
    best = F.max_by(
        F.struct("kx", "ky", "power"), F.struct("power", -F.col("ikx"), -F.col("iky"))
    )
    return (
        spectrum.filter(~((F.col("kx") == 0) & (F.col("ky") == 0)))
        .groupBy("dataset", "channel")
        .agg(best.alias("p"))
        .select("dataset", "channel", "p.kx", "p.ky", "p.power")
    )


def spacetime_spectrum(
    field: DataFrame,
    grid: Grid | DataFrame,
    limit: int = DIRECT_LIMIT,
    longest: int | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """(dataset, channel, iw, ikx, iky, omega, kx, ky, power): joint spectrum, iw and ikx centred.

    Separable: a 2-D transform per frame, a shuffle by wavenumber, a transform in time. No task
    holds more than one frame batch or one wavenumber's series. The time mean is taken from each wavenumber's series,
    where its frames meet anyway, so the field itself is shuffled once.
    """

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (nx, ny), part in batch.groupby(["nx", "ny"], sort=False):
                for channel in ("u_x", "u_y"):
                    z = _frame_transforms(part, channel, nx, ny)
                    _, i, j = np.indices(z.shape)
                    size = z[0].size
                    yield pd.DataFrame({
                        "dataset": np.repeat(part["dataset"].to_numpy(), size),
                        "channel": channel,
                        "t": np.repeat(part["t"].to_numpy(), size),
                        "i": i.ravel(), "iky": j.ravel(),
                        "re": z.real.ravel(), "im": z.imag.ravel(),
                    })

    keys = ["dataset", "channel", "i", "iky"]
    if catalog is None:
        catalog = field.groupBy("dataset").agg((F.max("t") + 1).alias("n_steps"))
    lengths = measured(catalog.select("dataset", F.col("n_steps").cast("long").alias("n")), "lengths")
    raw = _frames(field).mapInPandas(frames, "dataset string, channel string, t int, i int, iky int, re double, im double")
    series = Window.partitionBy(*keys)
    waves = raw.select(
        *keys, "t", *[(F.col(c) - F.avg(c).over(series)).alias(c) for c in ("re", "im")]
    ).join(lengths, "dataset")
    w = hann(F.col("t"), F.col("n"))
    if longest is None:
        longest = lengths.agg(F.max("n").alias("n")).first().n or 0
    turned = dft(
        waves.select(*keys, "n", "t", (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im")),
        keys, limit, longest,
    )
    norm = hann_power(F.col("n")) * hann_power(F.col("nx")) * hann_power(F.col("ny"))
    iw = F.expr("(k + n div 2) % n")
    ikx = F.expr("(i + nx div 2) % nx")
    power = (
        (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        * F.col("dx") * F.col("dy") / norm / TWO_PI**3
        * one_sided(F.col("iky"), F.col("ny"))
    )
    return with_grid(turned.join(lengths, "dataset"), grid, "nx", "ny", "dx", "dy").select(
        "dataset",
        "channel",
        iw.cast("int").alias("iw"),
        ikx.cast("int").alias("ikx"),
        "iky",
        (TWO_PI * (iw - F.floor(F.col("n") / 2)) / F.col("n")).alias("omega"),
        (TWO_PI * (ikx - F.floor(F.col("nx") / 2)) / (F.col("nx") * F.col("dx"))).alias("kx"),
        (TWO_PI * F.col("iky") / (F.col("ny") * F.col("dy"))).alias("ky"),
        power.alias("power"),
    )


def spacetime_peak(spectrum: DataFrame) -> DataFrame:
    """Largest bin except DC; period inf at zero frequency."""
    best = F.max_by(
        F.struct("omega", "kx", "ky", "power"),
        F.struct("power", -F.col("iw"), -F.col("ikx"), -F.col("iky")),
    )
    return (
        spectrum.filter("NOT (omega = 0 AND kx = 0 AND ky = 0)")
        .groupBy("dataset", "channel")
        .agg(best.alias("p"))
        .select(
            "dataset",
            "channel",
            "p.omega",
            F.when(F.col("p.omega") != 0, TWO_PI / F.abs("p.omega")).otherwise(float("inf")).alias("period"),
            "p.kx",
            "p.ky",
            "p.power",
        )
    )


def log_spectral_distance(predicted: DataFrame, true: DataFrame, keys: list[str], over: list[str]) -> DataFrame:
    """(keys, lsd): mean |log10 ratio| over `over` channels and k >= 1, powers floored relative to
    each true channel's peak."""
    floor = true.filter("k >= 1").groupBy(*keys, *over).agg(
        (SPECTRUM_FLOOR_RATIO * F.max("power")).alias("floor")
    )
    pair = (
        predicted.filter("k >= 1").select(*keys, *over, "k", F.col("power").alias("p"))
        .join(true.select(*keys, *over, "k", F.col("power").alias("q")), [*keys, *over, "k"])
        .join(floor, [*keys, *over])
    )
    ratio = F.log10(F.greatest("p", "floor") / F.greatest("q", "floor"))
    return pair.groupBy(*keys).agg(F.avg(F.abs(ratio)).alias("lsd"))


def point_series(probes: DataFrame) -> DataFrame:
    """Probe rows (dataset, label, t, u_x, u_y) as series named label.channel."""
    long = channels(probes, "dataset", "label", "t")
    return long.select(
        "dataset", F.concat_ws(".", "label", "channel").alias("name"), "t", F.col("u").alias("value")
    )


def temporal_report(series: DataFrame, keys: list[str], nperseg: int, n_peaks: int, longest: int | None = None):
    """(keys, mean, std, method, rank, period, omega, power_fraction) for periodogram and Welch."""
    facts = series.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    spectra = periodogram(series, keys, longest=longest).withColumn("method", F.lit("periodogram"))
    spectra = spectra.unionByName(welch(series, keys, nperseg).withColumn("method", F.lit("welch")))
    return facts.join(dominant_periods(spectra, [*keys, "method"], n_peaks), keys)
