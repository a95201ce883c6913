"""Modal decompositions per dataset: state matrix, POD, exact DMD, SPOD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gridtide.functions.batches import stacks, sums_by_key
from gridtide.functions.layout import channels
from gridtide.operators.linalg import (
    FLUSH_BYTES,
    MAX_WIDTH,
    SLAB,
    dealt,
    eigenbasis,
    gram,
    gram_entries,
    leading_eigenpairs,
    project,
    square,
    sum_arrays,
    wide_eigenbasis,
)
from gridtide.operators.spectra import TWO_PI, check_segments, segments
from gridtide.operators.stats import fluctuation
from gridtide.schema import Grid, with_grid
from gridtide.session import materialize

X_PER_TILE, Y_PER_TILE, FRAMES_PER_TILE = 16, 128, 1024
BLOCK_CELLS = 4096
#: Rows of up to so many segments are multiplied together, so many rows at once.
NARROW, NARROW_ROWS = 16, 4096
# A Gram matrix resolves singular values down to about the root of the float epsilon.
GRAM_TOLERANCE = 1e-7
CELL = ["channel", "x", "y"]


def state_blocks(field: DataFrame, grid: Grid | DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(dataset, t, block, vec): fluctuations flattened channel by channel, cut in blocks."""
    position = (
        F.when(F.col("channel") == "u_x", 0).otherwise(1) * F.col("nx") + F.col("x")
    ) * F.col("ny") + F.col("y")
    cells = with_grid(channels(fluctuation(field), "dataset", "t", "x", "y"), grid, "nx", "ny")
    return (
        cells.select("dataset", "t", position.alias("p"), "u")
        .groupBy("dataset", "t", F.floor(F.col("p") / block_cells).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("p", "u"))).alias("v"))
        .select("dataset", "t", "block", F.col("v.u").alias("vec"))
    )


def cell_rows(field: DataFrame) -> DataFrame:
    """(dataset, channel, x, y, vec): each cell's fluctuation over time, frames as short axis."""
    packed = field.groupBy("dataset", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("t", "u_x", "u_y"))).alias("s")
    )
    both = packed.select(
        "dataset", "x", "y",
        F.explode(
            F.array(
                F.struct(F.lit("u_x").alias("channel"), F.col("s.u_x").alias("vec")),
                F.struct(F.lit("u_y").alias("channel"), F.col("s.u_y").alias("vec")),
            )
        ).alias("c"),
    )
    mean = F.expr("aggregate(c.vec, 0D, (a, v) -> a + v) / size(c.vec)")
    return both.withColumn("m", mean).select(
        "dataset", F.col("c.channel").alias("channel"), "x", "y",
        F.expr("transform(c.vec, v -> v - m)").alias("vec"),
    )


def _tile() -> list[Column]:
    return [F.floor(F.col("x") / X_PER_TILE), F.floor(F.col("y") / Y_PER_TILE)]


def frame_gram(field: DataFrame) -> DataFrame:
    """(dataset, i, j, g): inner products of a dataset's frames."""
    return gram_entries(cell_rows(field), ["dataset"])


def pod_factors(
    rows: DataFrame, rank: int | None = None, tolerance: float = GRAM_TOLERANCE, n_frames: int | None = None
) -> DataFrame:
    """(dataset, mode, s, share, n_values, v) from cell rows; coefficients over time are s * v.

    `n_frames`, the longest dataset's length, says whether a task can square the frames. Beyond `MAX_WIDTH` of them a rank
    is needed, and a subspace of that rank is iterated instead.
    """
    if n_frames is not None and n_frames > MAX_WIDTH:
        if rank is None:
            raise ValueError(f"{n_frames} frames exceed {MAX_WIDTH}: give a rank")
        return wide_eigenbasis(rows, "dataset", rank, tolerance)
    return eigenbasis(gram(rows, ["dataset"]), ["dataset"], rank, tolerance)


def pod_modes(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(dataset, channel, x, y, coef): mode shapes U = X V / S, one array over modes per cell."""
    weights = factors.select(
        "dataset", "mode", F.expr("transform(v, a -> a / s)").alias("w")
    )
    return project(rows, ["dataset"], _tile(), CELL, weights)


def pod_coefficients(factors: DataFrame) -> DataFrame:
    """(dataset, mode, t, value)."""
    return factors.select(
        "dataset", "mode", "s", F.posexplode("v").alias("t", "a")
    ).select("dataset", "mode", "t", (F.col("s") * F.col("a")).alias("value"))


def pod_report(factors: DataFrame, level: float = 0.9) -> DataFrame:
    """Per mode: share, cumulative share, coefficient std; and how many modes reach `level`.

    Ordered by mode, of which there are at most as many as the short axis is wide.
    """
    run = Window.partitionBy("dataset").orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)
    table = factors.select(
        "dataset",
        "mode",
        F.col("share").alias("energy_fraction"),
        F.sum("share").over(run).alias("cumulative"),
        F.expr(
            "s * sqrt(aggregate(v, 0D, (a, x) -> a + x * x) / size(v)"
            " - power(aggregate(v, 0D, (a, x) -> a + x) / size(v), 2))"
        ).alias("coefficient_std"),
    )
    needed = table.groupBy("dataset").agg(
        (F.count_if(F.col("cumulative") < level) + 1).alias("modes_for_level")
    )
    return table.join(needed, "dataset")


def reconstruct(modes: DataFrame, factors: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """(dataset, channel, x, y, t, value): summed contribution of the chosen modes (default all)."""
    if chosen is not None:
        factors = factors.filter(F.col("mode").isin(chosen))
        # The shapes of the chosen modes only, in ascending order like their courses; a dataset may have fewer modes.
        some = F.array(*[F.lit(k) for k in sorted(set(chosen))])
        modes = modes.withColumn("coef", F.transform(F.filter(some, lambda k: k < F.size("coef")), lambda k: F.col("coef")[k]))
    courses = factors.select("dataset", "mode", F.col("s").alias("_s"), F.posexplode("v").alias("t", "a"))
    weights = (
        courses.groupBy("dataset", "t")
        .agg(F.array_sort(F.collect_list(F.struct("mode", (F.col("_s") * F.col("a")).alias("c")))).alias("w"))
        .select("dataset", _frames(F.col("t")), F.col("t").alias("mode"), F.col("w.c").alias("w"))
    )
    # The modes are the summed axis; frames come in tiles, so no group holds a whole dataset's.
    spans = factors.select("dataset", F.explode(F.expr(f"sequence(0, cast((size(v) - 1) div {FRAMES_PER_TILE} as int))")).alias("frames")).distinct()
    done = project(modes.join(spans, "dataset"), ["dataset", "frames"], _tile(), CELL, weights, vec="coef", whole=True)
    return done.select("dataset", "frames", *CELL, F.posexplode("coef").alias("i", "value")).select(
        "dataset", *CELL, (F.col("frames") * FRAMES_PER_TILE + F.col("i")).alias("t"), "value"
    )


def _frames(t: Column) -> Column:
    return F.floor(t / FRAMES_PER_TILE).cast("int").alias("frames")


# --- exact DMD --------------------------------------------------------------------------------

DMD_SCHEMA = (
    "mode int, lam_re double, lam_im double, energy_fraction double, amp_re double, amp_im double,"
    " norm double, w_re array<double>, w_im array<double>"
)


def exact_dmd(
    rows: DataFrame, rank: int | None = None, tolerance: float = GRAM_TOLERANCE, n_frames: int | None = None
) -> DataFrame:
    """(dataset, mode, lam, energy_fraction, amplitude, norm, w): exact DMD from the frames' Gram.

    X and X' are the frames without the last and without the first, so all products of them are
    blocks of one Gram matrix G: A~ from X'X, mode norms and the least-squares amplitudes of the
    first frame from the blocks as well. `w` are each mode's weights over the frames of X'.
    More than `MAX_WIDTH` frames (`n_frames` is the longest dataset's number) need a rank.
    """
    if n_frames is not None and n_frames > MAX_WIDTH:
        if rank is None:
            raise ValueError(f"{n_frames} frames exceed {MAX_WIDTH}: give a rank")
        return _wide_dmd(rows, rank, tolerance)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        g = square(part)
        values, s, v = leading_eigenpairs(g[:-1, :-1], rank, tolerance)
        scaled = v / s
        reduced = scaled.T @ g[:-1, 1:] @ scaled
        lam, w = np.linalg.eig(reduced)
        weights = scaled @ w  # modes = X' weights
        order = np.lexsort((-lam.imag, -np.abs(lam)))
        lam, weights = lam[order], weights[:, order]
        inner = weights.conj().T @ g[1:, 1:] @ weights  # modes' own products
        amplitude = np.linalg.lstsq(inner, weights.conj().T @ g[1:, 0], rcond=None)[0]
        out = pd.DataFrame(
            {
                "dataset": key[0],
                "mode": np.arange(len(lam)),
                "lam_re": lam.real,
                "lam_im": lam.imag,
                "energy_fraction": (s**2).sum() / values.sum(),
                "amp_re": amplitude.real,
                "amp_im": amplitude.imag,
                "norm": np.sqrt(np.maximum(np.diag(inner).real, 0.0)),
            }
        )
        frames = np.vstack([np.zeros((1, len(lam))), weights])  # the first frame is not in X'
        out["w_re"], out["w_im"] = list(frames.real.T), list(frames.imag.T)
        return out

    return dealt(gram(rows, ["dataset"]), "dataset").groupBy("dataset").applyInPandas(
        solve, "dataset string, " + DMD_SCHEMA
    )


def _wide_dmd(rows: DataFrame, rank: int, tolerance: float) -> DataFrame:
    """`exact_dmd` without a Gram of frames: X = U S V^T by iteration, then products of X V, X' V and the first frame,
    which are as wide as the rank. The modes' weights are V times a small matrix, made slab by slab."""
    frames = materialize(rows.select("dataset", *CELL, "vec"), "frames")
    early = frames.withColumn("vec", F.expr("slice(vec, 1, size(vec) - 1)"))
    late = frames.withColumn("vec", F.expr("slice(vec, 2, size(vec) - 1)"))
    factors = wide_eigenbasis(early, "dataset", rank, tolerance)
    weights = factors.select("dataset", "mode", F.expr("transform(v, a -> a / s)").alias("w"))
    first = frames.select("dataset", *CELL, F.expr("slice(vec, 1, 1)").alias("first"))
    u = project(early, ["dataset"], _tile(), CELL, weights).withColumnRenamed("coef", "now")
    y = project(late, ["dataset"], _tile(), CELL, weights).withColumnRenamed("coef", "next")
    near = u.join(y, ["dataset", *CELL]).join(first, ["dataset", *CELL])
    grams = gram(near.select("dataset", F.concat("now", "next", "first").alias("vec")), ["dataset"])
    shares = factors.groupBy("dataset").agg(F.sum("share").alias("share"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        g, share = square(part), part["share"].iloc[0]
        r = len(g) // 2
        lam, w = np.linalg.eig(g[:r, r : 2 * r])  # U^T X' V / S
        order = np.lexsort((-lam.imag, -np.abs(lam)))
        lam, w = lam[order], w[:, order]
        inner = w.conj().T @ g[r : 2 * r, r : 2 * r] @ w
        amplitude = np.linalg.lstsq(inner, w.conj().T @ g[r : 2 * r, 2 * r], rcond=None)[0]
        return pd.DataFrame({
            "dataset": part["dataset"].iloc[0], "mode": np.arange(r), "lam_re": lam.real, "lam_im": lam.imag, "energy_fraction": share,
            "amp_re": amplitude.real, "amp_im": amplitude.imag, "norm": np.sqrt(np.maximum(np.diag(inner).real, 0.0)),
            "c_re": list(w.real.T), "c_im": list(w.imag.T),
        })

    small = materialize(
        dealt(grams.join(shares, "dataset"), "dataset").groupBy("dataset").applyInPandas(
            solve,
            "dataset string, mode int, lam_re double, lam_im double, energy_fraction double, amp_re double, amp_im double,"
            " norm double, c_re array<double>, c_im array<double>",
        ),
        "dmd",
    )
    # Weights over the frames: for each mode the sum over the factors of v / s times the mode's coefficient.
    scaled = weights.withColumnRenamed("mode", "factor").select("dataset", "factor", F.posexplode(F.expr(
        f"transform(sequence(0, (size(w) - 1) div {SLAB}), k -> slice(w, k * {SLAB} + 1, {SLAB}))")).alias("slab", "part"))
    pieces = small.select("dataset", "mode", F.posexplode(F.arrays_zip("c_re", "c_im")).alias("factor", "c")).join(scaled, ["dataset", "factor"])
    both = pieces.select("dataset", "mode", "slab", F.expr("concat(transform(part, p -> p * c.c_re), transform(part, p -> p * c.c_im))").alias("w"))
    summed = sum_arrays(both, ["dataset", "mode", "slab"], "w").select(
        "dataset", "mode", "slab", F.expr("slice(w, 1, size(w) div 2)").alias("re"), F.expr("slice(w, size(w) div 2 + 1, size(w) div 2)").alias("im")
    )
    whole = summed.groupBy("dataset", "mode").agg(F.array_sort(F.collect_list(F.struct("slab", "re", "im"))).alias("p")).select(
        "dataset", "mode",
        F.concat(F.array(F.lit(0.0)), F.flatten("p.re")).alias("w_re"),  # the first frame is not in X'
        F.concat(F.array(F.lit(0.0)), F.flatten("p.im")).alias("w_im"),
    )
    return materialize(small.drop("c_re", "c_im").join(whole, ["dataset", "mode"]), "dmd")


def dmd_modes(rows: DataFrame, dmd: DataFrame) -> DataFrame:
    """(dataset, channel, x, y, re, im): complex mode shapes, arrays over modes."""
    weights = dmd.select(
        "dataset",
        F.explode(
            F.array(
                F.struct((2 * F.col("mode")).alias("mode"), F.col("w_re").alias("w")),
                F.struct((2 * F.col("mode") + 1).alias("mode"), F.col("w_im").alias("w")),
            )
        ).alias("p"),
    ).select("dataset", "p.mode", "p.w")
    both = project(rows, ["dataset"], _tile(), CELL, weights)
    return both.select(
        "dataset", *CELL,
        F.expr("filter(coef, (v, i) -> i % 2 = 0)").alias("re"),
        F.expr("filter(coef, (v, i) -> i % 2 = 1)").alias("im"),
    )


def dominant_dmd_modes(dmd: DataFrame, lengths: DataFrame, n_modes: int, dt: float = 1.0) -> DataFrame:
    """Top modes by |amplitude| * norm, one of each conjugate pair: frequency, growth, period,
    power at the first frame and RMS power over the dataset's `n_steps`."""
    mu_re = F.ln(F.hypot("lam_re", "lam_im")) / dt
    mu_im = F.atan2("lam_im", "lam_re") / dt
    power = F.hypot("amp_re", "amp_im") * F.col("norm")
    g2 = 2 * F.col("growth_rate")
    n = F.col("n_steps")
    # Mean of exp(2 g t) over t = 0..n-1, a geometric sum; expm1 keeps it exact for small g.
    mean_square = F.when(F.abs(g2) < 1e-15, 1.0).otherwise(F.expm1(g2 * n) / F.expm1(g2) / n)
    ranked = Window.partitionBy("dataset").orderBy(F.desc("power"), F.asc("mode"))
    return (
        dmd.select("dataset", "mode", "lam_re", "lam_im", mu_im.alias("frequency"), mu_re.alias("growth_rate"),
                   "amp_re", "amp_im", power.alias("power"))
        .filter("frequency >= 0")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n_modes)
        .join(lengths.select("dataset", "n_steps"), "dataset")
        .select(
            "dataset", "rank", "mode", "lam_re", "lam_im", "frequency", "growth_rate",
            F.when(F.col("frequency") != 0, TWO_PI / F.col("frequency")).otherwise(float("inf")).alias("period"),
            "power",
            (F.col("power") * F.sqrt(mean_square)).alias("rms_power"),
        )
    )


def mode_evolution(
    modes: DataFrame, dmd: DataFrame, mode: int, n_frames: int | DataFrame, normalize_growth: bool = True
) -> DataFrame:
    """(dataset, channel, x, y, t, value): Re(a phi lambda^t), t < n_frames, in polar form.

    `n_frames` is one number or (dataset, n_steps). `modes` holds the shapes of all modes, or of this one only. With
    `normalize_growth` an oscillating mode keeps its amplitude; a real one keeps its growth.
    """
    radius, phase = F.hypot("lam_re", "lam_im"), F.atan2("lam_im", "lam_re")
    size = F.when((F.lit(normalize_growth)) & (F.col("lam_im") != 0), 1.0).otherwise(radius)
    own = dmd.filter(F.col("mode") == mode)
    own = own.withColumn("_n", F.lit(n_frames)) if isinstance(n_frames, int) else own.join(n_frames.select("dataset", F.col("n_steps").alias("_n")), "dataset")
    turns = (
        own.select("dataset", size.alias("size"), phase.alias("phase"), "amp_re", "amp_im",
                F.explode(F.expr("sequence(0, cast(_n - 1 as int))")).alias("t"))
        .withColumn("g", F.pow("size", F.col("t").cast("double")))
        .select(
            "dataset", "t",
            (F.col("g") * (F.col("amp_re") * F.cos(F.col("phase") * F.col("t")) - F.col("amp_im") * F.sin(F.col("phase") * F.col("t")))).alias("c_re"),
            (F.col("g") * (F.col("amp_re") * F.sin(F.col("phase") * F.col("t")) + F.col("amp_im") * F.cos(F.col("phase") * F.col("t")))).alias("c_im"),
        )
    )
    place = F.when(F.size("re") == 1, 0).otherwise(mode)
    shape = modes.select("dataset", *CELL, F.col("re")[place].alias("re"), F.col("im")[place].alias("im"))
    return shape.join(turns, "dataset").select(
        "dataset", *CELL, "t", (F.col("re") * F.col("c_re") - F.col("im") * F.col("c_im")).alias("value")
    )


# --- SPOD -------------------------------------------------------------------------------------


def segment_waves(field: DataFrame, nperseg: int, noverlap: int) -> DataFrame:
    """(dataset, k, channel, x, y, re, im): per frequency and cell, arrays over the segments.

    Scaled so that summed squares over cells, averaged over segments, are the total Welch density.
    """
    check_segments(nperseg, noverlap)
    scale = 1 / np.sqrt((np.hanning(nperseg) ** 2).sum() * TWO_PI)
    doubled = slice(1, (nperseg + 1) // 2)

    @pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im")]))
    def waves(batch: pd.Series) -> pd.DataFrame:
        v = np.stack(batch.to_list())
        z = np.fft.rfft((v - v.mean(axis=1, keepdims=True)) * np.hanning(nperseg), axis=1) * scale
        z[:, doubled] *= np.sqrt(2)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    series = channels(field, "dataset", "x", "y", "t").withColumnRenamed("u", "value")
    cut = segments(series, ["dataset", *CELL], nperseg, noverlap).withColumn("z", waves("values"))
    return (
        cut.select("dataset", *CELL, "seg", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("k", "w"))
        .groupBy("dataset", "k", *CELL)
        .agg(F.array_sort(F.collect_list(F.struct("seg", "w.re", "w.im"))).alias("s"))
        .select("dataset", "k", *CELL, F.col("s.re").alias("re"), F.col("s.im").alias("im"))
    )


def _products(keys: pd.DataFrame, z: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(keys, sums) of the rows' outer products, real parts before imaginary ones. Narrow rows are multiplied all at once,
    wide ones key by key."""
    n = z.shape[1]
    if n <= NARROW:
        for start in range(0, len(z), NARROW_ROWS):
            some = z[start : start + NARROW_ROWS]
            g = (some.conj()[:, :, None] * some[:, None, :]).reshape(len(some), -1)
            own, _, sums = sums_by_key(keys.iloc[start : start + NARROW_ROWS], np.concatenate((g.real, g.imag), axis=1))
            yield own, sums
        return
    for (dataset, k), at in keys.groupby(["dataset", "k"], sort=False, dropna=False).indices.items():
        g = z[at].conj().T @ z[at]
        yield pd.DataFrame({"dataset": [dataset], "k": [k]}), np.concatenate([g.real.ravel(), g.imag.ravel()])[None, :]


def spod(waves: DataFrame, nperseg: int) -> DataFrame:
    """(dataset, k, omega, mode, eigenvalue, w_re, w_im): modes per frequency, from the
    segments x segments Gram of that frequency; `w` are a mode's weights over the segments."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sums of a task by number of segments: (keys, sums) pairs, folded when they have grown.
        held: dict[int, list[tuple[pd.DataFrame, np.ndarray]]] = {}
        size = 0

        def folded() -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
            for n, parts in held.items():
                found, _, sums = sums_by_key(pd.concat([p for p, _ in parts], ignore_index=True), np.concatenate([g for _, g in parts]))
                yield n, found, sums

        for batch in batches:
            for at, re in stacks(batch["re"]):
                n = re.shape[1]
                if n > MAX_WIDTH:
                    raise ValueError(f"more than {MAX_WIDTH} segments: use longer ones")
                z = re + 1j * np.stack(batch["im"].iloc[at].to_list())
                keys = batch[["dataset", "k"]].iloc[at].reset_index(drop=True)
                for own, g in _products(keys, z):
                    held.setdefault(n, []).append((own, g))
                    size += g.nbytes
            if size > FLUSH_BYTES:
                held = {n: [(found, sums)] for n, found, sums in folded()}
                size = sum(g.nbytes for parts in held.values() for _, g in parts)
                if size > FLUSH_BYTES // 2:
                    for parts in held.values():
                        yield parts[0][0].assign(g=list(parts[0][1]))
                    held, size = {}, 0
        for _, found, sums in folded():
            yield found.assign(g=list(sums))

    sums = sum_arrays(
        waves.mapInPandas(partial, "dataset string, k int, g array<double>"), ["dataset", "k"], "g"
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, g in stacks(batch["g"]):
                n = int(round(np.sqrt(g.shape[1] / 2)))
                square = g[:, : n * n].reshape(-1, n, n) + 1j * g[:, n * n :].reshape(-1, n, n)
                for some in np.array_split(np.arange(len(at)), max(1, square.nbytes // FLUSH_BYTES)):
                    if not len(some):
                        continue
                    values, vectors = np.linalg.eigh(square[some])
                    values, vectors = np.maximum(values[:, ::-1], 0.0), vectors[:, :, ::-1]
                    top = np.argmax(np.abs(vectors), axis=1)[:, None, :]
                    vectors = vectors * np.exp(-1j * np.angle(np.take_along_axis(vectors, top, axis=1)))
                    scaled = vectors / np.sqrt(np.where(values > 0, values, np.inf))[:, None, :]
                    weights = scaled.transpose(0, 2, 1).reshape(-1, n)
                    own = batch[["dataset", "k"]].iloc[np.repeat(at[some], n)].reset_index(drop=True)
                    yield own.assign(
                        mode=np.tile(np.arange(n), len(some)), eigenvalue=(values / n).ravel(), w_re=list(weights.real), w_im=list(weights.imag)
                    )

    modes = sums.mapInPandas(
        solve,
        "dataset string, k int, mode int, eigenvalue double, w_re array<double>, w_im array<double>",
    )
    return modes.select(
        "dataset", "k", (TWO_PI * F.col("k") / nperseg).alias("omega"), "mode", "eigenvalue", "w_re", "w_im"
    )


def spod_modes(waves: DataFrame, modes: DataFrame, n_modes: int = 1) -> DataFrame:
    """(dataset, k, mode, channel, x, y, re, im): orthonormal shapes of the leading modes."""
    near = waves.join(modes.filter(F.col("mode") < n_modes), ["dataset", "k"])
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    return near.select(
        "dataset", "k", "mode", *CELL,
        F.expr(f"{dot('re', 'w_re')} - {dot('im', 'w_im')}").alias("re"),
        F.expr(f"{dot('re', 'w_im')} + {dot('im', 'w_re')}").alias("im"),
    )


def leading_frequencies(modes: DataFrame, n_peaks: int) -> DataFrame:
    """Top frequencies by the first mode's eigenvalue, k = 0 left out, with their share."""
    leading = modes.filter("mode = 0 AND k >= 1")
    total = leading.groupBy("dataset").agg(F.sum("eigenvalue").alias("total"))
    ranked = Window.partitionBy("dataset").orderBy(F.desc("eigenvalue"), F.asc("k"))
    return (
        leading.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n_peaks)
        .join(total, "dataset")
        .select(
            "dataset", "rank", (TWO_PI / F.col("omega")).alias("period"), "omega", "eigenvalue",
            (F.col("eigenvalue") / F.col("total")).alias("eigenvalue_fraction"),
        )
    )
