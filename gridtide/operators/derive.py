"""Derived fields: stencils and row-local expressions on field tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.functions.batches import group_stacks
from gridtide.functions.layout import exact_quantiles
from gridtide.schema import Grid, with_grid

# Fixed value: guards the ratio of a field without gradients.
TINY = 1e-12
FIELDS = ("vorticity", "u_x", "u_y", "speed")
SIGNED_FIELDS = ("vorticity", "u_x", "u_y")


def grid_spacing(catalog: DataFrame, nx: int, ny: int, lx: float, ly: float) -> DataFrame:
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs at least two points per axis")
    return catalog.select(
        "dataset",
        F.lit(nx).alias("nx"),
        F.lit(ny).alias("ny"),
        F.lit(lx / (nx - 1)).alias("dx"),
        F.lit(ly / (ny - 1)).alias("dy"),
    )


def _slope(value: str, window, spacing: str) -> Column:
    """Central difference inside, one-sided at both ends."""
    ahead, behind = F.lead(value).over(window), F.lag(value).over(window)
    steps = F.when(ahead.isNull() | behind.isNull(), 1.0).otherwise(2.0)
    return (F.coalesce(ahead, value) - F.coalesce(behind, value)) / (steps * F.col(spacing))


def gradients(field: DataFrame, grid: Grid | DataFrame, *, extra_keys: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Adds dux_dx, duy_dx, dux_dy, duy_dy.

    One exchange by frame serves both stencil directions and a following per-frame aggregation. A field that is `dealt` by
    some of its frames' keys already needs none.
    """
    keys = [*extra_keys, "dataset", "t"]
    frames = with_grid(field, grid, "dx", "dy")
    frames = frames if dealt else frames.repartition(*keys)
    along_x = Window.partitionBy(*keys, "y").orderBy("x")
    along_y = Window.partitionBy(*keys, "x").orderBy("y")
    return frames.select(
        *field.columns,
        _slope("u_x", along_x, "dx").alias("dux_dx"),
        _slope("u_y", along_x, "dx").alias("duy_dx"),
        _slope("u_x", along_y, "dy").alias("dux_dy"),
        _slope("u_y", along_y, "dy").alias("duy_dy"),
    )


def vorticity() -> Column:
    return F.col("duy_dx") - F.col("dux_dy")


def divergence() -> Column:
    return F.col("dux_dx") + F.col("duy_dy")


def speed() -> Column:
    return F.sqrt(F.col("u_x") * F.col("u_x") + F.col("u_y") * F.col("u_y"))


def energy_density() -> Column:
    return 0.5 * (F.col("u_x") * F.col("u_x") + F.col("u_y") * F.col("u_y"))


def select_field(field: DataFrame, grid: Grid | DataFrame, name: str) -> DataFrame:
    """One scalar field by name, column `value`; only vorticity pays for stencils."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}, expected one of {FIELDS}")
    keys = ["dataset", "t", "x", "y"]
    if name == "vorticity":
        return gradients(field, grid).select(*keys, vorticity().alias("value"))
    column = speed() if name == "speed" else F.col(name)
    return field.select(*keys, column.alias("value"))


def kinetic_energy(field: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("dataset", "t")
    return field.groupBy(*keys).agg(F.avg(energy_density()).alias("energy"))


def enstrophy(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    w = vorticity()
    return gradients(field, grid).groupBy("dataset", "t").agg(F.avg(0.5 * w * w).alias("enstrophy"))


def rms_divergence(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    d = divergence()
    return (
        gradients(field, grid).groupBy("dataset", "t").agg(F.sqrt(F.avg(d * d)).alias("rms_divergence"))
    )


def frame_physics(field: DataFrame, grid: Grid | DataFrame, *extra_keys: str, dealt: bool = False) -> DataFrame:
    """Energy, enstrophy, RMS divergence and channel means per frame, from one exchange. The field may be held as lines."""
    if is_lines(field):
        return packed_physics(field, grid, *extra_keys, dealt=dealt)
    w, d = vorticity(), divergence()
    return (
        gradients(field, grid, extra_keys=extra_keys, dealt=dealt)
        .groupBy(*extra_keys, "dataset", "t")
        .agg(
            F.avg(energy_density()).alias("energy"),
            F.avg(0.5 * w * w).alias("enstrophy"),
            F.sqrt(F.avg(d * d)).alias("rms_divergence"),
            F.avg("u_x").alias("mean_u_x"),
            F.avg("u_y").alias("mean_u_y"),
        )
    )


def normalized_divergence(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """RMS divergence over the RMS of its two terms, per step."""
    d = divergence()
    scale = F.col("dux_dx") * F.col("dux_dx") + F.col("duy_dy") * F.col("duy_dy")
    return (
        gradients(field, grid)
        .groupBy("dataset", "t")
        .agg(F.sqrt(F.avg(d * d)).alias("rms_divergence"), F.sqrt(F.avg(scale)).alias("scale"))
        .select(
            "dataset",
            "t",
            "rms_divergence",
            (F.col("rms_divergence") / (F.col("scale") + TINY)).alias("normalized"),
        )
    )


def divergence_report(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    return (
        normalized_divergence(field, grid)
        .groupBy("dataset")
        .agg(
            F.avg("rms_divergence").alias("rms_mean"),
            F.max("rms_divergence").alias("rms_max"),
            F.avg("normalized").alias("normalized_mean"),
            F.max("normalized").alias("normalized_max"),
        )
    )


def vorticity_series(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    w = vorticity()
    return (
        gradients(field, grid)
        .groupBy("dataset", "t")
        .agg(F.avg(w).alias("mean_vorticity"), F.avg(0.5 * w * w).alias("enstrophy"))
    )


def vorticity_report(field: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    return (
        vorticity_series(field, grid)
        .groupBy("dataset")
        .agg(
            F.avg("mean_vorticity").alias("vorticity_mean"),
            F.stddev_pop("mean_vorticity").alias("vorticity_std"),
            F.avg("enstrophy").alias("enstrophy_mean"),
            F.stddev_pop("enstrophy").alias("enstrophy_std"),
        )
    )


def value_range(field: DataFrame, grid: Grid | DataFrame, name: str, stride: int = 1) -> DataFrame:
    """1st/99th percentile of a field over every `stride`-th frame, and half the span.

    Signed fields get a range symmetric about zero. The field may be held as lines.
    """
    sampled = field.filter(F.col("t") % stride == 0)
    if is_lines(field):
        held = packed_vorticity(sampled, grid) if name == "vorticity" else line_field(sampled, grid, name)
        sampled = held.select("dataset", F.explode("value").alias("value"))
    else:
        sampled = select_field(sampled, grid, name)
    bounds = (
        exact_quantiles(sampled, ["dataset"], "value", [0.01, 0.99])
        .groupBy("dataset")
        .agg(
            F.max(F.when(F.col("prob") == 0.01, F.col("quantile"))).alias("lo"),
            F.max(F.when(F.col("prob") == 0.99, F.col("quantile"))).alias("hi"),
        )
    )
    if name in SIGNED_FIELDS:
        limit = F.greatest(F.abs("lo"), F.abs("hi"))
        bounds = bounds.select("dataset", (-limit).alias("lo"), limit.alias("hi"))
    return bounds.withColumn("diff_limit", (F.col("hi") - F.col("lo")) / 2)


# Line form: one row per (dataset, t, x), the y axis packed in arrays.


def to_lines(field: DataFrame) -> DataFrame:
    packed = field.groupBy("dataset", "t", "x").agg(
        F.array_sort(F.collect_list(F.struct("y", "u_x", "u_y"))).alias("line")
    )
    return packed.select(
        "dataset", "t", "x", F.col("line.u_x").alias("u_x"), F.col("line.u_y").alias("u_y")
    )


def to_cells(lines: DataFrame) -> DataFrame:
    return lines.select(
        "dataset", "t", "x", F.posexplode(F.arrays_zip("u_x", "u_y")).alias("y", "cell")
    ).select("dataset", "t", "x", "y", F.col("cell.u_x").alias("u_x"), F.col("cell.u_y").alias("u_y"))


def line_gradients(lines: DataFrame, grid: Grid | DataFrame, *, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines with arrays dux_dx, duy_dx, dux_dy, duy_dy: slopes along y inside each line, along x from the lines beside it.

    Lines move once, to their frame; no cell becomes a row.
    """
    across = Window.partitionBy(*extra_keys, "dataset", "t").orderBy("x")
    near = with_grid(lines, grid, "dx", "dy").withColumns({
        **{f"_ahead_{c}": F.coalesce(F.lead(c).over(across), c) for c in ("u_x", "u_y")},
        **{f"_behind_{c}": F.coalesce(F.lag(c).over(across), c) for c in ("u_x", "u_y")},
        "_across": F.when(F.lead("x").over(across).isNull() | F.lag("x").over(across).isNull(), F.col("dx")).otherwise(2 * F.col("dx")),
    }).withColumn("_last", F.size("u_x") - 1)
    along_x = lambda c: F.expr(f"zip_with(_ahead_{c}, _behind_{c}, (a, b) -> (a - b) / _across)")
    along_y = lambda c: F.expr(
        f"transform({c}, (v, i) -> ({c}[least(i + 1, _last)] - {c}[greatest(i - 1, 0)])"
        " / ((least(i + 1, _last) - greatest(i - 1, 0)) * dy))"
    )
    return near.select(
        *lines.columns, along_x("u_x").alias("dux_dx"), along_x("u_y").alias("duy_dx"),
        along_y("u_x").alias("dux_dy"), along_y("u_y").alias("duy_dy"),
    )


def line_field(lines: DataFrame, grid: Grid | DataFrame, name: str) -> DataFrame:
    """`select_field` on lines: (dataset, t, x, value), `value` an array along y."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}, expected one of {FIELDS}")
    if name == "vorticity":
        value = F.expr("zip_with(duy_dx, dux_dy, (a, b) -> a - b)")
        return line_gradients(lines, grid).select("dataset", "t", "x", value.alias("value"))
    value = F.expr("zip_with(u_x, u_y, (a, b) -> sqrt(a * a + b * b))") if name == "speed" else F.col(name)
    return lines.select("dataset", "t", "x", value.alias("value"))


def line_physics(lines: DataFrame, grid: Grid | DataFrame, *extra_keys: str) -> DataFrame:
    """`frame_physics` on lines, with mean vorticity and normalized divergence: each line is summed where it lies."""
    total = lambda a, b, term: F.expr(f"aggregate(zip_with({a}, {b}, (a, b) -> {term}), 0D, (s, v) -> s + v)")
    sums = line_gradients(lines, grid, extra_keys=extra_keys).select(
        *extra_keys, "dataset", "t", F.size("u_x").alias("n"),
        total("u_x", "u_y", "0.5D * (a * a + b * b)").alias("e"), total("duy_dx", "dux_dy", "a - b").alias("w"),
        total("duy_dx", "dux_dy", "0.5D * (a - b) * (a - b)").alias("z"), total("dux_dx", "duy_dy", "(a + b) * (a + b)").alias("d"),
        total("dux_dx", "duy_dy", "a * a + b * b").alias("g"), total("u_x", "u_x", "a").alias("x"), total("u_y", "u_y", "a").alias("y"),
    )
    mean = lambda c: F.sum(c) / F.sum("n")
    frames = sums.groupBy(*extra_keys, "dataset", "t").agg(
        mean("e").alias("energy"), mean("w").alias("mean_vorticity"), mean("z").alias("enstrophy"),
        F.sqrt(mean("d")).alias("rms_divergence"), F.sqrt(mean("g")).alias("_scale"), mean("x").alias("mean_u_x"), mean("y").alias("mean_u_y"),
    )
    return frames.withColumn("normalized", F.col("rms_divergence") / (F.col("_scale") + TINY)).drop("_scale")


def is_lines(frames: DataFrame) -> bool:
    """Whether frames are held as lines, y packed, and not as cells."""
    return isinstance(frames.schema["u_x"].dataType, T.ArrayType)


def whole_frames(lines: DataFrame, keys: list[str], *columns: str, dealt: bool = False) -> DataFrame:
    """Lines dealt by frame, those of a frame side by side and ascending by x. Lines that are `dealt` by some of the keys stay."""
    kept = lines.select(*keys, "x", "u_x", "u_y", *columns)
    return (kept if dealt else kept.repartition(*keys)).sortWithinPartitions(*keys, "x")


def _stack_slope(stack: np.ndarray, axis: int, spacing: np.ndarray) -> np.ndarray:
    """`_slope` of (frames, x, y) along an axis, one spacing per frame."""
    n = stack.shape[axis]
    ahead, behind = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    steps = np.maximum(ahead - behind, 1).reshape([-1 if a == axis else 1 for a in range(3)])
    return (stack.take(ahead, axis) - stack.take(behind, axis)) / (steps * spacing[:, None, None])


def packed_physics(lines: DataFrame, grid: Grid | DataFrame, *extra_keys: str, dealt: bool = False) -> DataFrame:
    """`frame_physics` on lines: a batch of whole frames is differentiated at once, and no cell becomes a row."""
    keys = [*extra_keys, "dataset", "t"]
    found = ["energy", "enstrophy", "rms_divergence", "mean_u_x", "mean_u_y"]
    types = T.StructType([lines.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in found])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        for first, (u, v) in group_stacks(batches, [*keys, "dx", "dy"], ["u_x", "u_y"]):
            dx, dy = first["dx"].to_numpy(), first["dy"].to_numpy()
            w = _stack_slope(v, 1, dx) - _stack_slope(u, 2, dy)
            d = _stack_slope(u, 1, dx) + _stack_slope(v, 2, dy)
            mean = lambda a: a.mean(axis=(1, 2))
            values = [mean(0.5 * (u * u + v * v)), mean(0.5 * w * w), np.sqrt(mean(d * d)), mean(u), mean(v)]
            yield from pa.table([*[first[k] for k in keys], *values], names=schema.names).cast(schema).to_batches()

    frames = whole_frames(with_grid(lines, grid, "dx", "dy"), keys, "dx", "dy", dealt=dealt)
    return frames.mapInArrow(measure, types)


def packed_vorticity(lines: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """(dataset, t, value): vorticity along y of each line, a batch of whole frames differentiated at once."""
    types = T.StructType([lines.schema["dataset"], lines.schema["t"], T.StructField("value", T.ArrayType(T.DoubleType()))])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        for first, (u, v) in group_stacks(batches, ["dataset", "t", "dx", "dy"], ["u_x", "u_y"]):
            w = _stack_slope(v, 1, first["dx"].to_numpy()) - _stack_slope(u, 2, first["dy"].to_numpy())
            each = first.take(pa.array(np.repeat(np.arange(len(w)), w.shape[1])))
            ends = pa.array(np.arange(w.shape[0] * w.shape[1] + 1, dtype=np.int32) * w.shape[2], pa.int32())
            values = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
            yield from pa.table([each["dataset"], each["t"], values], names=schema.names).cast(schema).to_batches()

    return whole_frames(with_grid(lines, grid, "dx", "dy"), ["dataset", "t"], "dx", "dy").mapInArrow(turn, types)


def line_enstrophy(lines: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """Enstrophy per frame on packed lines: the window moves whole lines, never single cells."""
    across = Window.partitionBy("dataset", "t").orderBy("x")
    near = with_grid(lines, grid, "dx", "dy").select(
        "dataset",
        "t",
        "dx",
        "dy",
        "u_x",
        F.coalesce(F.lead("u_y").over(across), "u_y").alias("ahead"),
        F.coalesce(F.lag("u_y").over(across), "u_y").alias("behind"),
        F.when(
            F.lead("x").over(across).isNull() | F.lag("x").over(across).isNull(), 1.0
        ).otherwise(2.0).alias("steps"),
    )
    ends = near.withColumn("n", F.size("u_x"))
    half_squares = F.expr(
        "aggregate(sequence(0, n - 1), 0D, (acc, i) -> acc + 0.5D * power("
        "(ahead[i] - behind[i]) / (steps * dx)"
        " - (u_x[least(i + 1, n - 1)] - u_x[greatest(i - 1, 0)])"
        " / ((least(i + 1, n - 1) - greatest(i - 1, 0)) * dy), 2))"
    )
    return (
        ends.select("dataset", "t", "n", half_squares.alias("s"))
        .groupBy("dataset", "t")
        .agg((F.sum("s") / F.sum("n")).alias("enstrophy"))
    )
