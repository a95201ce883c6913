"""Scans and checks: catalog, bounded reads, probes, selection, roles, profile, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.layout import channels

# Fixed value: velocities beyond this are not plausible.
MAX_ABS_VALUE = 100.0


class DatasetError(ValueError):
    """A dataset is unknown, or its role forbids reading it."""


def dataset_catalog(field: DataFrame, description: str, source_suffix: str = ".npy") -> DataFrame:
    """Attributes per dataset: length, grid size, channel order, source file."""
    return field.groupBy("dataset").agg(
        (F.max("t") + 1).cast("int").alias("n_steps"),
        (F.max("x") + 1).cast("int").alias("nx"),
        (F.max("y") + 1).cast("int").alias("ny"),
    ).select(
        "*",
        F.lit("u_x,u_y").alias("channel_names"),
        F.concat("dataset", F.lit(source_suffix)).alias("source_file"),
        F.lit(description).alias("description"),
    )


def time_scan(field: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames start, start+stride, ... below `end` (default: all)."""
    if stride < 1:
        raise ValueError(f"stride must be >= 1, got {stride}")
    rows = field.filter(F.col("t") >= start)
    if end is not None:
        rows = rows.filter(F.col("t") < end)
    return rows if stride == 1 else rows.filter((F.col("t") - start) % stride == 0)


def parse_points(spec: str) -> list[tuple[str, int, int]]:
    """`label:x:y` items, comma separated."""
    points = []
    for item in spec.split(","):
        label, x, y = item.strip().split(":")
        points.append((label, int(x), int(y)))
    return points


def point_probe(field: DataFrame, spec: str) -> DataFrame:
    """Velocity series at the probed cells. The points come from one argument, so a literal
    condition (pushed to the scan) picks their cells."""
    points = parse_points(spec)
    wanted = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(x).alias("x"), F.lit(y).alias("y"))
            for label, x, y in points
        ]
    )
    at_probe = None
    for _, x, y in points:
        hit = (F.col("x") == x) & (F.col("y") == y)
        at_probe = hit if at_probe is None else at_probe | hit
    return (
        field.filter(at_probe)
        .withColumn("p", F.explode(wanted))
        .filter("p.x = x AND p.y = y")
        .select("dataset", F.col("p.label").alias("label"), "t", "u_x", "u_y")
    )


def select_datasets(field: DataFrame, catalog: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows of the datasets named in `only` (column dataset); an unknown name is an error.

    A column `position` in `only` is kept: the order in which the datasets were asked for.
    """
    if only is None:
        return field
    unknown = only.join(catalog, "dataset", "left_anti").select("dataset").take(5)
    if unknown:
        known = [row.dataset for row in catalog.select("dataset").orderBy("dataset").take(20)]
        raise DatasetError(f"unknown datasets {[row.dataset for row in unknown]}, known: {known}")
    if "position" in only.columns:
        return field.join(only.groupBy("dataset").agg(F.min("position").alias("position")), "dataset")
    return field.join(only, "dataset", "left_semi")


def unreadable(wanted: DataFrame, roles: DataFrame) -> DataFrame:
    """Datasets of `wanted` that may not be read, with the reason."""
    return (
        wanted.join(roles, "dataset", "left")
        .filter("role IS NULL OR role = 'test'")
        .select(
            "dataset",
            F.when(F.col("role").isNull(), "unknown dataset").otherwise("test dataset").alias("reason"),
        )
    )


def role_violations(train: DataFrame, train_eval: DataFrame, roles: DataFrame) -> DataFrame:
    """Every broken role rule: train overlapping val/test, train-eval outside train, test read."""
    overlap = train.join(roles.filter("role IN ('val', 'test')"), "dataset").select(
        "dataset", F.concat(F.lit("train overlaps "), F.col("role")).alias("reason")
    )
    outside = train_eval.join(train, "dataset", "left_anti").select(
        "dataset", F.lit("train-eval not in train").alias("reason")
    )
    return overlap.unionByName(outside).unionByName(unreadable(train_eval, roles))


def readable(field: DataFrame, wanted: DataFrame, roles: DataFrame) -> DataFrame:
    bad = unreadable(wanted, roles).take(5)
    if bad:
        raise DatasetError("; ".join(f"{row.dataset}: {row.reason}" for row in bad))
    return field.join(wanted, "dataset", "left_semi")


def raw_profile(field: DataFrame) -> DataFrame:
    """Size, range, moments, NaN and Inf counts per dataset and channel, in one pass."""
    u = F.col("u")
    return (
        channels(field, "dataset")
        .groupBy("dataset", "channel")
        .agg(
            F.count("*").alias("size"),
            F.min(u).alias("min"),
            F.max(u).alias("max"),
            F.avg(u).alias("mean"),
            F.stddev_pop(u).alias("std"),
            F.count_if(F.isnan(u)).alias("n_nan"),
            F.count_if(F.abs(u) == float("inf")).alias("n_inf"),
        )
    )


def contract_violations(
    field: DataFrame, expected: DataFrame, nx: int, ny: int, max_abs: float = MAX_ABS_VALUE
) -> DataFrame:
    """Broken data rules (dataset, rule, detail): existence, grid, finite values, range."""
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull())
    facts = field.groupBy("dataset").agg(
        F.count("*").alias("n"),
        (F.max("t") + 1).alias("n_t"),
        (F.max("x") + 1).alias("nx"),
        (F.max("y") + 1).alias("ny"),
        F.count_if(~(finite("u_x") & finite("u_y"))).alias("n_bad"),
        F.max(F.greatest(F.abs("u_x"), F.abs("u_y"))).alias("largest"),
    )
    checked = expected.select("dataset").join(facts, "dataset", "left")
    rule = lambda broken, name, detail: F.when(
        broken, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))
    )
    rules = F.array_compact(
        F.array(
            rule(F.col("n").isNull(), "exists", F.lit("no rows")),
            rule((F.col("nx") != nx) | (F.col("ny") != ny), "grid", F.concat_ws("x", "nx", "ny")),
            rule(F.col("n") != F.col("n_t") * nx * ny, "dense", F.col("n")),
            rule(F.col("n_bad") > 0, "finite", F.col("n_bad")),
            rule(~(F.col("largest") < max_abs), "range", F.floor("largest").cast("long")),
        )
    )
    return checked.select("dataset", F.explode(rules).alias("v")).select("dataset", "v.rule", "v.detail")


def snapshot_pick(field: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first, middle and last frame of every dataset."""
    picks = catalog.select(
        "dataset",
        F.explode(
            F.expr("array_distinct(array(0, cast(n_steps div 2 as int), n_steps - 1))")
        ).alias("t"),
    )
    return field.join(picks, ["dataset", "t"])
