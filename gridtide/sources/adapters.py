"""Views that read the benchmark tables as field, series, state and request tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.operators.derive import to_cells, to_lines
from gridtide.schema import Grid, with_grid
from gridtide.session import materialize

# Fixed values of the adapter (the axes' sizes follow from the two-digit discount and tax).
NX, NY = 11, 9
LX, LY = 25.0, 2.0
SUPPLIERS_PER_DATASET = 25
USERS_PER_SERIES = 50
FIRST_YEAR = 1995
BIN_SECONDS = 6 * 3600
SERIES_START = "2024-01-01 00:00:00"
SERIES_STEPS = 120
# A prime, so that means of cents rarely end on a rounding tie.
CENTS_PER_UNIT = 99991.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inside(column: Column, low: int, high: int, what: str) -> Column:
    """The column as an integer; a row beyond the fixed axis fails the job instead of vanishing from it."""
    value = column.cast("int")
    said = F.concat(F.lit(f"{what} outside {low} to {high}: "), value.cast("string"))
    return F.when(value.between(low, high) | value.isNull(), value).otherwise(F.raise_error(said).cast("int"))


def _cells(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """One row per item; with `whole` without those that lack an axis."""
    month = (F.year("l_shipdate") - FIRST_YEAR) * 12 + F.month("l_shipdate") - 1
    group = F.floor(F.col("l_suppkey") / SUPPLIERS_PER_DATASET).cast("long").cast("string")
    items = table(spark, sf_dir, "lineitem")
    if whole:
        items = items.filter("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL")
    return items.select(
        F.concat(F.lit("d"), F.lpad(group, 6, "0")).alias("dataset"),
        _inside(month, 0, 2**31 - 1, f"months since {FIRST_YEAR}").alias("t"),
        _inside(F.round(F.col("l_discount") * 100), 0, NX - 1, "discount").alias("x"),
        _inside(F.round(F.col("l_tax") * 100), 0, NY - 1, "tax").alias("y"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a dense field: month x discount x tax cells per supplier group, holes 0."""
    cells = _cells(spark, sf_dir)
    axes = (
        cells.groupBy("dataset")
        .agg(F.max("t").alias("last"))
        # A few rows per dataset become whole frames: spread them before they grow.
        .select("dataset", F.explode(F.expr("sequence(0, last)")).alias("t"))
        .repartition("dataset", "t")
        .withColumn("x", F.explode(F.expr(f"sequence(0, {NX - 1})")))
        .withColumn("y", F.explode(F.expr(f"sequence(0, {NY - 1})")))
    )
    # The axes come as rows of no item, so every cell has one and nothing is joined: the size of rows that were made from a
    # few is guessed from those few, and a guess of some MB would send a whole field to the driver. The one exchange by
    # frame also serves what is done per frame afterwards.
    both = _cells(spark, sf_dir, whole=True).withColumn("item", F.lit(1)).unionByName(
        axes.withColumns({"qty": F.lit(None).cast("long"), "cents": F.lit(None).cast("long"), "item": F.lit(0)})
    )
    mean = lambda c: F.try_divide(F.sum(c), F.sum("item"))
    means = both.repartition("dataset", "t").groupBy("dataset", "t", "x", "y").agg(mean("qty").alias("u_x"), (mean("cents") / CENTS_PER_UNIT).alias("u_y"))
    return means.fillna(0.0, ["u_x", "u_y"])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset lengths straight from two columns, without building the field."""
    return (
        _cells(spark, sf_dir).groupBy("dataset").agg((F.max("t") + 1).cast("int").alias("n_steps"))
    )


GRID = Grid(NX, NY, LX / (NX - 1), LY / (NY - 1))


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    return GRID


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as a table, one row per dataset; spacing counts intervals, not points."""
    return with_grid(catalog(spark, sf_dir).select("dataset"), GRID, "nx", "ny", "dx", "dy")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_roles(catalog(spark, sf_dir))


def with_roles(names: DataFrame) -> DataFrame:
    """Of four datasets the third validates, the fourth tests, the others train."""
    index = F.substring("dataset", 2, 6).cast("int") % 4
    return names.select(
        "dataset",
        F.when(index == 3, "test").when(index == 2, "val").otherwise("train").alias("role"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with an event-time TIMESTAMP (watermarks reject TIMESTAMP_NTZ)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dense series: 6-hour means per event type and user group, holes 0."""
    group = F.floor(F.col("user_id") / USERS_PER_SERIES).cast("long").cast("string")
    start = F.unix_timestamp(F.to_timestamp(F.lit(SERIES_START)))
    points = events(spark, sf_dir).select(
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("u"), F.lpad(group, 6, "0")).alias("name"),
        _inside(F.floor((F.unix_timestamp("ts") - start) / BIN_SECONDS), 0, SERIES_STEPS - 1, "bin of an event").alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    filled = points.groupBy("dataset", "name", "t").agg(
        (F.sum("cents") / F.count("*")).alias("value")
    )
    axes = (
        points.select("dataset", "name")
        .distinct()
        .withColumn("t", F.explode(F.expr(f"sequence(0, {SERIES_STEPS - 1})")))
    )
    return axes.join(filled, ["dataset", "name", "t"], "left").select(
        "dataset", "name", "t", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one state vector per (label, vec_id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("dataset"),
        F.col("vec_id").cast("int").alias("t"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )


class Tables:
    """The views of one folder. A job that reads the field many times sets `stored`: the field is
    then written once to the shared folder, as a field table at rest would be, and read from there. With
    `packed` it is written as lines, and its cells are read from those."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False, packed: bool = False) -> None:
        self.spark, self.sf_dir, self.stored, self.packed = spark, sf_dir, stored, packed

    def _kept(self, view: DataFrame, label: str) -> DataFrame:
        return materialize(view, label) if self.stored else view

    @cached_property
    def lines(self) -> DataFrame:
        return self._kept(to_lines(field(self.spark, self.sf_dir)), "lines")

    @cached_property
    def field(self) -> DataFrame:
        if self.packed:
            return to_cells(self.lines)
        return self._kept(field(self.spark, self.sf_dir), "field")

    @cached_property
    def catalog(self) -> DataFrame:
        return self._kept(catalog(self.spark, self.sf_dir), "catalog")

    grid = GRID

    @cached_property
    def roles(self) -> DataFrame:
        return with_roles(self.catalog)

    @cached_property
    def train(self) -> DataFrame:
        return self.roles.filter("role = 'train'").select("dataset")

    @cached_property
    def train_field(self) -> DataFrame:
        return self.field.join(self.train, "dataset", "left_semi")

    @cached_property
    def train_catalog(self) -> DataFrame:
        return self.catalog.join(self.train, "dataset", "left_semi")
