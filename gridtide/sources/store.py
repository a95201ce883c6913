"""Stores and sinks: array-file ingest, partitioned field store, summaries, score and table exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.operators.derive import to_lines
from gridtide.schema import CHANNELS, COMPLEX, FIELD_LINE
from gridtide.sources import arrays

CHUNK_STEPS = 100
SIGNIFICANT_DIGITS = 6
LINE_SCHEMA = FIELD_LINE


# --- array files ------------------------------------------------------------------------------


def array_tasks(paths: DataFrame, chunk_t: int = CHUNK_STEPS) -> DataFrame:
    """(path, dataset, offset, t0, t1) slices of (T, 2, X, Y) files, from their headers only.

    Paths are URIs that `pyarrow.fs` opens, or absolute local paths. The dataset is the file's stem; `stem@offset` names a
    part that starts at a later step.
    """

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, place = arrays.opened(path)
                with system.open_input_file(place) as file:
                    n = arrays.Header.of(file, path).shape[0]
                name, offset = arrays.named(path)
                starts = np.arange(0, n, chunk_t)
                yield pd.DataFrame({
                    "path": path, "dataset": name, "offset": offset,
                    "t0": starts, "t1": np.minimum(starts + chunk_t, n),
                })

    dealt = paths.select("path").repartition(_tasks(paths.sparkSession), "path")
    return dealt.mapInPandas(tasks, "path string, dataset string, offset int, t0 int, t1 int")


def ingest_arrays(paths: DataFrame, chunk_t: int = CHUNK_STEPS) -> DataFrame:
    """field_line rows of the array files in a table of paths. A task reads the bytes of its slice, a few MB of frames at a time;
    whole folders are read by `arrays.read_arrays`."""

    schema = to_arrow_schema(T.StructType.fromDDL(LINE_SCHEMA))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for block in arrays.batches_of(row["path"], row["dataset"], row["offset"], row["t0"], row["t1"]):
                    yield block.cast(schema)

    # A slice is a few bytes here and many rows behind: dealt by number, as partitions of so few bytes would be merged.
    tasks = array_tasks(paths, chunk_t).repartition(_tasks(paths.sparkSession), "path", "t0")
    return tasks.mapInArrow(lines, LINE_SCHEMA)


def _tasks(spark: SparkSession) -> int:
    """Partitions for rows that stand for files or slices."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def export_arrays(field: DataFrame, folder: str, chunk_t: int = CHUNK_STEPS) -> DataFrame:
    """Write dense (T, 2, X, Y) float64 parts of at most `chunk_t` steps, one task each; returns (path)."""
    arrays.write_arrays(field, folder, chunk_t)
    system, place = arrays.opened(folder)
    prefix = folder.rstrip("/")
    found = [f"{prefix}/{i.base_name}" for i in system.get_file_info(FileSelector(place)) if i.base_name.endswith(".npy")]
    return field.sparkSession.createDataFrame([(p,) for p in sorted(found)], "path string")


# --- field store ------------------------------------------------------------------------------


def write_store(field: DataFrame, path: str, chunk_t: int = CHUNK_STEPS, overwrite: bool = False) -> None:
    """Lines partitioned by (dataset, t_chunk). Appending replaces only the partitions it brings, so a
    repeated write adds nothing twice; `overwrite` replaces the store."""
    write_lines(to_lines(field), path, chunk_t, overwrite)


def write_lines(lines: DataFrame, path: str, chunk_t: int = CHUNK_STEPS, overwrite: bool = False) -> None:
    """`write_store` for a field that comes as lines."""
    (
        lines.withColumn("t_chunk", F.floor(F.col("t") / chunk_t).cast("int")).repartition("dataset", "t_chunk")
        .sortWithinPartitions("t", "x")
        .write.partitionBy("dataset", "t_chunk")
        .option("partitionOverwriteMode", "static" if overwrite else "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Field lines with their partition columns, so time bounds on t_chunk prune files."""
    schema = "t int, x int, u_x array<double>, u_y array<double>, dataset string, t_chunk int"
    return spark.read.schema(schema).parquet(path)


def read_steps(spark: SparkSession, path: str, start: int, end: int, chunk_t: int = CHUNK_STEPS) -> DataFrame:
    """Steps [start, end) of every dataset: partition pruning first, then the exact bound."""
    lines = read_store(spark, path)
    return lines.filter(
        F.col("t_chunk").between(start // chunk_t, max(end - 1, start) // chunk_t)
        & (F.col("t") >= start) & (F.col("t") < end)
    )


def convert(
    spark: SparkSession, uri: str, path: str, description: str, excluded: Sequence[str] = (), chunk_t: int = CHUNK_STEPS, overwrite: bool = False
) -> None:
    """Array files below `uri` as a store at `path`, with their attributes beside it: those of the whole store (description,
    channels, excluded files) and, per dataset, its source files."""
    write_lines(arrays.read_arrays(spark, uri, chunk_t, excluded), f"{path}/lines", chunk_t, overwrite)
    sources: dict[str, list[str]] = {}
    for file in arrays.files(uri, excluded):
        sources.setdefault(arrays.named(file)[0], []).append(file.rsplit("/", 1)[-1])
    mode = "overwrite" if overwrite else "append"
    rows = [(name, sorted(found)) for name, found in sources.items()]
    spark.createDataFrame(rows, "dataset string, source_files array<string>").coalesce(1).write.mode(mode).json(f"{path}/sources")
    group = spark.createDataFrame([(description, list(CHANNELS), list(excluded))], "description string, channel_names array<string>, excluded_files array<string>")
    group.coalesce(1).write.mode("overwrite").json(f"{path}/group")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, n_steps, nx, ny, source_files, description, channel_names, excluded_files) of a converted store."""
    lines = read_store(spark, f"{path}/lines")
    sizes = lines.groupBy("dataset").agg(
        (F.max("t") + 1).cast("int").alias("n_steps"), (F.max("x") + 1).cast("int").alias("nx"), F.max(F.size("u_x")).alias("ny")
    )
    sources = spark.read.schema("dataset string, source_files array<string>").json(f"{path}/sources")
    merged = sources.select("dataset", F.explode("source_files").alias("f")).groupBy("dataset").agg(F.array_sort(F.collect_set("f")).alias("source_files"))
    group = spark.read.schema("description string, channel_names array<string>, excluded_files array<string>").json(f"{path}/group")
    return sizes.join(merged, "dataset", "left").crossJoin(F.broadcast(group))  # one row


# --- summaries and comparison -------------------------------------------------------------------


def _readable(field: T.StructField) -> Column:
    named = lambda c: F.struct(c["re"].alias("real"), c["im"].alias("imag"))
    kind = field.dataType.simpleString()
    if kind == COMPLEX:
        return F.when(F.col(field.name).isNotNull(), named(F.col(field.name))).alias(field.name)
    if kind == f"array<{COMPLEX}>":
        return F.transform(field.name, named).alias(field.name)
    return F.col(field.name)


def write_summaries(report: DataFrame, script: str, path: str, run: int = 0) -> None:
    """One JSON record per dataset below (script, run): {"dataset", "script", ...columns}.

    A later run of some datasets is added under its own number; repeating a run replaces it. Complex values, structs of
    `re` and `im`, alone or in arrays, become {"real", "imag"}.
    """
    body = [_readable(f) for f in report.schema if f.name != "dataset"]
    rows = report.select(
        "dataset", F.to_json(F.struct("dataset", F.lit(script).alias("script"), *body)).alias("value")
    )
    rows.write.mode("overwrite").json(f"{path}/script={script}/run={run}")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, script, value): the newest run's record of every dataset and check."""
    records = spark.read.schema("dataset string, value string, script string, run int").json(path)
    return records.groupBy("dataset", "script").agg(F.max_by("value", "run").alias("value"))


def summary_value(script: str, field: str, digits: int) -> Column:
    """A check's headline number from its record."""
    value = F.get_json_object("value", f"$.{field}").cast("double")
    return F.round(F.max(F.when(F.col("script") == script, value)), digits)


def comparison_table(summaries: DataFrame, headlines: dict[str, tuple[str, str, int]]) -> DataFrame:
    """One row per dataset with any summary; a check it lacks stays NULL. Columns sorted."""
    columns = [
        summary_value(script, field, digits).alias(name)
        for name, (script, field, digits) in sorted(headlines.items())
    ]
    return summaries.groupBy("dataset").agg(*columns)


def merge_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows over old ones; datasets of an earlier run keep theirs."""
    names = [c for c in new.columns if c != "dataset"]
    joined = old.select("dataset", F.struct(*names).alias("o")).join(
        new.select("dataset", F.struct(*names).alias("n")), "dataset", "full_outer"
    )
    return joined.select("dataset", F.coalesce("n", "o").alias("r")).select("dataset", "r.*")


def write_table_csv(table: DataFrame, path: str) -> None:
    names = sorted(c for c in table.columns if c != "dataset")
    table.select("dataset", *names).write.mode("overwrite").option("header", True).csv(path)


# --- scores -------------------------------------------------------------------------------------


def significant(value: Column, digits: int = SIGNIFICANT_DIGITS) -> Column:
    """Rounded to `digits` significant digits."""
    shift = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.round(value * shift) / shift)


def finite_scores(scores: DataFrame) -> DataFrame:
    """Scores that are numbers, to six significant digits."""
    v = F.col("value")
    return scores.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).withColumn("value", significant(v))


def dropped_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Names of the scores `finite_scores` leaves out, per key."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return scores.filter(bad).groupBy(*keys).agg(F.array_sort(F.collect_set("metric")).alias("dropped"))


def write_scores(scores: DataFrame, keys: list[str], path: str) -> None:
    """One JSON object per group, metric names sorted; a group holds the few scores of one run."""
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    finite_scores(scores).groupBy(*keys).agg(F.map_from_entries(entries).alias("scores")).write.mode(
        "overwrite"
    ).json(path)


def table_digest(table: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, digest): order- and layout-independent content hash.

    Every row's sha256 is cut in eight numbers, and each is summed over the table: the sums combine
    map-side, so copies of one row meet in no single place. The digest hashes the sums.
    """
    # Every field comes with its length, so that no text can stand for a separator; a null has none.
    text = lambda c: F.col(c).cast("string")
    field = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(text(c)), F.lit(":"), text(c)))
    row_hash = F.sha2(F.concat(*[field(c) for c in columns]), 256)
    limb = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = table.select(row_hash.alias("_h")).agg(
        F.count("*").alias("n_rows"), *[F.sum(limb(i)).cast("string").alias(f"_s{i}") for i in range(8)]
    )
    return sums.select("n_rows", F.sha2(F.concat_ws(",", *[f"_s{i}" for i in range(8)]), 256).alias("digest"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
