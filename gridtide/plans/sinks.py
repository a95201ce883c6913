"""Queries that write and read back: array files, field store, summaries, scores, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import autocorr, derive, evaluate, modal, stats
from gridtide.plans.common import R, r, rounded
from gridtide.plans.modes import mean_pair_rows
from gridtide.plans.registry import query
from gridtide.plans.scoring import NPERSEG, pred_physics, true_physics
from gridtide.session import materialize, work_path
from gridtide.sources import adapters as src
from gridtide.sources import arrays, store

FIELD_SQL = f"SELECT dataset, t, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y FROM field"


@query("array_ingest", "A1", FIELD_SQL)
def _(spark, sf):
    # The field as array files of at most 40 steps, read back in slices of 25.
    folder = work_path(spark, "arrays")
    store.export_arrays(src.field(spark, sf), folder, 40).write.parquet(f"{folder}/paths")
    lines = store.ingest_arrays(spark.read.schema("path string").parquet(f"{folder}/paths"), 25)
    return rounded(derive.to_cells(lines), "u_x", "u_y")


@query("array_source", "A1", FIELD_SQL)
def _(spark, sf):
    # The same through the data source: written twice by URI, the second time over the first.
    folder = work_path(spark, "arrays")
    uri = folder if "://" in folder else f"file://{folder}"
    field = src.field(spark, sf)
    arrays.write_arrays(field, uri, 30)
    arrays.write_arrays(field, uri, 40, overwrite=True)
    return rounded(derive.to_cells(arrays.read_arrays(spark, uri, 25)), "u_x", "u_y")


@query(
    "converted_catalog",
    "A3 A1 A2",
    """SELECT dataset, n_steps, 11 AS nx, 9 AS ny, dataset || '@0.npy' || CASE WHEN n_steps > 50 THEN ',' || dataset || '@50.npy' ELSE '' END AS source_files, 'monthly cells' AS description,
              'u_x,u_y' AS channel_names, 'd000001@0.npy,d000001@50.npy,notes.npy' AS excluded_files FROM catalog WHERE dataset <> 'd000001'""",
)
def _(spark, sf):
    # Array files converted to a store; one dataset's files are excluded. The attributes are read back from it.
    folder, path = work_path(spark, "arrays"), work_path(spark, "converted")
    arrays.write_arrays(src.field(spark, sf), folder, 50)
    store.convert(spark, folder, path, "monthly cells", ["d000001@0.npy", "d000001@50.npy", "notes.npy"])
    return store.catalog(spark, path).select(
        "dataset", "n_steps", "nx", "ny", "description", *[F.concat_ws(",", c).alias(c) for c in ("source_files", "channel_names", "excluded_files")]
    )


@query(
    "field_store",
    "A2 A4",
    f"""SELECT dataset, t, x, {R('sum(u_x)')} AS u_x, {R('sum(u_y)')} AS u_y FROM field WHERE t >= 30 AND t < 70 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    path = work_path(spark, "store")
    field = src.field(spark, sf)
    store.write_store(field, path, 20, overwrite=True)
    # Appending the same later steps again replaces their partitions.
    store.write_store(field.filter("t >= 60"), path, 20)
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)).alias(c)
    return store.read_steps(spark, path, 30, 70, 20).select("dataset", "t", "x", total("u_x"), total("u_y"))


CHECKS = {
    "n_steps": ("split", "n_steps", 0),
    "enstrophy_mean": ("vorticity", "enstrophy_mean", 4),
    "div_normalized_mean": ("divergence", "normalized_mean", 4),
    "ux_tau_int": ("autocorrelation", "tau_int", 2),
    "ux_n_eff": ("autocorrelation", "n_eff", 1),
    "ux_mean_half_change": ("stationarity", "mean_change", 4),
}


def write_checks(spark, sf, path):
    data = src.Tables(spark, sf, stored=True)
    field, grid, catalog = data.field, data.grid, data.catalog
    store.write_summaries(catalog, "split", path)
    store.write_summaries(derive.vorticity_report(field, grid), "vorticity", path)
    store.write_summaries(derive.divergence_report(field, grid), "divergence", path)
    acf = autocorr.field_autocorrelation(field, lengths=catalog).filter("channel = 'u_x'").drop("channel")
    store.write_summaries(autocorr.decorrelation(acf, ["dataset"]), "autocorrelation", path)
    halves = stats.half_change(field, catalog).filter("channel = 'u_x'")
    change = (F.col("mean_second") - F.col("mean_first")) / F.abs("mean_first")
    store.write_summaries(halves.select("dataset", change.alias("mean_change")), "stationarity", path)


@query(
    "summary_records",
    "A11",
    f"""SELECT dataset, 'vorticity' AS script, {R('avg(en)', 4)} AS enstrophy_mean FROM (
          SELECT dataset, t, avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy)) AS en FROM grads GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    path = work_path(spark, "summaries")
    store.write_summaries(derive.vorticity_report(src.field(spark, sf), src.grid(spark, sf)), "vorticity", path)
    value = F.get_json_object("value", "$.enstrophy_mean").cast("double")
    return store.read_summaries(spark, path).select("dataset", "script", r(value, 4).alias("enstrophy_mean"))


@query(
    "complex_summaries",
    "A11",
    f"""SELECT dataset, {R('max(re)')} AS leading_real, {R('abs(max(im))')} AS leading_imag, CAST(count(*) AS BIGINT) AS modes,
               {R('sum(re)')} AS total_real FROM mean_pair_eigen GROUP BY 1""",
)
def _(spark, sf):
    # Eigenvalues as complex numbers, alone and in an array, through the JSON records.
    path = work_path(spark, "summaries")
    dmd = modal.exact_dmd(mean_pair_rows(spark, sf))
    value = F.struct(F.col("lam_re").alias("re"), F.abs("lam_im").alias("im"))
    store.write_summaries(dmd.groupBy("dataset").agg(F.max(value).alias("leading"), F.collect_list(value).alias("eigenvalues")), "dmd", path)
    number = lambda p: F.get_json_object("value", p).cast("double")
    reals = F.from_json(F.get_json_object("value", "$.eigenvalues"), "array<struct<real:double,imag:double>>")
    return store.read_summaries(spark, path).select(
        "dataset", r(number("$.leading.real")).alias("leading_real"), r(number("$.leading.imag")).alias("leading_imag"),
        F.size(reals).cast("bigint").alias("modes"), r(F.aggregate(reals, F.lit(0.0), lambda s, v: s + v["real"])).alias("total_real"),
    )


@query(
    "comparison_table",
    "A12 A11",
    f"""SELECT dataset, CAST(n_steps AS DOUBLE) AS n_steps, {R('enstrophy', 4)} AS enstrophy_mean, {R('div', 4)} AS div_normalized_mean,
               {R('tau', 2)} AS ux_tau_int, {R('n_steps / (2 * tau)', 1)} AS ux_n_eff, {R('change', 4)} AS ux_mean_half_change
        FROM catalog
        LEFT JOIN (SELECT dataset, avg(en) AS enstrophy, avg(rms / (sc + 1e-12)) AS div FROM (
                SELECT dataset, t, avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy)) AS en, sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy))) AS rms,
                       sqrt(avg(dux_dx * dux_dx + duy_dy * duy_dy)) AS sc FROM grads GROUP BY 1, 2) GROUP BY 1) USING (dataset)
        LEFT JOIN (SELECT dataset, 0.5 + coalesce(sum(rho) FILTER (WHERE lag >= 1 AND lag < zero), 0) AS tau FROM field_acf
              JOIN (SELECT dataset, min(CASE WHEN rho <= 0 THEN lag END) AS zero FROM field_acf WHERE channel = 'u_x' GROUP BY 1) USING (dataset)
              WHERE channel = 'u_x' AND zero IS NOT NULL GROUP BY 1) USING (dataset)
        LEFT JOIN (SELECT dataset, (avg(mean) FILTER (WHERE t >= n_steps // 2) - avg(mean) FILTER (WHERE t < n_steps // 2))
                             / abs(avg(mean) FILTER (WHERE t < n_steps // 2)) AS change
              FROM stepstats JOIN catalog USING (dataset) WHERE channel = 'u_x' GROUP BY 1) USING (dataset)""",
)
def _(spark, sf):
    path = work_path(spark, "summaries")
    write_checks(spark, sf, path)
    table = store.comparison_table(store.read_summaries(spark, path), CHECKS)
    store.write_table_csv(table, f"{path}-csv")
    schema = "dataset string, " + ", ".join(f"{c} double" for c in sorted(CHECKS))
    return spark.read.schema(schema).option("header", True).csv(f"{path}-csv")


def temporal_long(spark, sf):
    data = src.Tables(spark, sf)
    p = evaluate.mean_velocity(materialize(pred_physics(data), "physics"), "model", "member")
    q = evaluate.mean_velocity(materialize(true_physics(data), "physics"))
    return evaluate.temporal_scores(p, q, NPERSEG).drop("model")


@query(
    "finite_scores",
    "A13",
    f"""SELECT dataset, member, metric,
               {R('CASE WHEN value = 0 THEN 0.0 ELSE round(value * power(10, 5 - floor(log10(abs(value))))) / power(10, 5 - floor(log10(abs(value)))) END', 9)} AS value
        FROM temporal_long WHERE isfinite(value)""",
)
def _(spark, sf):
    return rounded(store.finite_scores(temporal_long(spark, sf)), "value", digits=9)


@query(
    "score_records",
    "A13",
    """SELECT dataset, member, count(*) FILTER (WHERE isfinite(value)) AS kept, count(*) FILTER (WHERE NOT isfinite(value)) AS dropped
       FROM temporal_long GROUP BY 1, 2""",
)
def _(spark, sf):
    path = work_path(spark, "scores")
    scores = temporal_long(spark, sf)
    keys = ["dataset", "member"]
    store.write_scores(scores, keys, path)
    saved = spark.read.schema("dataset string, member int, scores map<string, double>").json(path)
    lost = store.dropped_scores(scores, keys).select(*keys, F.size("dropped").cast("long").alias("dropped"))
    return saved.select(*keys, F.size("scores").cast("long").alias("kept")).join(lost, keys, "left").withColumn(
        "dropped", F.coalesce("dropped", F.lit(0))
    )


LIMBS = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)
)

DIGEST_TEXT = " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(l_quantity AS BIGINT)", "CAST(round(l_extendedprice * 100) AS BIGINT)", "l_returnflag")
)


@query(
    "table_digest",
    "A14",
    f"""SELECT count(*) AS n_rows, sha256(concat_ws(',', {LIMBS})) AS digest
        FROM (SELECT sha256({DIGEST_TEXT}) AS h FROM lineitem)""",
)
def _(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "qty", "cents", "l_returnflag"]
    items = src.table(spark, sf, "lineitem").select(
        "*", F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    )
    return store.table_digest(items, columns)
