"""Queries on fitted dynamics of two states, whose decompositions and forecasts have closed forms in SQL.

The state is a dataset's two domain means, as a field of one cell. A linear map A of two states has powers
A^k = a_k I + b_k (A - h I) with h half its trace; a_k and b_k follow from the two eigenvalues h + g and h - g.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import evaluate, forecast, modal
from gridtide.operators.linalg import MAX_WIDTH
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.modes import CONTEXT, mean_pair_rows, scored
from gridtide.plans.registry import query
from gridtide.schema import Grid
from gridtide.session import materialize
from gridtide.sources import adapters as src

RIDGE = 1e-3
BLOCK = 7


def sql_map(pairs: str, ridge: str = "0.0") -> str:
    """The least-squares map of (x, y) to (nx, ny): its entries p, q, r, s, half its trace h, and disc = g^2."""
    return f"""SELECT *, (p + s) / 2 AS h, (p - s) * (p - s) / 4 + q * r AS disc, sqrt(abs((p - s) * (p - s) / 4 + q * r)) AS g FROM (
                 SELECT * EXCLUDE (a, b, c, d, xx, xy, yx, yy), (xx * c - xy * b) / d AS p, (xy * a - xx * b) / d AS q,
                        (yx * c - yy * b) / d AS r, (yy * a - yx * b) / d AS s
                 FROM (SELECT *, a * c - b * b AS d FROM (SELECT * REPLACE (a + {ridge} * (a + c) / (2 * n) AS a, c + {ridge} * (a + c) / (2 * n) AS c) FROM ({pairs}))))"""


PRODUCTS = "sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(nx * x) AS xx, sum(nx * y) AS xy, sum(ny * x) AS yx, sum(ny * y) AS yy, count(*) AS n"


def sql_power(stable: bool, k: str = "k") -> str:
    """a_k and b_k; with `stable`, eigenvalues outside the unit circle are moved onto it."""
    one, two = "h + g", "h - g"
    radius = "sqrt(h * h + g * g)"
    if stable:
        one, two = (f"({e}) / greatest(abs({e}), 1)" for e in (one, two))
        radius = f"least({radius}, 1)"
    return f"""CASE WHEN disc >= 0 THEN (power({one}, {k}) + power({two}, {k})) / 2 ELSE power({radius}, {k}) * cos({k} * atan2(g, h)) END AS a_k,
               CASE WHEN disc >= 0 THEN (power({one}, {k}) - power({two}, {k})) / (2 * g) ELSE power({radius}, {k}) * sin({k} * atan2(g, h)) / g END AS b_k"""


add_view("duo", "SELECT dataset, t, avg(u_x) AS u, avg(u_y) * 50 AS v FROM field GROUP BY 1, 2")
add_view(
    "duo_norm",
    "SELECT avg(u) AS mu, avg(v) AS mv, stddev_pop(u) AS su, stddev_pop(v) AS sv FROM duo JOIN roles USING (dataset) WHERE role = 'train'",
)
add_view("duo_z", "SELECT dataset, t, role, (u - mu) / su AS x, (v - mv) / sv AS y FROM duo JOIN roles USING (dataset), duo_norm")
add_view(
    "duo_next",
    """SELECT * FROM (SELECT dataset, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM duo_z WHERE role = 'train' WINDOW w AS (PARTITION BY dataset ORDER BY t))
       WHERE nx IS NOT NULL""",
)
add_view("duo_dmd", sql_map(f"SELECT {PRODUCTS} FROM duo_next"))
add_view("duo_var", sql_map(f"SELECT {PRODUCTS} FROM duo_next", str(RIDGE)))
# One mode of the two states, and its newest and former value as a delay state.
add_view("duo_axis", "SELECT cos(f) AS c1, sin(f) AS c2 FROM (SELECT atan2(2 * sum(x * y), sum(x * x) - sum(y * y)) / 2 AS f FROM duo_next)")
add_view(
    "duo_delays",
    """SELECT dataset, t, role, z AS x, lag(z) OVER w AS y, lead(z) OVER w AS nx, z AS ny
       FROM (SELECT dataset, t, role, c1 * x + c2 * y AS z FROM duo_z, duo_axis) WINDOW w AS (PARTITION BY dataset ORDER BY t)""",
)
add_view("duo_delay_dmd", sql_map(f"SELECT {PRODUCTS} FROM duo_delays WHERE role = 'train' AND y IS NOT NULL AND nx IS NOT NULL"))
LEADS = f"unnest(range(1, n_steps - {CONTEXT} + 1)) AS l(k)"


def sql_run(name: str, fit: str, stable: bool) -> None:
    add_view(
        name,
        f"""SELECT dataset, k AS lead, mu + su * (a_k * x + b_k * ((p - h) * x + q * y)) AS u, mv + sv * (a_k * y + b_k * (r * x + (s - h) * y)) AS v
            FROM (SELECT *, {sql_power(stable)} FROM duo_z JOIN catalog USING (dataset), {LEADS}, {fit}, duo_norm WHERE t = {CONTEXT - 1})""",
    )


sql_run("duo_dmd_run", "duo_dmd", True)
sql_run("duo_var_run", "duo_var", False)
add_view(
    "duo_delay_run",
    f"""SELECT dataset, k AS lead, mu + su * c1 * z AS u, mv + sv * c2 * z AS v FROM (
          SELECT *, a_k * x + b_k * ((p - h) * x + q * y) AS z FROM (
            SELECT *, {sql_power(True)} FROM duo_delays JOIN catalog USING (dataset), {LEADS}, duo_delay_dmd, duo_axis, duo_norm WHERE t = {CONTEXT - 1}))""",
)


def duo(spark, sf):
    """The tables with the domain means as a field of one cell."""
    data = src.Tables(spark, sf, stored=True)
    means = data.field.groupBy("dataset", "t").agg(F.avg("u_x").alias("u_x"), (F.avg("u_y") * 50).alias("u_y"))
    data.field = materialize(means.select("dataset", "t", F.lit(0).alias("x"), F.lit(0).alias("y"), "u_x", "u_y"), "duo")
    return data


def duo_models(data):
    train, lengths = data.train_field, data.train_catalog
    codec = forecast.fit_codec(train, lengths, 1, 1, 2)
    return {
        "dmd": forecast.fit_delay_dmd(train, lengths, 1, 1, 2, 2, 1),
        "delay_dmd": forecast.fit_delay_dmd(train, lengths, 1, 1, 1, 2, 2),
        "latent_var": forecast.fit_latent_var(codec, train, 1, RIDGE),
    }


def sql_cells(run: str, block: str) -> str:
    return f"""SELECT dataset, CAST({block} AS INTEGER) AS block, CAST(lead AS INTEGER) AS lead, 0 AS x, 0 AS y, {R('u', 4)} AS u_x, {R('v', 4)} AS u_y FROM {run}"""


def duo_run(spark, sf, kind, block_steps=None):
    data = duo(spark, sf)
    return rounded(forecast.predict(duo_models(data)[kind], data.field, CONTEXT, scored(data), block_steps), "u_x", "u_y", digits=4)


@query("duo_dmd_forecast", "H3 H4 H11", sql_cells("duo_dmd_run", f"(lead - 1) // {BLOCK}"))
def _(spark, sf):
    # Powers of the stabilized eigenvalues, block by block.
    return duo_run(spark, sf, "dmd", BLOCK)


@query("duo_delay_forecast", "H5 H3", sql_cells("duo_delay_run", "0"))
def _(spark, sf):
    return duo_run(spark, sf, "delay_dmd")


@query("duo_latent_forecast", "H9 H7 H6", sql_cells("duo_var_run", f"(lead - 1) // {BLOCK}"))
def _(spark, sf):
    return duo_run(spark, sf, "latent_var", BLOCK)


def four_cells(rows):
    axis = F.array(F.lit(0), F.lit(1))
    spread = rows.drop("x", "y").withColumn("x", F.explode(axis)).withColumn("y", F.explode(axis))
    times = 1 + F.col("x") + 2 * F.col("y")
    return spread.withColumns({"u_x": F.col("u_x") * times, "u_y": F.col("u_y") * times})


RUNS = {"dmd": "duo_dmd_run", "delay_dmd": "duo_delay_run", "latent_var": "duo_var_run"}


@query(
    "dynamics_evaluation",
    "I15 H3 H5 H9",
    f"""SELECT model, dataset, grp, metric, {R('value')} AS value FROM (
          SELECT model, dataset, 'all' AS grp, avg(rmse) AS rmse_mean, avg(miss) AS crps_mean FROM (
            SELECT model, f.dataset, lead, sqrt(7.5 * ((f.u - d.u) * (f.u - d.u) / su / su + (f.v - d.v) * (f.v - d.v) / sv / sv) / 2) AS rmse,
                   2.5 * (abs(f.u - d.u) / su + abs(f.v - d.v) / sv) / 2 AS miss
            FROM ({' UNION ALL '.join(f"SELECT '{k}' AS model, * FROM {v}" for k, v in RUNS.items())}) f JOIN duo d ON f.dataset = d.dataset AND d.t = f.lead + {CONTEXT - 1}, duo_norm)
          GROUP BY 1, 2) UNPIVOT (value FOR metric IN (rmse_mean, crps_mean))""",
)
def _(spark, sf):
    # Fitted dynamics over their whole horizons through the whole evaluation, on four cells of 1 to 4 times the state.
    data = duo(spark, sf)
    steps = scored(data)
    runs = None
    for kind, model in duo_models(data).items():
        run = forecast.predict(model, data.field, CONTEXT, steps).drop("block").select(F.lit(kind).alias("model"), F.lit(0).alias("member"), "*")
        runs = run if runs is None else runs.unionByName(run)
    truth = data.field.filter(F.col("t") >= CONTEXT).withColumn("lead", (F.col("t") - (CONTEXT - 1)).cast("int")).drop("t")
    scales = data.train_field.agg(F.stddev_pop("u_x").alias("s_u_x"), F.stddev_pop("u_y").alias("s_u_y"))
    table = evaluate.evaluate(
        materialize(four_cells(runs), "forecast"), materialize(four_cells(truth), "truth"), Grid(2, 2, 1.0, 1.0), materialize(scales, "scales"), block_steps=BLOCK, nperseg=16
    )
    return rounded(table.filter("grp = 'all' AND metric IN ('rmse_mean', 'crps_mean')"), "value")


# --- decompositions -----------------------------------------------------------------------------------

add_view(
    "mean_pair_map",
    sql_map(f"""SELECT dataset, {PRODUCTS} FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM mean_pair WINDOW w AS (PARTITION BY dataset ORDER BY t))
                WHERE nx IS NOT NULL GROUP BY 1"""),
)
# The first frame, and its part outside the mean of both modes.
add_view(
    "mean_pair_start",
    """SELECT m.*, x, y, (p - h) * x + q * y AS e, r * x + (s - h) * y AS f FROM mean_pair_map m JOIN mean_pair USING (dataset) WHERE t = 0""",
)
AMPLITUDES = f"""SELECT dataset, {R('CASE WHEN disc >= 0 THEN h + i * g ELSE h END')} AS lam_re, {R('CASE WHEN disc >= 0 THEN 0.0::DOUBLE ELSE i * g END')} AS lam_im,
           {R('CASE WHEN disc >= 0 THEN sqrt((e + i * g * x) * (e + i * g * x) + (f + i * g * y) * (f + i * g * y)) ELSE sqrt(e * e + f * f + g * g * (x * x + y * y)) END / (2 * g)', 5)} AS power
    FROM mean_pair_start, (VALUES (1), (-1)) AS v(i)"""


def amplitudes(dmd):
    power = F.hypot("amp_re", "amp_im") * F.col("norm")
    return dmd.select("dataset", r("lam_re").alias("lam_re"), (r("lam_im") + 0.0).alias("lam_im"), r(power, 5).alias("power"))


@query("domain_dmd_amplitudes", "G9 G8", AMPLITUDES)
def _(spark, sf):
    return amplitudes(modal.exact_dmd(mean_pair_rows(spark, sf)))


@query("wide_domain_dmd", "G9 G8 G3", AMPLITUDES)
def _(spark, sf):
    # As if no task could square the frames: subspace iteration and QR trees.
    return amplitudes(modal.exact_dmd(mean_pair_rows(spark, sf), 2, n_frames=MAX_WIDTH + 1))


@query(
    "wide_domain_pod",
    "G3 G5 G6",
    f"""SELECT dataset, CAST(mode AS INTEGER) AS mode, {R('lam / (a + c)')} AS energy_fraction, {R('sqrt(lam / n)')} AS coefficient_std
        FROM (SELECT *, (a + c) / 2 + CASE mode WHEN 0 THEN 1 ELSE -1 END * sqrt((a - c) * (a - c) / 4 + b * b) AS lam
              FROM (SELECT dataset, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, count(*) AS n FROM mean_pair GROUP BY 1), range(2) AS m(mode))""",
)
def _(spark, sf):
    factors = modal.pod_factors(mean_pair_rows(spark, sf), 2, n_frames=MAX_WIDTH + 1)
    report = modal.pod_report(factors).select("dataset", "mode", "energy_fraction", "coefficient_std")
    return rounded(report, "energy_fraction", "coefficient_std")


@query(
    "domain_dmd_evolution",
    "G11",
    f"""SELECT dataset, channel, 0 AS x, 0 AS y, CAST(t AS INTEGER) AS t,
               {R('''CASE WHEN disc >= 0 THEN (part + i * g * start) / (2 * i * g) * power(h + i * g, t)
                          ELSE start / 2 * cos(t * atan2(g, h)) + part / (2 * g) * sin(t * atan2(g, h)) END''')} AS value
        FROM (SELECT *, CASE channel WHEN 'u_x' THEN x ELSE y END AS start, CASE channel WHEN 'u_x' THEN e ELSE f END AS part, CASE WHEN h >= 0 THEN 1 ELSE -1 END AS i
              FROM mean_pair_start JOIN catalog USING (dataset), unnest(range(n_steps)) AS ts(t), (VALUES ('u_x'), ('u_y')) AS v(channel))""",
)
def _(spark, sf):
    # The leading mode over the whole dataset; an oscillating one keeps its amplitude.
    rows = materialize(mean_pair_rows(spark, sf), "rows")
    dmd = materialize(modal.exact_dmd(rows), "dmd")
    one = modal.dmd_modes(rows, dmd.filter("mode = 0"))
    return rounded(modal.mode_evolution(one, dmd, 0, src.catalog(spark, sf)), "value")
