"""Queries on modal decompositions and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import forecast, modal, windows
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.registry import query
from gridtide.plans.temporal import sql_welch
from gridtide.session import materialize, work_path
from gridtide.sources import adapters as src

CONTEXT = 24
RANK = 12
CELL = ["channel", "x", "y"]

add_view(
    "fluct_long",
    """SELECT dataset, t, x, y, 'u_x' AS channel, u_x AS u FROM fluct
       UNION ALL SELECT dataset, t, x, y, 'u_y', u_y FROM fluct""",
)


@query(
    "state_blocks",
    "G1 C9",
    f"""SELECT dataset, t, CAST(p // 64 AS INTEGER) AS block, CAST(count(*) AS INTEGER) AS size, {R('sum(u)')} AS total,
               {R('arg_min(u, p)')} AS first, {R('arg_max(u, p)')} AS last
        FROM (SELECT dataset, t, (CASE channel WHEN 'u_x' THEN 0 ELSE 1 END * 11 + x) * 9 + y AS p, u FROM fluct_long)
        GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    blocks = modal.state_blocks(src.field(spark, sf), src.grid(spark, sf), 64)
    return blocks.select(
        "dataset", "t", "block", F.size("vec").alias("size"),
        r(F.expr("aggregate(vec, 0D, (a, v) -> a + v)")).alias("total"),
        r(F.col("vec")[0]).alias("first"), r(F.element_at("vec", -1)).alias("last"),
    )


@query(
    "frame_gram",
    "G2",
    f"""SELECT a.dataset, a.t AS i, b.t AS j, {R('sum(a.u * b.u)', 4)} AS g
        FROM fluct_long a JOIN fluct_long b USING (dataset, channel, x, y) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(modal.frame_gram(src.field(spark, sf)), "g", digits=4)


@query(
    "snapshot_gram",
    "G2",
    f"""SELECT 'label' || a.label AS dataset, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {R('sum(a.v * b.v)', 5)} AS g
        FROM (SELECT vec_id, label, i.i, CAST(embedding[i.i + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS i(i)) a
        JOIN (SELECT vec_id, i.i, CAST(embedding[i.i + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS i(i)) b USING (vec_id)
        GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    # Many snapshots of a short state: the state is the short axis.
    return rounded(modal.gram_entries(src.snapshots(spark, sf), ["dataset"]), "g", digits=5)


@query(
    "snapshot_pod",
    "G3",
    f"""SELECT 'label' || label AS dataset, {R('sum(v * v)', 4)} AS total
        FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""",
)
def _(spark, sf):
    factors = modal.eigenbasis(modal.gram(src.snapshots(spark, sf), ["dataset"]), ["dataset"], tolerance=1e-7)
    return factors.groupBy("dataset").agg(r(F.sum(F.col("s") * F.col("s")), 4).alias("total"))


def rows_and_factors(spark, sf):
    rows = modal.cell_rows(src.field(spark, sf))
    return rows, modal.pod_factors(rows)


@query(
    "pod_spectrum",
    "G3 G5",
    f"""SELECT dataset, {R('sum(u * u)', 3)} AS total, CAST(1.0 AS DOUBLE) AS shares FROM fluct_long GROUP BY 1""",
)
def _(spark, sf):
    # The squared singular values add up to the state's summed squares, the shares to 1.
    _, factors = rows_and_factors(spark, sf)
    return factors.groupBy("dataset").agg(
        r(F.sum(F.col("s") * F.col("s")), 3).alias("total"), r(F.sum("share")).alias("shares")
    )


@query(
    "pod_modes",
    "G4 G5",
    """SELECT dataset, CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j,
              CASE WHEN i.i = j.j THEN 1.0 ELSE 0.0 END::DOUBLE AS g
       FROM catalog, range(6) AS i(i), range(6) AS j(j)""",
)
def _(spark, sf):
    # Inner products of the leading mode shapes: the identity.
    rows, factors = rows_and_factors(spark, sf)
    modes = modal.pod_modes(rows, factors.filter("mode < 6"))
    products = modal.gram(modes.withColumnRenamed("coef", "vec"), ["dataset"])
    return products.select("dataset", "i", F.posexplode("row").alias("j", "g")).withColumn(
        "g", r(F.col("g")) + 0.0
    )


@query("pod_report", "G6")
def _(spark, sf):
    _, factors = rows_and_factors(spark, sf)
    report = modal.pod_report(factors)
    return rounded(report, "energy_fraction", "cumulative", "coefficient_std")


@query(
    "pod_coefficients",
    "G5",
    f"""SELECT dataset, t, {R('sum(u * u)', 4)} AS energy FROM fluct_long GROUP BY 1, 2""",
)
def _(spark, sf):
    # Modes are orthonormal, so a frame's squared coefficients add up to its own squares.
    _, factors = rows_and_factors(spark, sf)
    c = modal.pod_coefficients(factors)
    return c.groupBy("dataset", "t").agg(r(F.sum(F.col("value") * F.col("value")), 4).alias("energy"))


@query(
    "mode_reconstruction",
    "G7",
    f"SELECT dataset, channel, x, y, t, {R('u', 5)} AS value FROM fluct_long",
)
def _(spark, sf):
    rows, factors = rows_and_factors(spark, sf)
    return rounded(modal.reconstruct(modal.pod_modes(rows, factors), factors), "value", digits=5)


# The two domain means as a state: every decomposition of it has a closed form.
add_view(
    "mean_pair",
    """SELECT dataset, t, ux - avg(ux) OVER w AS x, uy - avg(uy) OVER w AS y
       FROM (SELECT dataset, t, avg(u_x) AS ux, avg(u_y) * 50 AS uy FROM field GROUP BY 1, 2) WINDOW w AS (PARTITION BY dataset)""",
)


def mean_pair_rows(spark, sf):
    means = src.field(spark, sf).groupBy("dataset", "t").agg(
        F.avg("u_x").alias("u_x"), (F.avg("u_y") * 50).alias("u_y")
    )
    # One cell per dataset: cell_rows removes the time mean and packs the frames.
    return modal.cell_rows(means.withColumns({"x": F.lit(0), "y": F.lit(0)}))


@query(
    "domain_pod_report",
    "G6 G3 G5",
    f"""SELECT dataset, CAST(mode AS INTEGER) AS mode, {R('lam / (a + c)')} AS energy_fraction,
               {R('CASE mode WHEN 0 THEN lam / (a + c) ELSE 1.0 END')} AS cumulative, {R('sqrt(lam / n)')} AS coefficient_std,
               CAST(CASE WHEN top / (a + c) >= 0.9 THEN 1 ELSE 2 END AS BIGINT) AS modes_for_level
        FROM (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS top,
                     (a + c) / 2 + CASE mode WHEN 0 THEN 1 ELSE -1 END * sqrt((a - c) * (a - c) / 4 + b * b) AS lam
              FROM (SELECT dataset, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, count(*) AS n FROM mean_pair GROUP BY 1), range(2) AS m(mode))""",
)
def _(spark, sf):
    factors = modal.pod_factors(mean_pair_rows(spark, sf))
    return rounded(modal.pod_report(factors), "energy_fraction", "cumulative", "coefficient_std")


add_view(
    "mean_pair_dmd",
    """SELECT dataset, n, tr, det, tr * tr / 4 - det AS disc FROM (
         SELECT dataset, n, ((yxx * c - yxy * b) + (yyy * a - yyx * b)) / (a * c - b * b) AS tr,
                (yxx * yyy - yxy * yyx) / (a * c - b * b) AS det
         FROM (SELECT dataset, count(*) + 1 AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(nx * x) AS yxx, sum(nx * y) AS yxy,
                      sum(ny * x) AS yyx, sum(ny * y) AS yyy
               FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM mean_pair WINDOW w AS (PARTITION BY dataset ORDER BY t))
               WHERE nx IS NOT NULL GROUP BY 1))""",
)
add_view(
    "mean_pair_eigen",
    """SELECT dataset, CASE WHEN disc >= 0 THEN tr / 2 + s * sqrt(disc) ELSE tr / 2 END AS re,
              CASE WHEN disc >= 0 THEN 0.0::DOUBLE ELSE s * sqrt(-disc) END AS im
       FROM mean_pair_dmd, (VALUES (1), (-1)) AS v(s)""",
)


@query(
    "domain_dmd",
    "G8",
    f"SELECT dataset, {R('re')} AS lam_re, {R('im')} AS lam_im, CAST(1.0 AS DOUBLE) AS energy_fraction FROM mean_pair_eigen",
)
def _(spark, sf):
    dmd = modal.exact_dmd(mean_pair_rows(spark, sf))
    return rounded(dmd.select("dataset", "lam_re", "lam_im", "energy_fraction"), "lam_re", "lam_im", "energy_fraction")


@query(
    "domain_dmd_modes",
    "G10",
    f"""SELECT dataset, {R('atan2(im, re)')} AS frequency, {R('ln(sqrt(re * re + im * im))')} AS growth_rate,
               CASE WHEN atan2(im, re) = 0 THEN CAST('inf' AS DOUBLE) ELSE {R('2 * pi() / atan2(im, re)')} END AS period
        FROM mean_pair_eigen WHERE im >= 0""",
)
def _(spark, sf):
    dmd = modal.exact_dmd(mean_pair_rows(spark, sf))
    top = modal.dominant_dmd_modes(dmd, src.catalog(spark, sf), 2)
    return rounded(top.select("dataset", "frequency", "growth_rate", "period"), "frequency", "growth_rate", "period")


@query("exact_dmd", "G8 G9")
def _(spark, sf):
    dmd = modal.exact_dmd(modal.cell_rows(src.field(spark, sf)), RANK)
    return rounded(
        dmd.select("dataset", "mode", "lam_re", "lam_im", "energy_fraction",
                   F.hypot("amp_re", "amp_im").alias("amplitude"), "norm"),
        "lam_re", "lam_im", "energy_fraction", "amplitude", "norm",
    )


@query("dominant_dmd_modes", "G10")
def _(spark, sf):
    dmd = modal.exact_dmd(modal.cell_rows(src.field(spark, sf)), RANK)
    top = modal.dominant_dmd_modes(dmd, src.catalog(spark, sf), 3)
    return rounded(top, *top.columns[3:])


@query("dmd_mode_evolution", "G11")
def _(spark, sf):
    # Only the mode that is shown is projected; the rows are read for the fit and for its shapes, so they are made once.
    rows = materialize(modal.cell_rows(src.field(spark, sf)), "rows")
    dmd = materialize(modal.exact_dmd(rows, RANK), "dmd")
    one = modal.dmd_modes(rows, dmd.filter("mode = 0"))
    return rounded(modal.mode_evolution(one, dmd, 0, src.catalog(spark, sf)), "value")


SPOD_SEGMENT, SPOD_OVERLAP = 24, 12


@query(
    "spod",
    "G12",
    f"""SELECT dataset, k, {R('omega')} AS omega, {R('sum(power)', 5)} AS total FROM (
          {sql_welch('SELECT dataset, channel, x, y, t, u AS value FROM vel', 'dataset, channel, x, y', SPOD_SEGMENT, SPOD_OVERLAP)})
        GROUP BY dataset, k, omega""",
)
def _(spark, sf):
    # Per frequency the eigenvalues add up to the Welch power of all cells.
    waves = modal.segment_waves(src.field(spark, sf), SPOD_SEGMENT, SPOD_OVERLAP)
    modes = modal.spod(waves, SPOD_SEGMENT)
    return modes.groupBy("dataset", "k", r("omega").alias("omega")).agg(r(F.sum("eigenvalue"), 5).alias("total"))


@query(
    "spod_modes",
    "G12",
    f"SELECT dataset, CAST(k.k AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS norm FROM catalog, range({SPOD_SEGMENT // 2 + 1}) AS k(k)",
)
def _(spark, sf):
    waves = modal.segment_waves(src.field(spark, sf), SPOD_SEGMENT, SPOD_OVERLAP)
    shapes = modal.spod_modes(waves, modal.spod(waves, SPOD_SEGMENT))
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return shapes.groupBy("dataset", "k").agg(r(F.sum(square)).alias("norm"))


@query(
    "leading_frequencies",
    "G13",
    f"""SELECT dataset, CAST(rank AS INTEGER) AS rank, {R('2 * pi() / omega')} AS period, {R('omega')} AS omega,
               {R('power', 5)} AS eigenvalue, {R('power / total')} AS eigenvalue_fraction
        FROM (SELECT *, sum(power) OVER (PARTITION BY dataset) AS total, row_number() OVER (PARTITION BY dataset ORDER BY power DESC, k) AS rank
              FROM (SELECT dataset, k, omega, sum(power) AS power FROM (
                {sql_welch('SELECT dataset, channel, x, y, t, u AS value FROM vel', 'dataset, channel, x, y', 60, 0)}) WHERE k >= 1 GROUP BY 1, 2, 3))
        WHERE rank <= 3""",
)
def _(spark, sf):
    # One segment fits the series, so the first eigenvalue is the cells' summed power.
    waves = modal.segment_waves(src.field(spark, sf), 60, 0)
    top = rounded(modal.leading_frequencies(modal.spod(waves, 60), 3), "eigenvalue", digits=5)
    return rounded(top, "period", "omega", "eigenvalue_fraction")


@query("spod_leading_frequencies", "G13 G12")
def _(spark, sf):
    waves = modal.segment_waves(src.field(spark, sf), SPOD_SEGMENT, SPOD_OVERLAP)
    top = modal.leading_frequencies(modal.spod(waves, SPOD_SEGMENT), 3)
    return rounded(top, "period", "omega", "eigenvalue", "eigenvalue_fraction")


# --- forecasters ------------------------------------------------------------------------------------


def scored(data):
    """Every step behind the context, per dataset."""
    return windows.context_counts(data.catalog, CONTEXT)


@query(
    "persistence",
    "H1",
    f"""SELECT dataset, CAST(l.i AS INTEGER) AS lead, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y
        FROM field JOIN catalog USING (dataset), unnest(range(1, n_steps - {CONTEXT} + 1)) AS l(i) WHERE t = {CONTEXT - 1}""",
)
def _(spark, sf):
    steps = windows.context_counts(src.catalog(spark, sf), CONTEXT)
    return rounded(forecast.persistence(src.field(spark, sf), CONTEXT, steps), "u_x", "u_y")


@query(
    "mean_field_forecast",
    "H2",
    f"""SELECT c.dataset, CAST(l.i AS INTEGER) AS lead, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y
        FROM (SELECT x, y, avg(u_x) AS u_x, avg(u_y) AS u_y FROM field JOIN roles USING (dataset)
              WHERE role = 'train' GROUP BY 1, 2), catalog c, unnest(range(1, c.n_steps - {CONTEXT} + 1)) AS l(i)""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    run = forecast.mean_forecast(data.train_field, data.catalog, windows.context_counts(data.catalog, CONTEXT))
    return rounded(run, "u_x", "u_y")


@query(
    "baseline_models",
    "H10 H1 H2",
    f"""SELECT kind, c.dataset, CAST(l.i AS INTEGER) AS lead, x, y, {R('u_x')} AS u_x, {R('u_y')} AS u_y, parameters FROM (
          SELECT 'persistence' AS kind, dataset, x, y, u_x, u_y, CAST(0 AS BIGINT) AS parameters FROM field WHERE t = {CONTEXT - 1}
          UNION ALL SELECT 'mean_field', d.dataset, x, y, u_x, u_y, CAST(2 * 99 AS BIGINT)
          FROM (SELECT x, y, avg(u_x) AS u_x, avg(u_y) AS u_y FROM field JOIN roles USING (dataset)
                WHERE role = 'train' GROUP BY 1, 2), catalog d) c JOIN catalog n USING (dataset), unnest(range(1, n_steps - {CONTEXT} + 1)) AS l(i)""",
)
def _(spark, sf):
    # Saved, loaded and asked like any other model.
    data = src.Tables(spark, sf, stored=True)
    runs = []
    for model in (forecast.persistence_model(data.field), forecast.fit_mean_field(data.train_field)):
        path = work_path(spark, "model")
        forecast.save_model(model, path, model.kind)
        loaded = forecast.load_model(spark, path)
        size = forecast.parameter_count(loaded)  # exactly one row
        run = forecast.predict(loaded, data.field, CONTEXT, scored(data)).drop("block").crossJoin(F.broadcast(size))
        runs.append(run.withColumn("kind", F.lit(loaded.kind)))
    return rounded(runs[0].unionByName(runs[1]), "u_x", "u_y")


@query(
    "stabilize_eigenvalues",
    "H4",
    f"""SELECT dataset, name, t, {R('re / greatest(sqrt(re * re + im * im), 1)')} AS re,
               {R('im / greatest(sqrt(re * re + im * im), 1)')} AS im, sqrt(re * re + im * im) > 1 AS was_unstable
        FROM (SELECT dataset, name, t, value / 100 AS re, lag(value, 1, 0.0) OVER (PARTITION BY dataset, name ORDER BY t) / 100 AS im
              FROM series)""",
)
def _(spark, sf):
    # Complex values from the series: the value and the one before.
    s = src.series(spark, sf)
    before = s.select("dataset", "name", (F.col("t") + 1).alias("t"), F.col("value").alias("b"))
    z = s.join(before, ["dataset", "name", "t"], "left").select(
        "dataset", "name", "t", (F.col("value") / 100).alias("re"), (F.coalesce("b", F.lit(0.0)) / 100).alias("im")
    )
    re, im = forecast.stabilized(F.col("re"), F.col("im"))
    return z.select(
        "dataset", "name", "t", r(re).alias("re"), r(im).alias("im"),
        (F.hypot("re", "im") > 1).alias("was_unstable"),
    )


def dmd_model(data, delays):
    return forecast.fit_delay_dmd(
        data.train_field, data.train_catalog, src.NX, src.NY, spatial_rank=RANK, rank=RANK, delays=delays
    )


@query("dmd_forecast", "H3 H4")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    run = forecast.predict(dmd_model(data, 1), data.field, CONTEXT, scored(data))
    return rounded(run, "u_x", "u_y")


@query("delay_dmd_forecast", "H5")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    run = forecast.predict(dmd_model(data, 3), data.field, CONTEXT, scored(data))
    return rounded(run, "u_x", "u_y")


@query("delay_dmd_info", "H5 H3")
def _(spark, sf):
    return rounded(dmd_model(src.Tables(spark, sf, stored=True), 3).info, "value")


FULL = 2 * src.NX * src.NY


@query(
    "codec_round_trip",
    "H6",
    f"SELECT dataset, t, x, y, {R('u_x', 5)} AS u_x, {R('u_y', 5)} AS u_y FROM field",
)
def _(spark, sf):
    # At full rank the projection is the identity.
    data = src.Tables(spark, sf, stored=True)
    codec = forecast.fit_codec(data.field, data.catalog, src.NX, src.NY, FULL)
    back = forecast.decode(forecast.encode(data.field, codec.basis), codec.basis, ["dataset"], "t")
    return rounded(back, "u_x", "u_y", digits=5)


add_view(
    "var_fit",
    """SELECT fit, n_pairs, m, (f22 * f1y - f12 * f2y) / (f11 * f22 - f12 * f12) AS a1,
               (f11 * f2y - f12 * f1y) / (f11 * f22 - f12 * f12) AS a2 FROM (
          SELECT name AS fit, CAST(count(*) AS DOUBLE) AS n_pairs, any_value(m) AS m, sum(l1 * l1) AS f11, sum(l1 * l2) AS f12,
                 sum(l2 * l2) AS f22, sum(l1 * v) AS f1y, sum(l2 * v) AS f2y
          FROM (SELECT name, m, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2
                FROM (SELECT *, avg(value) OVER (PARTITION BY name) AS m, value - avg(value) OVER (PARTITION BY name) AS v FROM series)
                WINDOW w AS (PARTITION BY name, dataset ORDER BY t)) WHERE l2 IS NOT NULL GROUP BY 1)""",
)


@query("latent_var", "H7", f"SELECT fit, n_pairs, {R('m')} AS latent_mean, {R('a1')} AS a1, {R('a2')} AS a2 FROM var_fit")
def _(spark, sf):
    # Scalar latents, two lags, one fit per user group: the 2 x 2 normal equations have a closed form.
    fits = series_var(spark, sf)
    return fits.select(
        "fit", "n_pairs", r(F.col("latent_mean")[0]).alias("latent_mean"),
        r(F.col("operator")[0][0]).alias("a1"), r(F.col("operator")[1][0]).alias("a2"),
    )


def series_latents(spark, sf):
    return src.series(spark, sf).select(
        F.col("name").alias("fit"), "dataset", "t", F.array("value").alias("z")
    )


def series_var(spark, sf):
    return forecast.var_operator(series_latents(spark, sf), 2)


@query(
    "transition_spectrum",
    "H8",
    f"""SELECT fit, CAST(row_number() OVER (PARTITION BY fit ORDER BY round(sqrt(re * re + im * im), 9) DESC, re DESC, im DESC) - 1 AS INTEGER) AS mode,
               {R('re')} AS re, {R('im')} AS im, {R('sqrt(re * re + im * im)')} AS magnitude
        FROM (SELECT fit, CASE WHEN a1 * a1 / 4 + a2 >= 0 THEN a1 / 2 + s * sqrt(a1 * a1 / 4 + a2) ELSE a1 / 2 END AS re,
                     CASE WHEN a1 * a1 / 4 + a2 >= 0 THEN 0.0::DOUBLE ELSE s * sqrt(-(a1 * a1 / 4 + a2)) END AS im
              FROM var_fit, (VALUES (1), (-1)) AS v(s))""",
)
def _(spark, sf):
    return rounded(forecast.transition_spectrum(series_var(spark, sf)), "re", "im", "magnitude")


@query(
    "latent_var_forecast",
    "H7 H11",
    f"""SELECT fit, dataset, CAST((lead - 1) // 25 AS INTEGER) AS block, CAST(lead AS INTEGER) AS lead, {R('value')} AS value FROM (
          WITH RECURSIVE run AS (
            SELECT name AS fit, dataset, 0 AS lead, max(CASE t WHEN 39 THEN value END) AS value, max(CASE t WHEN 38 THEN value END) AS before
            FROM series GROUP BY 1, 2
            UNION ALL
            SELECT run.fit, dataset, lead + 1, m + a1 * (value - m) + a2 * (before - m), value
            FROM run JOIN var_fit ON var_fit.fit = run.fit WHERE lead < 80)
          SELECT * FROM run WHERE lead >= 1)""",
)
def _(spark, sf):
    states = forecast.delay_states(series_latents(spark, sf), 2).filter(F.col("t") == 39)
    run = forecast.forecast_var_latents(series_var(spark, sf), states, 80, 25)
    return run.select("fit", "dataset", "block", "lead", r(F.col("z")[0]).alias("value"))


@query("latent_forecast", "H9 H6 H7")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    codec = forecast.fit_codec(data.train_field, data.train_catalog, src.NX, src.NY, RANK)
    model = forecast.fit_latent_var(codec, data.train_field, window=2, ridge=1e-3)
    return rounded(forecast.predict(model, data.field, CONTEXT, scored(data)), "u_x", "u_y")


@query(
    "model_store",
    "H10",
    f"""SELECT name, CAST(value AS DOUBLE) AS value FROM (
          VALUES ('delays', 2), ('rank', {RANK}), ('spatial_rank', {RANK}),
                 ('parameters', {FULL} * {RANK} + 2 * {RANK} + 2 * {RANK} * {RANK} + 2 * {RANK} * {RANK})) AS v(name, value)
        UNION ALL SELECT 'n_pairs', CAST(sum(n_steps - 2) AS DOUBLE) FROM catalog JOIN roles USING (dataset) WHERE role = 'train'""",
)
def _(spark, sf):
    # Sizes of a model that was saved and loaded.
    model = dmd_model(src.Tables(spark, sf, stored=True), 2)
    path = work_path(spark, "model")
    forecast.save_model(model, path, "delay dmd")
    loaded = forecast.load_model(spark, path)
    count = forecast.parameter_count(loaded).select(
        F.lit("parameters").alias("name"), F.col("parameters").cast("double").alias("value")
    )
    sizes = loaded.info.filter(F.col("name").isin("rank", "spatial_rank", "delays", "n_pairs"))
    return rounded(sizes.unionByName(count), "value")


@query(
    "block_forecast",
    "H11",
    f"""SELECT dataset, CAST(l.i AS INTEGER) AS lead, CAST((l.i - 1) // 7 AS INTEGER) AS block, CAST(99 AS BIGINT) AS cells,
               CAST(0.0 AS DOUBLE) AS difference FROM catalog, unnest(range(1, n_steps - {CONTEXT} + 1)) AS l(i)""",
)
def _(spark, sf):
    # Block by block against the single forecast: no difference.
    data = src.Tables(spark, sf, stored=True)
    model = dmd_model(data, 3)
    whole = forecast.predict(model, data.field, CONTEXT, scored(data)).select(
        "dataset", "lead", "x", "y", F.col("u_x").alias("w_x"), F.col("u_y").alias("w_y")
    )
    cut = forecast.predict(model, data.field, CONTEXT, scored(data), 7)
    apart = F.greatest(F.abs(F.col("u_x") - F.col("w_x")), F.abs(F.col("u_y") - F.col("w_y")))
    return cut.join(whole, ["dataset", "lead", "x", "y"]).groupBy("dataset", "lead", "block").agg(
        F.count("*").alias("cells"), (r(F.max(apart)) + 0.0).alias("difference")
    )
