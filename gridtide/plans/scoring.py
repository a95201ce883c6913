"""Queries on forecast evaluation and selection.

The forecast under test repeats the year before the context's end; member m starts m months earlier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import evaluate, forecast, moments, scans, selection, windows
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.modes import CONTEXT, FULL, RANK, dmd_model
from gridtide.plans.registry import query
from gridtide.plans.temporal import sql_lines, sql_peak, sql_welch
from gridtide.session import materialize
from gridtide.sources import adapters as src

MEMBERS, YEAR = 4, 12
THRESHOLD, BLOCK, MAX_RATIO, NPERSEG, OVERLAP = 0.55, 12, 1.02, 32, 16
LEADS = (1, 10, 40, 100)
MODEL = "seasonal"


def truth(data, lines: bool = False):
    return windows.split_context(data.lines if lines else data.field, CONTEXT)[1]


def ensemble(data, n_steps: int | None = None, parts: int | None = None, lines: bool = False):
    """The seasonal ensemble over the scored steps, or over `n_steps` (a rollout). With `parts` the frames are dealt over so
    many partitions before they are repeated, and `origin` names the step a frame repeats. With `lines` frames are packed
    before they are repeated: a line is a row."""
    source = data.lines if lines else data.field
    last = F.col("n_steps") - CONTEXT if n_steps is None else F.lit(n_steps)
    # Each frame of the year goes to its leads, one a year. A table of all leads would be joined by a guess of its size.
    first = F.col("t") - (CONTEXT - YEAR) + F.col("member") + 1
    leads = F.filter(F.sequence(F.lit(1), last), lambda lead: F.pmod(lead - first, F.lit(YEAR)) == 0)
    frames = source.filter(F.col("t").between(CONTEXT - YEAR - MEMBERS + 1, CONTEXT - 1)).join(data.catalog, "dataset")
    frames = frames.repartition(parts, "dataset", "t") if parts else frames
    return (
        frames.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
        .filter(F.col("t").between(CONTEXT - YEAR - F.col("member"), CONTEXT - 1 - F.col("member")))
        .withColumn("lead", F.explode(leads))
        .select(
            F.lit(MODEL).alias("model"), "dataset", "member", "lead", *([c for c in ("x", "y", "u_x", "u_y") if c in source.columns]),
            *([F.col("t").alias("origin")] if parts else []),
        )
    )


def scales(data):
    s = moments.effective_std(
        moments.pooled_stats(moments.channel_moments(data.train_field)), "per_channel"
    )
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("effective_std"))).alias(f"s_{c}")
    return s.agg(pick("u_x"), pick("u_y"))


def aligned(data):
    return evaluate.align(ensemble(data), truth(data), scales(data))


# Physics of both sides once per query: the frames' tables are small, the frames are not.
def pred_physics(data):
    return evaluate.physics(ensemble(data, lines=True), data.grid, "model", "member")


def true_physics(data):
    return evaluate.physics(truth(data, lines=True), data.grid)


def pred_spectra(data):
    return evaluate.line_spectra(ensemble(data, lines=True), data.grid, "model", "member")


def true_spectra(data):
    return evaluate.line_spectra(truth(data, lines=True), data.grid)


def member_stability(data, max_ratio=MAX_RATIO):
    return evaluate.stability(pred_physics(data), true_physics(data), BLOCK, max_ratio)


add_view("truth", f"SELECT dataset, CAST(t - {CONTEXT} + 1 AS INTEGER) AS lead, x, y, u_x, u_y FROM field WHERE t >= {CONTEXT}")
add_view(
    "ens_src",
    f"""SELECT dataset, CAST(m.m AS INTEGER) AS member, CAST(l.l AS INTEGER) AS lead,
               {CONTEXT - YEAR} - m.m + (l.l - 1) % {YEAR} AS t
        FROM catalog, unnest(range(1, n_steps - {CONTEXT} + 1)) AS l(l), range({MEMBERS}) AS m(m)""",
)
add_view("ens", "SELECT dataset, member, lead, x, y, u_x, u_y FROM ens_src JOIN field USING (dataset, t)")
add_view(
    "scales",
    """SELECT max(CASE WHEN channel = 'u_x' THEN std END) AS s_x, max(CASE WHEN channel = 'u_y' THEN std END) AS s_y
       FROM train_stats""",
)
add_view(
    "pairs",
    """SELECT e.dataset, e.member, e.lead, e.x, e.y, e.u_x / s_x AS p_x, e.u_y / s_y AS p_y, q.u_x / s_x AS q_x, q.u_y / s_y AS q_y
       FROM ens e JOIN truth q USING (dataset, lead, x, y), scales""",
)
add_view(
    "rmse_curve",
    """SELECT dataset, member, lead, sqrt(avg(((p_x - q_x) * (p_x - q_x) + (p_y - q_y) * (p_y - q_y)) / 2)) AS rmse
       FROM pairs GROUP BY 1, 2, 3""",
)
add_view(
    "curves",
    f"""SELECT dataset, lead, {MEMBERS} AS size, miss - 0.5 * apart AS crps, sqrt(0.5 * apart2) AS spread, mean_rmse,
               sqrt({MEMBERS + 1}.0::DOUBLE / {MEMBERS}) * sqrt(0.5 * apart2) / mean_rmse AS spread_skill
        FROM (SELECT dataset, lead, avg((abs(p_x - q_x) + abs(p_y - q_y)) / 2) AS miss,
                     avg((abs(p_x - n_x) + abs(p_y - n_y)) / 2) AS apart,
                     avg(((p_x - n_x) * (p_x - n_x) + (p_y - n_y) * (p_y - n_y)) / 2) AS apart2,
                     sqrt(avg(((m_x - q_x) * (m_x - q_x) + (m_y - q_y) * (m_y - q_y)) / 2)) AS mean_rmse
              FROM (SELECT *, coalesce(lead(p_x) OVER w, first_value(p_x) OVER w) AS n_x, coalesce(lead(p_y) OVER w, first_value(p_y) OVER w) AS n_y,
                           avg(p_x) OVER c AS m_x, avg(p_y) OVER c AS m_y
                    FROM pairs WINDOW w AS (PARTITION BY dataset, lead, x, y ORDER BY member), c AS (PARTITION BY dataset, lead, x, y))
              GROUP BY 1, 2)""",
)


@query(
    "forecast_alignment",
    "I1",
    f"""SELECT dataset, member, lead, count(*) AS cells, {R('sum(p_x - q_x)')} AS bias FROM pairs GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    return aligned(data).groupBy("dataset", "member", "lead").agg(
        F.count("*").alias("cells"), r(F.sum(F.col("p_x") - F.col("q_x"))).alias("bias")
    )


@query(
    "shape_check",
    "I1",
    """SELECT dataset, CAST(m.m AS INTEGER) AS member, 99 * 1 * (n_steps - 24 - 50)::BIGINT AS missing, CAST(0 AS BIGINT) AS extra
       FROM catalog, range(4) AS m(m)""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    # A forecast cut to 50 leads lacks the rest of the truth's cells.
    short = ensemble(data, 50)
    return evaluate.shape_violations(short, truth(data)).drop("model")


@query("rmse_per_lead", "I2", f"SELECT dataset, member, lead, {R('rmse')} AS rmse FROM rmse_curve")
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(evaluate.rmse_per_lead(aligned(data)).drop("model"), "rmse")


CURVES = ("crps", "spread", "mean_rmse", "spread_skill")


@query(
    "ensemble_scores",
    "I3 I4",
    f"SELECT dataset, lead, size, {', '.join(f'{R(c)} AS {c}' for c in CURVES)} FROM curves",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(evaluate.ensemble_scores(aligned(data)).drop("model"), *CURVES)


@query(
    "member_median",
    "I5",
    f"""SELECT dataset, lead, {R('(list_sort(list(rmse))[2] + list_sort(list(rmse))[3]) / 2')} AS rmse
        FROM rmse_curve GROUP BY 1, 2""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    curve = evaluate.rmse_per_lead(aligned(data))
    return rounded(evaluate.member_median(curve, ["dataset", "lead"], "rmse"), "rmse")


@query(
    "skill_horizon",
    "I6",
    f"""SELECT dataset, CAST(coalesce(min(CASE WHEN NOT crps <= {THRESHOLD} THEN lead END) - 1, max(lead)) AS INTEGER) AS skill_horizon
        FROM curves GROUP BY 1""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    curve = evaluate.ensemble_scores(aligned(data))
    return evaluate.skill_horizon(curve, ["dataset"], "crps", THRESHOLD)


@query(
    "report_leads",
    "I7",
    " UNION ALL ".join(
        f"SELECT dataset, '{p}_lead_' || lead AS metric, {R(c)} AS value FROM curves WHERE lead IN {LEADS}"
        for c, p in (("crps", "crps"), ("spread_skill", "spread_skill"), ("mean_rmse", "rmse"))
    ),
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    curve = evaluate.ensemble_scores(aligned(data))
    parts = [
        evaluate.report_leads(curve, ["dataset"], c, p, LEADS)
        for c, p in (("crps", "crps"), ("spread_skill", "spread_skill"), ("mean_rmse", "rmse"))
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


# --- physics --------------------------------------------------------------------------------------

QUANTITIES = ("energy", "enstrophy", "rms_divergence", "mean_u_x", "mean_u_y")
add_view(
    "frame_physics",
    """SELECT dataset, t, avg(0.5 * (u_x * u_x + u_y * u_y)) AS energy, avg(0.5 * (duy_dx - dux_dy) * (duy_dx - dux_dy)) AS enstrophy,
              sqrt(avg((dux_dx + duy_dy) * (dux_dx + duy_dy))) AS rms_divergence, avg(u_x) AS mean_u_x, avg(u_y) AS mean_u_y
       FROM grads GROUP BY 1, 2""",
)
add_view("true_phys", f"SELECT *, t - {CONTEXT} + 1 AS lead FROM frame_physics WHERE t >= {CONTEXT}")
add_view("pred_phys", "SELECT * FROM ens_src JOIN frame_physics USING (dataset, t)")
for axis in ("x", "y"):
    add_view(
        f"lines_t_{axis}",
        f"SELECT dataset, channel, t, k, avg(power) AS power FROM ({sql_lines(axis)}) GROUP BY 1, 2, 3, 4",
    )
    add_view(
        f"true_lines_{axis}",
        f"SELECT dataset, channel, k, avg(power) AS power FROM lines_t_{axis} WHERE t >= {CONTEXT} GROUP BY 1, 2, 3",
    )
    add_view(
        f"pred_lines_{axis}",
        f"SELECT dataset, member, channel, k, avg(power) AS power FROM ens_src JOIN lines_t_{axis} USING (dataset, t) GROUP BY 1, 2, 3, 4",
    )


@query(
    "series_summary",
    "I8",
    f"""SELECT dataset, CAST(lead AS INTEGER) AS lead, {', '.join(f'{R(q)} AS {q}' for q in QUANTITIES)} FROM true_phys""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(true_physics(data), *QUANTITIES)


@query(
    "mean_line_spectra",
    "I8 F5",
    " UNION ALL ".join(
        f"SELECT dataset, member, '{a}' AS axis, channel, k, {R('power')} AS power FROM pred_lines_{a}" for a in ("x", "y")
    ),
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    s = pred_spectra(data)
    return rounded(s.drop("model", "omega"), "power")


def sql_lsd(pred: str, true: str, keys: str, join: str, over: str) -> str:
    """keys, lsd of pred (keys, over, k, power) against true (join, over, k, power)."""
    comma = f", {over}" if over else ""
    return f"""SELECT {keys}, avg(abs(log10(greatest(p, fl) / greatest(q, fl)))) AS lsd FROM (
                 SELECT {keys}{comma}, k, a.power AS p, b.power AS q, b.fl FROM ({pred}) a
                 JOIN (SELECT *, 1e-10 * max(power) OVER (PARTITION BY {join}{comma}) AS fl FROM ({true}) WHERE k >= 1) b
                 USING ({join}{comma}, k) WHERE k >= 1) GROUP BY {keys}"""


add_view(
    "physics_long",
    """UNPIVOT (SELECT p.dataset, member, abs(pe - qe) / qe AS energy_rel_error, abs(pn - qn) / qn AS enstrophy_rel_error, pd / qd AS divergence_ratio
         FROM (SELECT dataset, member, avg(energy) AS pe, avg(enstrophy) AS pn, avg(rms_divergence) AS pd FROM pred_phys GROUP BY 1, 2) p
         JOIN (SELECT dataset, avg(energy) AS qe, avg(enstrophy) AS qn, avg(rms_divergence) AS qd FROM true_phys GROUP BY 1) q USING (dataset))
       ON energy_rel_error, enstrophy_rel_error, divergence_ratio INTO NAME metric VALUE value""",
)
add_view(
    "spectrum_long",
    " UNION ALL ".join(
        f"SELECT dataset, member, 'spectrum_{a}_lsd' AS metric, lsd AS value FROM ({sql_lsd(f'SELECT * FROM pred_lines_{a}', f'SELECT * FROM true_lines_{a}', 'dataset, member', 'dataset', 'channel')})"
        for a in ("x", "y")
    ),
)
VELOCITY = "SELECT {k}, 'u_x' AS name, lead - 1 AS t, mean_u_x AS value FROM {v} UNION ALL SELECT {k}, 'u_y', lead - 1, mean_u_y FROM {v}"
PRED_V = VELOCITY.format(k="dataset, member", v="pred_phys")
TRUE_V = VELOCITY.format(k="dataset", v="true_phys")
add_view(
    "drift_long",
    f"""SELECT p.dataset, member, name || '_' || w.kind AS metric,
               CASE w.kind WHEN 'mean_offset' THEN abs(pm - qm) / qs ELSE ps / qs END AS value
        FROM (SELECT dataset, member, name, avg(value) AS pm, stddev_pop(value) AS ps FROM ({PRED_V}) GROUP BY 1, 2, 3) p
        JOIN (SELECT dataset, name, avg(value) AS qm, stddev_pop(value) AS qs FROM ({TRUE_V}) GROUP BY 1, 2) q USING (dataset, name),
        (VALUES ('mean_offset'), ('mean_std_ratio')) AS w(kind)""",
)
add_view("pred_welch", sql_welch(PRED_V, "dataset, member, name", NPERSEG, OVERLAP))
add_view("true_welch", sql_welch(TRUE_V, "dataset, name", NPERSEG, OVERLAP))
add_view("pred_peak", sql_peak("SELECT dataset, member, k, omega, power FROM pred_welch WHERE name = 'u_y'", "dataset, member"))
add_view("true_peak", sql_peak("SELECT dataset, k, omega, power FROM true_welch WHERE name = 'u_y'", "dataset"))
add_view(
    "temporal_long",
    f"""SELECT dataset, member, 'temporal_' || name || '_lsd' AS metric, lsd AS value
        FROM ({sql_lsd('SELECT * FROM pred_welch', 'SELECT * FROM true_welch', 'dataset, member, name', 'dataset, name', '')})
        UNION ALL
        SELECT p.dataset, member, 'u_y_period_error', CASE WHEN p.power <= 1e-10 * q.power OR (p.peak_k = 1 AND q.peak_k > 1)
               THEN CAST('nan' AS DOUBLE) ELSE abs(q.omega / p.omega - 1) END
        FROM pred_peak p JOIN true_peak q ON p.dataset = q.dataset
        UNION ALL
        SELECT p.dataset, member, 'u_y_peak_power_ratio', p.power / q.power FROM pred_peak p JOIN true_peak q ON p.dataset = q.dataset""",
)
LONG = "SELECT dataset, member, metric, {v} AS value FROM {t}"


@query(
    "physics_comparison",
    "I9",
    " UNION ALL ".join(LONG.format(v=R("value"), t=t) for t in ("physics_long", "spectrum_long")),
)
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    scores = evaluate.physics_scores(pred_physics(data), true_physics(data))
    spectra = evaluate.spectrum_scores(pred_spectra(data), true_spectra(data))
    return rounded(scores.unionByName(spectra).drop("model"), "value")


@query("temporal_scores", "I10 I9", LONG.format(v=R("value"), t="temporal_long"))
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    p = evaluate.mean_velocity(materialize(pred_physics(data), "physics"), "model", "member")
    q = evaluate.mean_velocity(materialize(true_physics(data), "physics"))
    return rounded(evaluate.temporal_scores(p, q, NPERSEG).drop("model"), "value")


@query("mean_drift", "I11", LONG.format(v=R("value"), t="drift_long"))
def _(spark, sf):
    data = src.Tables(spark, sf)
    p = evaluate.mean_velocity(pred_physics(data), "model", "member")
    q = evaluate.mean_velocity(true_physics(data))
    return rounded(evaluate.drift_scores(p, q).drop("model"), "value")


# --- stability ------------------------------------------------------------------------------------


def sql_stability(pred: str, max_ratio: float) -> str:
    return f"""
      SELECT dataset, member, forecast_steps, CAST(coalesce(f * {BLOCK}, forecast_steps) AS DOUBLE) AS stable_steps,
             energy_peak_ratio, enstrophy_peak_ratio
      FROM (SELECT p.dataset, member, min(CASE WHEN NOT (e / te <= {max_ratio} AND n / tn <= {max_ratio}) THEN block END) AS f,
                   max(e / te) AS energy_peak_ratio, max(n / tn) AS enstrophy_peak_ratio, CAST(max(last) AS INTEGER) AS forecast_steps
            FROM (SELECT dataset, member, (lead - 1) // {BLOCK} AS block, avg(energy) AS e, avg(enstrophy) AS n, max(lead) AS last
                  FROM {pred} GROUP BY 1, 2, 3) p
            JOIN (SELECT dataset, max(e) AS te, max(n) AS tn FROM (
                    SELECT dataset, (lead - 1) // {BLOCK} AS block, avg(energy) AS e, avg(enstrophy) AS n FROM true_phys GROUP BY 1, 2) GROUP BY 1) q
            USING (dataset) GROUP BY 1, 2)"""


add_view("member_stability", sql_stability("pred_phys", MAX_RATIO))
STABLE = f"dataset, member, forecast_steps, stable_steps, {R('energy_peak_ratio')} AS energy_peak_ratio, {R('enstrophy_peak_ratio')} AS enstrophy_peak_ratio"


@query("stability", "I12 E7", f"SELECT {STABLE} FROM member_stability")
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(member_stability(data).drop("model"), "energy_peak_ratio", "enstrophy_peak_ratio")


ROLLOUT = 120
add_view(
    "roll_phys",
    f"""SELECT * FROM (SELECT dataset, CAST(m.m AS INTEGER) AS member, CAST(l.l AS INTEGER) AS lead, {CONTEXT - YEAR} - m.m + (l.l - 1) % {YEAR} AS t
        FROM catalog, range(1, {ROLLOUT + 1}) AS l(l), range({MEMBERS}) AS m(m)) JOIN frame_physics USING (dataset, t)""",
)
add_view("roll_stability", sql_stability("roll_phys", 0.98))


def rollout_stability(data):
    # A frame moves before it is repeated, and its copies stay in its partition. The number, not the one that the field was dealt
    # by, keeps partitions from being merged by the size of frames that aren't repeated yet.
    parts = 2 * int(data.spark.conf.get("spark.sql.shuffle.partitions"))
    runs = ensemble(data, ROLLOUT, parts, lines=True)
    pred = evaluate.physics(runs, data.grid, "model", "member", "origin", dealt=True).drop("origin")
    return evaluate.stability(pred, true_physics(data), BLOCK, 0.98)


@query("rollout_stability", "I13", f"SELECT {STABLE} FROM roll_stability")
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(rollout_stability(data).drop("model"), "energy_peak_ratio", "enstrophy_peak_ratio")


@query("dmd_rollout_stability", "I13 H11")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    run = forecast.predict(dmd_model(data, 2), data.field, CONTEXT, 90, 30)
    pred = run.select(F.lit("delay_dmd").alias("model"), "dataset", F.lit(0).alias("member"), "lead", "x", "y", "u_x", "u_y")
    table = evaluate.physics(pred, data.grid, "model", "member")
    return rounded(
        evaluate.stability(table, true_physics(data), BLOCK, 2.0), "energy_peak_ratio", "enstrophy_peak_ratio"
    )


def reconstruction_scores(data, codec):
    field, grid = data.field, data.grid
    back = forecast.decode(forecast.encode(field, codec.basis), codec.basis, ["dataset"], "t")
    pred = back.select(
        F.lit("pod").alias("model"), "dataset", F.lit(0).alias("member"), (F.col("t") + 1).alias("lead"), "x", "y", "u_x", "u_y"
    )
    true = windows.split_context(field, 0)[1]
    pooled = evaluate.align(pred, true, scales(data)).groupBy("model", "dataset", "member").agg(
        F.sqrt(F.avg((F.pow(F.col("p_x") - F.col("q_x"), 2) + F.pow(F.col("p_y") - F.col("q_y"), 2)) / 2)).alias("value")
    )
    p, q = evaluate.physics(pred, grid, "model", "member"), evaluate.physics(true, grid)
    return rounded(
        pooled.withColumn("metric", F.lit("rmse")).unionByName(evaluate.physics_scores(p, q)), "value"
    )


@query("reconstruction_scores", "I14 H6")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    codec = forecast.fit_codec(data.train_field, data.train_catalog, src.NX, src.NY, RANK)
    return reconstruction_scores(data, codec)


@query(
    "exact_reconstruction_scores",
    "I14 H6",
    """SELECT dataset, metric, CAST(v AS DOUBLE) AS value FROM catalog,
       (VALUES ('rmse', 0), ('energy_rel_error', 0), ('enstrophy_rel_error', 0), ('divergence_ratio', 1)) AS s(metric, v)""",
)
def _(spark, sf):
    # A codec of full rank on its own data loses nothing.
    data = src.Tables(spark, sf, stored=True)
    codec = forecast.fit_codec(data.field, data.catalog, src.NX, src.NY, FULL)
    scores = reconstruction_scores(data, codec).select("dataset", "metric", "value")
    return scores.withColumn("value", F.col("value") + 0.0)


add_view(
    "member_long",
    f"""SELECT dataset, member, 'rmse_mean' AS metric, avg(rmse) AS value FROM rmse_curve GROUP BY 1, 2
        UNION ALL SELECT dataset, member, 'rmse_lead_' || lead, rmse FROM rmse_curve WHERE lead IN {LEADS}
        UNION ALL SELECT * FROM (SELECT dataset, member, metric, value FROM physics_long)
        UNION ALL SELECT * FROM (SELECT dataset, member, metric, value FROM spectrum_long)
        UNION ALL SELECT * FROM (SELECT dataset, member, metric, value FROM temporal_long)
        UNION ALL SELECT * FROM (SELECT dataset, member, metric, value FROM drift_long)
        UNION ALL SELECT dataset, member, 'stable_steps', stable_steps FROM member_stability
        UNION ALL SELECT dataset, member, 'energy_peak_ratio', energy_peak_ratio FROM member_stability
        UNION ALL SELECT dataset, member, 'enstrophy_peak_ratio', enstrophy_peak_ratio FROM member_stability""",
)


add_view(
    "evaluation",
    f"""SELECT dataset, 'member_' || member AS grp, metric, value FROM member_long
        UNION ALL
        SELECT dataset, 'all', metric, (list_sort(list(value))[2] + list_sort(list(value))[3]) / 2 FROM member_long GROUP BY dataset, metric
        UNION ALL
        SELECT dataset, 'all', 'crps_mean', avg(crps) FROM curves GROUP BY dataset
        UNION ALL
        SELECT dataset, 'all', 'ensemble_size', CAST({MEMBERS} AS DOUBLE) FROM curves GROUP BY dataset
        UNION ALL
        SELECT dataset, 'all', 'crps_skill_horizon', CAST(coalesce(min(CASE WHEN NOT crps <= {THRESHOLD} THEN lead END) - 1, max(lead)) AS DOUBLE) FROM curves GROUP BY dataset
        UNION ALL
        SELECT dataset, 'all', 'crps_lead_' || lead, crps FROM curves WHERE lead IN {LEADS}
        UNION ALL
        SELECT dataset, 'all', 'spread_skill_lead_' || lead, spread_skill FROM curves WHERE lead IN {LEADS}""",
)


def evaluated(data, forecast_table, truth_table):
    return evaluate.evaluate(
        forecast_table, truth_table, data.grid, materialize(scales(data), "scales"),
        threshold=THRESHOLD, leads=LEADS, block_steps=BLOCK, max_ratio=MAX_RATIO, nperseg=NPERSEG,
    )


@query("full_evaluation", "I15", f"SELECT dataset, grp, metric, {R('value')} AS value FROM evaluation")
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True, packed=True)
    table = evaluated(data, materialize(ensemble(data, lines=True), "forecast"), truth(data, lines=True))
    return rounded(table.drop("model"), "value")


@query(
    "role_evaluation",
    "I15 I19 A7",
    f"""SELECT dataset, CASE WHEN role = 'train' THEN 'train.' || dataset WHEN grp = 'all' THEN 'val' ELSE 'val.' || grp END AS grp,
               metric, {R('value')} AS value FROM evaluation JOIN roles USING (dataset)
        WHERE role = 'val' OR role = 'train' AND grp = 'all'
        UNION ALL
        SELECT dataset, 'val', 'stable_fraction', {R('avg(CASE WHEN stable_steps >= forecast_steps THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')}
        FROM member_stability JOIN roles USING (dataset) WHERE role = 'val' GROUP BY dataset""",
)
def _(spark, sf):
    # The guard comes first: of test datasets no step is forecast or scored.
    data = src.Tables(spark, sf, stored=True, packed=True)
    wanted = materialize(data.roles.filter("role <> 'test'").select("dataset"), "wanted")
    scans.readable(data.catalog, wanted, data.roles)
    own = materialize(ensemble(data, lines=True).join(wanted, "dataset", "left_semi"), "forecast")
    table = evaluated(data, own, truth(data, lines=True).join(wanted, "dataset", "left_semi"))
    return rounded(evaluate.by_role(table, data.roles, windows.context_counts(data.catalog, CONTEXT)).drop("model"), "value")


add_view(
    "baselines",
    f"""SELECT 'persistence' AS model, dataset, x, y, u_x, u_y FROM field WHERE t = {CONTEXT - 1}
        UNION ALL SELECT 'mean_field', d.dataset, x, y, u_x, u_y
        FROM (SELECT x, y, avg(u_x) AS u_x, avg(u_y) AS u_y FROM field JOIN roles USING (dataset)
              WHERE role = 'train' GROUP BY 1, 2), catalog d""",
)


@query(
    "baseline_evaluation",
    "I15 H10 H1 H2",
    f"""SELECT model, dataset, 'val' AS grp, metric, {R('value')} AS value FROM (
          SELECT model, dataset, avg(rmse) AS rmse_mean, avg(miss) AS crps_mean FROM (
            SELECT model, b.dataset, lead, sqrt(avg(((b.u_x - q.u_x) * (b.u_x - q.u_x) / s_x / s_x + (b.u_y - q.u_y) * (b.u_y - q.u_y) / s_y / s_y) / 2)) AS rmse,
                   avg((abs(b.u_x - q.u_x) / s_x + abs(b.u_y - q.u_y) / s_y) / 2) AS miss
            FROM baselines b JOIN truth q USING (dataset, x, y) JOIN roles USING (dataset), scales WHERE role = 'val' GROUP BY 1, 2, 3)
          GROUP BY 1, 2) UNPIVOT (value FOR metric IN (rmse_mean, crps_mean))""",
)
def _(spark, sf):
    # Fitted models through the whole evaluation; of their scores two have a short form in SQL.
    data = src.Tables(spark, sf, stored=True)
    val = materialize(data.roles.filter("role = 'val'").select("dataset"), "val")
    scans.readable(data.catalog, val, data.roles)
    seen, steps = data.field.join(val, "dataset", "left_semi"), windows.context_counts(data.catalog.join(val, "dataset", "left_semi"), CONTEXT)
    runs = [
        forecast.predict(model, seen, CONTEXT, steps).drop("block").select(F.lit(model.kind).alias("model"), F.lit(0).alias("member"), "*")
        for model in (forecast.persistence_model(data.field), forecast.fit_mean_field(data.train_field))
    ]
    table = evaluated(data, materialize(runs[0].unionByName(runs[1]), "forecast"), truth(data).join(val, "dataset", "left_semi"))
    roles = evaluate.by_role(table, data.roles, steps).filter("metric IN ('rmse_mean', 'crps_mean')")
    return rounded(roles, "value")


# --- selection ------------------------------------------------------------------------------------

N_STEPS = 10
add_view(
    "validations",
    f"""SELECT *, CASE WHEN isnan(crps) THEN CAST('-inf' AS DOUBLE)
               WHEN stable_steps < {N_STEPS} THEN stable_steps * {N_STEPS + 1} + {N_STEPS} / (1 + log10(greatest(peak, 1)))
               ELSE stable_steps * {N_STEPS + 1} + skill - crps / (1 + crps) END AS selection_score
        FROM (SELECT dataset || '/' || name AS run, t AS idx, CAST(floor(value) % 11 AS DOUBLE) AS skill,
                     CASE WHEN value > 150 THEN CAST('nan' AS DOUBLE) ELSE value / 100 END AS crps,
                     CAST(least({N_STEPS}, floor(value / 3)) AS DOUBLE) AS stable_steps, value / 10 AS peak,
                     CAST(4 AS DOUBLE) AS members, CAST(least(4, floor(value / 8)) AS DOUBLE) AS stable_members, value
              FROM series)""",
)


def validations(spark, sf):
    """Each series as one run of validations, its scores by rule from the values."""
    v = F.col("value")
    return (
        src.series(spark, sf)
        .select(
            F.concat_ws("/", "dataset", "name").alias("run"),
            F.col("t").alias("idx"),
            (F.floor(v) % 11).cast("double").alias("skill"),
            F.when(v > 150, float("nan")).otherwise(v / 100).alias("crps"),
            F.least(F.lit(N_STEPS), F.floor(v / 3)).cast("double").alias("stable_steps"),
            (v / 10).alias("peak"),
            F.lit(4.0).alias("members"),
            F.least(F.lit(4), F.floor(v / 8)).cast("double").alias("stable_members"),
            v.alias("value"),
            F.lit(N_STEPS).alias("forecast_steps"),
        )
        .withColumn(
            "selection_score",
            selection.selection_score(
                F.col("skill"), F.col("crps"), F.col("stable_steps"), F.col("forecast_steps"), F.col("peak")
            ),
        )
    )


@query(
    "selection_score",
    "I16",
    f"SELECT run, idx, {R('selection_score')} AS selection_score FROM validations",
)
def _(spark, sf):
    return rounded(validations(spark, sf).select("run", "idx", "selection_score"), "selection_score")


@query(
    "model_selection_scores",
    "I17",
    f"""SELECT dataset, forecast_steps, skill_horizon, {R('tb')} AS tie_break_crps, stable_steps, {R('ep')} AS energy_peak_ratio,
               {R('np')} AS enstrophy_peak_ratio, {R('pk')} AS peak, members, stable_members,
               {R('CASE WHEN stable_steps < forecast_steps THEN stable_steps * (forecast_steps + 1) + forecast_steps / (1 + log10(greatest(pk, 1))) ELSE stable_steps * (forecast_steps + 1) + skill_horizon - tb / (1 + tb) END')} AS selection_score
        FROM (SELECT dataset, CAST(coalesce(min(CASE WHEN NOT crps <= {THRESHOLD} THEN lead END) - 1, max(lead)) AS INTEGER) AS skill_horizon,
                     max(CASE WHEN lead = 10 THEN crps END) AS tb, max(lead) AS forecast_steps FROM curves GROUP BY 1)
        JOIN (SELECT dataset, CAST(4 AS DOUBLE) AS members, CAST(count(*) FILTER (WHERE stable_steps >= forecast_steps) AS DOUBLE) AS stable_members,
                     (list_sort(list(stable_steps))[2] + list_sort(list(stable_steps))[3]) / 2 AS stable_steps,
                     (list_sort(list(energy_peak_ratio))[2] + list_sort(list(energy_peak_ratio))[3]) / 2 AS ep,
                     (list_sort(list(enstrophy_peak_ratio))[2] + list_sort(list(enstrophy_peak_ratio))[3]) / 2 AS np,
                     (list_sort(list(greatest(energy_peak_ratio, enstrophy_peak_ratio)))[2] + list_sort(list(greatest(energy_peak_ratio, enstrophy_peak_ratio)))[3]) / 2 AS pk
              FROM member_stability GROUP BY 1) USING (dataset)""",
)
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    curves = evaluate.ensemble_scores(aligned(data))
    table = selection.selection_scores(curves, member_stability(data), THRESHOLD, 10)
    return rounded(
        table.drop("model"), "tie_break_crps", "energy_peak_ratio", "enstrophy_peak_ratio", "peak", "selection_score"
    )


@query(
    "run_selection",
    "I18",
    f"""SELECT run, idx, start, m, {R('frac')} AS stable_fraction, settled, {R('score')} AS score,
               row_number() OVER (PARTITION BY run ORDER BY score DESC, idx) = 1 AS best
        FROM (SELECT *, selection_score + CASE WHEN stable_steps < {N_STEPS} THEN 0 ELSE frac * {N_STEPS + 1} * 400 END AS score
              FROM (SELECT v.run, v.idx, v.start, v.m, v.selection_score, v.stable_steps, v.len >= greatest(5, v.idx + 3) AS settled,
                           sum(w.stable_members) / sum(w.members) AS frac
                    FROM (SELECT *, CAST(least(greatest(idx - 2, 0), len - least(5, len)) AS INTEGER) AS start, CAST(least(5, len) AS INTEGER) AS m
                          FROM (SELECT *, max(idx) OVER (PARTITION BY run) + 1 AS len FROM validations)) v
                    JOIN validations w ON w.run = v.run AND w.idx >= v.start AND w.idx < v.start + v.m
                    GROUP BY ALL))""",
)
def _(spark, sf):
    return rounded(selection.run_selection(validations(spark, sf), 2), "stable_fraction", "score")


@query(
    "stable_fraction",
    "I19",
    f"""SELECT dataset, {R('avg(CASE WHEN stable_steps >= forecast_steps THEN 1.0 ELSE 0.0 END)')} AS stable_fraction
        FROM member_stability GROUP BY 1""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    return rounded(evaluate.stable_fraction(member_stability(data), ["dataset"]), "stable_fraction")


# Limits near the data's scores, so some pass and some fail. `absent` is a metric nobody reports.
LIMITS = (
    ("energy_rel_error", "max", 0.02), ("enstrophy_rel_error", "max", 0.02), ("spectrum_x_lsd", "max", 0.2),
    ("stable_fraction", "min", 0.5), ("u_x_mean_offset", "member_max", 0.6), ("u_y_mean_std_ratio", "member_max", 1.05),
)


add_view(
    "limits",
    "SELECT metric, scope, CAST(lim AS DOUBLE) AS lim FROM (VALUES "
    + ", ".join(f"('{m}', '{s}', {v})" for m, s, v in LIMITS)
    + ") AS l(metric, scope, lim)",
)
add_view(
    "gate_members",
    """SELECT dataset AS model, member, metric, value FROM physics_long
       UNION ALL SELECT dataset, member, metric, value FROM spectrum_long
       UNION ALL SELECT dataset, member, metric, value FROM drift_long
       UNION ALL SELECT dataset, member, 'stable_steps', stable_steps FROM member_stability""",
)
add_view(
    "gate_scores",
    """SELECT model, metric, (list_sort(list(value))[2] + list_sort(list(value))[3]) / 2 AS value FROM gate_members GROUP BY 1, 2
       UNION ALL SELECT dataset, 'stable_fraction', avg(CASE WHEN stable_steps >= forecast_steps THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM member_stability GROUP BY 1""",
)
add_view(
    "gate_broken",
    f"""SELECT model, member, 'stable validation forecast' AS why FROM gate_members WHERE metric = 'stable_steps' AND NOT value >= 40
        UNION ALL SELECT dataset, member, 'stable rollout' FROM roll_stability WHERE NOT stable_steps >= {ROLLOUT}
        UNION ALL SELECT model, member, 'member_max ' || l.metric FROM gate_members g JOIN limits l ON g.metric = l.metric AND l.scope = 'member_max'
                  WHERE NOT coalesce(value <= lim, FALSE)""",
)
add_view(
    "gate_failed",
    """SELECT model, l.scope || ' ' || l.metric AS why FROM gate_scores g JOIN limits l ON g.metric = l.metric AND l.scope IN ('max', 'min')
       WHERE NOT CASE l.scope WHEN 'max' THEN value <= lim ELSE value >= lim AND NOT isnan(value) END""",
)


@query(
    "acceptance_gate",
    "I20",
    """SELECT model, members, usable, failed_limits, usable >= 0.8 * members AND failed_limits = 0 AS passed,
              concat_ws('; ', CASE WHEN usable < 0.8 * members THEN member_reasons END, limit_reasons) AS reasons
       FROM (SELECT model, count(DISTINCT member) AS members,
                    count(DISTINCT member) - (SELECT count(DISTINCT member) FROM gate_broken b WHERE b.model = g.model) AS usable,
                    (SELECT count(*) FROM gate_failed f WHERE f.model = g.model) AS failed_limits,
                    (SELECT string_agg(w, '; ' ORDER BY w) FROM (SELECT DISTINCT 'member ' || member || ': ' || why AS w FROM gate_broken b WHERE b.model = g.model)) AS member_reasons,
                    (SELECT string_agg(why, '; ' ORDER BY why) FROM gate_failed f WHERE f.model = g.model) AS limit_reasons
             FROM gate_members g GROUP BY 1)""",
)
def _(spark, sf):
    data = src.Tables(spark, sf, stored=True)
    # One gate per dataset's ensemble. A gate reads stored scores, so they are stored first.
    pred = materialize(pred_physics(data), "physics")
    true = materialize(true_physics(data), "physics")
    stable = evaluate.stability(pred, true, BLOCK, MAX_RATIO)
    keep = ["dataset", "member", "metric", "value"]
    members = (
        evaluate.physics_scores(pred, true).select(keep)
        .unionByName(evaluate.spectrum_scores(pred_spectra(data), true_spectra(data)).select(keep))
        .unionByName(evaluate.drift_scores(
            evaluate.mean_velocity(pred, "model", "member"), evaluate.mean_velocity(true)
        ).select(keep))
        .unionByName(stable.select("dataset", "member", F.lit("stable_steps").alias("metric"), F.col("stable_steps").alias("value")))
        .withColumnRenamed("dataset", "model")
    )
    members = materialize(members, "members")
    medians = evaluate.member_median(members, ["model", "metric"])
    share = evaluate.stable_fraction(stable, ["dataset"]).select(
        F.col("dataset").alias("model"), F.lit("stable_fraction").alias("metric"), F.col("stable_fraction").alias("value")
    )
    rollouts = materialize(
        rollout_stability(data).select(F.col("dataset").alias("model"), "member", "stable_steps"), "rollouts"
    )
    return selection.gate(medians.unionByName(share), members, rollouts, LIMITS, 40, ROLLOUT)


@query(
    "forecast_parity",
    "I21",
    f"""SELECT dataset, {R('apart / sd')} AS difference, apart / sd <= 4.5 AS within
        FROM (SELECT dataset, max(greatest(abs(a.u_x - b.u_x), abs(a.u_y - b.u_y))) AS apart
              FROM (SELECT * FROM ens WHERE member = 0) a JOIN (SELECT * FROM ens WHERE member = 1) b USING (dataset, lead, x, y) GROUP BY 1)
        JOIN (SELECT dataset, stddev_pop(u) AS sd FROM (SELECT dataset, u_x AS u FROM truth UNION ALL SELECT dataset, u_y FROM truth) GROUP BY 1)
        USING (dataset)""",
)
def _(spark, sf):
    data = src.Tables(spark, sf)
    both = ensemble(data)
    a, b = both.filter("member = 0"), both.filter("member = 1")
    return rounded(evaluate.parity(a, b, truth(data), 4.5), "difference")


@query(
    "trial_leaderboard",
    "I22",
    f"""SELECT run AS trial, split_part(run, '/', 1) AS kind, count(score) AS validations, {R('max(score)')} AS best_score,
               {R('arg_max(frac, score)')} AS stable_fraction, {R('arg_max(score, idx)')} AS last_score, max(skill) < 10 AS error
        FROM (SELECT run, idx, skill, CASE WHEN value > 0 THEN round(selection_score, 9) - idx * 1e-6 END AS score, stable_members / members AS frac FROM validations)
        GROUP BY 1, 2""",
)
def _(spark, sf):
    v = validations(spark, sf)
    reports = v.select(
        F.col("run").alias("trial"), "idx",
        F.when(F.col("value") > 0, F.round("selection_score", 9) - F.col("idx") * 1e-6).alias("score"),
        (F.col("stable_members") / F.col("members")).alias("stable_fraction"),
    )
    trials = v.groupBy(F.col("run").alias("trial")).agg((F.max("skill") < 10).alias("error"))
    trials = trials.withColumn("kind", F.split("trial", "/")[0])
    return rounded(
        selection.leaderboard(trials, reports, ["kind"]), "best_score", "stable_fraction", "last_score"
    )
