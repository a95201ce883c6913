"""Queries on time: windows and samples, spectra, autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import autocorr, scans, spectra, stats, windows
from gridtide.operators.derive import to_lines
from gridtide.plans.common import R, add_view, r, rounded
from gridtide.plans.fields import PROBES, channel_mean_series
from gridtide.plans.registry import query
from gridtide.session import materialize
from gridtide.sources import adapters as src

KEYS = ["dataset", "name"]
NPERSEG, NOVERLAP = 32, 16

# --- windows, samples, restructuring ------------------------------------------------------------

add_view(
    "sample_index",
    """SELECT dataset, CAST(s.i AS INTEGER) AS sample, CASE WHEN o.i < 4 THEN 'input' ELSE 'target' END AS role,
              CAST(CASE WHEN o.i < 4 THEN o.i ELSE o.i - 4 END AS INTEGER) AS "offset",
              CAST(s.i * 5 + o.i AS INTEGER) AS t
       FROM catalog, unnest(range((n_steps - 6) // 5 + 1)) AS s(i), range(6) AS o(i)""",
)


@query(
    "windowed_samples",
    "E1",
    f"""SELECT dataset, sample, role, "offset", t, {R('avg(u_x)')} AS u_x, {R('avg(u_y)')} AS u_y
        FROM sample_index JOIN field USING (dataset, t) GROUP BY ALL""",
)
def _(spark, sf):
    frames = stats.mean_field(src.field(spark, sf), "dataset", "t").groupBy("dataset", "t").agg(
        F.avg("u_x").alias("u_x"), F.avg("u_y").alias("u_y")
    )
    samples = windows.windowed_samples(frames, src.catalog(spark, sf), window=4, horizon=2, stride=5)
    return rounded(samples, "u_x", "u_y")


@query(
    "context_split",
    "E2",
    """SELECT dataset, CAST(t - 24 + 1 AS INTEGER) AS lead, count(*) AS cells, n_steps - 24 AS n_scored
       FROM field JOIN catalog USING (dataset) WHERE t >= 24 GROUP BY dataset, t, n_steps""",
)
def _(spark, sf):
    windows.check_window(4, 24)
    _, targets = windows.split_context(src.field(spark, sf), 24)
    counts = windows.context_counts(src.catalog(spark, sf), 24)
    return targets.groupBy("dataset", "lead").agg(F.count("*").alias("cells")).join(counts, "dataset")


@query(
    "snapshot_pairs",
    "E3",
    f"""SELECT dataset, name, t, {R('value')} AS value, {R('v1')} AS value_after FROM (
          SELECT *, lead(value) OVER (PARTITION BY dataset, name ORDER BY t) AS v1 FROM series) WHERE v1 IS NOT NULL""",
)
def _(spark, sf):
    pairs = windows.snapshot_pairs(src.series(spark, sf), KEYS, ["value"])
    return rounded(pairs, "value", "value_after")


@query(
    "delay_pairs",
    "E4",
    """SELECT dataset, CAST(b.t AS INTEGER) AS before, CAST(b.t + 1 AS INTEGER) AS after
       FROM catalog, unnest(range(3, n_steps - 1)) AS b(t)""",
)
def _(spark, sf):
    return windows.delay_pairs(src.catalog(spark, sf), 4)


@query(
    "lagged_features",
    "E5",
    f"""SELECT dataset, name, t, {R('l1')} AS newest, {R('l2')} AS middle, {R('l3')} AS oldest, {R('value')} AS target
        FROM (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3
              FROM series WINDOW w AS (PARTITION BY dataset, name ORDER BY t)) WHERE t >= 3""",
)
def _(spark, sf):
    latents = src.series(spark, sf).select(*KEYS, "t", F.array("value").alias("z"))
    rows = windows.lagged_features(latents, 3, tuple(KEYS), block=64)
    picks = [F.col("features")[i] for i in range(3)] + [F.col("target")[0]]
    names = ("newest", "middle", "oldest", "target")
    return rows.select(*KEYS, "t", *[r(c).alias(n) for c, n in zip(picks, names)])


@query(
    "epoch_batches",
    "E6",
    """SELECT position, position // 16 AS batch, dataset, start FROM (
         SELECT row_number() OVER (ORDER BY md5('7:3:0:' || dataset || ':' || start)) - 1 AS position, dataset, start,
                count(*) OVER () AS n
         FROM (SELECT dataset, CAST(s.i AS INTEGER) AS start FROM catalog, unnest(range(n_steps - 5)) AS s(i)))
       WHERE position < n // 16 * 16""",
)
def _(spark, sf):
    return windows.epoch_batches(src.catalog(spark, sf), span=6, seed=7, epoch=3, batch_size=16)


@query(
    "block_means",
    "E7",
    f"SELECT dataset, name, CAST(t // 25 AS INTEGER) AS block, {R('avg(value)')} AS value FROM series GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return rounded(windows.block_means(src.series(spark, sf), KEYS, 25), "value")


# --- spectra --------------------------------------------------------------------------------------


def sql_periodogram(source: str, keys: str, t: str = "t", spacing: str = "1.0") -> str:
    """SQL of (keys, n, k, omega, power) by direct sums over `source` (keys, t, value)."""
    return f"""
      SELECT {keys}, n, k, 2 * pi() * k / (n * {spacing}) AS omega,
             (re * re + im * im) * {spacing} / w2 / (2 * pi())
               * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END AS power
      FROM (SELECT {keys}, n, CAST(ks.k AS INTEGER) AS k, sum(v * w * cos(2 * pi() * ((pos * ks.k) % n) / n)) AS re,
                   sum(v * w * sin(2 * pi() * ((pos * ks.k) % n) / n)) AS im, sum(w * w) AS w2
            FROM (SELECT {keys}, pos, v, n, 0.5 - 0.5 * cos(2 * pi() * pos / (n - 1)) AS w
                  FROM (SELECT {keys}, {t} AS pos, value - avg(value) OVER p AS v, count(*) OVER p AS n
                        FROM ({source}) WINDOW p AS (PARTITION BY {keys}))) b,
                 unnest(range(n // 2 + 1)) AS ks(k)
            GROUP BY {keys}, n, ks.k)"""


def sql_welch(source: str, keys: str, nperseg: int, noverlap: int) -> str:
    step = nperseg - noverlap
    cut = f"""SELECT {keys}, seg, t - seg * {step} AS pos0, value FROM (
                SELECT *, max(t) OVER (PARTITION BY {keys}) + 1 AS total FROM ({source})), range(1000) AS g(seg)
              WHERE t >= seg * {step} AND t < seg * {step} + {nperseg} AND seg * {step} + {nperseg} <= total"""
    return f"""SELECT {keys}, k, omega, avg(power) AS power FROM (
        {sql_periodogram(cut, keys + ', seg', t='pos0')}) GROUP BY {keys}, k, omega"""


def sql_dominant(spectrum: str, keys: str, n: int) -> str:
    return f"""
      SELECT {keys}, CAST(rank AS INTEGER) AS rank, 2 * pi() / omega AS period, omega, power / total AS power_fraction FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY power DESC, k) AS rank FROM (
          SELECT *, lag(power) OVER w AS lo, lead(power) OVER w AS hi,
                 sum(CASE WHEN k >= 1 THEN power END) OVER (PARTITION BY {keys}) AS total
          FROM ({spectrum}) WINDOW w AS (PARTITION BY {keys} ORDER BY k))
        WHERE k >= 1 AND power > lo AND power > hi)
      WHERE rank <= {n}"""


def sql_peak(spectrum: str, keys: str) -> str:
    return f"""
      SELECT {keys}, k AS peak_k,
             CASE WHEN refine THEN omega + 0.5 * (a - c) / bend * d ELSE omega END AS omega,
             CASE WHEN refine THEN exp(b - 0.25 * (a - c) * (0.5 * (a - c) / bend)) ELSE power END AS power
      FROM (SELECT *, a - 2 * b + c AS bend, k > 1 AND k < last AND power > 0 AND a - 2 * b + c <> 0 AS refine FROM (
        SELECT *, ln(nullif(lo, 0) + 1e-300) AS a, ln(CASE WHEN power > 0 THEN power END) AS b, ln(nullif(hi, 0) + 1e-300) AS c,
               row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN k >= 1 THEN power ELSE -1 END DESC, k) AS pick FROM (
          SELECT *, lag(power) OVER w AS lo, lead(power) OVER w AS hi, max(k) OVER p AS last,
                 min(CASE WHEN k >= 1 THEN omega END) OVER p AS d
          FROM ({spectrum}) WINDOW w AS (PARTITION BY {keys} ORDER BY k), p AS (PARTITION BY {keys}))))
      WHERE pick = 1"""


add_view("series_pg", sql_periodogram("SELECT dataset, name, t, value FROM series", "dataset, name"))
add_view("series_welch", sql_welch("SELECT dataset, name, t, value FROM series", "dataset, name", NPERSEG, NOVERLAP))


def series_periodogram(spark, sf):
    return spectra.periodogram(src.series(spark, sf), KEYS, longest=src.SERIES_STEPS)


def series_welch(spark, sf):
    return spectra.welch(src.series(spark, sf), KEYS, NPERSEG, NOVERLAP)


@query(
    "periodogram",
    "F1",
    f"SELECT dataset, name, k, {R('omega')} AS omega, {R('power', 3)} AS power FROM series_pg",
)
def _(spark, sf):
    return rounded(rounded(series_periodogram(spark, sf), "omega"), "power", digits=3)


@query(
    "welch_spectrum",
    "F2",
    f"SELECT dataset, name, k, {R('omega')} AS omega, {R('power', 3)} AS power FROM series_welch",
)
def _(spark, sf):
    return rounded(rounded(series_welch(spark, sf), "omega"), "power", digits=3)


@query(
    "dominant_periods",
    "F3",
    f"""SELECT dataset, name, rank, {R('period')} AS period, {R('omega')} AS omega,
               {R('power_fraction')} AS power_fraction
        FROM ({sql_dominant('SELECT * FROM series_pg', 'dataset, name', 3)})""",
)
def _(spark, sf):
    peaks = spectra.dominant_periods(series_periodogram(spark, sf), KEYS, 3)
    return rounded(peaks, "period", "omega", "power_fraction")


@query(
    "interpolated_peak",
    "F4",
    f"""SELECT dataset, name, peak_k, {R('omega')} AS omega, {R('power')} AS power
        FROM ({sql_peak('SELECT * FROM series_welch', 'dataset, name')})""",
)
def _(spark, sf):
    return rounded(spectra.interpolated_peak(series_welch(spark, sf), KEYS), "omega", "power")


def sql_lines(axis: str, table: str = "vel", extra: str = "") -> str:
    """SQL of the per-line spectra along `axis` of a (.., channel, u) table."""
    other = "y" if axis == "x" else "x"
    spacing = "2.5" if axis == "x" else "0.25"
    keys = f"{extra}dataset, channel, t, {other}"
    return sql_periodogram(
        f"SELECT {keys}, {axis}, u AS value FROM {table}", keys, t=axis, spacing=f"CAST({spacing} AS DOUBLE)"
    )


for axis, n_other in (("x", 9), ("y", 11)):
    add_view(
        f"lines_{axis}",
        f"""SELECT dataset, channel, k, omega, sum(power) / {n_other} AS total, avg(power) AS power
            FROM ({sql_lines(axis)}) GROUP BY 1, 2, 3, 4""",
    )


@query(
    "line_spectrum",
    "F5",
    " UNION ALL ".join(
        f"SELECT '{a}' AS axis, dataset, channel, k, {R('omega')} AS omega, {R('total')} AS power FROM lines_{a}"
        for a in ("x", "y")
    ),
)
def _(spark, sf):
    field, grid = src.field(spark, sf), src.grid(spark, sf)
    both = [
        spectra.line_spectrum(field, grid, a, mean=False).withColumn("axis", F.lit(a)) for a in ("x", "y")
    ]
    return rounded(both[0].unionByName(both[1]), "omega", "power")


@query(
    "spectrum_on_lines",
    "F5",
    " UNION ALL ".join(
        f"SELECT '{a}' AS axis, dataset, channel, k, {R('omega')} AS omega, {R('total')} AS power FROM lines_{a}"
        for a in ("x", "y")
    ),
)
def _(spark, sf):
    # The field at rest as lines: spectra along y need no exchange of it.
    lines, grid = materialize(to_lines(src.field(spark, sf)), "lines"), src.grid(spark, sf)
    both = [spectra.spectrum_of_lines(lines, grid, a, mean=False).withColumn("axis", F.lit(a)) for a in ("x", "y")]
    return rounded(both[0].unionByName(both[1]), "omega", "power")


@query(
    "spectrum_summary",
    "F6",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS axis, dataset, channel, {R('sum(power) * min(omega)')} AS variance,
                   {R('CASE WHEN arg_max(k, power) <> 1 THEN arg_max(omega, power) END')} AS peak_k,
                   {R('CASE WHEN arg_max(k, power) <> 1 THEN 2 * pi() / arg_max(omega, power) END')} AS peak_wavelength
            FROM lines_{a} WHERE k >= 1 GROUP BY dataset, channel"""
        for a in ("x", "y")
    ),
)
def _(spark, sf):
    field, grid = src.field(spark, sf), src.grid(spark, sf)
    both = [
        spectra.spectrum_summary(
            spectra.line_spectrum(field, grid, a).withColumn("axis", F.lit(a)), ["axis", "dataset", "channel"]
        )
        for a in ("x", "y")
    ]
    return rounded(both[0].unionByName(both[1]), "variance", "peak_k", "peak_wavelength")


@query(
    "wavenumber_axes",
    "F7",
    f"""SELECT dataset, 'x' AS axis, CAST(r.i AS INTEGER) AS i, {R('2 * pi() * r.i / (nx * dx)')} AS k FROM grid, range(6) AS r(i)
        UNION ALL SELECT dataset, 'y', CAST(r.i AS INTEGER), {R('2 * pi() * r.i / (ny * dy)')} FROM grid, range(5) AS r(i)
        UNION ALL SELECT dataset, 'x_centred', CAST(r.i AS INTEGER), {R('2 * pi() * (r.i - 5) / (nx * dx)')} FROM grid, range(11) AS r(i)""",
)
def _(spark, sf):
    return rounded(spectra.wavenumber_axes(src.grid_table(spark, sf)), "k")


# The cross-check sums directly: 2-D per frame first, then over time.
add_view(
    "frame_waves",
    """SELECT dataset, channel, t, CAST(kx.i AS INTEGER) AS i, CAST(ky.j AS INTEGER) AS j,
              sum(u * wx * wy * cos(2 * pi() * (x * kx.i / 11.0 + y * ky.j / 9.0))) AS re,
              sum(-u * wx * wy * sin(2 * pi() * (x * kx.i / 11.0 + y * ky.j / 9.0))) AS im
       FROM (SELECT dataset, t, x, y, c.channel, CASE c.channel WHEN 'u_x' THEN u_x ELSE u_y END AS u,
                    0.5 - 0.5 * cos(2 * pi() * x / 10) AS wx, 0.5 - 0.5 * cos(2 * pi() * y / 8) AS wy
             FROM fluct, (VALUES ('u_x'), ('u_y')) AS c(channel)), range(11) AS kx(i), range(5) AS ky(j)
       GROUP BY 1, 2, 3, 4, 5""",
)
add_view(
    "waves2d",
    """SELECT dataset, channel, (i + 5) % 11 AS ikx, j AS iky, 2 * pi() * ((i + 5) % 11 - 5) / 27.5 AS kx,
              2 * pi() * j / 2.25 AS ky,
              avg(re * re + im * im) * 2.5 * 0.25 / (3.75 * 3.0) / (4 * pi() * pi()) * CASE j WHEN 0 THEN 1 ELSE 2 END AS power
       FROM frame_waves GROUP BY dataset, channel, i, j""",
)
WAVES = f"{R('kx')} AS kx, {R('ky')} AS ky, {R('power')} AS power"


@query("wavenumber_spectrum", "F8", f"SELECT dataset, channel, ikx, iky, {WAVES} FROM waves2d")
def _(spark, sf):
    s = spectra.wavenumber_spectrum(src.field(spark, sf), src.grid(spark, sf))
    return rounded(s, "kx", "ky", "power")


@query(
    "wavenumber_peak",
    "F9",
    f"""SELECT dataset, channel, {WAVES} FROM (
          SELECT *, row_number() OVER (PARTITION BY dataset, channel ORDER BY round(power, 9) DESC, ikx, iky) AS pick
          FROM waves2d WHERE NOT (ikx = 5 AND iky = 0)) WHERE pick = 1""",
)
def _(spark, sf):
    # A real field has equal power at kx and -kx in the ky = 0 column: rounding makes it a tie.
    s = spectra.wavenumber_spectrum(src.field(spark, sf), src.grid(spark, sf))
    return rounded(spectra.wavenumber_peak(rounded(s, "power", digits=9)), "kx", "ky", "power")


add_view(
    "waves3d",
    """SELECT dataset, channel, CAST((w + n // 2) % n AS INTEGER) AS iw, (i + 5) % 11 AS ikx, j AS iky,
              2 * pi() * ((w + n // 2) % n - n // 2) / n AS omega,
              2 * pi() * ((i + 5) % 11 - 5) / 27.5 AS kx, 2 * pi() * j / 2.25 AS ky,
              (r2 * r2 + i2 * i2) * 2.5 * 0.25 / (3.0 * (n - 1) / 8) / (3.75 * 3.0) / power(2 * pi(), 3)
                * CASE j WHEN 0 THEN 1 ELSE 2 END AS power
       FROM (SELECT dataset, channel, i, j, n, ws.w,
                    sum(h * (re * cos(2 * pi() * ((t * ws.w) % n) / n) + im * sin(2 * pi() * ((t * ws.w) % n) / n))) AS r2,
                    sum(h * (im * cos(2 * pi() * ((t * ws.w) % n) / n) - re * sin(2 * pi() * ((t * ws.w) % n) / n))) AS i2
             FROM (SELECT f.*, n_steps AS n, 0.5 - 0.5 * cos(2 * pi() * t / (n_steps - 1)) AS h
                   FROM frame_waves f JOIN catalog USING (dataset)), unnest(range(n)) AS ws(w)
             GROUP BY 1, 2, 3, 4, 5, 6)""",
)


@query(
    "spacetime_spectrum",
    "F10",
    f"SELECT dataset, channel, iw, ikx, iky, {R('omega')} AS omega, {WAVES} FROM waves3d",
)
def _(spark, sf):
    s = spectra.spacetime_spectrum(
        src.field(spark, sf), src.grid(spark, sf), catalog=src.catalog(spark, sf)
    )
    return rounded(s, "omega", "kx", "ky", "power")


@query(
    "spacetime_peak",
    "F11",
    f"""SELECT dataset, channel, {R('omega')} AS omega,
               CASE WHEN omega = 0 THEN CAST('inf' AS DOUBLE) ELSE {R('2 * pi() / abs(omega)')} END AS period, {WAVES}
        FROM (SELECT *, row_number() OVER (PARTITION BY dataset, channel ORDER BY round(power, 9) DESC, iw, ikx, iky) AS pick
              FROM waves3d WHERE NOT (omega = 0 AND kx = 0 AND iky = 0)) WHERE pick = 1""",
)
def _(spark, sf):
    s = spectra.spacetime_spectrum(
        src.field(spark, sf), src.grid(spark, sf), catalog=src.catalog(spark, sf)
    )
    peak = spectra.spacetime_peak(rounded(s, "power", digits=9))
    return rounded(peak, "omega", "period", "kx", "ky", "power")


# --- autocorrelation ------------------------------------------------------------------------------

add_view(
    "field_acf",
    """SELECT dataset, channel, n_steps, lag, s / (n_steps - lag) / first_value(s / n_steps) OVER (
              PARTITION BY dataset, channel ORDER BY lag) AS rho
       FROM (SELECT a.dataset, c.channel, n_steps, CAST(b.t - a.t AS INTEGER) AS lag,
                    sum(CASE c.channel WHEN 'u_x' THEN a.u_x * b.u_x ELSE a.u_y * b.u_y END) AS s
             FROM fluct a JOIN fluct b ON a.dataset = b.dataset AND a.x = b.x AND a.y = b.y AND b.t >= a.t
             JOIN catalog ON catalog.dataset = a.dataset AND b.t - a.t <= least(150, n_steps // 2),
             (VALUES ('u_x'), ('u_y')) AS c(channel) GROUP BY 1, 2, 3, 4)""",
)
add_view(
    "series_acf",
    """SELECT dataset, name, 120 AS n_steps, lag, s / (120 - lag) / first_value(s / 120) OVER (
              PARTITION BY dataset, name ORDER BY lag) AS rho
       FROM (SELECT a.dataset, a.name, CAST(b.t - a.t AS INTEGER) AS lag, sum(a.v * b.v) AS s
             FROM (SELECT *, value - avg(value) OVER (PARTITION BY dataset, name) AS v FROM series) a
             JOIN (SELECT *, value - avg(value) OVER (PARTITION BY dataset, name) AS v FROM series) b
             ON a.dataset = b.dataset AND a.name = b.name AND b.t - a.t BETWEEN 0 AND 40 GROUP BY 1, 2, 3)""",
)


@query("field_autocorrelation", "F12", f"SELECT dataset, channel, n_steps, lag, {R('rho')} AS rho FROM field_acf")
def _(spark, sf):
    return rounded(autocorr.field_autocorrelation(src.field(spark, sf), lengths=src.catalog(spark, sf)), "rho")


def series_acf(spark, sf):
    return autocorr.series_autocorrelation(src.series(spark, sf), KEYS, longest=src.SERIES_STEPS)


@query("series_autocorrelation", "F13", f"SELECT dataset, name, n_steps, lag, {R('rho')} AS rho FROM series_acf")
def _(spark, sf):
    return rounded(series_acf(spark, sf), "rho")


@query(
    "decorrelation",
    "F14",
    f"""SELECT dataset, name, {R('lag1')} AS lag1, one_over_e, below_005, zero, {R('tau')} AS tau_int,
               {R('CASE WHEN tau <> 0 THEN 120 / (2 * tau) END')} AS n_eff
        FROM (SELECT dataset, name, lag1, one_over_e, below_005, zero,
                     CASE WHEN zero IS NOT NULL THEN 0.5 + coalesce(s, 0) END AS tau
              FROM (SELECT dataset, name, max(CASE WHEN lag = 1 THEN rho END) AS lag1,
                           min(CASE WHEN rho <= exp(-1) THEN lag END) AS one_over_e,
                           min(CASE WHEN rho <= 0.05 THEN lag END) AS below_005,
                           min(CASE WHEN rho <= 0 THEN lag END) AS zero FROM series_acf GROUP BY 1, 2)
              LEFT JOIN (SELECT dataset, name, sum(rho) AS s FROM series_acf
                         JOIN (SELECT dataset, name, min(CASE WHEN rho <= 0 THEN lag END) AS z FROM series_acf GROUP BY 1, 2)
                         USING (dataset, name) WHERE lag >= 1 AND lag < z GROUP BY 1, 2) USING (dataset, name))""",
)
def _(spark, sf):
    return rounded(autocorr.decorrelation(series_acf(spark, sf), KEYS), "lag1", "tau_int", "n_eff")


@query(
    "white_noise_band",
    "F15",
    f"SELECT dataset, name, {R('1.96 / sqrt(max(t) + 1)')} AS band FROM series GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(autocorr.white_noise_band(src.series(spark, sf), KEYS), "band")


def sql_report(source: str, keys: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{method}' AS method, k, omega, power FROM ({sql})"
        for method, sql in (
            ("periodogram", sql_periodogram(source, keys)),
            ("welch", sql_welch(source, keys, NPERSEG, NOVERLAP)),
        )
    )
    return f"""SELECT dataset, name, {R('mean')} AS mean, {R('std')} AS std, method, rank, {R('period')} AS period,
                      {R('omega')} AS omega, {R('power_fraction')} AS power_fraction
               FROM ({sql_dominant(parts, keys + ', method', 3)})
               JOIN (SELECT {keys}, avg(value) AS mean, stddev_pop(value) AS std FROM ({source}) GROUP BY {keys})
               USING ({keys})"""


REPORT = ("mean", "std", "period", "omega", "power_fraction")


@query(
    "point_spectrum_report",
    "F16 A5",
    sql_report(
        """SELECT dataset, p.label || '.' || channel AS name, t, u AS value FROM vel
           JOIN (VALUES ('wall', 0, 4), ('core', 5, 4), ('outlet', 10, 8)) AS p(label, px, py) ON x = px AND y = py""",
        "dataset, name",
    ),
)
def _(spark, sf):
    probes = spectra.point_series(scans.point_probe(src.field(spark, sf), PROBES))
    return rounded(spectra.temporal_report(probes, KEYS, NPERSEG, 3), *REPORT)


@query("domain_spectrum_report", "F17 C7", sql_report("SELECT * FROM spatial_series", "dataset, name"))
def _(spark, sf):
    series = stats.spatial_series(src.field(spark, sf))
    return rounded(spectra.temporal_report(series, KEYS, NPERSEG, 3), *REPORT)


@query(
    "log_spectral_distance",
    "F18",
    f"""SELECT dataset, {R('avg(abs(log10(greatest(p, fl) / greatest(q, fl))))')} AS lsd FROM (
          SELECT dataset, channel, k, p, q, 1e-10 * max(q) OVER (PARTITION BY dataset, channel) AS fl
          FROM (SELECT dataset, channel, k, power AS q FROM lines_y WHERE k >= 1)
          JOIN (SELECT channel, k, avg(power) AS p FROM lines_y WHERE k >= 1 GROUP BY 1, 2) USING (channel, k))
        GROUP BY 1""",
)
def _(spark, sf):
    # Each dataset's spectrum against the mean spectrum over datasets.
    true = spectra.line_spectrum(src.field(spark, sf), src.grid(spark, sf), "y")
    typical = true.groupBy("channel", "k").agg(F.avg("power").alias("power"))
    names = src.catalog(spark, sf).select("dataset")
    predicted = names.join(true.select("dataset", "channel", "k"), "dataset").join(typical, ["channel", "k"])
    return rounded(spectra.log_spectral_distance(predicted, true, ["dataset"], ["channel"]), "lsd")


# --- two halves with their periods ------------------------------------------------------------------


@query(
    "stationarity_periods",
    "C11 C10",
    f"""SELECT dataset, name, half, rank, {R('period')} AS period, {R('power_fraction')} AS power_fraction FROM ({sql_dominant(
        sql_periodogram('''SELECT dataset, channel AS name, CASE WHEN t < n_steps // 2 THEN 'first' ELSE 'second' END AS half,
                                  CASE WHEN t < n_steps // 2 THEN t ELSE t - n_steps // 2 END AS t, mean AS value
                           FROM stepstats JOIN catalog USING (dataset)''', 'dataset, name, half'),
        'dataset, name, half', 3)})""",
)
def _(spark, sf):
    keys = ["dataset", "name", "half"]
    halves = stats.with_halves(channel_mean_series(spark, sf), src.catalog(spark, sf))
    halves = halves.select(*keys, F.col("step").alias("t"), "value")
    peaks = spectra.dominant_periods(spectra.periodogram(halves, keys), keys, 3)
    return rounded(peaks.select(*keys, "rank", "period", "power_fraction"), "period", "power_fraction")
