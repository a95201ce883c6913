import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import forecast, modal
from gridtide.operators.linalg import gram


def cells(df, column):
    """(channel, x, y)-ordered array of one column."""
    rows = df.orderBy("channel", "x", "y").collect()
    return np.array([r[column] for r in rows])


def wave_field(n=40, growth=0.0, period=8.0):
    t, x, y = np.meshgrid(np.arange(n), np.arange(6), np.arange(4), indexing="ij")
    k = 2 * np.pi / 6
    u = np.exp(growth * t) * np.cos(k * x - 2 * np.pi * t / period)
    return np.stack([u, 0.5 * u * np.cos(y)], axis=1)


def test_gram_in_any_layout(spark, rng):
    a, b = rng.normal(size=(50, 4)), rng.normal(size=(50, 3))
    df = spark.createDataFrame([("k" + str(i % 2), a[i].tolist(), b[i].tolist()) for i in range(50)], "k string, a array<double>, b array<double>")
    for parts in (1, 7):
        rows = gram(df.repartition(parts), ["k"], "a", "b").filter("k = 'k1'").orderBy("i").collect()
        np.testing.assert_allclose(np.array([r.row for r in rows]), a[1::2].T @ b[1::2])


def test_pod_of_two_orthogonal_patterns(make_field):
    t = np.arange(40)
    p, q = np.zeros((4, 3)), np.zeros((4, 3))
    p[0], q[2] = 1.0, 2.0
    u = np.sin(2 * np.pi * t / 8)[:, None, None] * p + np.sin(2 * np.pi * t / 5)[:, None, None] * q
    field = make_field({"d": np.stack([u, 0 * u], axis=1)})
    rows = modal.cell_rows(field)
    factors = modal.pod_factors(rows)
    table = modal.pod_report(factors).orderBy("mode").collect()
    assert [round(r.energy_fraction, 6) for r in table] == [0.8, 0.2]
    assert {r.modes_for_level for r in table} == {2}
    modes = modal.pod_modes(rows, factors)
    u_modes = cells(modes, "coef")
    np.testing.assert_allclose(u_modes.T @ u_modes, np.eye(2), atol=1e-9)
    one = modal.reconstruct(modes, factors, [0]).filter("channel = 'u_x'")
    worst = one.filter("x <> 2").agg(F.max(F.abs("value"))).first()[0]
    assert worst < 1e-9
    back = modal.reconstruct(modes, factors).filter("channel = 'u_x' AND x = 0 AND y = 0").orderBy("t")
    np.testing.assert_allclose([r.value for r in back.collect()], u[:, 0, 0] - u[:, 0, 0].mean(), atol=1e-9)


@pytest.mark.parametrize("growth", [0.0, -0.02, 0.03])
def test_dmd_recovers_a_travelling_wave(spark, make_field, growth):
    a = wave_field(40, growth)
    a = a - a.mean(axis=0) if growth == 0 else a
    # A symmetric pair of copies keeps the time mean at zero for a growing wave.
    field = make_field({"d": a})
    packed = field.groupBy("dataset", "x", "y").agg(F.array_sort(F.collect_list(F.struct("t", "u_x", "u_y"))).alias("s"))
    rows = packed.select("dataset", F.lit("u_x").alias("channel"), "x", "y", F.col("s.u_x").alias("vec"))
    dmd = modal.exact_dmd(rows)
    lengths = spark.createDataFrame([("d", 40)], "dataset string, n_steps int")
    top = modal.dominant_dmd_modes(dmd, lengths, 1).first()
    assert top.frequency == pytest.approx(2 * np.pi / 8, rel=1e-6)
    assert top.growth_rate == pytest.approx(growth, abs=1e-6)
    assert top.period == pytest.approx(8)
    assert top.rms_power == pytest.approx(top.power * np.sqrt(np.mean(np.exp(2 * growth * np.arange(40)))), rel=1e-5)
    # The mode and its conjugate make up the field.
    modes = modal.dmd_modes(rows, dmd)
    course = modal.mode_evolution(modes, dmd, top.mode, 40, normalize_growth=False)
    got = np.array([r.value for r in course.filter("x = 1 AND y = 2").orderBy("t").collect()])
    np.testing.assert_allclose(2 * got, a[:, 0, 1, 2], atol=1e-6)


def test_spod_energy_is_the_welch_power(make_field, rng):
    a = rng.normal(size=(64, 2, 3, 2))
    field = make_field({"d": a})
    waves = modal.segment_waves(field, 16, 8)
    modes = modal.spod(waves, 16)
    total = np.array([r.s for r in modes.groupBy("k").agg(F.sum("eigenvalue").alias("s")).orderBy("k").collect()])
    w, want = np.hanning(16), 0
    for s in range(0, 49, 8):
        seg = a[s : s + 16] - a[s : s + 16].mean(axis=0)
        p = np.abs(np.fft.rfft(seg * w[:, None, None, None], axis=0)) ** 2 / (w**2).sum() / (2 * np.pi)
        p[1:8] *= 2
        want = want + p.sum(axis=(1, 2, 3)) / 7
    np.testing.assert_allclose(total, want, rtol=1e-9)
    leading = modal.leading_frequencies(modes, 2).orderBy("rank").collect()
    first = {r.k: r.eigenvalue for r in modes.filter("mode = 0 AND k >= 1").collect()}
    assert leading[0].eigenvalue == pytest.approx(max(first.values()))
    assert leading[0].eigenvalue_fraction == pytest.approx(max(first.values()) / sum(first.values()))


def rotations(rng, n=16, sets=2):
    """Two rotations (periods 8 and 4) seen through a random embedding."""
    embed = rng.normal(size=(4, 2 * 6 * 4))
    out = {}
    for i in range(sets):
        t = np.arange(n) + 3 * i
        z = np.stack([np.cos(2 * np.pi * t / 8), np.sin(2 * np.pi * t / 8), np.cos(np.pi * t / 2), np.sin(np.pi * t / 2)], 1)
        out[f"d{i}"] = (z @ embed).reshape(n, 2, 6, 4)
    return out


def catalog(spark, arrays):
    return spark.createDataFrame([(k, len(v)) for k, v in arrays.items()], "dataset string, n_steps int")


def as_array(run, dataset, n, nx, ny):
    out = np.full((n, 2, nx, ny), np.nan)
    for r in run.filter(F.col("dataset") == dataset).collect():
        out[r.lead - 1, :, r.x, r.y] = r.u_x, r.u_y
    return out


@pytest.mark.parametrize("side", ["state", "frames"])
@pytest.mark.parametrize("delays", [1, 2])
def test_dmd_forecasts_rotations_exactly(spark, make_field, rng, monkeypatch, side, delays):
    monkeypatch.setattr(forecast, "short_side", lambda *a: forecast.Side(side, 48))
    arrays = rotations(rng)
    field = make_field(arrays)
    model = forecast.fit_delay_dmd(field, catalog(spark, arrays), 6, 4, 10, 10, delays)
    run = forecast.predict(model, field, 6, 10, 4)
    for name, a in arrays.items():
        np.testing.assert_allclose(as_array(run, name, 10, 6, 4), a[6:], atol=1e-6)
    info = {r.name: r.value for r in model.info.collect()}
    assert info["spatial_rank"] == 4 and info["n_pairs"] == 2 * (16 - delays)
    assert info["unstable_modes"] <= 4


def test_a_standing_wave_needs_two_delays(spark, make_field, rng):
    pattern = rng.normal(size=(2, 4, 3))
    a = {"d": np.cos(2 * np.pi * np.arange(30) / 7)[:, None, None, None] * pattern}
    field, names = make_field(a), catalog(spark, a)
    errors = []
    for delays in (1, 2):
        model = forecast.fit_delay_dmd(field, names, 4, 3, 5, 5, delays)
        run = as_array(forecast.predict(model, field, 12, 10), "d", 10, 4, 3)
        errors.append(np.abs(run - a["d"][12:22]).max())
    # The time mean of the cosine is not exactly zero, so two delays are near exact, one is not.
    assert errors[1] < 0.1 * errors[0]


def test_latent_var_blocks_and_store(spark, make_field, rng, tmp_path):
    arrays = rotations(rng)
    field, names = make_field(arrays), catalog(spark, arrays)
    codec = forecast.fit_codec(field, names, 6, 4, 10)
    model = forecast.fit_latent_var(codec, field, window=2)
    forecast.save_model(model, str(tmp_path / "m"), "var")
    loaded = forecast.load_model(spark, str(tmp_path / "m"))
    whole = as_array(forecast.predict(loaded, field, 6, 10), "d0", 10, 6, 4)
    parts = as_array(forecast.predict(model, field, 6, 10, 3), "d0", 10, 6, 4)
    np.testing.assert_allclose(whole, arrays["d0"][6:], atol=1e-5)
    np.testing.assert_allclose(parts, whole, atol=1e-8)
    assert forecast.parameter_count(loaded).first().parameters == 48 * 4 + 2 * 4 * 4
    info = {r.name: r.value for r in loaded.info.collect()}
    assert info["n_pairs"] == 28 and info["spectral_radius"] == pytest.approx(1, abs=1e-6)


def test_a_wide_short_axis_is_iterated(spark, make_field, rng, monkeypatch):
    arrays = rotations(rng)
    field, names = make_field(arrays), catalog(spark, arrays)
    assert forecast.short_side(names, 6, 4) == forecast.Side("frames", 32)
    known = forecast.fit_codec(field, names, 6, 4, 4)
    monkeypatch.setattr(forecast, "MAX_WIDTH", 10)
    wide = forecast.fit_codec(field, names, 6, 4, 4)
    got, want = ({r.name: r.value for r in m.info.collect()} for m in (wide, known))
    assert got == pytest.approx(want)
    back = forecast.decode(forecast.encode(field, wide.basis), wide.basis, ["dataset"], "t")
    apart = back.join(field.withColumnsRenamed({"u_x": "a", "u_y": "b"}), ["dataset", "t", "x", "y"]).agg(
        F.max(F.abs(F.col("u_x") - F.col("a")) + F.abs(F.col("u_y") - F.col("b")))
    ).first()[0]
    assert apart < 1e-6


def test_a_wide_gram_is_refused_with_advice(spark, monkeypatch):
    from gridtide.operators import linalg

    monkeypatch.setattr(linalg, "MAX_WIDTH", 2)
    df = spark.createDataFrame([("k", [1.0, 2.0, 3.0])], "k string, vec array<double>")
    with pytest.raises(Exception, match="longer axis in the rows"):
        linalg.gram(df, ["k"]).collect()


def test_autoregression_of_nearly_equal_latents(spark, rng):
    # The second latent is nearly the first: the lags' condition is about 1e7, their normal equations' 1e14.
    a, b = rng.normal(size=60), rng.normal(size=60)
    z = np.stack([a, a + 1e-7 * b], 1)
    x = z - z.mean(axis=0)
    lags, target = x[:-1], x[1:]
    assert np.linalg.cond(lags) > 5e6
    rows = spark.createDataFrame([("f", "d", i, v.tolist()) for i, v in enumerate(z)], "fit string, dataset string, t int, z array<double>")
    got = forecast.var_operator(rows.repartition(5), 1).first()
    want = np.linalg.lstsq(lags, target, rcond=None)[0]
    np.testing.assert_allclose(np.array(got.operator), want, rtol=1e-6, atol=1e-3)
    assert got.n_pairs == 59 and np.abs(want).max() > 1e4


def test_least_squares_by_a_tree_at_condition_1e10(spark, rng):
    from gridtide.operators import linalg

    u, _ = np.linalg.qr(rng.normal(size=(200, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    a = (u * [1, 1e-3, 1e-7, 1e-10]) @ v.T
    b = a @ [1.0, -2.0, 0.5, 3.0] + 1e-13 * rng.normal(size=200)
    rows = spark.createDataFrame([("f", [*map(float, r), float(y)]) for r, y in zip(a, b)], "fit string, row array<double>").repartition(9)
    found = linalg.triangles(rows, "fit", "row").first()
    r = linalg.triangle_of(found.r, found.width)
    np.testing.assert_allclose(r.T @ r, np.column_stack((a, b)).T @ np.column_stack((a, b)), atol=1e-13)
    got, want = (np.linalg.lstsq(m, y, rcond=1e-14)[0] for m, y in ((r[:, :4], r[:, 4]), (a, b)))
    # What is determined by the data agrees: the residual, and the solution within its own sensitivity.
    np.testing.assert_allclose(a @ got, a @ want, atol=1e-14)
    np.testing.assert_allclose(got, want, atol=1e-16 * 1e10 * 50)
    assert found.n == 200


@pytest.mark.parametrize("n", [3, modal.NARROW + 1])
def test_spod_sums_equal_the_segments_gram(spark, rng, n):
    """Narrow rows are multiplied all at once, wide ones key by key; few sums leave a task."""
    z = rng.normal(size=(3, 2, 20, n, 2))
    rows = [(f"d{d}", k, "u_x", x, 0, z[d, k, x, :, 0].tolist(), z[d, k, x, :, 1].tolist()) for d in range(3) for k in range(2) for x in range(20)]
    waves = spark.createDataFrame(rows, "dataset string, k int, channel string, x int, y int, re array<double>, im array<double>")
    got = modal.spod(waves.repartition(2), 4).collect()
    assert len(got) == 3 * 2 * n
    for d in range(3):
        for k in range(2):
            c = z[d, k, :, :, 0] + 1j * z[d, k, :, :, 1]
            g = c.conj().T @ c
            own = sorted((r for r in got if (r.dataset, r.k) == (f"d{d}", k)), key=lambda r: r.mode)
            np.testing.assert_allclose([r.eigenvalue for r in own], np.linalg.eigvalsh(g)[::-1] / n, rtol=1e-9)
            w = np.array(own[0].w_re) + 1j * np.array(own[0].w_im)
            np.testing.assert_allclose(g @ w, own[0].eigenvalue * n * w, atol=1e-8)


def test_spod_products_of_a_batch_are_few_frames(rng):
    keys = pd.DataFrame({"dataset": ["a", "b"] * 50, "k": [0, 0, 1, 1] * 25})
    z = rng.normal(size=(100, 3)) + 1j * rng.normal(size=(100, 3))
    [(found, sums)] = list(modal._products(keys, z))
    assert len(found) == 4 and sums.shape == (4, 18)
