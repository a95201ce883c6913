import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridtide.operators import autocorr, spectra


def power_of(v):
    n, w = len(v), np.hanning(len(v))
    p = np.abs(np.fft.rfft((v - v.mean()) * w)) ** 2 / (w**2).sum() / (2 * np.pi)
    p[1 : (n + 1) // 2] *= 2
    return p


def column(df, what, /, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return np.array([r[what] for r in df.orderBy("k" if "k" in df.columns else "lag").collect()])


def test_unit_sine_has_variance_one_half(make_series):
    s = make_series({"a": np.sin(2 * np.pi * np.arange(1000) / 50)})
    p = spectra.periodogram(s, ["name"])
    assert column(p, "power").sum() * 2 * np.pi / 1000 == pytest.approx(0.5, rel=1e-6)
    assert spectra.dominant_periods(p, ["name"], 1).first().period == pytest.approx(50)


@pytest.mark.parametrize("limit", [1 << 18, 60])
def test_periodogram_equals_numpy_direct_and_split(make_series, rng, limit):
    # A prime, an even and an odd length; beyond the limit a series is never gathered.
    data = {"prime": rng.normal(size=101), "even": rng.normal(size=64), "odd": rng.normal(size=45)}
    p = spectra.periodogram(make_series(data), ["name"], limit=limit)
    for name, v in data.items():
        np.testing.assert_allclose(column(p, "power", name=name), power_of(v), rtol=1e-8, atol=1e-12)


def test_welch_and_its_limits(make_series, rng):
    data = {"a": rng.normal(size=100), "b": rng.normal(size=37)}
    p = spectra.welch(make_series(data), ["name"], 32, 20)
    for name, v in data.items():
        want = np.mean([power_of(v[s : s + 32]) for s in range(0, len(v) - 31, 12)], axis=0)
        np.testing.assert_allclose(column(p, "power", name=name), want, rtol=1e-9)
    with pytest.raises(ValueError, match="noverlap"):
        spectra.welch(make_series(data), ["name"], 32, 32)
    with pytest.raises(PySparkException, match="shorter than nperseg"):
        spectra.welch(make_series(data), ["name"], 50).collect()


def test_two_tones_are_ranked_by_power(make_series):
    t = np.arange(2000)
    s = make_series({"a": np.sin(2 * np.pi * t / 200) + 0.4 * np.sin(2 * np.pi * t / 25)})
    peaks = spectra.dominant_periods(spectra.periodogram(s, ["name"]), ["name"], 2).orderBy("rank").collect()
    assert [round(r.period) for r in peaks] == [200, 25]


@pytest.mark.parametrize("period", [21.3, 27.0, 33.7])
def test_a_tone_between_bins_is_refined(make_series, period):
    s = make_series({"a": np.sin(2 * np.pi * np.arange(1000) / period)})
    peak = spectra.interpolated_peak(spectra.welch(s, ["name"], 200), ["name"]).first()
    assert 2 * np.pi / peak.omega == pytest.approx(period, rel=0.02)


@pytest.mark.parametrize("limit", [1 << 14, 50])
def test_series_autocorrelation_direct_and_split(make_series, rng, limit):
    data = {"a": np.cumsum(rng.normal(size=120)), "b": rng.normal(size=31)}
    acf = autocorr.series_autocorrelation(make_series(data), ["name"], limit=limit)
    for name, v in data.items():
        c, n = v - v.mean(), len(v)
        raw = np.array([(c[: n - lag] * c[lag:]).sum() / (n - lag) for lag in range(n // 3 + 1)])
        np.testing.assert_allclose(column(acf, "rho", name=name), raw / raw[0], atol=1e-9)


@pytest.mark.parametrize("block", [7, 1024])
def test_field_autocorrelation_in_any_blocks(make_field, rng, block):
    a = np.cumsum(rng.normal(size=(40, 2, 3, 2)), axis=0)
    acf = autocorr.field_autocorrelation(make_field({"d": a}), max_lag=15, block=block)
    u = a - a.mean(axis=0)
    for c, name in enumerate(("u_x", "u_y")):
        raw = np.array([(u[: 40 - k, c] * u[k:, c]).sum() / (40 - k) for k in range(16)])
        np.testing.assert_allclose(column(acf, "rho", channel=name), raw / raw[0], atol=1e-9)


def test_decorrelation_marks(spark):
    rho = [1.0, 0.5, 0.2, -0.1, 0.3]
    acf = spark.createDataFrame([("a", 10, i, v) for i, v in enumerate(rho)], "name string, n_steps int, lag int, rho double")
    m = autocorr.decorrelation(acf, ["name"]).first()
    assert (m.lag1, m.one_over_e, m.below_005, m.zero) == (0.5, 2, 3, 3)
    assert m.tau_int == pytest.approx(1.2) and m.n_eff == pytest.approx(10 / 2.4)
    never = autocorr.decorrelation(acf.filter("lag < 2"), ["name"]).first()
    assert never.zero is None and never.tau_int is None and never.n_eff is None


def test_travelling_wave_is_found_in_space_and_time(make_field, make_grid):
    t, x, y = np.meshgrid(np.arange(40), np.arange(32), np.arange(16), indexing="ij")
    kx, ky, w = 2 * np.pi * 4 / 32, 2 * np.pi * 3 / 16, 2 * np.pi * 6 / 40
    u = np.sin(kx * x + ky * y - w * t)
    field, grid = make_field({"d": np.stack([u, 0.5 * u], axis=1)}), make_grid(["d"], 32, 16)
    for limit in (1 << 18, 8):
        s = spectra.spacetime_spectrum(field, grid, limit=limit)
        p = spectra.spacetime_peak(s).filter("channel = 'u_x'").first()
        assert (abs(p.kx), p.ky, abs(p.omega)) == pytest.approx((kx, ky, w))
        assert np.sign(p.kx) == -np.sign(p.omega)
        assert p.period == pytest.approx(2 * np.pi / w)
    flat = spectra.wavenumber_peak(spectra.wavenumber_spectrum(field, grid)).filter("channel = 'u_x'").first()
    assert (abs(flat.kx), flat.ky) == pytest.approx((kx, ky))


def test_spectrum_volume_is_the_windowed_variance(make_field, make_grid, rng):
    a = rng.normal(size=(24, 2, 8, 6))
    field, grid = make_field({"d": a}), make_grid(["d"], 8, 6, 0.5, 0.25)
    s = spectra.spacetime_spectrum(field, grid).filter("channel = 'u_y'")
    volume = (2 * np.pi / 24) * (2 * np.pi / (8 * 0.5)) * (2 * np.pi / (6 * 0.25))
    w = np.hanning(24)[:, None, None] * np.hanning(8)[:, None] * np.hanning(6)
    u = a[:, 1] - a[:, 1].mean(axis=0)
    assert s.agg(F.sum("power")).first()[0] * volume == pytest.approx(((u * w) ** 2).sum() / (w**2).sum())


def test_log_distance_of_a_factor_and_of_silence(spark):
    true = spark.createDataFrame([("a", k, 10.0 / (k + 1)) for k in range(6)], "name string, k int, power double")
    double = true.withColumn("power", 2 * F.col("power"))
    assert spectra.log_spectral_distance(double, true, ["name"], []).first().lsd == pytest.approx(np.log10(2))
    silent = true.withColumn("power", F.lit(0.0))
    assert 9 < spectra.log_spectral_distance(silent, true, ["name"], []).first().lsd < 11
