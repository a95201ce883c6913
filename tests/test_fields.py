import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridtide.functions.layout import core_rows, exact_quantiles, halo_blocks, halo_window
from gridtide.operators import derive, moments, scans, stats, windows


def values(df, *columns, by=("t",)):
    rows = df.orderBy(*by).collect()
    return [np.array([r[c] for r in rows], dtype=float) for c in columns]


@pytest.fixture
def rotation(make_field, make_grid):
    x, y = np.meshgrid(np.arange(6) * 0.5, np.arange(5) * 0.25, indexing="ij")
    a = np.stack([np.stack([-y, x])] * 2)
    return make_field({"rot": a}), make_grid(["rot"], 6, 5, 0.5, 0.25)


def test_solid_body_rotation(rotation):
    field, grid = rotation
    g = derive.gradients(field, grid)
    worst = g.select(F.max(F.abs(derive.vorticity() - 2)), F.max(F.abs(derive.divergence()))).first()
    assert max(worst) < 1e-12
    (e,) = values(derive.enstrophy(field, grid), "enstrophy")
    np.testing.assert_allclose(e, 2.0)


def test_gradient_matches_numpy_in_both_layouts(make_field, make_grid, rng):
    a = rng.normal(size=(3, 2, 7, 5))
    grid = make_grid(["d"], 7, 5, 0.3, 0.7)
    w = np.gradient(a[:, 1], 0.3, axis=1) - np.gradient(a[:, 0], 0.7, axis=2)
    want = (0.5 * w**2).mean(axis=(1, 2))
    for parts in (1, 7):
        field = make_field({"d": a}, parts)
        np.testing.assert_allclose(values(derive.enstrophy(field, grid), "enstrophy")[0], want)
        lines = derive.to_lines(field)
        np.testing.assert_allclose(values(derive.line_enstrophy(lines, grid), "enstrophy")[0], want)
    back = derive.to_cells(lines)
    assert back.exceptAll(field.select(back.columns)).count() == 0


def test_frame_gradients_need_one_field_exchange(rotation):
    field, grid = rotation
    plan = derive.enstrophy(field, grid)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(dataset") == 1, plan


def test_unknown_field_name(rotation):
    with pytest.raises(ValueError, match="unknown field"):
        derive.select_field(*rotation, "pressure")


def test_correlation_of_constant_and_anti_fields(make_field, rng):
    u = rng.normal(size=(2, 1, 4, 4))
    anti = make_field({"d": np.concatenate([u, -u], axis=1)})
    np.testing.assert_allclose(values(stats.channel_correlation(anti), "correlation")[0], -1, rtol=1e-9)
    flat = make_field({"d": np.ones((2, 2, 4, 4))})
    assert values(stats.channel_correlation(flat), "correlation")[0].tolist() == [0, 0]


def test_histogram_matches_numpy(make_field, rng):
    a = np.round(rng.normal(size=(5, 2, 6, 6)), 1)  # many values on edges
    rows = stats.histogram(make_field({"d": a}), 10).orderBy("channel", "bin").collect()
    for c, name in enumerate(("u_x", "u_y")):
        counts = [r["count"] for r in rows if r.channel == name]
        assert sum(counts) == a[:, c].size and len(counts) == 10
        want, _ = np.histogram(a[:, c], 10)
        assert np.abs(np.array(counts) - want).sum() <= 4  # edges differ in their last bit


def test_rolling_mean_is_centred_and_block_free(spark, make_series, rng):
    v = rng.normal(size=103)
    series = make_series({"a": v, "b": v[:40]})
    lengths = series.groupBy("name").agg((F.max("t") + 1).alias("n_steps"))
    for block in (4, 4096):
        got = stats.rolling_mean(series, ["name"], lengths, parts=10, block=block)
        for name, n in (("a", 103), ("b", 40)):
            w = max(n // 10, 1)
            rows = got.filter(F.col("name") == name).orderBy("t").collect()
            want = np.convolve(v[:n], np.ones(w) / w, "valid")
            np.testing.assert_allclose([r.value for r in rows], want)
            assert rows[0].t == (n - len(want)) // 2


def test_exact_quantiles_with_a_hot_value(spark, rng):
    hot = np.concatenate([np.zeros(500), rng.normal(size=333), rng.exponential(50, size=200)])
    few = rng.normal(size=5)
    df = spark.createDataFrame([("hot", float(v)) for v in hot] + [("few", float(v)) for v in few], "k string, v double")
    got = {(r.k, r.prob): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0, 0.01, 0.5, 0.77, 1], 16).collect()}
    for k, data in (("hot", hot), ("few", few)):
        for p in (0, 0.01, 0.5, 0.77, 1):
            assert got[k, p] == pytest.approx(np.quantile(data, p))


@pytest.mark.parametrize("block", [1, 3, 100])
def test_halo_blocks_keep_windows_exact(make_series, block):
    series = make_series({"a": np.arange(20.0) ** 2})
    near = halo_window(["name"], "t")
    rows = core_rows(
        halo_blocks(series, "t", 2, 1, block)
        .withColumn("lag2", F.lag("value", 2).over(near)).withColumn("next", F.lead("value").over(near))
    ).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(20))
    assert [r.lag2 for r in rows] == [None, None] + [float(t**2) for t in range(18)]
    assert [r.next for r in rows] == [float(t**2) for t in range(1, 20)] + [None]


def test_moments_pool_like_one_pass_on_any_layout(make_field, rng):
    a = {"a": rng.normal(3, 1, size=(4, 2, 3, 3)), "b": rng.normal(-2, 2, size=(9, 2, 3, 3)), "c": rng.normal(size=(1, 2, 3, 3))}
    whole = np.concatenate(list(a.values()))
    seen = []
    for parts in (1, 7):
        m = moments.channel_moments(make_field(a, parts).coalesce(1).sortWithinPartitions("dataset", "t", "x", "y"))
        rows = moments.pooled_stats(m).orderBy("channel").collect()
        for c, row in enumerate(rows):
            assert row.mean == pytest.approx(whole[:, c].mean())
            assert row.std == pytest.approx(whole[:, c].std())
            assert (row.n_samples, row.n_sources) == (whole[:, c].size, 3)
        seen.append([(r.mean, r.std) for r in rows])
        merged = moments.merge_moments(m).orderBy("channel").first()
        assert merged.m2 == pytest.approx(((whole[:, 0] - whole[:, 0].mean()) ** 2).sum())
    assert seen[0] == seen[1]


def test_stats_rules_and_shared_std(spark):
    schema = "channel string, mean double, std double, n_samples long, n_sources long, n_distinct_sources long"
    bad = spark.createDataFrame(
        [("u_x", float("nan"), 1.0, 5, 2, 1), ("u_y", 0.0, 0.0, 0, 0, 0), ("u_y", 0.0, 2.0, 1, 1, 1)], schema
    )
    found = sorted((r.channel, r.rule) for r in moments.stats_violations(bad).collect())
    assert found == [
        ("u_x", "duplicate source datasets"), ("u_x", "mean not finite"), ("u_y", "duplicate channel"),
        ("u_y", "n_samples not > 0"), ("u_y", "no source datasets"), ("u_y", "std not finite and > 0"),
    ]
    good = spark.createDataFrame([("u_x", 0.0, 3.0, 1, 1, 1), ("u_y", 0.0, 4.0, 1, 1, 1)], schema)
    assert {round(r.effective_std, 9) for r in moments.effective_std(good, "shared").collect()} == {round(12.5**0.5, 9)}
    with pytest.raises(ValueError, match="std mode"):
        moments.effective_std(good, "none")


def test_contract_and_roles(spark, make_field):
    a = np.zeros((2, 2, 3, 3))
    a[0, 0, 0, 0], a[1, 1, 1, 1] = np.nan, 200.0
    field = make_field({"bad": a, "good": np.ones((2, 2, 3, 3))})
    names = spark.createDataFrame([("bad",), ("good",), ("gone",)], "dataset string")
    found = {(r.dataset, r.rule) for r in scans.contract_violations(field, names, 3, 3).collect()}
    assert found == {("bad", "finite"), ("bad", "range"), ("gone", "exists")}
    roles = spark.createDataFrame([("bad", "test"), ("good", "train")], "dataset string, role string")
    with pytest.raises(scans.DatasetError, match="test dataset"):
        scans.readable(field, names, roles)
    with pytest.raises(scans.DatasetError, match="gone"):
        scans.select_datasets(field, field.select("dataset").distinct(), names)


def test_samples_pairs_and_short_regions(spark):
    catalog = spark.createDataFrame([("a", 9), ("b", 6)], "dataset string, n_steps int")
    index = windows.sample_index(catalog, 3, 2, 2).collect()
    assert {(r.dataset, r.sample) for r in index} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    assert sorted(r.t for r in index if (r.dataset, r.sample) == ("a", 2)) == [4, 5, 6, 7, 8]
    with pytest.raises(PySparkException, match="too few steps"):
        windows.sample_index(catalog, 5, 3).collect()
    pairs = windows.delay_pairs(catalog, 3).filter("dataset = 'b'").orderBy("before").collect()
    assert [(r.before, r.after) for r in pairs] == [(2, 3), (3, 4), (4, 5)]
    with pytest.raises(PySparkException, match="no step left"):
        windows.context_counts(catalog, 6).collect()


def test_epochs_are_permutations_that_cycle(spark):
    catalog = spark.createDataFrame([("a", 30), ("b", 21)], "dataset string, n_steps int")
    n = 26 + 17
    one = windows.epoch_batches(catalog, 5, 1, 0, 8).orderBy("position").collect()
    assert len(one) == n // 8 * 8 and [r.position for r in one] == list(range(len(one)))
    assert len({(r.dataset, r.start) for r in one}) == len(one)
    more = windows.epoch_batches(catalog, 5, 1, 0, 8, samples=100).collect()
    assert len(more) == 96
    first = {(r.dataset, r.start) for r in more if r.position < n}
    assert len(first) == n
    other = windows.epoch_batches(catalog, 5, 1, 1, 8).orderBy("position").collect()
    assert [(r.dataset, r.start) for r in other] != [(r.dataset, r.start) for r in one]


def test_latent_scales_refuse_constant_modes(spark):
    rows = [("a", t, "m0", float(t % 3)) for t in range(6)] + [("a", t, "m1", 1.0) for t in range(6)]
    latents = spark.createDataFrame(rows, "dataset string, t int, mode string, value double")
    with pytest.raises(ValueError, match="m1"):
        moments.checked_latent_scales(latents)


def test_lines_give_what_cells_give_without_moving_cells(spark, make_field, rng):
    from gridtide.operators import derive, spectra
    from gridtide.schema import Grid

    field, grid = make_field({"a": rng.normal(size=(3, 2, 5, 4)), "b": rng.normal(size=(2, 2, 5, 4))}), Grid(5, 4, 0.5, 0.25)
    path_free = spark.createDataFrame(derive.to_lines(field).collect(), "dataset string, t int, x int, u_x array<double>, u_y array<double>")
    near = lambda a, b, keys: [pytest.approx([r[c] for c in sorted(r.asDict())], nan_ok=True) == [q[c] for c in sorted(q.asDict())] for r, q in zip(a.orderBy(*keys).drop(*keys).collect(), b.orderBy(*keys).drop(*keys).collect(), strict=True)]
    lines = derive.line_physics(path_free, grid)
    cells = derive.frame_physics(field, grid)
    assert all(near(lines.select(*cells.columns), cells, ["dataset", "t"]))
    for axis in "xy":
        keys = ["dataset", "channel", "k"]
        assert all(near(spectra.spectrum_of_lines(path_free, grid, axis), spectra.line_spectrum(field, grid, axis), keys))
    for name in derive.FIELDS:
        got = derive.line_field(path_free, grid, name).selectExpr("dataset", "t", "x", "posexplode(value) as (y, value)")
        assert all(near(got, derive.select_field(field, grid, name), ["dataset", "t", "x", "y"]))
    # Spectra along y exchange only sums; physics moves lines once, never single cells.
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    along_y = plan(spectra.spectrum_of_lines(path_free, grid, "y"))
    assert along_y.index("MapInPandas") > along_y.rindex("Exchange")
    whole = plan(lines)
    assert whole.count("Exchange") == 1 and "Generate" not in whole


def test_spectra_exchange_the_field_once(make_field, rng):
    from gridtide.operators import spectra
    from gridtide.schema import Grid

    field, grid = make_field({"a": 5 + rng.normal(size=(12, 2, 4, 3))}), Grid(4, 3, 1.0, 1.0)
    for frame in (spectra.wavenumber_spectrum(field, grid), spectra.spacetime_spectrum(field, grid, longest=12)):
        logical = frame._jdf.queryExecution().optimizedPlan().toString()
        assert logical.count("MapInPandas") == 1 and "avg(u_x" not in logical


def test_value_range_of_lines(make_field, make_grid, rng):
    field, grid = make_field({"a": rng.normal(size=(5, 2, 4, 3)), "b": rng.normal(size=(3, 2, 4, 3))}), make_grid(["a", "b"], 4, 3, 0.5, 0.25)
    lines = derive.to_lines(field)
    for name in derive.FIELDS:
        got, want = ({r.dataset: (r.lo, r.hi, r.diff_limit) for r in derive.value_range(f, grid, name, 2).collect()} for f in (lines, field))
        assert got.keys() == want.keys() == {"a", "b"}
        assert all(got[d] == pytest.approx(want[d], rel=1e-12) for d in got)
