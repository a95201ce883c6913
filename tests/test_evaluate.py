import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridtide.functions.batches import group_stacks
from gridtide.operators import derive, evaluate, selection
from gridtide.plans import scoring

RUN = "model string, dataset string, member int"
NAN = float("nan")


@pytest.fixture
def case(spark, rng):
    """Three members, four leads, a 3 x 2 grid, against numpy."""

    def make(m=3):
        q = rng.normal(size=(4, 2, 3, 2))
        p = q + rng.normal(size=(m, 4, 2, 3, 2))
        _, lead, x, y = np.indices((1, 4, 3, 2))
        truth = spark.createDataFrame(
            [("d", int(a) + 1, int(b), int(c), float(q[a, 0, b, c]), float(q[a, 1, b, c])) for a, b, c in zip(lead.ravel(), x.ravel(), y.ravel())],
            "dataset string, lead int, x int, y int, u_x double, u_y double",
        )
        runs = spark.createDataFrame(
            [("m", "d", k, int(a) + 1, int(b), int(c), float(p[k, a, 0, b, c]), float(p[k, a, 1, b, c])) for k in range(m) for a, b, c in zip(lead.ravel(), x.ravel(), y.ravel())],
            f"{RUN}, lead int, x int, y int, u_x double, u_y double",
        ).repartition(5)
        scales = spark.createDataFrame([(2.0, 0.5)], "s_u_x double, s_u_y double")
        s = np.array([2.0, 0.5])[:, None, None]
        return runs, truth, scales, p / s, q / s

    return make


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_ensemble_scores_follow_the_member_cycle(case, m):
    runs, truth, scales, p, q = case(m)
    aligned = evaluate.align(runs, truth, scales)
    got = evaluate.ensemble_scores(aligned).orderBy("lead").collect()
    pairs = [(k, k + 1) for k in range(m - 1)] + ([(0, m - 1)] if m >= 3 else [])
    axes = (1, 2, 3)
    miss = np.mean([np.abs(p[k] - q).mean(axis=axes) for k in range(m)], axis=0)
    apart = np.mean([np.abs(p[a] - p[b]).mean(axis=axes) for a, b in pairs], axis=0) if pairs else 0
    apart_sq = np.mean([((p[a] - p[b]) ** 2).mean(axis=axes) for a, b in pairs], axis=0) if pairs else 0
    spread, rmse = np.sqrt(0.5 * apart_sq), np.sqrt(((p.mean(axis=0) - q) ** 2).mean(axis=axes))
    np.testing.assert_allclose([r.crps for r in got], miss - 0.5 * apart)
    np.testing.assert_allclose([r.mean_rmse for r in got], rmse)
    ratio = [r.spread_skill for r in got]
    if m == 1:
        assert all(math.isnan(v) for v in ratio)
    else:
        np.testing.assert_allclose(ratio, np.sqrt((m + 1) / m) * spread / rmse)
    curves = evaluate.rmse_per_lead(aligned).filter("member = 0").orderBy("lead").collect()
    np.testing.assert_allclose([r.rmse for r in curves], np.sqrt(((p[0] - q) ** 2).mean(axis=axes)))


def test_one_member_blown_up_keeps_crps_at_least_zero(case):
    runs, truth, scales, _, _ = case(4)
    blown = runs.withColumn("u_x", F.when(F.col("member") == 2, 1e6).otherwise(F.col("u_x")))
    got = evaluate.ensemble_scores(evaluate.align(blown, truth, scales)).collect()
    assert min(r.crps for r in got) >= 0


def test_shape_violations(case):
    runs, truth, _, _, _ = case(3)
    odd = runs.filter("NOT (member = 1 AND lead = 4)").unionByName(
        runs.filter("member = 2 AND lead = 4").withColumn("lead", F.lit(9))
    )
    found = {(r.member, r.missing, r.extra) for r in evaluate.shape_violations(odd, truth).collect()}
    assert found == {(1, 6, 0), (2, 0, 6)}


@pytest.mark.parametrize(
    ("values", "want"),
    [([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 3.0], 2.5), ([1.0, NAN, 2.0], 2.0), ([1.0, NAN, NAN, 2.0], NAN), ([5.0], 5.0)],
)
def test_member_median_counts_nan_as_worst(spark, values, want):
    df = spark.createDataFrame([("a", v) for v in values], "k string, value double")
    got = evaluate.member_median(df, ["k"]).first().value
    assert (math.isnan(got) and math.isnan(want)) or got == want


@pytest.mark.parametrize(
    ("curve", "want"), [([0.1, 0.2, 0.5, 0.1], 2), ([0.1, 0.32], 2), ([NAN, 0.1], 0), ([0.1, NAN, 0.1], 1)]
)
def test_skill_horizon_counts_leading_steps(spark, curve, want):
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(curve)], "k string, lead int, err double")
    assert evaluate.skill_horizon(df, ["k"], "err", 0.32).first().skill_horizon == want


def steps(spark, values, **keys):
    rows = [(*keys.values(), i + 1, float(e), float(w)) for i, (e, w) in enumerate(values)]
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in keys.items())
    return spark.createDataFrame(rows, f"{names}, lead int, energy double, enstrophy double")


@pytest.mark.parametrize(
    ("pred", "stable", "peak"),
    [
        ([(1, 1)] * 10, 10, 1.0),
        ([(1, 1)] * 4 + [(2, 1)] * 6, 10, 2.0),  # the limit itself passes
        ([(1, 1)] * 8 + [(9, 1)] * 2, 8, 9.0),  # the short last block counts in full
        ([(1, 1)] * 4 + [(1, 3)] * 4 + [(1, 1)] * 2, 4, 1.0),
        ([(1, 1)] * 4 + [(NAN, 1)] * 6, 4, NAN),
    ],
)
def test_stability_blocks(spark, pred, stable, peak):
    true = steps(spark, [(1, 1)] * 10, dataset="d")
    run = steps(spark, pred, model="m", dataset="d", member=0)
    got = evaluate.stability(run, true, 4, 2.0).first()
    assert (got.stable_steps, got.forecast_steps) == (stable, 10)
    assert got.energy_peak_ratio == peak or (math.isnan(peak) and math.isnan(got.energy_peak_ratio))


def test_a_rollout_may_be_longer_than_the_truth(spark):
    true = steps(spark, [(1, 1)] * 5, dataset="d")
    run = steps(spark, [(1, 1)] * 12 + [(5, 1)] * 4, model="m", dataset="d", member=0)
    assert evaluate.stability(run, true, 4, 2.0).first().stable_steps == 12


def test_physics_of_a_doubled_field(make_field, make_grid, rng):
    a = rng.normal(size=(40, 2, 6, 5))
    grid = make_grid(["d"], 6, 5)
    shift = lambda f: f.withColumn("lead", F.col("t") + 1).drop("t")
    truth = shift(make_field({"d": a}))
    run = shift(make_field({"d": 2 * a})).withColumns({"model": F.lit("m"), "member": F.lit(0)})
    p, q = evaluate.physics(run, grid, "model", "member"), evaluate.physics(truth, grid)
    scores = {r.metric: r.value for r in evaluate.physics_scores(p, q).collect()}
    assert scores == pytest.approx({"energy_rel_error": 3, "enstrophy_rel_error": 3, "divergence_ratio": 2})
    lsd = evaluate.spectrum_scores(evaluate.line_spectra(run, grid, "model", "member"), evaluate.line_spectra(truth, grid))
    assert [r.value for r in lsd.collect()] == pytest.approx([np.log10(4)] * 2)


def test_drift_has_no_period(spark):
    t = np.arange(100)
    wave = np.sin(2 * np.pi * t / 8)
    def table(v, extra):
        return spark.createDataFrame(
            [(*extra, "d", n, int(i), float(s)) for n in ("u_x", "u_y") for i, s in enumerate(v)],
            ("model string, member int, " if extra else "") + "dataset string, name string, t int, value double",
        )
    scores = lambda v: {r.metric: r.value for r in evaluate.temporal_scores(table(v, ("m", 0)), table(wave, ()), 32).collect()}
    assert math.isnan(scores(t / 10.0)["u_y_period_error"])
    assert math.isnan(scores(np.zeros(100))["u_y_period_error"])
    good = scores(0.5 * wave)
    assert good["u_y_period_error"] == pytest.approx(0, abs=1e-9)
    assert good["u_y_peak_power_ratio"] == pytest.approx(0.25)


def brute_score(skill, crps, stable, n, peak, fraction=0.0, k=1):
    if math.isnan(crps):
        return -math.inf
    if stable < n:
        return stable * (n + 1) + (n / (1 + math.log10(max(peak, 1))) if math.isfinite(peak) else 0)
    return stable * (n + 1) + fraction * (n + 1) * k**2 + skill - (1 if math.isinf(crps) else crps / (1 + crps))


def test_selection_score_cases(spark):
    cases = [(3, 0.2, 10, 10, 1.1), (3, NAN, 10, 10, 1.0), (0, 0.2, 4, 10, 50.0), (0, 0.2, 4, 10, NAN), (2, math.inf, 10, 10, 1.0), (1, 0.3, 0, 10, 0.5)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "skill double, crps double, s double, n double, peak double")
    got = [r[0] for r in df.select(selection.selection_score(F.col("skill"), F.col("crps"), F.col("s"), F.col("n"), F.col("peak"))).collect()]
    assert got == pytest.approx([brute_score(*c) for c in cases])


@pytest.mark.parametrize("pattern", ["SS.S", ".....SS", "S.S.S.S.S", "S", "SSSSSS"])
@pytest.mark.parametrize("neighbors", [0, 1, 2])
def test_run_selection_windows(spark, pattern, neighbors):
    n, size = 10, 2 * neighbors + 1
    rows = [("r", i, 100.0 + (i % 3), 10.0 if c == "S" else 4.0, 10.0, 2.0, 2.0 if c == "S" else 1.0) for i, c in enumerate(pattern)]
    df = spark.createDataFrame(rows, "run string, idx int, selection_score double, stable_steps double, forecast_steps double, members double, stable_members double")
    got = selection.run_selection(df, neighbors).orderBy("idx").collect()
    scores = []
    for i, row in enumerate(rows):
        m = min(size, len(rows))
        start = min(max(i - neighbors, 0), len(rows) - m)
        near = rows[start : start + m]
        fraction = sum(v[6] for v in near) / sum(v[5] for v in near)
        bonus = 0 if neighbors == 0 or row[3] < n else fraction * (n + 1) * (size * 2) ** 2
        scores.append(row[2] + bonus)
        assert got[i].stable_fraction == pytest.approx(fraction)
        assert got[i].settled == (len(rows) >= max(size, i + neighbors + 1))
    assert [r.score for r in got] == pytest.approx(scores)
    assert [r.idx for r in got if r.best] == [int(np.argmax(scores))]


@pytest.mark.parametrize(("broken", "passed"), [(0, True), (1, True), (2, False)])
def test_gate_needs_seven_of_eight_members(spark, broken, passed):
    members = [("m", k, "stable_steps", 4.0 if k < broken else 10.0) for k in range(8)]
    members += [("m", k, "offset", 0.5) for k in range(8)]
    rollouts = spark.createDataFrame([("m", k, 30.0) for k in range(8)], "model string, member int, stable_steps double")
    limits = [("offset", "member_max", 1.0), ("err", "max", 0.3), ("share", "min", 0.8)]
    scores = spark.createDataFrame([("m", "err", 0.3), ("m", "share", 0.8)], "model string, metric string, value double")
    table = spark.createDataFrame(members, "model string, member int, metric string, value double")
    got = selection.gate(scores, table, rollouts, limits, 10, 30).first()
    assert (got.usable, got.passed) == (8 - broken, passed)


def test_gate_fails_missing_and_nan_scores(spark):
    rollouts = spark.createDataFrame([("m", 0, 30.0)], "model string, member int, stable_steps double")
    table = spark.createDataFrame([("m", 0, "stable_steps", 10.0)], "model string, member int, metric string, value double")
    limits = [("err", "max", 0.3), ("share", "min", 0.8), ("gone", "max", 1.0)]
    scores = spark.createDataFrame([("m", "err", NAN), ("m", "share", NAN)], "model string, metric string, value double")
    got = selection.gate(scores, table, rollouts, limits, 10, 30).first()
    assert not got.passed and got.failed_limits == 3 and got.reasons == "max err; max gone; min share"


def test_leaderboard_puts_unscored_trials_last(spark):
    trials = spark.createDataFrame([("a", 0.1, False), ("b", 0.2, True), ("c", 0.3, False)], "trial string, lr double, error boolean")
    reports = spark.createDataFrame([("a", 0, 1.0, 0.5), ("a", 1, 3.0, 1.0), ("a", 2, 2.0, 0.0), ("c", 0, 5.0, 0.2)], "trial string, idx int, score double, stable_fraction double")
    rows = selection.leaderboard(trials, reports, ["lr"]).collect()
    assert [r.trial for r in rows] == ["c", "a", "b"]
    assert (rows[1].best_score, rows[1].stable_fraction, rows[1].last_score, rows[1].validations) == (3.0, 1.0, 2.0, 3)
    assert rows[2].best_score is None and rows[2].error


def as_lines(cells):
    keys = [c for c in cells.columns if c not in ("y", "u_x", "u_y")]
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "u_x", "u_y"))).alias("line"))
    return packed.select(*keys, F.col("line.u_x").alias("u_x"), F.col("line.u_y").alias("u_y"))


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_score_like_cells(case, make_grid, m):
    runs, truth, scales, _, _ = case(m)
    # Along y, two points have no window, and a cell's NaN becomes a NULL on its way: those are left out.
    whole = [evaluate.line_spectra(df, make_grid(["d"], 3, 2, 0.5, 0.25), "model", "member").filter("axis = 'x'") for df in (as_lines(runs), runs)]
    runs = runs.withColumn("u_x", F.when(F.expr("member = 0 AND lead = 2 AND x = 1 AND y = 1"), NAN).otherwise(F.col("u_x")))
    # Two datasets, one of them without a name.
    other = lambda df: df.unionByName(df.withColumns({"dataset": F.lit(None).cast("string"), "u_y": F.col("u_y") * 2}))
    runs, truth, grid = other(runs), other(truth), make_grid(["d"], 3, 2, 0.5, 0.25)
    packed = as_lines(runs), as_lines(truth)

    def same(a, b, keys):
        order = lambda df: sorted((tuple(str(r[k]) for k in keys), r.asDict()) for r in df.collect())
        a, b = order(a), order(b)
        assert a and [k for k, _ in a] == [k for k, _ in b]
        for (_, p), (_, q) in zip(a, b):
            assert p.keys() == q.keys()
            for c in p.keys() - set(keys):
                assert p[c] is None if q[c] is None else p[c] == pytest.approx(q[c], rel=1e-9, abs=1e-12, nan_ok=True), c

    aligned, lines = evaluate.align(runs, truth, scales), evaluate.align(*packed, scales)
    same(evaluate.rmse_per_lead(lines), evaluate.rmse_per_lead(aligned), ["model", "dataset", "member", "lead"])
    same(evaluate.ensemble_scores(lines), evaluate.ensemble_scores(aligned), ["model", "dataset", "lead"])
    physics = [evaluate.physics(df, grid, "model", "member") for df in (packed[0], runs)]
    same(*physics, ["model", "dataset", "member", "lead"])
    same(*whole, ["model", "dataset", "member", "axis", "channel", "k"])
    blown = evaluate.line_spectra(packed[0], grid, "model", "member").filter("axis = 'x' AND channel = 'u_x' AND member = 0").collect()
    assert len(blown) == 4 and all(math.isnan(r.power) for r in blown)  # two datasets, k of 0 and 1


def test_frames_that_span_batches_stay_whole():
    rng = np.random.default_rng(5)
    sizes, widths = [1, 3, 2, 3, 4], [2, 2, 5, 2, 2]
    rows = [(None if g == 0 else f"k{g}", rng.normal(size=w).tolist()) for g, (n, w) in enumerate(zip(sizes, widths)) for _ in range(n)]
    table = pa.table({"k": pa.array([r[0] for r in rows]), "v": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    for size in (1, 2, 5, 100):
        found = {}
        for first, (stack,) in group_stacks(iter(table.to_batches(max_chunksize=size)), ["k"], ["v"]):
            assert len(first) == len(stack)
            found |= {name: part.tolist() for name, part in zip(first["k"].to_pylist(), stack)}
        assert list(found) and found == {k: [v for name, v in rows if name == k] for k, _ in rows}
    uneven = pa.table({"k": ["a", "a"], "v": pa.array([[1.0], [1.0, 2.0]])})
    with pytest.raises(ValueError, match="length"):
        list(group_stacks(iter(uneven.to_batches()), ["k"], ["v"]))


def test_members_of_a_line_are_not_split(case):
    runs, truth, scales, _, _ = case()
    lines = evaluate.ensemble_scores(evaluate.align(as_lines(runs), as_lines(truth), scales))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    # The window asks for whole lines in one partition, so that the runtime cannot split a skewed one under the Arrow sums.
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Window")


def test_forecasts_under_test_move_as_lines(spark, make_field):
    field = make_field({"d00": np.random.default_rng(2).normal(size=(30, 2, 3, 2))})

    class Data:
        lines, catalog, grid = derive.to_lines(field), spark.createDataFrame([("d00", 30)], "dataset string, n_steps int"), None

    run = scoring.ensemble(Data, lines=True)
    assert "y" not in run.columns and run.count() == 4 * 6 * 3  # members, leads, lines of each frame
    cells = type("Cells", (), {"field": field, "catalog": Data.catalog})
    assert run.select(F.sum(F.size("u_x"))).first()[0] == scoring.ensemble(cells).count() == 4 * 6 * 6


def test_run_selection_makes_no_row_per_vote(spark):
    rows = [("a", t, float(t % 3), 10.0, float(t), 4.0, float(t % 5)) for t in range(9)] * 2 + [(None, 0, 1.0, 10.0, 1.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, idx int, selection_score double, forecast_steps double, stable_steps double, members double, stable_members double")
    found = selection.run_selection(df, 2)
    got = found.collect()
    assert len(got) == 18 and {r.run for r in got} == {"a"}  # rows that repeat a key stay, one without a run has no window
    for r in got:
        near = range(r.start, r.start + r.m)
        assert r.stable_fraction == pytest.approx(sum(t % 5 for t in near) / (4 * len(near)))
