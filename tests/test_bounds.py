"""Bounds and missing sides fail or count; they never drop rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.functions import fourier
from gridtide.operators import autocorr, evaluate, linalg, selection, spectra, windows
from gridtide.plans import scoring
from gridtide.sources import adapters


def test_a_wrong_bound_on_lengths_fails(make_series):
    series = make_series({"a": np.arange(10.0), "b": np.arange(30.0) ** 2})
    for run in (spectra.periodogram, autocorr.series_autocorrelation):
        assert run(series, ["name"], longest=30).select("name").distinct().count() == 2
        with pytest.raises(Exception, match="exceeds the bound"):
            run(series, ["name"], longest=20).collect()
    rows = series.withColumn("n", F.lit(30)).withColumn("re", F.col("value")).withColumn("im", F.lit(0.0))
    with pytest.raises(Exception, match="exceeds the bound"):
        fourier.dft(rows.where("name = 'b'"), ["name"], longest=8).collect()


def test_autocorrelation_needs_no_join_of_its_sums(make_series, rng):
    x = rng.normal(size=60)
    got = {r.lag: r.rho for r in autocorr.series_autocorrelation(make_series({"a": x}), ["name"]).collect()}
    v = x - x.mean()
    for lag, rho in got.items():
        assert rho == pytest.approx((v[: 60 - lag] * v[lag:]).sum() / (60 - lag) / v.var(), abs=1e-9)


def test_the_field_is_transformed_once(make_field, rng):
    field = make_field({"a": rng.normal(size=(20, 2, 3, 2))})
    plan = autocorr.field_autocorrelation(field, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_wide_basis_of_two_fits_equals_the_narrow_one(spark, rng):
    mats = {"a": rng.normal(size=(20, 6)), "b": 10 * rng.normal(size=(20, 6))}
    rows = spark.createDataFrame([(k, r.tolist()) for k, m in mats.items() for r in m], "fit string, vec array<double>")
    narrow = linalg.eigenbasis(linalg.gram(rows, ["fit"]), ["fit"], 3)
    wide = linalg.wide_eigenbasis(rows, "fit", 3)
    key = lambda r: (r.fit, r.mode)
    for a, b in zip(sorted(narrow.collect(), key=key), sorted(wide.collect(), key=key), strict=True):
        assert key(a) == key(b) and a.n_values == b.n_values
        assert a.s == pytest.approx(b.s, rel=1e-6) and a.share == pytest.approx(b.share, rel=1e-6)
        np.testing.assert_allclose(a.v, b.v, atol=1e-5)


def test_a_short_dataset_fails(spark):
    catalog = spark.createDataFrame([("a", 10), ("b", 3)], "dataset string, n_steps int")
    assert windows.delay_pairs(catalog, 2).count() == 9
    with pytest.raises(Exception, match="fewer than 5 steps in b"):
        windows.delay_pairs(catalog, 4).collect()


def test_a_member_of_one_side_only_is_broken(spark):
    scores = spark.createDataFrame([("m", "rmse", 0.1)], "model string, metric string, value double")
    members = spark.createDataFrame([("m", k, "stable_steps", 9.0) for k in range(4)], "model string, member int, metric string, value double")
    rollouts = spark.createDataFrame([("m", k, 99.0) for k in (0, 1, 4)], "model string, member int, stable_steps double")
    row = selection.gate(scores, members, rollouts, [], 5, 50, min_fraction=0.5).first()
    assert (row.members, row.usable, row.passed) == (5, 2, False)
    assert "member 2" in row.reasons and "member 4" in row.reasons


def test_rows_beyond_the_fixed_axes_fail(spark, tmp_path):
    columns = "l_suppkey bigint, l_shipdate date, l_discount double, l_tax double, l_quantity double, l_extendedprice double"
    for k, (day, discount) in enumerate((("1994-12-31", 0.1), ("1996-05-01", 0.12))):
        row = spark.sql(f"SELECT 1L, DATE'{day}', {discount}D, 0.0D, 1.0D, 1.0D").toDF(*[c.split()[0] for c in columns.split(", ")])
        row.write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        with pytest.raises(Exception, match="outside"):
            adapters.field(spark, f"{tmp_path}/{k}").collect()
    late = spark.sql("SELECT 'click' AS event_type, 1L AS user_id, 1.0D AS value, TIMESTAMP_NTZ'2024-03-05 00:00:00' AS ts")
    late.write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(Exception, match="outside"):
        adapters.series(spark, str(tmp_path)).collect()


def test_scores_are_grouped_by_role_and_test_datasets_fail(spark):
    roles = spark.createDataFrame([("a", "val"), ("b", "train"), ("c", "test")], "dataset string, role string")
    scored = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "dataset string, n_scored int")
    rows = [("m", d, g, k, v) for d in "ab" for g in ("all", "member_0", "member_1") for k, v in (("stable_steps", 10.0 if g != "member_1" else 4.0), ("rmse_mean", 0.5))]
    schema = "model string, dataset string, grp string, metric string, value double"
    got = {(r.dataset, r.grp, r.metric): r.value for r in evaluate.by_role(spark.createDataFrame(rows, schema), roles, scored).collect()}
    assert {g for _, g, _ in got} == {"val", "val.member_0", "val.member_1", "train.b"}
    assert got["a", "val", "stable_fraction"] == 0.5 and ("b", "train.b", "stable_fraction") not in got
    one = spark.createDataFrame([r for r in rows if r[2] != "member_1"], schema)
    assert {r.grp for r in evaluate.by_role(one, roles, scored).collect()} == {"val", "train.b"}
    bad = spark.createDataFrame([*rows, ("m", "c", "all", "rmse_mean", 1.0)], schema)
    with pytest.raises(Exception, match="not a validation or training dataset: c"):
        evaluate.by_role(bad, roles, scored).collect()


def items(spark, path, rows):
    columns = "l_suppkey bigint, l_shipdate date, l_discount double, l_tax double, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_field_is_made_without_a_join(spark, tmp_path):
    day = datetime.date(1995, 2, 3)
    sf = items(spark, tmp_path, [(1, day, 0.1, 0.0, 4.0, 1.0), (1, day, 0.1, 0.0, None, 3.0), (1, day, None, 0.0, 9.0, 9.0), (None, day, 0.1, 0.0, 5.0, 5.0)])
    field = adapters.field(spark, sf)
    assert "Join" not in field._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.dataset, r.t, r.x, r.y): (r.u_x, r.u_y) for r in field.collect()}
    assert len(got) == 2 * 2 * 99 and got["d000000", 1, 10, 0] == (2.0, 400 / 2 / adapters.CENTS_PER_UNIT)
    # Items without a dataset have frames of their own, all zero, as their keys meet nothing.
    assert {v for k, v in got.items() if k != ("d000000", 1, 10, 0)} == {(0.0, 0.0)}


def test_cells_meet_without_a_broadcast(spark, tmp_path, make_field):
    # Repeated frames are small as files, whatever the number of their rows.
    cells = make_field({"a": np.ones((3, 2, 2, 2))}).withColumnRenamed("t", "lead").withColumns({"model": F.lit("m"), "member": F.lit(0)})
    cells.write.parquet(f"{tmp_path}/cells")
    stored = spark.read.schema(cells.schema).parquet(f"{tmp_path}/cells")
    scales = spark.createDataFrame([(1.0, 1.0)], "s_u_x double, s_u_y double")
    for table in (evaluate.shape_violations(stored, stored), evaluate.parity(stored, stored, stored, 0.1), evaluate.rmse_per_lead(evaluate.align(stored, stored, scales))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        cell = [line for line in plan.splitlines() if "Join [dataset" in line and "lead" in line]
        assert cell and all("SortMergeJoin" in line for line in cell)


def test_ensembles_repeat_the_year(spark, tmp_path):
    days = [(datetime.date(1995 + t // 12, t % 12 + 1, 1), t) for t in (*range(24), 39)]
    data = adapters.Tables(spark, items(spark, tmp_path, [(1, d, 0.0, 0.0, 1.0 + t, 1.0) for d, t in days]))
    for n_steps, last in ((None, 16), (30, 30)):
        run = scoring.ensemble(data, n_steps)
        got = {(r.member, r.lead): r.u_x for r in run.filter("x = 0 AND y = 0").collect()}
        assert got == {(m, k): 1.0 + 12 - m + (k - 1) % 12 for m in range(4) for k in range(1, last + 1)}
        joined = [line for line in run._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joined and not any(" t#" in line or "(t#" in line for line in joined)  # by dataset only, never a table of all leads


def test_lengths_of_many_series_are_not_broadcast(spark, make_series, monkeypatch):
    series = make_series({"a": np.arange(10.0), "b": np.arange(16.0) ** 2})
    few = spectra.segments(series, ["name"], 4, 2)
    monkeypatch.setattr(spectra, "MANY_SERIES", 1)
    many = spectra.segments(series, ["name"], 4, 2)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 4 + 7


def test_rollouts_move_frames_before_they_are_repeated(spark, tmp_path):
    rng = np.random.default_rng(3)
    days = [(datetime.date(1995 + t // 12, t % 12 + 1, 1), t) for t in range(30)]
    rows = [(1, d, x / 100, y / 100, float(rng.integers(1, 50)), 100.0 + t) for d, t in days for x in range(3) for y in range(3)]
    data = adapters.Tables(spark, items(spark, tmp_path, rows))
    dealt = evaluate.physics(scoring.ensemble(data, 30, 8), data.grid, "model", "member", "origin", dealt=True)
    exchanges = [line for line in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("lead" in line or "member" in line for line in exchanges)
    plain = evaluate.physics(scoring.ensemble(data, 30), data.grid, "model", "member")
    key = lambda r: (r.member, r.lead)
    a, b = sorted(dealt.drop("origin").collect(), key=key), sorted(plain.collect(), key=key)
    assert len(a) == 4 * 30 and list(map(key, a)) == list(map(key, b))
    for p, q in zip(a, b):
        assert (p.energy, p.enstrophy, p.mean_u_x) == pytest.approx((q.energy, q.enstrophy, q.mean_u_x), rel=1e-12)
