"""Block products, tree sums and wide eigenbases against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import linalg, modal


def table(spark, mats, key="fit"):
    return spark.createDataFrame([(k, i, r.tolist()) for k, m in mats.items() for i, r in enumerate(m)], f"{key} string, i bigint, vec array<double>")


def test_sums_of_arrays_cross_batches_and_keys(spark, rng):
    rows = [(f"k{i % 3}", None if i % 3 == 2 else i % 3, rng.normal(size=3 + i % 3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, v array<double>").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.a, r.b): r.v for r in linalg.sum_arrays(df, ["a", "b"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 3
    for k in range(3):
        np.testing.assert_allclose(got[f"k{k}", None if k == 2 else k], np.sum([r[2] for r in rows[k::3]], axis=0))


def test_a_gram_over_many_partitions_is_summed_up_a_tree(spark, rng, monkeypatch):
    a = rng.normal(size=(400, 5))
    monkeypatch.setattr(linalg, "TILE_ENTRIES", 10)
    monkeypatch.setattr(linalg, "FAN", 4)
    grams = linalg.gram(table(spark, {"a": a}).repartition(200), ["fit"])
    rows = sorted(grams.collect(), key=lambda r: r.i)
    np.testing.assert_allclose([r.row for r in rows], a.T @ a)
    # Two levels of sums behind the partial ones, and no group that sees every partition.
    plan = grams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("slab", [2, 3, 1024])
def test_block_product_equals_the_matrix_product(spark, rng, monkeypatch, slab):
    monkeypatch.setattr(linalg, "SLAB", slab)
    mats = {"a": rng.normal(size=(30, 7)), "b": rng.normal(size=(20, 7))}
    weights = {"a": rng.normal(size=(4, 7)), "b": rng.normal(size=(2, 7)), "c": rng.normal(size=(2, 7))}
    w = spark.createDataFrame([(k, m, r.tolist()) for k, x in weights.items() for m, r in enumerate(x)][::-1], "fit string, mode int, w array<double>")
    rows = table(spark, mats)
    got = linalg.project(rows, ["fit"], [F.col("i") % 3], ["i"], w)
    for k in mats:
        found = got.filter(F.col("fit") == k).orderBy("i").collect()
        np.testing.assert_allclose([r.coef for r in found], mats[k] @ weights[k].T)
    whole = linalg.project(rows, ["fit"], [F.col("i") % 3], ["i"], w, whole=True)
    assert sorted((r.fit, r.i) for r in whole.collect()) == sorted((k, i) for k in mats for i in range(len(mats[k])))


def test_no_weights_lie_in_the_rows_of_a_tile(spark, rng):
    rows = table(spark, {"a": rng.normal(size=(8, 3))})
    w = rows.select("fit", F.col("i").cast("int").alias("mode"), F.col("vec").alias("w"))
    plan = linalg.project(rows, ["fit"], [F.col("i")], ["i"], w)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "collect_list" not in plan
    # The left side of the products carries its own slab only.
    left = plan.split("FlatMapCoGroupsInArrow")[1]
    assert "explode" in left


def decaying(rng, n, width, rate=0.7):
    u, _ = np.linalg.qr(rng.normal(size=(n, min(n, width))))
    v, _ = np.linalg.qr(rng.normal(size=(width, min(n, width))))
    return (u * 100 * rate ** np.arange(min(n, width))) @ v.T


def test_a_wide_basis_in_slabs_equals_the_narrow_one(spark, rng, monkeypatch):
    monkeypatch.setattr(linalg, "SLAB", 16)
    monkeypatch.setattr(linalg, "TILE_ROWS", 8)
    monkeypatch.setattr(linalg, "FAN", 3)
    mats = {"a": decaying(rng, 60, 100), "b": decaying(rng, 25, 70, 0.5), "zero": np.zeros((9, 40))}
    rows = table(spark, mats).drop("i").repartition(5)
    found = linalg.wide_eigenbasis(rows, "fit", 6).collect()
    assert {r.fit for r in found} == {"a", "b"}
    for k in "ab":
        got = sorted((r for r in found if r.fit == k), key=lambda r: r.mode)
        u, s, vt = np.linalg.svd(mats[k], full_matrices=False)
        assert [r.mode for r in got] == list(range(6)) and {r.n_values for r in got} == {mats[k].shape[1]}
        np.testing.assert_allclose([r.s for r in got], s[:6], rtol=1e-9)
        np.testing.assert_allclose([r.share for r in got], s[:6] ** 2 / (s**2).sum(), rtol=1e-9)
        vectors = np.array([r.v for r in got])
        np.testing.assert_allclose(np.abs(np.sum(vectors * vt[:6], axis=1)), 1, atol=1e-9)
        assert all(v[np.argmax(np.abs(v))] > 0 for v in vectors)


def test_wide_pod_and_dmd_equal_the_narrow_ones(spark, make_field, rng, monkeypatch):
    t, x, y = np.meshgrid(np.arange(40), np.arange(6), np.arange(4), indexing="ij")
    u = np.exp(-0.02 * t) * np.cos(np.pi * x / 3 - np.pi * t / 4) + 0.3 * np.cos(np.pi * t / 10) * np.sin(y)
    field = make_field({"d": np.stack([u, 0.5 * u * np.cos(y)], axis=1)})
    rows = modal.cell_rows(field)
    narrow, dmd = modal.pod_factors(rows, 4).collect(), modal.exact_dmd(rows, 4)
    monkeypatch.setattr(modal, "MAX_WIDTH", 16)
    monkeypatch.setattr(linalg, "SLAB", 8)
    monkeypatch.setattr(modal, "SLAB", 8)
    with pytest.raises(ValueError, match="give a rank"):
        modal.pod_factors(rows, n_frames=40)
    wide = modal.pod_factors(rows, 4, n_frames=40).collect()
    for a, b in zip(sorted(narrow, key=lambda r: r.mode), sorted(wide, key=lambda r: r.mode), strict=True):
        assert (a.s, a.share, a.n_values) == pytest.approx((b.s, b.share, b.n_values), rel=1e-7)
        np.testing.assert_allclose(a.v, b.v, atol=1e-6)
    other = modal.exact_dmd(rows, 4, n_frames=40)
    by = lambda df: sorted(df.collect(), key=lambda r: (round(r.lam_re, 6), round(r.lam_im, 6)))
    for a, b in zip(by(dmd), by(other), strict=True):
        assert (a.lam_re, a.lam_im) == pytest.approx((b.lam_re, b.lam_im), abs=1e-6)
        assert a.energy_fraction == pytest.approx(b.energy_fraction)
        power = lambda r: np.hypot(r.amp_re, r.amp_im) * r.norm
        assert power(a) == pytest.approx(power(b), rel=1e-5)
    # A mode's course does not depend on its scale.
    for found in (dmd, other):
        top = modal.dominant_dmd_modes(found, spark.createDataFrame([("d", 40)], "dataset string, n_steps int"), 1).first()
        course = modal.mode_evolution(modal.dmd_modes(rows, found), found, top.mode, 40, False).filter("x = 2 AND y = 1 AND channel = 'u_x'")
        values = [r.value for r in course.orderBy("t").collect()]
        if found is dmd:
            first = values
    np.testing.assert_allclose(values, first, atol=1e-5)


def test_a_subset_of_modes_is_rebuilt_from_these_alone(spark, make_field, rng, monkeypatch):
    monkeypatch.setattr(modal, "FRAMES_PER_TILE", 8)
    a = rng.normal(size=(30, 2, 3, 2))
    rows = modal.cell_rows(make_field({"d": a}))
    factors = modal.pod_factors(rows)
    modes = modal.pod_modes(rows, factors)
    flat = (a - a.mean(axis=0)).reshape(30, -1)
    u, s, vt = np.linalg.svd(flat, full_matrices=False)
    for chosen in ([0, 3], [2, 99], None):
        got = modal.reconstruct(modes, factors, chosen).orderBy("t", "channel", "x", "y").collect()
        pick = [k for k in (range(len(s)) if chosen is None else chosen) if k < len(s) and s[k] > 1e-6]
        np.testing.assert_allclose(np.array([r.value for r in got]).reshape(30, -1), (u[:, pick] * s[pick]) @ vt[pick], atol=1e-8)


def test_a_batch_of_tiles_is_bounded(spark, rng):
    """Ten thousand rows come to a task at once, so a tile is a few kB, and the matrix is still whole."""
    for width in (2, 84, 600):
        assert linalg._tile_rows(width) * width * 8 * 10_000 <= 100 << 20
    a = rng.normal(size=(30, 84))
    rows = spark.createDataFrame([("d", r.tolist()) for r in a], "dataset string, vec array<double>")
    got = {r.i: r.row for r in linalg.gram(rows, ["dataset"]).collect()}
    np.testing.assert_allclose([got[i] for i in range(84)], a.T @ a, rtol=1e-9, atol=1e-9)


def test_many_small_groups_are_spread(spark, rng):
    # By their bytes all groups would share one task.
    df = table(spark, {f"k{i:02d}": rng.normal(size=(4, 3)) for i in range(40)})
    factors = linalg.eigenbasis(linalg.gram(df, ["fit"]), ["fit"])
    assert factors.select("fit", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count() > 1
    weights = factors.select("fit", "mode", F.col("v").alias("w"))
    product = linalg.project(df, ["fit"], [F.floor(F.col("i") / 2)], ["i"], weights, whole=True)
    assert product.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and product.count() == 160
