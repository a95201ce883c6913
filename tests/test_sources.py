"""Array files by URI, digests, quantiles of heavy tails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.functions import layout
from gridtide.sources import arrays, store


def as_arrays(lines):
    out = {}
    for r in lines.collect():
        out.setdefault(r.dataset, {})[r.t, r.x] = (r.u_x, r.u_y)
    return out


def test_array_files_by_uri_in_slices(spark, make_field, tmp_path, rng):
    field = {"a": rng.normal(size=(7, 2, 3, 4)), "b": rng.normal(size=(3, 2, 3, 4))}
    uri = f"file://{tmp_path}/arrays"
    arrays.write_arrays(make_field(field), uri, 5)
    assert sorted(p.name for p in (tmp_path / "arrays").glob("*.npy")) == ["a@0.npy", "a@5.npy", "b@0.npy"]
    np.testing.assert_array_equal(np.load(tmp_path / "arrays/a@5.npy"), field["a"][5:])
    assert not (tmp_path / "arrays/_temporary").exists() or not list((tmp_path / "arrays/_temporary").iterdir())
    lines = arrays.read_arrays(spark, uri, 2)
    assert lines.rdd.getNumPartitions() == 3 + 1 + 2
    got = as_arrays(lines)
    for name, a in field.items():
        assert set(got[name]) == {(t, x) for t in range(len(a)) for x in range(3)}
        for (t, x), (u_x, u_y) in got[name].items():
            np.testing.assert_array_equal([u_x, u_y], a[t, :, x])
    # Overwriting with longer parts leaves none of the former files, appending leaves them.
    arrays.write_arrays(make_field({"b": field["b"]}), uri, 2)
    assert len(list((tmp_path / "arrays").glob("*.npy"))) == 4
    arrays.write_arrays(make_field(field), uri, 100, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "arrays").glob("*.npy")) == ["a@0.npy", "b@0.npy"]


def test_kinds_of_array_files(spark, tmp_path, rng):
    a = rng.normal(size=(4, 2, 2, 3))
    np.save(tmp_path / "f4.npy", a.astype("<f4"))
    np.save(tmp_path / "big.npy", a.astype(">f8"))
    np.save(tmp_path / "none.npy", a[:0])
    got = as_arrays(arrays.read_arrays(spark, str(tmp_path)))
    assert set(got) == {"f4", "big"}
    np.testing.assert_allclose(got["f4"][3, 1][0], a[3, 0, 1], rtol=1e-6)
    np.testing.assert_array_equal(got["big"][2, 0][1], a[2, 1, 0])
    np.save(tmp_path / "wrong.npy", a[0])
    with pytest.raises(Exception, match="expected .T, 2, X, Y."):
        arrays.read_arrays(spark, str(tmp_path)).collect()
    np.save(tmp_path / "wrong.npy", np.asfortranarray(a))
    with pytest.raises(Exception, match="Fortran"):
        arrays.read_arrays(spark, str(tmp_path)).collect()


def test_a_failed_or_repeated_write_leaves_whole_files(spark, make_field, tmp_path, rng):
    a = rng.normal(size=(6, 2, 3, 2))
    holes = make_field({"good": a, "holes": a}).filter("not (dataset = 'holes' and t = 4 and x = 1 and y = 1)")
    with pytest.raises(Exception, match="cells"):
        arrays.write_arrays(holes, f"file://{tmp_path}/out", 6)
    assert not list((tmp_path / "out").rglob("*.npy"))
    # Two attempts of one task: both write all, the commit takes one of them.
    writer = arrays._Writer(str(tmp_path / "twice"), False)
    (tmp_path / "twice").mkdir()
    made = []
    for attempt in (1, 2):
        own = tmp_path / f"twice/_temporary/{writer.job}/0-{attempt}"
        own.mkdir(parents=True)
        np.save(own / "a@0.npy", a)
        made.append(arrays._Written([(str(own / "a@0.npy"), str(tmp_path / "twice/a@0.npy"))]))
    writer.commit([made[1], None])
    np.testing.assert_array_equal(np.load(tmp_path / "twice/a@0.npy"), a)
    assert [p.name for p in (tmp_path / "twice").rglob("*.npy")] == ["a@0.npy"]


def test_digest_tells_fields_and_nulls_apart(spark):
    digest = lambda *row: store.table_digest(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().digest
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a", "-"), ("a", ""), ("1:a", ""), ("", "1:a"), ("~", "~"), (None, None)]
    assert len({digest(*r) for r in rows}) == len(rows)


@pytest.mark.parametrize("small", [32, 1 << 16])
def test_quantiles_of_any_tails(spark, rng, small):
    parts = {
        "normal": rng.normal(size=500), "outlier": np.append(rng.normal(size=300), [1e300, -1e300]), "wide": 10.0 ** rng.uniform(-300, 300, 400),
        "extremes": np.append(rng.uniform(-1, 1, 200), [1.7e308, -1.7e308]), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([4.0]), "same": np.full(50, -2.5),
    }
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(k, float(v)) for k, x in parts.items() for v in x], "k string, v double")
    got = {(r.k, r.prob): r.quantile for r in layout.exact_quantiles(df, ["k"], "v", probs, buckets=64, small=small).collect()}
    for k, x in parts.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(x, p), rel=1e-9, abs=1e-12), (k, p)


def test_an_outlier_does_not_gather_the_rest(spark, rng):
    values = [("a", float(v)) for v in rng.normal(size=2000)] + [("a", 1e300)]
    df = spark.createDataFrame(values, "k string, v double")
    seen = []
    plain = layout.measured

    def note(df, label):
        out = plain(df, label)
        if label == "ranges":
            seen.append(out.count())
        return out

    layout.measured, kept = note, plain
    try:
        found = layout.exact_quantiles(df, ["k"], "v", [0.5], buckets=64, small=100).first().quantile
    finally:
        layout.measured = kept
    assert found == pytest.approx(np.median([v for _, v in values])) and 1 <= len(seen) <= 3


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert layout.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert layout.exact_quantiles(df.filter(F.lit(False)), ["k"], "v", [0.5]).count() == 0


def test_slices_are_dealt_over_tasks(spark, tmp_path, rng):
    for k in range(9):
        np.save(tmp_path / f"d{k}.npy", rng.normal(size=(4, 2, 3, 2)))
    paths = spark.createDataFrame([(f"{tmp_path}/d{k}.npy",) for k in range(9)], "path string").coalesce(1)
    lines = store.ingest_arrays(paths, 2)
    # 18 slices, a few bytes each, were merged into one task.
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert lines.count() == 9 * 4 * 3


def test_small_slices_share_a_task():
    slices = [(arrays.Slice(f"f{k}", "d", 0, 0, 2), 64) for k in range(4000)]
    parts = arrays.packed(slices)
    assert arrays.TASKS <= len(parts) <= 2 * arrays.TASKS and [s for p in parts for s in p.slices] == [s for s, _ in slices]
    large = arrays.packed([(s, arrays.TASK_BYTES + 1) for s, _ in slices[:5]])
    assert [len(p.slices) for p in large] == [1] * 5
    assert arrays.packed([]) == []
