"""What the sieve of operator 8 spares, and that no link is lost by it."""

import numpy as np
import pytest

import corpus_pipeline
from gridtide.llm import common, partenum_join
from tests.llm.test_search import brute_components


def test_texts_with_a_passage_in_common_are_no_cluster(spark, make_docs, text_of, monkeypatch):
    kept, stored = {}, partenum_join.stored

    def record(df, label):
        kept[label] = stored(df, label)
        return kept[label]

    monkeypatch.setattr(partenum_join, "stored", record)
    rng = np.random.default_rng(21)
    passage = text_of(rng, 60)
    texts = [f"{passage} {text_of(rng, 60)}" for _ in range(60)]
    texts.append(texts[3] + " end")
    got = {r.doc_id: r.component_id for r in partenum_join.join(make_docs(enumerate(texts)), 5, 800).collect()}
    assert [got[i] for i in range(61)] == brute_components(texts, 5, 800)[1]
    assert "signs" not in kept["sets"].columns
    assert kept["groups"].count() > 2 and kept["clusters"].count() == 2


def changed(rng, a, drop, add):
    return np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))


def test_sketches_lie_no_farther_apart_than_their_sets():
    rng = np.random.default_rng(22)
    for size in (1, 3, 60, 64, 65, 127, 130, 500, 1025, 40_000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for b in (a, changed(rng, a, size // 10, size // 10), changed(rng, a, 0, size // 4 + 1), changed(rng, a, size, size + 1)):
            raw = [partenum_join.sketch(x).tobytes() for x in (a, b)]
            far = partenum_join._Sketches(raw).far(np.array([0, 1]), np.array([1, 0]))
            assert far[0] == far[1] <= len(np.setxor1d(a, b))
            assert far[0] > 0 or len(np.setxor1d(a, b)) == 0 or size < 5


def test_rows_that_may_be_linked_are_joined():
    rng = np.random.default_rng(23)
    sets, group = [], []
    for g, (families, members) in enumerate([(1, 2), (5, 1), (4, 6), (1, 40), (30, 2), (1, 1)]):
        own = []
        for _ in range(families):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(30, 300)), dtype=np.uint64))
            own += [a, *(changed(rng, a, len(a) // 20, len(a) // 20) for _ in range(members - 1))]
        sets += [own[i] for i in rng.permutation(len(own))]
        group += [g] * len(own)
    joins = partenum_join.near_rows(np.array(group), np.array([len(s) for s in sets]), [partenum_join.sketch(s).tobytes() for s in sets], 800)
    label = list(range(len(sets)))
    for i, j in joins:
        assert group[i] == group[j] and label[i] != label[j]
        label = [label[i] if x == label[j] else x for x in label]
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if group[i] == group[j] and 1000 * both >= 800 * (len(a) + len(sets[j]) - both):
                linked += 1
                assert label[i] == label[j]
    assert linked > 100 and len(set(label)) >= 35


@pytest.fixture
def no_broadcast(spark):
    """Tables are too large to be broadcast, unless a query asks for it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def texts_moved(plan):
    """Rows with a text that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return texts_moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return texts_moved(plan.plan())
    columns, below = ([x.apply(i) for i in range(x.size())] for x in (plan.output(), plan.children()))
    own = kind == "ShuffleExchangeExec" and any(c.name() in ("text", "body") for c in columns)
    return sum(map(texts_moved, below)) + (plan.metrics().apply("shuffleRecordsWritten").value() if own else 0)


def test_only_texts_that_may_be_copies_are_moved(spark, make_docs, text_of, no_broadcast, monkeypatch):
    moved = []

    def run(df):
        rows = df.collect()
        moved.append(texts_moved(df._jdf.queryExecution().executedPlan()))
        return rows

    stored = common.stored

    def record(df, label):
        run(df)
        return stored(df, label)

    for module in (partenum_join, corpus_pipeline):
        monkeypatch.setattr(module, "stored", record)
    rng = np.random.default_rng(24)
    rows = [(i, text_of(rng, 40)) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)] + [(2000, rows[9][1]), (20, rows[20][1])]
    got = run(corpus_pipeline.near_copies(spark, make_docs(rows, clashing=False), ""))
    assert sorted(r.doc_id for r in got) == list(range(400))
    # Of five pairs both texts, for a class, a cluster and its comparison, and seven rows that go or stay by the marks.
    assert 0 < sum(moved) <= 80


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_a_sieve_misses_no_key_and_joins_stay_exact(spark, make_docs, text_of, no_broadcast, monkeypatch, words):
    monkeypatch.setattr(common, "SIEVE", words)
    rows = spark.createDataFrame([(i, str(i)) if i % 50 else (None, None) for i in range(1000)], "a bigint, b string")
    keys = spark.createDataFrame([(i, str(i)) for i in range(0, 1000, 7)] + [(3, "no"), (None, None)], "a bigint, b string")
    for on in (["a"], ["a", "b"]):
        flagged = common.maybe_in(rows, keys, *on)
        assert flagged.count() == 1000 and flagged.columns == ["a", "b", "maybe"]
        assert flagged.where("not maybe").join(keys, on, "left_semi").count() == 0 and flagged.where("maybe is null").count() == 0
        assert words == 1 or flagged.where("maybe").count() < 200
    assert common.maybe_in(rows, keys.limit(0), "a").where("maybe").count() == 0
    rng = np.random.default_rng(25)
    one, two, three, four = (text_of(rng, 40) for _ in range(4))
    docs = [(1, one), (5, one), (5, two), (7, three), (8, three + " end"), (9, four), (9, four), (9, four + " more and more"), (None, one), (None, one)]
    docs += [(None, None), (3, None), (3, None), (4, ""), (4, ""), (6, "")] + [(100 + i, text_of(rng, 30)) for i in range(200)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, make_docs(docs, clashing=False), "").collect()]
    nine = [r for r in got if r[0] == 9]
    assert len(nine) == 1
    want = [(1, one), (5, two), (7, three), (None, one), (None, one), (None, None), (3, None), (3, None), (4, ""), (6, ""), *docs[16:]]
    assert sorted([r for r in got if r[0] != 9], key=str) == sorted(want, key=str)
