"""Operators 1, 4, 9 and 10: held-out accuracy on the tables, brute force of their algebra, odd inputs."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridtide.llm import language_crf, pseudo_likelihood, quality_gam, queries, toxicity_kernel

SF = "/root/testdata/sf0.01"


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    n, k = 7, 3
    emission, move, first = rng.normal(size=(n, k)), np.exp(rng.normal(size=(k, k))), np.exp(rng.normal(size=k))
    reset = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.prod([np.exp(emission[i, y]) * (first[y] if reset[i] else move[path[i - 1], y]) for i, y in enumerate(path)])
        for i, y in enumerate(path):
            want[i, y] += p
    got = language_crf.forward_backward(emission, reset, move, first)[2]
    np.testing.assert_allclose(got, want / want.sum(1, keepdims=True), rtol=1e-9)


def test_chunks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    args = rng.normal(size=(1000, 4)), rng.random(1000) < 0.01, np.exp(rng.normal(size=(4, 4))), np.ones(4)
    args[1][0] = True
    whole = language_crf.forward_backward(*args)[2]
    monkeypatch.setattr(language_crf, "CHUNK", 37)
    np.testing.assert_allclose(language_crf.forward_backward(*args)[2], whole, rtol=1e-8)


def test_language_of_held_out_documents_and_spans(spark):
    rows = queries.op1_language_crf(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == 1000 and 0.15 < len(held) / len(rows) < 0.35
    assert (held.lang == held.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()


def test_language_of_odd_texts(spark, make_docs, odd_texts):
    model = language_crf.train(["the cat sat on the mat and the dog"] * 30 + ["der hund und die katze sind nicht da"] * 30, ["en"] * 30 + ["de"] * 30)
    got = {r.doc_id: r for r in language_crf.predict(make_docs(enumerate(odd_texts)), model, spans=True).collect()}
    for i, t in enumerate(odd_texts):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not letters) and 0 <= got[i].score <= 1
        assert (got[i].score == 0) == (not letters) and bool(got[i].spans) == letters
    mixed = model.spans(["the dog and the cat. der hund und die katze"])[0]
    assert [s[2] for s in mixed] == ["en", "de"] and mixed[0][0] == 0
    assert language_crf.predict(make_docs([]), model).count() == 0
    untrained = language_crf.fit(make_docs([(1, None)]))
    assert language_crf.predict(make_docs([(1, "hello"), (2, None)]), untrained).collect()[0].lang_pred == "und"


def test_quality_of_held_out_documents(spark):
    rows = queries.op4_quality_gam(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_quality_tables_add_up():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can tell
    model = quality_gam.train(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    total = model.intercept + sum(t[np.searchsorted(e, x[7, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
        total += t[tuple(np.searchsorted(model.pair_edges[c], x[7, c], side="right") for c in (a, b))]
    assert model.logit(x[7:8])[0] == pytest.approx(total)


def test_quality_measures_of_a_known_text():
    got = dict(zip(quality_gam.MEASURES, quality_gam.measures(["Ab cd.\nAb cd.\nx ## 1"])[0], strict=True))
    assert got["log_words"] == pytest.approx(np.log1p(7)) and got["log_lines"] == pytest.approx(np.log1p(3))
    assert got["line_copies"] == pytest.approx(1 / 3) and got["word_copies"] == pytest.approx(2 / 7)
    assert got["top_word"] == pytest.approx(2 / 7) and got["symbols"] == pytest.approx(2 / 20)


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_take_odd_texts_and_empty_tables(spark, make_docs, odd_texts, name):
    module = quality_gam if name == "quality" else toxicity_kernel
    docs = make_docs(enumerate(odd_texts))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(odd_texts))] + [(3, 0), (None, 1), (4, None), (999, 1)], f"doc_id bigint, {name} int")
    for some in (labels, labels.where("false"), labels.where(f"{name} = 1")):
        rows = module.score(docs, module.fit(docs, some)).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(odd_texts)))
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[5] == same[6] and same[9] == same[10] and same[0] == same[1]
    assert module.score(docs.where("false"), module.fit(docs, labels)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    rows = queries.op10_toxicity_kernel(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    clean, toxic = rows[rows.toxic == 0], rows[rows.toxic == 1]
    assert clean.predicted.mean() < 0.02 and toxic.predicted.mean() > 0.7
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_folded_weights_equal_the_kernel_expansion():
    def subsequences(word):
        word, found = f" {word} ", {}
        for shape in toxicity_kernel.SHAPES:
            for i in range(len(word) - shape[-1]):
                key = word[i] + "".join(word[i + s] for s in shape)
                found[key] = found.get(key, 0) + toxicity_kernel.DECAY ** (shape[-1] - len(shape))
        return found

    def kernel(a, b):
        x, y = subsequences(a), subsequences(b)
        size = toxicity_kernel.size_of(np.array([len(a), len(b)]))
        return sum(v * y.get(k, 0) for k, v in x.items()) / size[0] / size[1]

    marks, words = ["idiot", "stupid", "other"], ["idiot", "id-iot", "stupids", "nothing", "tidio"]
    letters = sorted({" ", *"".join(marks + words)})
    model = toxicity_kernel.Model(np.array([ord(c) for c in letters]), None, np.zeros(0), 0.0, 1.0, 0.0)
    sign, radix = model.table, len(letters) + 1
    t = toxicity_kernel.Tokens([w + "\n" for w in marks])
    found = list(toxicity_kernel.subsequences(t, sign, None, radix))
    known = toxicity_kernel.Known(np.concatenate([c for _, c, _ in found]), radix)
    basis = np.zeros((len(marks), len(known.codes)))
    for places, code, decay in found:
        np.add.at(basis, (np.searchsorted(t.stop, places, side="right"), np.searchsorted(known.codes, code)), decay)
    basis /= toxicity_kernel.size_of(t.stop - t.start)[:, None]
    got = toxicity_kernel.kernel_rows(words, sign, known, basis)
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)
    beta = np.array([1.0, -2.0, 0.5])
    model.known, model.weight = known, basis.T @ beta
    np.testing.assert_allclose(model.tokens(toxicity_kernel.Tokens([" ".join(words)]), sign), want @ beta, rtol=1e-5, atol=1e-6)


def test_tokens_join_single_signs_and_shorten_runs():
    t = toxicity_kernel.Tokens(["so s t u p i d", "stuuuupid  a", "a"])
    assert t.strings() == ["so", "stupid", "stuupid", "a", "a"] and t.row.tolist() == [0, 0, 1, 1, 2]


def test_gradient_step_raises_the_likelihood_and_pieces_average(spark, make_docs, text_of):
    rng = np.random.default_rng(8)
    docs = make_docs([(i, text_of(rng, 300)) for i in range(60)] + [(60, None), (61, "")]).repartition(5)
    words, network = pseudo_likelihood.fit(docs)
    counts = {}
    for r in docs.where("text is not null").collect():
        for w in r.text.split():
            counts[w] = counts.get(w, 0) + 1
    assert len(words) == len(counts)
    trained, fresh = (pseudo_likelihood.score(docs, words, n).toPandas().set_index("doc_id") for n in (network, pseudo_likelihood.Network.fresh()))
    assert trained.log_prob.sum() > fresh.log_prob.sum()
    assert trained.n_words[60] == 0 and trained.log_prob[60] == 0 and np.isnan(trained.mean_log_prob[61])


def test_probabilities_sum_to_one_and_scores_add_up():
    net = pseudo_likelihood.Network.fresh()
    near = np.array([[1], [2], [3], [pseudo_likelihood.SIZE]])
    every = np.arange(pseudo_likelihood.SIZE)
    assert np.exp(net.log_probabilities(every, np.repeat(near, len(every), 1)).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    rows = pa.array(["one two three", "", "four"])
    found = pseudo_likelihood.Bytes(rows, pseudo_likelihood.word_bytes())
    word, around = pseudo_likelihood.windows(found, pseudo_likelihood.Numbers(np.unique(found.hash)))
    assert around[:, 0].tolist() == [4096, 4096, word[1], word[2]] and (around[:, 3] == 4096).all()
    assert pseudo_likelihood.Network.of(net.flat()).flat().tolist() == net.flat().tolist()


def test_rare_words_have_their_own_probability(spark, make_docs):
    common = [" ".join(f"common{i}" for i in range(k, k + 400)) for k in range(0, 3600, 400)] * 9
    times = {f"rare{i}": 1 + i % 4 for i in range(900)}
    singles = [w for w, n in times.items() for _ in range(n)]
    docs = make_docs(enumerate(common + singles)).repartition(3)
    words, network = pseudo_likelihood.fit(docs)
    got = pseudo_likelihood.score(docs, words, network).toPandas().set_index("doc_id").log_prob
    own = {w: got[len(common) + i] for i, w in enumerate(singles)}
    found = pseudo_likelihood.Bytes(pa.array(list(times)), pseudo_likelihood.word_bytes())
    number, near = pseudo_likelihood.windows(found, pseudo_likelihood.Numbers(words))
    entry = network.log_probabilities(number, near)
    everything = {f"common{i}": 9 for i in range(3600)} | times
    spelled = pseudo_likelihood.Bytes(pa.array(list(everything)), pseudo_likelihood.word_bytes()).hash
    total = np.bincount(pseudo_likelihood.Numbers(words)(spelled), list(everything.values()), pseudo_likelihood.SIZE)
    for w, e, n in zip(times, entry, number, strict=True):
        assert n >= pseudo_likelihood.SIZE - pseudo_likelihood.OTHERS
        assert own[w] == pytest.approx(e + np.log(times[w] / total[n]), abs=1e-4)
    again = pseudo_likelihood.score(make_docs([(1, "rare7"), (2, "rare8"), (3, None)]), words, network, counts=pseudo_likelihood.count_words(docs, "text"))
    assert {r.doc_id: r.log_prob for r in again.collect()} == pytest.approx({1: own["rare7"], 2: own["rare8"], 3: 0})


def test_every_word_is_a_target(spark, make_docs):
    # Every eighth word is the same; the others must be learned as well.
    docs = make_docs([(i, "first b c d e f g h") for i in range(3000)]).coalesce(1)
    words, network = pseudo_likelihood.fit(docs)
    assert pseudo_likelihood.score(docs.limit(1), words, network).first().mean_log_prob > -3


def test_scores_cover_every_document(spark):
    rows = queries.op9_pseudo_likelihood(spark, "/root/testdata/sf0.001")
    assert rows.count() == 200 and rows.where("n_words > 0 and not log_prob < 0").count() == 0
    assert rows.where(F.abs(F.col("log_prob") / F.col("n_words") - F.col("mean_log_prob")) > 1e-9).count() == 0
