"""Every stage of the pipeline against a plain version of what it has to do."""

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from gridtide.llm import bpe_tree, quality_gam, toxicity_kernel
from tests.llm.test_search import brute_components, hit_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, on the table's rows plus odd ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no key here", "en", "s", 11), (90_001, None, None, None, None), (90_002, "", "en", "s", 0)], docs.schema)
    first = docs.where("doc_id % 3 = 0")
    docs = docs.unionByName(odd).unionByName(first.limit(1)).cache()
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
        found[-1].count()
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == list(pipeline.COLUMNS) and after.dtypes == before.dtypes
        assert after.exceptAll(before).count() == 0
    assert stages[1].count() < stages[0].count() and stages[-1].count() == stages[-2].count()


@pytest.mark.parametrize(("k", "column", "parts", "held", "module", "bad"), [(0, "quality", 5, 0, quality_gam, 0), (1, "toxic", 3, 1, toxicity_kernel, 1)])
def test_classifiers_drop_what_they_reject(spark, stages, k, column, parts, held, module, bad):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string")) % parts != held)
    scored = module.score(stages[k], module.fit(stages[k], learned.select("doc_id", column)))
    rejected = scored.where(f"predicted = {bad}")
    assert stages[k + 1].count() == stages[k].count() - rejected.count()
    known = stages[k].join(labels, "doc_id")
    dropped = known.join(stages[k + 1].select("doc_id"), "doc_id", "left_anti")
    wrong = known.where(f"{column} = {bad}")
    assert dropped.where(f"{column} <> {bad}").count() <= 0.02 * known.count()
    assert wrong.join(stages[k + 1].select("doc_id"), "doc_id", "left_semi").count() <= 0.3 * wrong.count() + 1


def test_one_document_of_each_component_stays(stages):
    rows = sorted(((r.doc_id, r.text) for r in stages[2].where("doc_id is not null").select("doc_id", "text").collect()), key=lambda r: r[0])
    _, label = brute_components([t for _, t in rows], 5, pipeline.NEAR)
    want = {rows[i][0] for i in label}
    assert ids(stages[3].where("doc_id is not null")) == want
    assert stages[3].where("doc_id is not null").count() == len(want)
    assert stages[3].where("doc_id is null").count() == stages[2].where("doc_id is null").count()


def test_near_copies_link_from_four_fifths_on(spark, make_docs):
    words = [f"w{i}" for i in range(52)]  # 48 shingles of five words
    rows = [(1, " ".join(words)), (2, " ".join(words[:47] + list("abcde"))), (3, " ".join(words[:46] + list("fghijk")))]
    # In common: 43 of 53 shingles (0.811), 42 of 54 (0.778).
    assert brute_components([t for _, t in rows], 5, 800)[1] == [0, 0, 2]
    assert sorted(ids(pipeline.near_copies(spark, make_docs(rows, clashing=False), SF))) == [1, 3]


def test_rows_that_share_a_key_go_by_their_texts(spark, make_docs, text_of):
    rng = np.random.default_rng(4)
    one, two, three, four = (text_of(rng, 40) for _ in range(4))
    # Of key 5 only the copy of `one` goes; of key 7 one of two near copies; key 8 copies a text of 5; rows without a key stay.
    rows = [(1, one), (5, one), (5, two), (7, three), (7, three + " end"), (8, two), (9, four), (9, four), (None, one), (None, None), (9, None)]
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, make_docs(rows, clashing=False), SF).collect()]
    sevens = [t for i, t in got if i == 7]
    assert len(sevens) == 1 and sevens[0] in (three, three + " end")
    want = [(1, one), (5, two), (9, four), (None, one), (None, None), (9, None)]
    assert sorted([r for r in got if r[0] != 7], key=str) == sorted(want, key=str)


def test_documents_with_benchmark_passages_go(spark, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = stages[3].select("doc_id", "text").collect()
    first = {t.split()[0].lower() for _, t in items}
    # Only texts that hold an item's words can be hit: a cheap sieve before the quadratic comparison.
    words = {w for _, t in items for w in t.lower().split()}
    want = set()
    for r in rows:
        common = [w in words for w in (r.text or "").lower().split()]
        if sum(common) >= 10 and first and hit_words(r.text, items, 10)[1]:
            want.add(r.doc_id)
    assert want and ids(stages[3]) - ids(stages[4]) == want


def test_tokens_are_the_librarys(stages):
    ranks = bpe_tree.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts = {r.doc_id: r.n_tokens for r in stages[5].collect()}
    for r in stages[4].select("doc_id", "text").collect():
        assert counts[r.doc_id] == len(library.encode_ordinary(r.text or ""))


def test_the_registry_has_all_queries(spark):
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in found if k.startswith("op")} and "pipeline" in found
    assert "op6_suffix_search" in entry.oracle_sql() and "pipeline" not in entry.oracle_sql()
    assert found["pipeline"](spark, "/root/testdata/sf0.001").count() > 50
