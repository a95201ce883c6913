"""Operators 2, 6, 7 and 8 against brute force and SQL."""

import gzip
import hashlib
import re
from base64 import b32encode

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridtide.llm import components, multi_index, partenum_join, queries, suffix_search, warc_writer

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = sorted(got.columns)
    got, want = (d[order].sort_values(order).reset_index(drop=True) for d in (got, want))
    for c in order:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit("x")).withColumn("key", F.lit("y"))


def test_archives_roll_repeat_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    bodies = [f"<p>{rng.integers(0, 10**9)} é{'x' * int(rng.integers(0, 3000))}</p>" for _ in range(300)]
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(bodies)]
    rows += [(1000 + i, "u", "same") for i in range(150)] + [(2000, None, None), (2001, "u", ""), (None, "u", "same"), (7, "http://h/7", bodies[7])]
    digests = []
    for name, parts in (("a", 3), ("b", 7)):
        folder = f"{tmp_path}/{name}"
        manifest = warc_writer.write(pages(spark, rows).repartition(parts), folder, shard_bytes=64_000, file_bytes=20_000).collect()
        assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 10
        digests.append(sorted((m.file, m.sha256) for m in manifest))
        for m in manifest:
            raw = (tmp_path / name / m.file).read_bytes()
            assert len(raw) == m.bytes and hashlib.sha256(raw).hexdigest() == m.sha256
            assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == m.records
        assert not [p for p in (tmp_path / name).iterdir() if p.name.startswith(".shard")]
    assert digests[0] == digests[1]
    got = {}
    for r in warc_writer.read(spark, f"{tmp_path}/a").collect():
        got.setdefault(r.key, []).append(r)
    assert len(got[7]) == 2 and all(r.record_type == "response" for r in got[7])
    for i, b in list(enumerate(bodies))[:20]:
        assert got[i][0].payload_bytes == len(b.encode()) and got[i][0].payload_digest == b32encode(hashlib.sha1(b.encode()).digest()).decode()
    assert {r[0].refers_to for k, r in got.items() if k and 1000 <= k < 1149} == {1149}
    assert got[1149][0].record_type == "response" and got[None][0].record_type == "response"
    assert got[2000][0].refers_to == 2001 and got[2001][0].payload_bytes == 0
    damaged = next(iter(sorted((tmp_path / "b").glob("*.gz"))))
    damaged.write_bytes(damaged.read_bytes()[:-9])
    with pytest.raises(Exception, match="damaged"):
        warc_writer.read(spark, f"{tmp_path}/b").count()


def test_no_pages_and_a_floor_for_revisits(spark, tmp_path):
    warc_writer.write(pages(spark, []), f"{tmp_path}/none")
    assert warc_writer.read(spark, f"{tmp_path}/none").count() == 0
    warc_writer.write(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")]), f"{tmp_path}/floor", min_bytes=5)
    kinds = {r.key: r.record_type for r in warc_writer.read(spark, f"{tmp_path}/floor").collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def hit_words(text, items, window):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, hit, named = find((text or "").translate(LOWER)), set(), set()
    for name, item in items:
        w = find((item or "").translate(LOWER))
        size = min(len(w), window)
        for i in range(len(w) - size + 1) if w else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    named.add(name)
    return len(words), len(hit), named


@pytest.fixture
def contaminated(odd_texts, text_of):
    rng = np.random.default_rng(6)
    items = [(str(i), text_of(rng, n)) for i, n in enumerate((14, 30, 59, 10, 9, 3, 1))] + [("7", None), ("8", "... !"), ("9", "ÄÖ über STRASSE 42")]
    texts = [t for t in odd_texts if t is None or len(t) < 50_000]
    for _, item in items[:7]:
        w = (item or "").split()
        texts += [f"{text_of(rng, 20)} {' '.join(w[:11])}. {text_of(rng, 5)}", " ".join(w).upper(), " - ".join(w), " ".join(w[1:] + w[:1]), " ".join(w[:9])]
    return texts + ["aÄÖ über strasse 42", "äö über STRASSE 42", "ÄÖ über-strasse42", "ÄÖ, über, strasse, 42 " * 3], items


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_suffix_search_equals_brute_force(spark, make_docs, contaminated, monkeypatch, block):
    monkeypatch.setattr(suffix_search, "BLOCK_BYTES", block)
    texts, items = contaminated
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(None, "tau1")], "item_id bigint, text string").withColumn("hits", F.lit(0))
    docs = make_docs(enumerate(texts))
    got = {r.doc_id: r for r in suffix_search.report(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, named = hit_words(t, items, 10)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(named), hit > 0), t
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    kept = suffix_search.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    longest = suffix_search.matches(docs, bench).where("item = '2'").agg(F.max("n_words")).first()[0]
    assert longest == 59


def test_suffix_array_is_sorted(text_of):
    rng = np.random.default_rng(1)
    text = " ".join(["a b a b a b c a b"] * 40)
    words = suffix_search.Bytes(pa.array([text, text_of(rng, 50), text]), suffix_search.word_bytes())
    shard = suffix_search.Shard(words, suffix_search.Tests.of(["x"], ["a b c"], 2))
    suffixes = [tuple(shard.text[p:][: 400]) for p in shard.array]
    assert suffixes == sorted(suffixes) and len(suffixes) == 720


def test_suffix_search_of_nothing(spark, make_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    row = suffix_search.report(make_docs([(1, "some words here")]), bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert suffix_search.report(make_docs([]), bench).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("z")).withColumn("shard", F.lit("q"))


def test_neighbours_reach_the_recall_and_are_exact(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 700)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 40)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(2000, 24)) * rng.uniform(0.5, 2, (2000, 1))).astype(np.float32)
    x[500:1200] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (4000, None), (4020, [0.0] * 24), (4040, [float("nan")] * 24), (4060, [1.0, None] * 12), (4080, []), (4100, [1.0]), (None, x[0].tolist())]
    table = vectors(spark, rows)
    found = multi_index.nearest(table)
    got = found.toPandas().sort_values(["query_id", "rank"])
    assert multi_index.recall(found, table) > 0.9
    assert set(got.query_id) == set(range(0, 2000, 20)) and (got.groupby("query_id").size() == 20).all()
    wide = x.astype(float)
    np.testing.assert_allclose(got.score, (wide[got.query_id] * wide[got.vec_id]).sum(1), rtol=1e-12)
    for _, q in got.groupby("query_id"):
        assert (q.query_id != q.vec_id).all() and q["rank"].tolist() == list(range(1, 21)) and q.vec_id.is_unique
        assert sorted(zip(-q.score, q.vec_id, strict=True)) == list(zip(-q.score, q.vec_id, strict=True))


def test_every_code_in_the_radius_is_retrieved():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    shard = multi_index.Shard(np.arange(3000), x, multi_index.learn(multi_index.extended(x, 10.0)), 10.0)
    for code in shard.codes[:20]:
        got = shard.within(code)
        far = multi_index._ONES[shard.codes ^ code].sum(1)
        assert set(got) == set(np.flatnonzero(far <= far[got].max())) or set(np.flatnonzero(far < far[got].max())) <= set(got)
        assert len(got) >= multi_index.LEAST


def test_neighbours_of_few_and_of_none(spark):
    assert multi_index.nearest(vectors(spark, [])).count() == 0
    few = multi_index.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5])])).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert multi_index.nearest(vectors(spark, [(0, [1.0, 0.0])])).count() == 0


def brute_components(texts, n, permille):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            near = a and b and 1000 * min(len(a), len(b)) >= permille * max(len(a), len(b)) and label[i] != label[j]
            if near and 1000 * len(a & b) >= permille * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for at in rng.integers(0, len(w), int(rng.integers(0, edits))):
            w[at] = f"new{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "permille", "block"), [(3, 900, 1024), (5, 800, 1024), (3, 900, 20), (5, 850, 7)])
def test_join_equals_brute_force(spark, make_docs, odd_texts, text_of, monkeypatch, n, permille, block):
    monkeypatch.setattr(partenum_join, "BLOCK", block)
    monkeypatch.setattr(partenum_join, "ASKING", max(3, block // 2))
    rng = np.random.default_rng(n * permille)
    line = text_of(rng, 13)
    texts = list(odd_texts)
    for words, edits in ((12, 3), (25, 4), (60, 6), (150, 14), (400, 30)):
        texts += family(rng, text_of(rng, words), 30, edits)
    texts += [f"{line}\n{text_of(rng, 20)}\n{line}" for _ in range(30)] + [text_of(rng, k) for k in (1, 2, 3, 4, 5)] * 2
    got = {r.doc_id: r for r in partenum_join.join(make_docs(enumerate(texts)), n, permille).collect()}
    sizes, label = brute_components(texts, n, permille)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label


def test_join_of_nothing_and_of_odd_keys(spark, make_docs):
    assert partenum_join.join(make_docs([])).count() == 0
    rows = partenum_join.join(make_docs([(5, "a b c d"), (5, "q r s t"), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (7, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (5, 5), (5, 5), (7, 7), (9, 5), (9, 5)]


@pytest.mark.parametrize("permille", [800, 850, 900, 950])
def test_similar_sets_share_a_signature(permille):
    rng = np.random.default_rng(permille)
    for size in (1, 2, 5, 9, 14, 18, 23, 40, 77, 120, 333, 900):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, size * (1000 - permille) // 1000 + 1)
            add = rng.integers(0, max(1, (len(a) - drop) * 1000 // permille - len(a) + 1)) if drop < len(a) else 0
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if both and 1000 * both >= permille * (len(a) + len(b) - both):
                assert len(np.intersect1d(partenum_join.signatures(a, permille), partenum_join.signatures(b, permille)))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300), (300, 302), (303, 302)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "p bigint, q bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and {got[i] for i in range(300, 304)} == {300}


def test_every_shard_is_a_partition_of_its_own(spark, tmp_path):
    rows = [(i, "u", f"{i:05d}" * 200) for i in range(1200)]
    manifest = warc_writer.write(pages(spark, rows), str(tmp_path / "w"), shard_bytes=60_000)
    shards = sorted(r.shard for r in manifest.collect())
    assert len(set(shards)) == 20 and len(list((tmp_path / "w/manifest").glob("part-*.parquet"))) == 20
