"""Operator 7 probes from radius to radius and compares few vectors in double precision."""

import numpy as np

from gridtide.llm import multi_index


def test_few_vectors_are_compared_in_double_precision(monkeypatch):
    rng, compared, einsum = np.random.default_rng(24), [], np.einsum
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:130] = x[100]
    shard = multi_index.Shard(np.arange(3000), x, multi_index.learn(multi_index.extended(x, 20.0)), 20.0)
    code = multi_index.codes(multi_index.extended(x, 0.0), multi_index.learn(multi_index.extended(x, 20.0)))
    monkeypatch.setattr(multi_index.np, "einsum", lambda form, rows, *more: compared.append(len(rows)) or einsum(form, rows, *more))
    for i in range(0, 3000, 100):
        ids, scores = shard.search(i, x[i], code[i], 20)
        numbers = np.concatenate([shard.members[shard.edge[c] : shard.edge[c + 1]] for c in shard.within(code[i])])
        numbers = numbers[numbers != i]
        assert len(numbers) >= 399
        score = einsum("ij,j->i", x[numbers], x[i])
        best = np.lexsort((numbers, -score))[:20]
        assert ids.tolist() == numbers[best].tolist() and scores.tolist() == score[best].tolist()
    assert max(compared) <= 50


def test_the_radius_does_not_depend_on_where_probing_begins():
    x = np.random.default_rng(25).normal(size=(2000, 24))
    shard = multi_index.Shard(np.arange(2000), x, multi_index.learn(multi_index.extended(x, 10.0)), 10.0)
    for code in shard.codes[:5]:
        far = multi_index._ONES[shard.codes ^ code].sum(1)
        m = shard.codes.shape[1]
        want = next(near for a in range(17) if len(near := np.flatnonzero(far < m * (a + 1))) >= multi_index.LEAST)
        for start in (0, 3, 8, 16):
            shard.start = start
            assert shard.within(code).tolist() == want.tolist()
