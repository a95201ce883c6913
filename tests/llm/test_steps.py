"""A training step of operator 9, and its softmax."""

import numpy as np

from gridtide.llm import pseudo_likelihood


def test_a_step_is_that_of_the_plain_gradient_in_two_softmaxes(monkeypatch):
    rng, calls, residual = np.random.default_rng(26), [], pseudo_likelihood._residual
    monkeypatch.setattr(pseudo_likelihood, "_residual", lambda *x: calls.append(1) or residual(*x))
    n, size = 700, pseudo_likelihood.SIZE
    word, near = np.where(rng.random(n) < 0.3, rng.integers(0, 9, n), rng.integers(0, size, n)), rng.integers(0, size + 1, (4, n))
    before, trainer = pseudo_likelihood.Network.fresh(), pseudo_likelihood.Trainer(pseudo_likelihood.Network.fresh())
    trainer.step(word, near)
    assert len(calls) == 2
    h = np.ones((n, 33))
    h[:, :-1] = np.tanh(before.shift.astype(float) + sum(before.near[k][near[k]].astype(float) for k in range(4)))
    slope = {name: np.zeros(shape) for name, shape in pseudo_likelihood.SHAPES.items()}
    top = before.top.astype(float)
    for i, w in enumerate(word):
        c, r = divmod(int(w), 64)
        low, back = before.low[c].astype(float), 0
        for weight, at, into in ((top, c, slope["top"]), (low, r, slope["low"][c])):
            p = np.exp(h[i] @ weight)
            g = (np.arange(64) == at) - p / p.sum()
            into += np.outer(h[i], g) / n
            # The top's weights have climbed only after this step's gradient was taken.
            back = back + weight @ g / n
        down = (back * (1 - h[i] ** 2))[:-1]
        slope["shift"] += down
        for k in range(4):
            slope["near"][k, near[k, i]] += down
    for name, g in slope.items():
        want = getattr(before, name) + pseudo_likelihood.RATE * g / np.sqrt(1e-3 + g * g)
        np.testing.assert_allclose(getattr(trainer.net, name), want, atol=2e-6)


def test_large_logits_are_lowered():
    logits = np.zeros((2, 64), np.float32)
    logits[0, 5], logits[1, 7] = 500, -500
    got = pseudo_likelihood._log_softmax(logits.copy(), np.array([5, 7]))
    np.testing.assert_allclose(got, [0, -500 - np.log(63)], rtol=1e-6)
