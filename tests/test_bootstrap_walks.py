"""Paths walked side by side are those drawn one by one, in blocks that fit the cache."""

import numpy as np
import pytest

from asofia.operators import signals as sg


@pytest.mark.parametrize(("n", "sims"), [(1, 7), (3, 2500), (700, 1203), (3000, 900)])
def test_walks_are_the_plain_paths(n, sims):
    values = np.random.default_rng(n).normal(0, .2, n)
    total, worst = sg._walks(values, sims, np.random.default_rng([42, n]))
    path = values[np.random.default_rng([42, n]).integers(0, n, (sims, n))].cumsum(axis=1)
    assert (total == path[:, -1]).all()
    assert (worst == (path - np.maximum(np.maximum.accumulate(path, axis=1), 0)).min(axis=1)).all()


def test_a_block_is_small(monkeypatch):
    seen = []
    real = sg._blocks
    monkeypatch.setattr(sg, "_blocks", lambda total, most: seen.append(most) or real(total, most))
    sg._walks(np.ones(500), 2500, np.random.default_rng(1))
    sg._walks(np.ones(4000), 100, np.random.default_rng(1))
    assert seen == [1000, 500]


def test_few_steps_are_looked_up_at_once(monkeypatch):
    seen = []
    real = np.take
    monkeypatch.setattr(sg.np, "take", lambda values, at, **rest: seen.append(at.shape) or real(values, at, **rest))
    sg._walks(np.ones(70), 1500, np.random.default_rng(1))
    assert seen == [(32, 1000), (32, 1000), (6, 1000), (32, 500), (32, 500), (6, 500)]
