"""Fits of score models: gradients against differences, simulated parameters found again, no better point nearby."""

import numpy as np
import pandas as pd
import pytest

from touchline.operators import score_models as M


@pytest.mark.parametrize(("kind", "shape"), [("poisson", 0.0), ("nb2", 0.3), ("shared_pace", 0.6)])
def test_probabilities_and_slopes(kind, shape):
    h, a = (x.ravel().astype(float) for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    lh, la = np.full_like(h, 1.4), np.full_like(h, 0.9)
    ll, gh, ga = M.goal_likelihood(kind, h, a, lh, la, shape)
    p = np.exp(ll)
    assert p.sum() == pytest.approx(1, abs=1e-9) and (p * h).sum() == pytest.approx(1.4, abs=1e-6)
    e = 1e-6
    near = h + a < 12
    up, down = (M.goal_likelihood(kind, h, a, lh * np.exp(s), la, shape)[0] for s in (e, -e))
    assert gh[near] == pytest.approx(((up - down) / 2 / e)[near], abs=1e-5)
    up, down = (M.goal_likelihood(kind, h, a, lh, la * np.exp(s), shape)[0] for s in (e, -e))
    assert ga[near] == pytest.approx(((up - down) / 2 / e)[near], abs=1e-5)


def simulated(kind, seed=4, teams=6, n=8_000):
    rng = np.random.default_rng(seed)
    att, dfn = rng.normal(0, 0.25, teams), rng.normal(0, 0.2, teams)
    att, dfn = att - att.mean(), dfn - dfn.mean()
    h, a = rng.integers(0, teams, n), rng.integers(0, teams, n)
    h, a = h[h != a], a[h != a]
    lh, la = np.exp(0.1 + 0.3 + att[h] - dfn[a]), np.exp(0.1 + att[a] - dfn[h])
    if kind == "nb2":
        lh, la = (x * rng.gamma(1 / 0.3, 0.3, len(h)) for x in (lh, la))
    if kind == "shared_pace":
        pace = rng.uniform(0.4, 1.6, len(h))
        lh, la = lh * pace, la * pace
    rows = pd.DataFrame({"home": h, "away": a, "hg": rng.poisson(lh), "ag": rng.poisson(la)})
    return rows.groupby(["home", "away", "hg", "ag"]).size().rename("w").reset_index(), att, dfn


@pytest.mark.parametrize(("kind", "shape"), [("poisson", 0.0), ("nb2", 0.3), ("shared_pace", 0.6)])
def test_parameters_are_found_again(kind, shape):
    rows, att, dfn = simulated(kind)
    f = M.fit(rows, kind, 0.01)
    assert f.attack == pytest.approx(att, abs=0.08) and f.defence == pytest.approx(dfn, abs=0.08)
    assert f.home == pytest.approx(0.3, abs=0.05) and abs(f.rho) < 0.06 and f.shape == pytest.approx(shape, abs=0.08)
    # the shape pays for itself against Poisson, and no shape nearby is better
    if kind != "poisson":
        assert f.loglik > M.fit(rows, "poisson", 0.01).loglik + 20
        assert all(M.fit(rows, kind, 0.01, s).loglik <= f.loglik + 0.05 for s in (f.shape - 0.06, f.shape + 0.06))


def test_joint_maximum_with_corrected_low_scores():
    """With draws at low scores added, rho and the rates move together: no change of rho alone is better."""
    rows, _, _ = simulated("poisson", 7, 6, 6_000)
    rows["w"] = rows["w"].astype(float)
    rows.loc[(rows.hg == 0) & (rows.ag == 0), "w"] *= 1.3
    rows.loc[(rows.hg == 1) & (rows.ag == 1), "w"] *= 1.2
    f = M.fit(rows, "poisson", 0.01)
    assert f.rho < -0.02 and f.gradient < 1e-4 * rows.w.sum()


def test_on_a_table(spark, sf):
    from touchline.plans.facts import facts

    got = M.fit_models(facts(spark, sf), "competition_id", ("poisson", "nb2"), 1.0).collect()
    by = {(r.competition_id, r.model): r for r in got}
    assert all(r.accepted for r in got) and all(by[c, "nb2"].loglik >= by[c, "poisson"].loglik - 0.5 for c, _ in by)
    assert M.fit_models(facts(spark, sf).limit(0), "competition_id").collect() == []


def test_vector_scaling():
    from touchline.operators import models

    rng = np.random.default_rng(6)
    p = rng.dirichlet([3, 2, 2.5], 40_000)
    truth = np.array([0.3, -0.2, 0.8, 1.1, 0.7])
    z = np.c_[truth[0] + truth[2] * np.log(p[:, 0]), truth[1] + truth[3] * np.log(p[:, 1]), truth[4] * np.log(p[:, 2])]
    q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    outcome = (q.cumsum(1) < rng.random((len(q), 1))).sum(1)
    counts = np.eye(3)[outcome]
    x, se = models.vector_scaling(np.log(p), counts)
    assert np.all(np.abs(x - truth) < 4 * se) and np.all(se < 0.06)
    # with much shrinkage, or with no rows, nothing changes
    assert models.vector_scaling(np.log(p[:100]), counts[:100], 1e9)[0] == pytest.approx([0, 0, 1, 1, 1], abs=1e-4)
    assert models.vector_scaling(np.zeros((0, 3)), np.zeros((0, 3)), 1.0)[0].tolist() == [0, 0, 1, 1, 1]
