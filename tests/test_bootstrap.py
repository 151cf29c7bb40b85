import random

"""The bootstrap in chunks, in time order and with all its replicates."""

import numpy as np
import pandas as pd
import pytest

from touchline.operators import scoring
from touchline.plans import forecasts


def test_chunks(monkeypatch):
    x = np.random.default_rng(3).random(101)
    whole = scoring.block_bootstrap(x, 500, 10, 7)
    for size in (1, 1000, 3333):
        monkeypatch.setattr(scoring, "DRAWN_AT_ONCE", size)
        assert np.array_equal(scoring.block_bootstrap(x, 500, 10, 7), whole)


def test_order(spark):
    pdf = pd.DataFrame({"g": "a", "t": [3, 1, 2, 2, 0] * 8, "i": range(40), "v": np.arange(40.0) ** 2})
    got = scoring.bootstrap_intervals(spark.createDataFrame(pdf), "g", ["t", "i"], "v").first()
    means = scoring.block_bootstrap(pdf.sort_values(["t", "i"]).v.to_numpy(), 2000, 10, 20260831)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_loss_intervals(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(scoring, "bootstrap_intervals", lambda df, group, order, value, **more: seen.update(more, order=order, rows=df.count(), timed=df.where("kickoff_at is not null").count()) or df)
    forecasts.loss_intervals(spark, sf)
    assert seen.get("replicates", 2000) == 2000 and seen["order"] == ["kickoff_at", "forecast_id"]
    assert seen["rows"] == seen["timed"] == forecasts.scored(spark, sf).count()


def test_published_order_of_draws():
    """The same means as drawing index after index with Python's generator and averaging what was drawn."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=57)
    for block in (1, 10, 57):
        draw = random.Random(20260831)
        want = []
        for _ in range(40):
            index = []
            while len(index) < len(x):
                start = draw.randrange(len(x) - block + 1)
                index.extend(range(start, start + block))
            want.append(x[index[: len(x)]].mean())
        assert scoring.block_bootstrap(x, 40, block, 20260831, True) == pytest.approx(want, abs=1e-12)
    batches = np.sort(rng.integers(0, 30, 57))
    groups = [np.flatnonzero(batches == b) for b in np.unique(batches)]
    draw = random.Random(5)
    want = []
    for _ in range(40):
        index = []
        while len(index) < len(x):
            start = draw.randrange(len(groups) - 10 + 1)
            for g in groups[start : start + 10]:
                index.extend(g)
        want.append(x[index[: len(x)]].mean())
    assert scoring.batched_bootstrap(x, batches, 40, 10, 5, True) == pytest.approx(want, abs=1e-12)
    assert scoring.batched_bootstrap(x, batches // 10, 40, 10, 5).tolist() == [x.mean()] * 2
    means = scoring.independent_bootstrap(x, 4000, 1)
    assert means.mean() == pytest.approx(x.mean(), abs=0.02) and means.std() == pytest.approx(x.std() / len(x) ** 0.5, rel=0.1)


def test_paired_intervals(spark):
    rng = np.random.default_rng(8)
    rows = [(d, int(i // 3), i, float(rng.normal(0.9 if d == "a" else 1.0, 0.1)), 1.0 if i % 17 else None) for d in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "domain string, ko long, id long, own double, base double")
    got = {r.scope: r for r in scoring.paired_intervals(df, "domain", "ko", "id", "own", "base", 300).collect()}
    assert set(got) == {"a", "b", "macro", "weighted", "independent"} and got["a"].conclusion == "CANDIDATE_BETTER" and got["b"].conclusion == "INCONCLUSIVE"
    assert all(r.low <= r.mean <= r.high for r in got.values()) and got["macro"].mean == pytest.approx((got["a"].mean + got["b"].mean) / 2)
    assert got["independent"].high - got["independent"].low == pytest.approx(got["weighted"].high - got["weighted"].low, rel=0.5)
    assert scoring.paired_intervals(df.limit(0), "domain", "ko", "id", "own", "base", 10).collect() == []


def test_gates(spark):
    m = spark.createDataFrame([("x", "log_loss", 1.0, 0.9), ("x", "ece", 0.02, 0.021), ("y", "log_loss", 1.0, 1.0), ("y", "ece", 0.02, 0.05), ("z", "log_loss", 1.0, None)], "model string, metric string, raw double, calibrated double")
    got = {r.model: (r.accepted, r.reasons) for r in scoring.calibration_gate(m, ["model"], {"log_loss": 0.001, "ece": 0.005}).collect()}
    assert got["x"] == (True, "") and got["y"] == (False, "ece regression exceeds tolerance; insufficient metric improvement") and not got["z"][0]
    metrics = ("joint_log_loss", "one_x_two_log_loss", "brier", "rps", "crps")
    rows = [("good", k, -0.01, -0.001) for k in metrics] + [("flat", k, -0.001, -0.0005) for k in metrics] + [("wide", k, -0.01, 0.001 if k == "joint_log_loss" else -0.1) for k in metrics] + [("domain", k, -0.01, -0.001) for k in metrics]
    d = [("good", x, -0.01) for x in "abc"] + [("flat", x, -0.01) for x in "abc"] + [("wide", x, -0.01) for x in "abc"] + [("domain", "a", -0.01), ("domain", "b", -0.01), ("domain", "c", 0.01)]
    got = {r.family: r.verdict for r in scoring.admission_gate(spark.createDataFrame(rows, "family string, metric string, mean double, high double"), spark.createDataFrame(d, "family string, domain string, mean double"), "family").collect()}
    assert got == {"good": "ACCEPTED", "flat": "REJECTED", "wide": "REJECTED", "domain": "REJECTED"}
