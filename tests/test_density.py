"""Kernel densities on more points than one broadcast holds."""

import numpy as np
import pytest

from scenelake.operators import density


@pytest.mark.parametrize("bandwidth", [0.3, None])
def test_kde_counts_every_point(spark, bandwidth):
    n = density.BLOCK + 5000 if hasattr(density, "BLOCK") else 25_000
    x = np.random.default_rng(3).normal(size=(n, 2)) * [1, 3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    got = {r.id: r.log_density for r in density.kde(rows.where("id < 40"), rows, bandwidth).collect()}
    h = bandwidth or n ** (-1 / 6)
    for i in range(40):
        want = np.log(np.exp(-((x - x[i]) ** 2).sum(axis=1) / (2 * h * h)).mean() / (2 * np.pi * h * h))
        assert got[i] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("d", [1, 2])
def test_kde_of_crowded_cells(spark, d, monkeypatch):
    """Full cells enter by moments, emptier ones by points, far rows by all points; no block holds the crowd."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.4, (9000, d)), r.uniform(-40, 40, (300, d)), np.repeat(r.normal(2, 1, (1, d)), 50, axis=0)])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    asked = np.concatenate([x[:60], x[-330:-270], np.full((1, d), 9.0), np.full((1, d), 300.0)])
    sent, send = [], density._sent
    monkeypatch.setattr(density, "_sent", lambda fit, block: sent.append(fit.count()) or send(fit, block))
    points = spark.createDataFrame([(i, v) for i, v in enumerate(asked.tolist())] + [(1000, [None] * d), (1001, None)], "id long, x array<double>")
    got = {p.id: p.log_density for p in density.kde(points, rows, 0.3, crowd=1000).collect()}
    assert len(got) == len(asked) + 2 and got[1000] is None and got[1001] is None
    assert sent[0] < 3000 < sent[1] == len(x)  # the rest by points; once more all, for the far rows alone
    for i, p in enumerate(asked):
        e = -((x - p) ** 2).sum(axis=1) / (2 * 0.3**2)
        want = e.max() + np.log(np.exp(e - e.max()).sum()) - np.log(len(x)) - d / 2 * np.log(2 * np.pi * 0.3**2)
        assert got[i] == pytest.approx(want, abs=1e-8)
