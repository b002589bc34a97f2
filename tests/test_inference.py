"""Fits, intervals, prices, translations, spreads and shapes against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsports.operators import asof, fit, rates, spread, stats, translation

T = dt.datetime


def test_price_in_effect(spark):
    day = lambda n, h=0: T(2024, 5, 1) + dt.timedelta(days=n, hours=h)
    ticks = spark.createDataFrame([(1, day(0), 0.5), (1, day(5), 0.6), (1, day(9), 0.7), (2, day(-400), 0.4), (4, day(3), 0.3)], "g int, ts timestamp_ntz, p double")
    asked = [
        (1, day(5), day(20)),  # a tick at the very time counts
        (1, day(4, 23), day(20)),
        (1, day(10), day(6)),  # the tick at day 9 came after the close: the close's holds
        (1, day(10), day(-1)),  # closed before the first tick
        (2, day(0), day(9)),  # too old
        (3, day(0), day(9)),  # no ticks
        (4, day(3), day(3)),
        (1, None, day(9)),
    ]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, g int, at timestamp_ntz, close timestamp_ntz")
    got = {r.i: (r.p, r.clipped, r.stale) for r in asof.price_in_effect(q, ticks, ["g"], "at", "close", "ts", 365).collect()}
    assert got == {0: (0.6, False, False), 1: (0.5, False, False), 2: (0.6, True, False), 3: (None, True, False), 4: (None, False, True), 5: (None, False, False), 6: (0.3, False, False), 7: (None, False, False)}


def test_cluster_errors(spark):
    rng = np.random.default_rng(3)
    x, cluster = rng.normal(size=400), rng.integers(0, 25, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x + rng.normal(size=25)[cluster])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, cluster, strict=True)], "x double, y double, c int")
    beta = fit.logistic(df, F.col("y"), [F.col("x")], ridge=0.0)
    se, n = fit.cluster_errors(df, F.col("y"), [F.col("x")], beta, F.col("c"))
    design = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-design @ np.array(beta)))
    scores = np.array([(design * (y - p)[:, None])[cluster == c].sum(0) for c in range(25)])
    inverse = np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]))
    assert n == 25 and se == pytest.approx(np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse) * 25 / 24), abs=1e-10)


def test_dispersed_counts_reach_the_optimum(spark):
    rng = np.random.default_rng(4)
    x, off = rng.integers(0, 3, 900) / 2, np.log(rng.integers(1, 3, 900))
    mu = np.exp(off + 0.4 + 0.5 * x)
    y = rng.negative_binomial(2.5, 2.5 / (2.5 + mu))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, off, y, strict=True)], "x double, o double, y int")
    m = fit.dispersed_counts(df, F.col("y"), [F.col("x")], F.col("o"), ridge=1.0, discrete=True)
    assert m["gradient"] <= 1e-7 * 900

    def loss(t):
        eta = off + t[0] + t[1] * x
        r, mean = np.exp(-(t[2] + t[3] * eta)), np.exp(eta)
        gamma = np.vectorize(math.lgamma)
        return (gamma(y + r) - gamma(r) + r * np.log(r / (r + mean)) + y * np.log(mean / (r + mean))).sum() - 0.5 * t[1] ** 2

    best = np.array([*m["beta"], m["a0"], m["a1"]])
    assert m["loglik"] == pytest.approx(loss(best), abs=1e-7)
    for step in np.eye(4) * 1e-3:  # no direction is better
        assert loss(best + step) < loss(best) and loss(best - step) < loss(best)
    rowwise = fit.dispersed_counts(df, F.col("y"), [F.col("x")], F.col("o"))
    assert rowwise["beta"] == pytest.approx(m["beta"], abs=1e-7) and rowwise["a1"] == pytest.approx(m["a1"], abs=1e-6)


def test_dispersed_counts_settle_parameters_of_little_curvature(spark):
    rng = np.random.default_rng(6)
    x = (np.arange(2000) % 500 == 0).astype(float)  # four rows decide about its coefficient
    y = rng.negative_binomial(2.5, 2.5 / (2.5 + np.exp(0.5 + x + np.arange(2000) % 3 / 10)))
    df = spark.createDataFrame([(float(a), float(i % 3) / 10, int(c)) for i, (a, c) in enumerate(zip(x, y, strict=True))], "x double, o double, y int")
    of = lambda tolerance: (lambda m: [*m["beta"], m["a0"], m["a1"]])(fit.dispersed_counts(df, F.col("y"), [F.col("x")], F.col("o"), ridge=0.0, tolerance=tolerance, discrete=True))
    assert of(1e-4) == pytest.approx(of(1e-11), abs=1e-6)


def test_dispersed_counts_without_spread(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (5,)], "y int")
    assert math.isfinite(fit.dispersed_counts(df, F.col("y"), [])["loglik"])


def test_joint_bootstrap_shares_its_draws(spark):
    rng = random.Random(5)
    data = [("all", b, rng.random(), rng.choice([0.5, 1.0])) for b in range(12) for _ in range(4)]
    data += [("copy", b, x, w) for _, b, x, w in data] + [("shift", b, x + 1, w) for _, b, x, w in data] + [("one", 3, 2.0, 1.0)]
    df = spark.createDataFrame(data, "g string, b int, x double, w double")
    got = {(r.g, r.draw): r.mean for r in stats.joint_bootstrap(df, "x", "w", "b", ["g"], 40, 9).collect()}
    for d in range(40):
        assert got["all", d] == pytest.approx(got["copy", d]) and got["shift", d] == pytest.approx(got["all", d] + 1)
        # block i of a resample is block drawn(seed, draw, i) % 12
        picks = [_drawn(9, d, i) % 12 for i in range(12)]
        rows = [(x, w) for p in picks for g, b, x, w in data if g == "all" and b == p]
        assert got["all", d] == pytest.approx(sum(x * w for x, w in rows) / sum(w for _, w in rows))
        assert got.get(("one", d)) == (2.0 if 3 in picks else None)


def _drawn(seed, draw, i):
    a, b, c = stats.STEPS
    x = (draw * a + i * b + (seed + 1) * c) % stats.PRIME
    for step in stats.STEPS:
        x = (x * step + draw * 7919 + i * 104729) % stats.PRIME
    return x


def test_shape_table_falls_back(spark):
    rows = [("a", 1, v) for v in (0, 1, 1, 2, 9)] + [("a", 2, 3)] + [("b", 1, 0), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "part string, state int, v int")
    got = {(r.part, r.state, r.k): (r.level, r.n, r.p) for r in rates.shape_table(df, "v", ["part", "state"], ["part"], 3, 4).collect()}
    assert [got["a", 1, k] for k in (1, 2, 3)] == [("fine", 4, 0.5), ("fine", 4, 0.25), ("fine", 4, 0.25)]
    assert [got["a", 2, k] for k in (1, 2, 3)] == [("coarse", 5, 0.4), ("coarse", 5, 0.2), ("coarse", 5, 0.4)]
    assert [got["b", 1, k] for k in (1, 2, 3)] == [("all", 6, pytest.approx(2 / 6)), ("all", 6, pytest.approx(2 / 6)), ("all", 6, pytest.approx(2 / 6))]
    for state in {(p, s) for p, s, _ in got}:
        assert sum(got[*state, k][2] for k in (1, 2, 3)) == pytest.approx(1)


def test_spread_keeps_each_days_mean(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, 2, 3, [math.log(2.0 + i % 4), math.log(1.5)], rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)) for i in range(12)]
    df = spark.createDataFrame(rows, "game_id int, day int, home int, away int, base array<double>, th double, ta double")
    got = spread.shrunk(df, [(1.0, 1.0), (0.3, 0.6)]).collect()
    for r in got:
        if r.tau_total == 1.0:
            assert list(r.home_mu) == pytest.approx([math.exp(b + r.th) for b in r.base])
    for day in range(3):
        for j in range(2):
            for side in ("home_mu", "away_mu"):
                sums = [sum(r[side][j] for r in got if r.day == day and r.tau_total == t) for t in (1.0, 0.3)]
                assert sums[0] == pytest.approx(sums[1])
    one = spark.range(1).select(spread.probability(F.array(F.lit(2.0), F.lit(1.5)), F.lit(4.0), F.lit(3)).alias("p")).first().p
    nb = lambda k, m: math.comb(k + 3, k) * (4 / (4 + m)) ** 4 * (m / (4 + m)) ** k
    assert one == pytest.approx(sum(nb(i, 2.0) * nb(3 - i, 1.5) for i in range(4)))


def test_translation_by_hand(spark):
    lines = [
        ("p", 2000, 11, 10, 4), ("q", 2000, 11, 30, 6), ("p", 2002, 11, 20, 2), ("q", 2002, 11, 20, 10),
        ("p", 2003, 1, 50, 20), ("q", 2003, 1, 50, 5), ("r", 2002, 1, 100, 25),
    ]
    df = spark.createDataFrame(lines, "player string, season int, level int, n int, k int")
    rel = translation.relative_rates(df, {"k": "k"})
    x = {(r.player, r.season, r.level): r.x for r in rel.collect()}
    assert x["p", 2000, 11] == pytest.approx(0.4 - 0.25) and x["q", 2002, 11] == pytest.approx(0.5 - 0.3)
    targets = spark.createDataFrame([("p", 2003), ("q", 2003), ("p", 2000)], "player string, target int")
    xs = translation.histories(rel, targets, (11,), {"k": 5.0}, skipped=(2001,))
    got = {(r.player, r.target): (r.n, r.xs) for r in xs.collect()}
    assert set(got) == {("p", 2003), ("q", 2003)}  # nothing before 2000
    n = 0.8 * 20 + 0.64 * 10  # 2001 is skipped, so 2000 is the second season back
    mean = (0.8 * 20 * (0.1 - 0.3) + 0.64 * 10 * (0.4 - 0.25)) / n
    assert got["p", 2003] == (pytest.approx(n), pytest.approx(mean * n / (n + 5)))
    outcomes = spark.createDataFrame([("p", 2003, "k", 50, 0.15), ("q", 2003, "k", 50, -0.15)], "player string, target int, stat string, w int, y double")
    c = translation.fitted(xs, outcomes).first()
    slope = 0.3 / (got["p", 2003][1] - got["q", 2003][1])
    assert c.b == pytest.approx(slope) and c.c == pytest.approx(slope * (got["p", 2003][1] + got["q", 2003][1]) / 2) and c.players == 2
    adj = {r.player: r.adj for r in translation.adjustments(xs, translation.fitted(xs, outcomes)).collect()}
    assert adj["p"] == pytest.approx(0.15) and adj["q"] == pytest.approx(-0.15)


def test_probability_has_no_largest_score(spark):
    got = spark.createDataFrame([(0,), (3,), (40,)], "y int").select(spread.probability(F.array(F.lit(12.0), F.lit(9.5)), F.lit(4.0), F.col("y")).alias("p")).collect()
    pmf = lambda m, k: math.comb(k + 3, k) * (4 / (4 + m)) ** 4 * (m / (4 + m)) ** k
    for (p,), y in zip(got, (0, 3, 40), strict=True):
        assert p == pytest.approx(sum(pmf(12.0, i) * pmf(9.5, y - i) for i in range(y + 1)), rel=1e-12)
