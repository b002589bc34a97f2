"""Hand-checked cases of the operators: strictness, ties, nulls, empty inputs."""

from __future__ import annotations

import datetime
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsports.functions import columns as fn
from pitsports.operators import asof, fit, gates, rates, stats, tables
from pitsports.sources import landed

D = dt.date


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_asof_is_strict_and_resets_by_key(spark):
    q = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 1, 1)), ("b", D(2024, 1, 9)), (None, D(2024, 1, 9)), ("a", None)], "k string, d date")
    f = spark.createDataFrame([("a", D(2024, 1, 1), 10), ("a", D(2024, 1, 2), 20), ("c", D(2024, 1, 1), 30), (None, D(2024, 1, 1), 40)], "k string, t date, v int")
    got = {(x.k, x.d): x.v for x in asof.asof_join(q, f, ["k"], "d", "t").collect()}
    assert got == {("a", D(2024, 1, 2)): 10, ("a", D(2024, 1, 1)): None, ("b", D(2024, 1, 9)): None, (None, D(2024, 1, 9)): None, ("a", None): None}
    at = {(x.k, x.d): x.v for x in asof.asof_join(q, f, ["k"], "d", "t", strict=False).collect()}
    assert at[("a", D(2024, 1, 2))] == 20 and at[("a", D(2024, 1, 1))] == 10


def test_asof_keeps_repeated_questions_and_empty_facts(spark):
    q = spark.createDataFrame([("a", D(2024, 1, 2))] * 3, "k string, d date")
    f = spark.createDataFrame([], "k string, t date, v int")
    assert [x.v for x in asof.asof_join(q, f, ["k"], "d", "t").collect()] == [None] * 3


def test_trailing_join_bounds(spark):
    q = spark.createDataFrame([(1, D(2024, 2, 1))], "k int, cutoff date")
    f = spark.createDataFrame([(1, D(2024, 1, 2), 1), (1, D(2024, 1, 1), 2), (1, D(2024, 2, 1), 4), (1, D(2024, 1, 31), 8)], "k int, day date, v int")
    assert sorted(x.v for x in asof.trailing_join(q, f, ["k"], "cutoff", "day", 30).collect()) == [1, 8]


def test_shrunk_rate_closed_form(spark):
    one = spark.range(1)
    got = one.select(rates.shrunk_rate(F.lit(10), F.lit(40), 60.0, F.lit(0.22), [(0.8, F.lit(50), F.lit(200))])).first()[0]
    assert abs(got - (10 + 0.8 * 50 + 60 * 0.22) / (40 + 160 + 60)) < 1e-12
    assert one.select(rates.shrunk_rate(F.lit(None).cast("int"), F.lit(None).cast("int"), 60.0, F.lit(0.22))).first()[0] == 0.22


def test_merge_latest_new_wins_and_evolves(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1.0), (3, "d", 2.0)], "k int, v string, w double")
    assert rows(tables.merge_latest(old, new, ["k"]), "k") == [(1, "a", None), (2, "c", 1.0), (3, "d", 2.0)]


def test_conform_rounds_fills_and_drops(spark):
    df = spark.createDataFrame([(2.5, "x", 1), (None, None, 2)], "a double, b string, extra int")
    out = tables.conform(df, T.StructType.fromDDL("a int, b string, c date"))
    assert out.dtypes == [("a", "int"), ("b", "string"), ("c", "date")]
    assert rows(out, "a") == [(None, None, None), (3, "x", None)]


def test_replace_groups_keeps_hand_set_columns(spark):
    old = spark.createDataFrame([(1, 10, "note"), (1, 11, None), (2, 20, "z")], "g int, k int, note string")
    new = spark.createDataFrame([(1, 10, None), (1, 12, "n")], "g int, k int, note string")
    assert rows(tables.replace_groups(old, new, ["g"], ["k"], ["note"]), "k") == [(1, 10, "note"), (1, 12, "n"), (2, 20, "z")]


def test_checked_overwrite_leaves_the_table_on_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1,), (2,)], "k int")
    tables.checked_overwrite(good, [lambda d: gates.unique_key(d, ["k"])], path)
    out = tables.checked_overwrite(good.union(good), [lambda d: gates.unique_key(d, ["k"])], path)
    assert not out.first().passed and spark.read.parquet(path).count() == 2


def test_gates_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k int")
    assert gates.unique_key(empty, ["k"]).first().passed
    assert not gates.not_all_null(empty, "k").first().passed
    assert not gates.share_at_least(empty, F.col("k") > 0, 0.5, "x").first().passed


def test_snapshot_detects_a_change(spark, tmp_path):
    path = str(tmp_path / "s")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.snapshot({"t": t}, path)
    assert tables.verify_snapshot(spark, path).first().ok
    t.where("k = 1").write.mode("overwrite").parquet(f"{path}/t")
    assert not tables.verify_snapshot(spark, path).first().ok


def test_devig_closed_forms(spark):
    a, b = F.lit(0.55), F.lit(0.50)
    mul, add, power = spark.range(1).select(fn.devig_multiplicative(a, b), fn.devig_additive(a, b), fn.devig_power(a, b)).first()
    assert abs(mul - 0.55 / 1.05) < 1e-12 and abs(add - 0.525) < 1e-12
    k = np.log(power) / np.log(0.55)
    assert abs(0.55**k + 0.50**k - 1) < 1e-9


def test_pmf_and_convolution_sum_to_one(spark):
    row = spark.range(1).select(fn.pmf_nb(F.lit(2.0), F.lit(4.0), 60).alias("p")).first()
    assert abs(sum(row.p) - 1) < 1e-9
    both = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75])], "a array<double>, b array<double>").select(fn.convolve(F.col("a"), F.col("b"), 2)).first()[0]
    assert np.allclose(both, [0.125, 0.5, 0.375])


def test_norm_cdf(spark):
    got = spark.range(1).select(fn.norm_cdf(F.lit(1.96)), fn.norm_cdf(F.lit(-1.0))).first()
    assert abs(got[0] - 0.9750021) < 1e-6 and abs(got[1] - 0.1586553) < 1e-6


def test_fits_recover_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    data = [(float(a), float(2 + 3 * a), float(rng.random() < 1 / (1 + np.exp(-(0.5 + a)))), float(rng.poisson(np.exp(0.3 + 0.5 * a)))) for a in x]
    df = spark.createDataFrame(data, "x double, y double, b double, c double")
    assert np.allclose(fit.weighted_least_squares(df, F.col("y"), [F.col("x")]), [2, 3], atol=1e-6)
    assert np.allclose(fit.logistic(df, F.col("b"), [F.col("x")]), [0.5, 1.0], atol=0.15)
    assert np.allclose(fit.count_regression(df, F.col("c"), [F.col("x")], 0.0), [0.3, 0.5], atol=0.1)


def test_bootstrap_is_deterministic_and_centred(spark):
    df = spark.createDataFrame([(float(i % 7), 1.0, i // 10) for i in range(500)], "x double, w double, block int")
    a = stats.block_bootstrap(df, "x", "w", "block", 200).agg(F.avg("mean")).first()[0]
    b = stats.block_bootstrap(df.repartition(7), "x", "w", "block", 200).agg(F.avg("mean")).first()[0]
    assert abs(a - b) < 1e-9 and abs(a - np.mean([i % 7 for i in range(500)])) < 0.1


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(3)
    facts = [(k, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(90)), rng.randrange(9)) for k in (1, 2) for _ in range(60)]
    daily = spark.createDataFrame(facts, "k int, day date, v int").groupBy("k", "day").agg(F.sum("v").alias("v"))
    asked = spark.createDataFrame([(k, datetime.date(2024, 1, 1) + datetime.timedelta(days=d)) for k in (1, 2, 3) for d in range(0, 100, 7)] * 2, "k int, cutoff date")
    got = {(x.k, x.cutoff): (x.s, x.s5) for x in asof.trailing_totals(asked, daily, ["k"], "cutoff", "day", 20, {"s": F.sum("v"), "s5": (5, F.sum("v"))}).collect()}
    expected = {}
    for k, cutoff in {(x.k, x.cutoff) for x in asked.collect()}:
        inside = lambda days: [v for kk, d, v in facts if kk == k and 0 < (cutoff - d).days <= days]  # noqa: B023, E731
        if inside(20):
            expected[k, cutoff] = (sum(inside(20)), sum(inside(5)) if inside(5) else None)
    assert got == expected


def test_centred_rate_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda y: datetime.date(y, 1, 1) + datetime.timedelta(days=rng.randrange(360))
    facts = [(w, y, day(y), float(rng.random() < 0.3), 1.0) for w in (1, 2, 3) for y in (2020, 2021, 2022) for _ in range(15)]
    asked = [(w, y, day(y)) for w in (1, 2, 4) for y in (2020, 2021, 2022) for _ in range(4)]
    f = spark.createDataFrame(facts, "who int, season int, day date, s double, n double")
    got = {(x.who, x.season, x.cutoff): x.value for x in rates.centred_rate(spark.createDataFrame(asked, "who int, season int, cutoff date"), f, "who", 10.0, (0.8, 0.6)).collect()}
    mean = lambda rows: sum(x[3] for x in rows) / len(rows) if rows else 0.0
    for w, y, cutoff in asked:
        now = [x for x in facts if x[1] == y and x[2] < cutoff]
        own = [x for x in now if x[0] == w]
        top, bottom = sum(x[3] for x in own) - len(own) * mean(now), len(own) + 10.0
        for lag, weight in ((1, 0.8), (2, 0.6)):
            before = [x for x in facts if x[1] == y - lag]
            mine = [x for x in before if x[0] == w]
            top, bottom = top + weight * (sum(x[3] for x in mine) - len(mine) * mean(before)), bottom + weight * len(mine)
        assert abs(got[w, y, cutoff] - top / bottom) < 1e-9


def test_versions_switch_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).toDF("k")
    assert tables.write_version(rows, path, []) and tables.current(spark, path).count() == 10
    assert not tables.write_version(rows.where("k < 5"), path, [lambda new: gates.no_shrink(tables.current(spark, path), new)])
    assert tables.current(spark, path).count() == 10
    assert tables.write_version(rows.union(rows), path, [lambda new: gates.no_shrink(tables.current(spark, path), new)]) and tables.current(spark, path).count() == 20
    with pytest.raises(Exception, match="boom"):
        tables.write_version(rows.select(F.raise_error(F.lit("boom")).alias("k")), path, [])
    assert tables.current(spark, path).count() == 20


def test_reliability_bins_are_equal_counts(spark):
    for values in ([0.5] * 100, [i / 1000 for i in range(1000)], [0.1, 0.1, 0.9] * 7):
        rows = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(values)], "i int, p double, y double").repartition(3)
        out = sorted((x.bin, x.n) for x in stats.reliability(rows, "p", "y", ["i"]).collect())
        assert [b for b, _ in out] == list(range(10)) and max(n for _, n in out) - min(n for _, n in out) <= 1


def test_draws_are_even(spark):
    out = spark.range(20000).select((stats.drawn(3, F.col("id") % 200, F.floor(F.col("id") / 200)) % 10).alias("x")).groupBy("x").count().collect()
    assert len(out) == 10 and all(1700 < x["count"] < 2300 for x in out)


def test_season_source_fails_without_facts(spark):
    rows = spark.createDataFrame([(None, 2020)], "game_id int, season int")
    with pytest.raises(FileNotFoundError):
        landed.season_frame(rows, 2021, ["game_id"])
    with pytest.raises(ValueError, match="game_id"):
        landed.season_frame(rows, 2020, ["game_id"])
