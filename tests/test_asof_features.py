"""Streams with state, the leak test, the stored grid, and counts over blocks, against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitsports.operators import asof, rates, tables
from pitsports.plans import base, leak_queries, pitching_queries
from pitsports.plans.base import QUERIES, pitches
from pitsports.streaming import jobs
from tests.conftest import SF

D = dt.date


def running(rows):
    """{(key, day): total} of (key, day, n) rows."""
    out = {}
    for key in {k for k, _, _ in rows}:
        total = 0
        for day in sorted({d for k, d, _ in rows if k == key}):
            total += sum(n for k, d, n in rows if (k, d) == (key, day))
            out[key, day] = total
    return out


def test_totals_in_state_patch_late_days_and_survive_restarts(spark, tmp_path):
    rng = random.Random(2)
    source, path, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    seen = []
    days = [(10, 12), (1, 9), (5, 20), (12, 12), (0, 0)]  # on time, all late, mixed, the last day again, before the first
    for low, high in days:
        rows = [(rng.choice("abc"), rng.randint(low, high), rng.randint(1, 5)) for _ in range(12)]
        seen += rows
        spark.createDataFrame(rows, "k string, day int, n long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, day int, n long").parquet(source)
        jobs.running_totals_stream(stream, "k", "day", ["n"], path, mark).awaitTermination()
        got = {(r.k, r.day): r.cum_n for r in jobs.latest_rows(spark, path, ["k", "day"]).collect()}
        assert got == running(seen)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    latest = lambda old, new: tables.merge_latest(old, new, ["k"], [F.col("v")])
    jobs.change_buckets(path, 0, rows, ["k"], latest, rows.schema, 8)
    before = jobs.versions(spark, path)
    one = rows.where("k = 7").withColumn("v", F.lit(2))
    for _ in range(2):  # a batch that is run again gives the same table
        jobs.change_buckets(path, 1, one, ["k"], latest, rows.schema, 8)
        after = jobs.versions(spark, path)
        assert sum(after[b] != before[b] for b in before) == 1
        assert {r.k: r.v for r in jobs.merged_table(spark, path).collect()} == {k: 2 if k == 7 else 1 for k in range(100)}
    jobs.change_buckets(path, 2, rows.limit(0), ["k"], latest, rows.schema, 8)
    assert jobs.merged_table(spark, path).count() == 100
    assert jobs.merged_table(spark, f"{tmp_path}/none") is None


def test_moved_games_redate_facts_before_and_after(spark, tmp_path):
    facts_in, moves_in, path, mark = (f"{tmp_path}/{x}" for x in ("f", "m", "t", "c"))
    facts = lambda rows: spark.createDataFrame(rows, "g long, i int, day date").coalesce(1).write.mode("append").parquet(facts_in)
    moves = lambda rows: spark.createDataFrame(rows, "g long, to date").coalesce(1).write.mode("append").parquet(moves_in)

    def run():
        a = spark.readStream.schema("g long, i int, day date").parquet(facts_in)
        b = spark.readStream.schema("g long, to date").parquet(moves_in)
        jobs.dated_stream(a, b, path, mark, "g", "day", "to", ["g", "i"], [F.col("day")]).awaitTermination()
        return {(r.g, r.i): r.available for r in jobs.merged_table(spark, f"{path}/facts").collect()}

    facts([(1, 1, D(2024, 4, 1)), (1, 2, D(2024, 4, 1)), (2, 1, D(2024, 4, 2))])
    moves([(3, D(2024, 9, 1))])
    assert run() == {(1, 1): D(2024, 4, 1), (1, 2): D(2024, 4, 1), (2, 1): D(2024, 4, 2)}
    moves([(1, D(2024, 8, 1))])  # months after the facts were written
    facts([(3, 1, D(2024, 4, 3))])  # after its move
    assert run() == {(1, 1): D(2024, 8, 1), (1, 2): D(2024, 8, 1), (2, 1): D(2024, 4, 2), (3, 1): D(2024, 9, 1)}
    moves([(1, D(2024, 8, 5))])
    facts([(2, 1, D(2024, 4, 9))])  # a replay with a later day
    assert run() == {(1, 1): D(2024, 8, 5), (1, 2): D(2024, 8, 5), (2, 1): D(2024, 4, 9), (3, 1): D(2024, 9, 1)}


def test_leak_test_catches_queries_that_leak(spark):
    def by_game_date(spark, sf):  # counts facts from the day of the game, not from the day on which they were known
        p = pitches(spark, sf)
        daily = p.groupBy("pitcher_id", "season", F.col("date").alias("day")).agg(F.count("*").alias("n"))
        run = asof.running_totals(daily, ["pitcher_id", "season"], "day", {"n": F.col("n")}).select("pitcher_id", "season", "day", "cum_n")
        return asof.asof_join(p.select("pitcher_id", "season", F.col("date").alias("cutoff")).distinct(), run, ["pitcher_id", "season"], "cutoff", "day").withColumn("cutoff", F.col("cutoff").cast("string"))

    def whole_season(spark, sf):  # a mean over the season that the game is in
        p = pitches(spark, sf)
        return p.select("game_id", "fld_team", "season").distinct().join(p.groupBy("season").agg(F.avg("velo").alias("v")), "season")

    for name, f in (("leaks_by_date", by_game_date), ("leaks_by_season", whole_season)):
        QUERIES[name] = f
    try:
        builds = [leak_queries.Build("leaks_by_date", ["pitcher_id", "season", "cutoff"], ["cum_n"], day="cutoff"), leak_queries.Build("leaks_by_season", ["game_id", "fld_team"], ["v"])]
        assert all(r.changed > 0 for r in leak_queries.leaks(spark, SF, builds).collect())
    finally:
        del QUERIES["leaks_by_date"], QUERIES["leaks_by_season"]
    assert not base._changes


def test_later_versions_of_the_grid_change_no_earlier_row(spark, tmp_path):
    p, path = pitches(spark, SF), f"{tmp_path}/grid"
    first = pitching_queries.stored_grid(p, path)
    rows = lambda v: sorted(map(tuple, pitching_queries.framing(p, tables.current(spark, path, v)).collect()), key=repr)
    before = rows(first)
    second = pitching_queries.stored_grid(p, path, (1995, 1996, 1997))
    assert second == first + 1 and rows(first) == before and rows(second) != before
    assert tables.current(spark, path, first).count() == 8 * 11 * 9  # every cell, seen or not


def test_two_scale_grid_by_hand(spark):
    import math

    cells = spark.createDataFrame([(1, 0, 0, 3.0, 4.0), (1, 2, 1, 1.0, 5.0)], "g int, x int, z int, s double, n double")
    got = {(r.x, r.z): r.p for r in rates.two_scale_grid(cells, ["g"], "x", "z", "s", "n", (4, 2), fine=0.5, wide=1.0, pull_fine=2.0, pull_wide=0.5).collect()}

    def blurred(sigma, at, value):
        reach = math.ceil(4 * sigma)
        w = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}
        total = sum(w.values())
        return sum(v[value] * w.get(at[0] - x, 0) / total * w.get(at[1] - z, 0) / total for (x, z), v in {(0, 0): (3, 4), (2, 1): (1, 5)}.items())

    for at in [(x, z) for x in range(4) for z in range(2)]:
        wide = (blurred(1.0, at, 0) + 0.5 * 4 / 9) / (blurred(1.0, at, 1) + 0.5)
        assert got[at] == pytest.approx((blurred(0.5, at, 0) + 2 * wide) / (blurred(0.5, at, 1) + 2), abs=1e-12)


def test_counts_and_sequences_over_blocks(spark):
    rng = random.Random(1)
    days = [("a", D(2020, 1, 1) + dt.timedelta(rng.randrange(1500)), i) for i in range(60)] + [("b", D(2021, 5, 5), 100), ("b", D(2021, 5, 5), 101)]
    facts = spark.createDataFrame(days, "k string, day date, i int").withColumn("y", F.year("day"))
    got = {r.i: r.seq for r in asof.sequence_in_blocks(facts, ["k"], "y", [F.col("day"), F.col("i")]).collect()}
    for k in "ab":
        ordered = sorted((d, i) for kk, d, i in days if kk == k)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    asked = [(k, D(2019, 1, 1) + dt.timedelta(n)) for k in "abc" for n in range(0, 2400, 97)] + [("b", D(2021, 5, 5))]
    q = spark.createDataFrame(asked, "k string, at date").withColumn("y", F.year("at"))
    out = {(r.k, r.at): r.n for r in asof.count_before(q, facts, ["k"], "y", "at", "day", "n").collect()}
    assert out == {(k, at): sum(kk == k and d < at for kk, d, _ in days) for k, at in asked}


def test_versions_are_claimed_once(spark, tmp_path):
    path = f"{tmp_path}/v"
    a = spark.range(3)
    assert tables.write_version(a, path, []) and tables.newest_version(spark, path) == 1
    (tmp_path / "v" / "_claims" / "2").touch()  # another writer is at work on version 2
    assert tables.write_version(spark.range(5), path, []) and tables.newest_version(spark, path) == 3
    assert tables.current(spark, path).count() == 5 and tables.current(spark, path, 1).count() == 3


def test_pool_follows_the_work(spark):
    """Spells of relievers are no more than the changes, and overlaps give each common day once."""
    from pitsports.operators import asof
    from pitsports.plans import base, pitching_queries

    a = base.appearances(base.pitches(spark, SF)).persist()
    used = pitching_queries.relievers_used(a).count()
    spells = pitching_queries.pool_spells(a).persist()
    assert used <= spells.count() <= 4 * used
    asked = a.where("not started").selectExpr("fld_team", "who", "explode(sequence(1, 30)) as n", "unix_date(day) as day").selectExpr("fld_team", "who", "day + n as at").distinct()
    days = spells.selectExpr("fld_team", "who", "explode(sequence(since, until - 1)) as at")
    assert days.count() == asked.count() == days.join(asked, ["fld_team", "who", "at"]).count()
    left, right = (spark.createDataFrame(x, f"k int, since int, until int, {n} string") for x, n in (([(1, -5, 70, "x"), (2, 3, 4, "y")], "a"), ([(1, -9, 0, "p"), (1, 31, 33, "q"), (1, 69, 90, "r"), (2, 4, 5, "s"), (2, 0, 0, "t")], "b")))
    out = asof.overlaps(left, right, ["k"]).selectExpr("k", "a", "b", "explode(sequence(since, until - 1)) as at").collect()
    assert sorted((x.b, x["at"]) for x in out) == [*(("p", d) for d in range(-5, 0)), ("q", 31), ("q", 32), ("r", 69)]


@pytest.mark.parametrize("name", ["str1_stream_merge_latest", "str2_late_facts"])
def test_batches_are_written_by_many_tasks(spark, monkeypatch, name):
    """A batch of a stream is no single file, so no task reads or writes it whole."""
    import pathlib

    from pitsports.plans import game_queries, table_queries

    paths = []
    for module in (game_queries, table_queries):
        made = module._scratch
        monkeypatch.setattr(module, "_scratch", lambda s, made=made: paths.append(made(s)) or paths[-1])
    with base.overridden(lineitem=lambda rows: rows.repartition(5)):
        QUERIES[name](spark, SF)
    assert len(list(pathlib.Path(paths[0].removeprefix("file:")).glob("*.parquet"))) > 3
