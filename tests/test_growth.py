"""Queries whose work must follow their tables: what is asked once, read once, and how many partitions a shuffle has."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from pitsports.operators import rates, tables
from pitsports.plans import base, leak_queries, registry
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weather_has_no_row_for_each_hour_of_a_game(spark):
    aggregates = [line for line in _plan(registry.QUERIES["survey_op38_game_weather"](spark, SF)).splitlines() if "Aggregate" in line]
    assert aggregates and not any("o_orderkey" in line or "game_id" in line for line in aggregates)


def test_projection_is_worked_out_once_a_question(spark):
    windows = [line for line in _plan(registry.QUERIES["survey_op15_projected_starters"](spark, SF)).splitlines() if "Window" in line and "n_same" in line]
    assert windows and all("windowspecdefinition(bat_team" in line and "windowspecdefinition(game_id" not in line for line in windows)


def test_translation_reads_the_facts_once(spark):
    for name in ("survey_op28_translation", "survey_op28_rookie_adjustment"):
        asked = []
        with base.overridden(lineitem=lambda rows: asked.append(1) or rows):
            plan = _plan(registry.QUERIES[name](spark, SF))
        assert len(asked) == 1 and "l_partkey" not in plan


def test_leak_test_joins_the_facts_once(spark):
    asked = []
    with base.overridden(lineitem=lambda rows: asked.append(1) or rows):
        out = leak_queries.leaks(spark, SF, leak_queries.RATES[:2]).collect()
    assert len(asked) == 1 and all(x.changed == 0 for x in out)


def test_sessions_have_partitions_for_their_tables(spark, monkeypatch):
    assert base.sized(spark, SF) is spark
    monkeypatch.setattr(base, "PART", 4 << 10)
    before = spark.conf.getAll
    own = base.sized(spark, SF)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) > 4 and spark.conf.getAll == before
    assert own.conf.get("spark.sql.session.timeZone") == "UTC" and own.conf.get("spark.checkpoint.dir") == spark.conf.get("spark.checkpoint.dir")
    small = registry.QUERIES["survey_op16_actual_lineup"]
    assert small(spark, SF).sparkSession.conf.get("spark.sql.shuffle.partitions") == own.conf.get("spark.sql.shuffle.partitions")
    assert small(spark, SF).groupBy("slot").count().orderBy("slot").collect()[0]["count"] == base.pitches(spark, SF).select("game_id", "bat_team").distinct().count()


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for d in dirs for x in Path(str(d)).rglob("shuffle_*.data")}


def test_tidy_sessions_leave_no_shuffle_files(spark):
    for session, stay in ((spark, True), (tables.tidy(spark), False)):
        before = _shuffle_files(spark)
        rows = tables.settled(session.range(10000).groupBy((F.col("id") % 1000).alias("k")).count(), spark)
        until = time.time() + 10
        while not stay and _shuffle_files(spark) - before and time.time() < until:  # they go in the background
            time.sleep(0.1)
        assert bool(_shuffle_files(spark) - before) == stay
        assert rows.sparkSession is spark and rows.count() == 1000


def test_assembly_settles_its_feature_rows(spark):
    asked = []
    with base.overridden(lineitem=lambda rows: asked.append(1) or rows):
        plan = _plan(registry.QUERIES["jn2_full_assembly"](spark, SF))
    assert len(asked) == 1 and plan.count("Join LeftOuter") == 10
    assert not any(word in plan for word in ("Window", "Aggregate", "Generate", "l_orderkey"))


def test_queries_over_all_facts_run_in_sized_sessions(spark, monkeypatch):
    monkeypatch.setattr(base, "PART", 4 << 10)
    wanted = base.sized(spark, SF).conf.get("spark.sql.shuffle.partitions")
    assert int(wanted) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("survey_op33_batter_form", "survey_op10_starter_row", "dq_domain_gates", "dq1_dq3_dq20_gates", "survey_op1_decayed_shrunk_rate"):
        conf = registry.QUERIES[name](spark, SF).sparkSession.conf
        assert conf.get("spark.sql.shuffle.partitions") == wanted and conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == base.JOINED


def test_sized_sessions_read_files_in_small_splits(spark, monkeypatch):
    monkeypatch.setattr(base, "PART", 4 << 10)
    monkeypatch.setattr(base, "READ", 8 << 10)
    size = Path(f"{SF}/lineitem.parquet").stat().st_size
    lines = base.table(base.sized(spark, SF), SF, "lineitem")
    assert lines.rdd.getNumPartitions() >= size // base.READ > 1
    assert base.table(spark, SF, "lineitem").rdd.getNumPartitions() < size // base.READ
    assert lines.count() == base.table(spark, SF, "lineitem").count()


def _settled_tables(spark):
    return {x for x in Path(tables.scratch(spark)).parent.iterdir() if x.is_dir()}


def test_leak_test_keeps_one_build_on_disk(spark):
    files, settled = _shuffle_files(spark), _settled_tables(spark)
    out = leak_queries.leaks(spark, SF, [leak_queries.PITCHING[0], leak_queries.BATTING[0]]).collect()
    assert all(x.rows > 0 and x.changed == 0 for x in out)
    assert len(_settled_tables(spark) - settled) <= 5  # the facts and appearances as given and as changed, and the days of games
    until = time.time() + 10
    while _shuffle_files(spark) - files and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not _shuffle_files(spark) - files


def test_passing_tables_go_and_lasting_ones_stay(spark):
    before = _settled_tables(spark)
    with tables.passing(spark):
        assert tables.settled(spark.range(3)).count() == 3
        with tables.lasting():
            kept = tables.settled(spark.range(5))
        assert len(_settled_tables(spark) - before) == 2
    assert len(_settled_tables(spark) - before) == 1 and kept.count() == 5


def test_appearances_have_no_window_for_each_pitcher_of_a_game(spark):
    plan = base.appearances_of(base.pitches(spark, SF))._jdf.queryExecution().analyzed().toString()
    specs = [x.split("specifiedwindowframe")[0] for x in plan.split("windowspecdefinition(")[1:]]
    assert len(specs) >= 2 and all(x.count(" ASC") == x.count("who#") for x in specs)  # by who they are sorted only


def test_segment_mix_settles_appearances_and_starters_rows(spark):
    plan = _plan(registry.QUERIES["survey_op29_segment_mix"](spark, SF))
    assert "l_orderkey" not in plan and "Window" not in plan and "Generate" not in plan


def test_lineup_features_join_facts_and_games_once(spark):
    plan = _plan(registry.QUERIES["survey_op14_lineup_features"](spark, SF))
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_stuff_rates_settle_the_pool(spark):
    plan = _plan(registry.QUERIES["survey_op26_stuff_rates"](spark, SF))
    assert "l_orderkey" not in plan and "Generate" not in plan


def test_large_sessions_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(base, "PART", 4 << 10)
    own = base.sized(spark, SF)
    assert all(own.conf.get(key) == value for key, value in tables.TIDY.items()) and base.sized(own, SF) is own
    rows = own.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    for _ in range(2):  # rows can be asked for again after their files went
        assert len(rows.collect()) == 10
        time.sleep(0.5)


def test_rates_of_repeated_questions_and_days(spark):
    q = spark.sql("SELECT 1 AS who, 2000 AS season, DATE '2000-05-02' AS cutoff, x FROM VALUES ('a'), ('b') AS t(x) UNION ALL SELECT NULL, 2000, DATE '2000-05-02', 'c'")
    f = spark.sql("SELECT * FROM VALUES (1, 2000, DATE '2000-05-01', 2.0D, 1), (1, 2000, DATE '2000-05-01', 3.0D, 1), (1, 2000, DATE '2000-05-02', 9.0D, 1), (1, 1998, DATE '1998-05-02', 4.0D, 2), (NULL, 2000, DATE '2000-05-01', 7.0D, 1) AS t(who, season, day, s, n)")
    out = {x.x: x for x in rates.decayed_rates(q, f, {"s": (10.0, 1.5)}).collect()}
    want = (5.0 + 0.6 * 4.0 + 10 * 1.5) / (2 + 0.6 * 2 + 10)
    assert abs(out["a"].s - want) < 1e-12 and out["b"].s == out["a"].s and not out["a"].rookie
    assert out["c"].rookie and out["c"].s == 1.5
