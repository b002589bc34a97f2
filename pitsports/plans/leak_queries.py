"""The leak test: any registered as-of query is built twice, on the given tables and on tables whose later facts are changed.

Facts that became known on or after a day are perturbed: all their measures change, and of those that neither decide who
started nor who caught a game some are taken away, so that counts change too. Rows about games up to that day must not change.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsports.operators import gates, tables
from pitsports.plans import asof_queries, composite_queries, domain_queries, pitching_queries, team_queries  # noqa: F401  (the builds)
from pitsports.plans.base import ORACLE_SQL, QUERIES, appearances_of, overridden, pitches, query, table

DAY = "1997-06-01"


@dataclass(frozen=True)
class Build:
    """A query, its keys, its values (numbers and others), and how a row's day is found: a column of the row, ``game`` (the
    game's date) or ``season`` (up to the day's year)."""

    name: str
    keys: Sequence[str]
    numbers: Sequence[str]
    others: Sequence[str] = ()
    day: str = "game"


RATES = [
    Build("survey_op1_decayed_shrunk_rate", ["pitcher_id", "season", "cutoff"], ["rate"], day="cutoff"),
    Build("survey_op19_factor_by_side", ["season", "venue_id", "side"], ["n", "log_factor"], day="season"),
    Build("survey_op22_centred_pooled_residual", ["pitcher_id", "season", "cutoff"], ["effect"], day="cutoff"),
    Build("survey_op23_catcher_framing", ["game_id", "fld_team"], ["catcher_id", "frm_runs"], ["frm_missing"]),
    Build("survey_op35_umpire_season_stats", ["umpire", "season", "cutoff"], ["n", "accuracy_pct", "favour", "k_boost", "bb_boost"], day="cutoff"),
]
PITCHING = [
    Build("survey_op6_starter_history", ["game_id", "fld_team"], ["pitcher_id", "starts", "bf", "last_bf", "rest", "prior_starts"]),
    Build("survey_op12_reliever_availability", ["game_id", "fld_team"], ["pitches_3d", "back_to_back", "closer_id", "era_15d", "era_season"], ["unavailable", "closer_available"]),
    Build("survey_op7_team_hook", ["game_id", "fld_team"], ["hook"]),
    Build("survey_op10_starter_row", ["game_id", "fld_team"], ["starter_id", "skill", "velo_delta", "exp_bf", "share_f5", "third_time"], ["rookie", "rest_bucket", "opener"]),
    Build("survey_op11_bullpen_pool", ["game_id", "fld_team"], ["pool", "available", "worked_yesterday", "skill_late", "skill_all"]),
    Build("survey_op26_stuff_rates", ["game_id", "fld_team"], ["sp_stuff", "pen_stuff"]),
    Build("survey_op34_pitcher_form", ["pitcher_id", "day"], ["n", "velo", "whiff_pct", "gb_pct", "velo_trend", "days_rest", "last_outing"], day="day"),
]
BATTING = [
    Build("survey_op5_contact_quality", ["batter_id", "season", "cutoff"], ["contact"], day="cutoff"),
    Build("survey_op14_lineup_features", ["game_id", "bat_team"], ["n", "strength", "k_bb", "platoon", "rookies"]),
    Build("survey_op15_projected_starters", ["game_id", "bat_team", "batter_id"], ["share", "slot", "pool"]),
    Build("survey_op17_environment", ["game_id", "bat_team"], ["park_factor", "temp_f", "level", "team_off", "team_def"], ["new_park"]),
    Build("survey_op32_team_form", ["game_id", "team"], ["wins", "losses", "run_diff", "run_diff_last_10", "games_back"], ["record", "record_last_10", "decided"]),
    Build("survey_op33_batter_form", ["batter_id", "day"], ["n", "value", "season_n", "season_value"], day="day"),
]


def perturbed(spark: SparkSession, sf: str, day: str = DAY) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Functions that change the later facts of the tables ``lineitem`` and ``orders``."""
    cut = F.lit(day).cast("date")
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("_made"))

    def lines(line: DataFrame) -> DataFrame:
        side = Window.partitionBy("l_orderkey", "l_linestatus")
        first = F.min(F.struct("l_linenumber", "l_suppkey")).over(side)
        x = line.join(made, "l_orderkey").withColumns({"_first": F.struct("l_linenumber", "l_suppkey") == first, "_least": F.min("l_partkey").over(side), "_late": F.greatest("_made", F.to_date("l_shipdate")) >= cut})
        spare = F.col("_late") & (F.col("l_linenumber") >= 5) & (F.col("l_linenumber") % 2 == 1) & ~F.col("_first") & (F.col("l_partkey") > F.col("_least"))
        late = lambda c: F.when(F.col("_late"), c)
        changed = {
            "l_quantity": late(51 - F.col("l_quantity")).otherwise(F.col("l_quantity")),
            "l_extendedprice": late(F.col("l_extendedprice") * 3 + 1).otherwise(F.col("l_extendedprice")),
            "l_discount": late(0.1 - F.col("l_discount")).otherwise(F.col("l_discount")),
            "l_tax": late(0.08 - F.col("l_tax")).otherwise(F.col("l_tax")),
            "l_returnflag": late(F.when(F.col("l_returnflag") == "R", "A").otherwise("R")).otherwise(F.col("l_returnflag")),
        }
        return x.where(~spare).withColumns(changed).select(*line.columns)

    def orders(o: DataFrame) -> DataFrame:
        late = F.to_date("o_orderdate") >= cut
        return o.withColumn("o_totalprice", F.when(late, F.col("o_totalprice") * 2 + 7).otherwise(F.col("o_totalprice")))

    return {"lineitem": lines, "orders": orders}


def _settled(spark: SparkSession, sf: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Functions that give the settled ``pitches`` of the tables as they are now, and their appearances, settled when first asked for."""
    p = tables.settled(pitches(spark, sf))

    @cache
    def a() -> DataFrame:
        with tables.lasting():
            return tables.settled(appearances_of(p.repartition("game_id")))

    return {"pitches": lambda _: p, "appearances": lambda _: a()}


def leaks(spark: SparkSession, sf: str, builds: Sequence[Build], day: str = DAY) -> DataFrame:
    """For each build the rows about days up to ``day`` that both builds have, and how many of them changed. The facts, as given
    and as changed, and their appearances are settled once for all builds. The rows of the first build are settled before the
    second begins, and what a build has settled goes with it: on disk are the facts and one build at a time, not all of them."""
    own = tables.tidy(spark)
    dates = tables.settled(table(own, sf, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("_date")).where(F.col("_date") <= day))
    given, changes, rows = _settled(own, sf), perturbed(own, sf, day), []
    with overridden(**changes):
        changed = _settled(own, sf)
    for b in builds:  # a step each
        with tables.passing(own):
            with overridden(**given):
                before = QUERIES[b.name](own, sf).select(*b.keys, *b.numbers, *b.others)
            if b.day == "game":
                before = before.join(dates.select("game_id"), "game_id")
            else:
                before = before.where(F.col(b.day) <= (int(day[:4]) if b.day == "season" else day))
            before = tables.settled(before)
            with overridden(**changes, **changed):
                after = QUERIES[b.name](own, sf)
            rows.append((b.name, *gates.changed_rows(before, after, b.keys, b.numbers, b.others).first()))
    return spark.createDataFrame(rows, "build string, rows long, changed long")


PERTURBED_SQL = f"""
lineitem_p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN late THEN 51 - l_quantity ELSE l_quantity END AS l_quantity, CASE WHEN late THEN l_extendedprice * 3 + 1 ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN late THEN 0.1 - l_discount ELSE l_discount END AS l_discount, CASE WHEN late THEN 0.08 - l_tax ELSE l_tax END AS l_tax, CASE WHEN NOT late THEN l_returnflag WHEN l_returnflag = 'R' THEN 'A' ELSE 'R' END AS l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT l.*, greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= DATE '{DAY}' AS late, min((l_linenumber, l_suppkey)) OVER s = (l_linenumber, l_suppkey) AS starts, min(l_partkey) OVER s AS least FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WINDOW s AS (PARTITION BY l_orderkey, l_linestatus))
  WHERE NOT (late AND l_linenumber >= 5 AND l_linenumber % 2 = 1 AND NOT starts AND l_partkey > least)),
orders_p AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{DAY}' THEN o_totalprice * 2 + 7 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders), """


def _leak_sql(b: Build) -> str:
    before = ORACLE_SQL[b.name]
    after = re.sub(r"\b(lineitem|orders)\b", r"\1_p", before).strip()
    after = "WITH " + PERTURBED_SQL + after.removeprefix("WITH ")
    differs = [f"coalesce(abs(a.{c} - b.{c}) > 1e-6, (a.{c} IS NULL) <> (b.{c} IS NULL))" for c in b.numbers] + [f"a.{c} IS DISTINCT FROM b.{c}" for c in b.others]
    until = {"game": f"(SELECT CAST(any_value(o_orderdate) AS DATE) FROM orders WHERE o_orderkey = a.game_id) <= DATE '{DAY}'", "season": f"a.season <= {DAY[:4]}"}.get(b.day, f"a.{b.day} <= '{DAY}'")
    return f"SELECT '{b.name}' AS build, count(*) AS rows, count(*) FILTER (WHERE {' OR '.join(differs)}) AS changed FROM ({before}) a JOIN ({after}) b USING ({', '.join(b.keys)}) WHERE {until}"


def _register(name: str, builds: Sequence[Build]) -> None:
    @query(name, " UNION ALL ".join(map(_leak_sql, builds)))
    def leak(spark, sf):
        return leaks(spark, sf, builds)


_register("survey_op61_leak_test", RATES)
_register("survey_op61_leak_test_pitching", PITCHING)
_register("survey_op61_leak_test_batting", BATTING)
