"""Landed files, guarded writes, scalar kernels and the gates around them, each over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsports.functions import columns as fn
from pitsports.operators import asof, gates, tables
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, games, pitches, query, r, table, team_games
from pitsports.plans.table_queries import _scratch
from pitsports.sources import landed


# sources


@query("src1_season_scan", f"{WITH_GAMES} SELECT season, count(*) AS n, count(note) AS noted FROM (SELECT season, CASE WHEN season >= 1996 AND game_id % 3 = 0 THEN 'late' END AS note FROM games WHERE season BETWEEN 1994 AND 1997) GROUP BY season")
def season_scan(spark, sf):
    """Season partitions of two layouts (older ones lack a column), read by name, pruned to some seasons."""
    path, g = _scratch(spark), games(spark, sf)
    g.where("season < 1996").select("game_id", "season").write.partitionBy("season").parquet(path)
    noted = g.where("season >= 1996").select("game_id", "season", F.when(F.col("game_id") % 3 == 0, "late").alias("note"))
    noted.write.mode("append").partitionBy("season").parquet(path)
    schema = T.StructType.fromDDL("game_id long, note string, season int")
    return landed.scan_seasons(spark, path, schema, [1994, 1995, 1996, 1997]).groupBy("season").agg(F.count("*").alias("n"), F.count("note").alias("noted"))


@query("src2_csv_inputs", "SELECT 'customer' AS name, count(*) AS n, count(c_mktsegment) AS texts FROM customer UNION ALL SELECT 'supplier', count(*), count(s_name) FROM supplier UNION ALL SELECT 'part', count(*), count(p_type) FROM part UNION ALL SELECT 'forecast', 0, 0")
def csv_inputs(spark, sf):
    """Required and optional CSV inputs: a required one must be there, a missing optional one is an empty typed frame."""
    path = _scratch(spark)
    schemas = {"customer": "c_custkey long, c_mktsegment string", "supplier": "s_suppkey long, s_name string", "part": "p_partkey long, p_type string"}
    for name, ddl in schemas.items():
        table(spark, sf, name).select(*T.StructType.fromDDL(ddl).names).write.option("header", True).csv(f"{path}/{name}")
    schemas["forecast"] = "game_id long, temp string"
    out = None
    for name, ddl in schemas.items():
        schema = T.StructType.fromDDL(ddl)
        one = landed.scan_csv(spark, f"{path}/{name}", schema, optional=name == "forecast").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count(schema.names[1]).alias("texts"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src6_split_by_table", "SELECT 'line' AS kind, sum(l_orderkey) AS keys, CAST(round(sum(l_extendedprice)) AS BIGINT) AS price FROM lineitem UNION ALL SELECT 'order', sum(o_orderkey), CAST(round(sum(o_totalprice)) AS BIGINT) FROM orders")
def split_by_table(spark, sf):
    """One gzip CSV with rows of two tables, told apart by a discriminator column, each with its own types."""
    path = _scratch(spark)
    line = table(spark, sf, "lineitem").select(F.lit("line").alias("table"), F.col("l_orderkey").alias("key"), F.col("l_extendedprice").cast("string").alias("price"), F.col("l_returnflag").alias("flag"))
    order = table(spark, sf, "orders").select(F.lit("order").alias("table"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.lit(None).cast("string").alias("flag"))
    line.unionByName(order).write.option("header", True).option("compression", "gzip").csv(path)
    raw = landed.scan_csv(spark, path, T.StructType.fromDDL("table string, key string, price string, flag string"))
    parts = landed.split_by(raw, "table", {"line": T.StructType.fromDDL("key long, price double, flag string"), "order": T.StructType.fromDDL("key long, price double")})
    sums = lambda name: parts[name].agg(F.lit(name).alias("kind"), F.sum("key").alias("keys"), F.round(F.sum("price")).cast("long").alias("price"))
    return sums("line").unionByName(sums("order"))


@query("src7_typed_text", "SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer")
def typed_text(spark, sf):
    """Delimited lines of text with a header: split, empty fields to null, cast."""
    path = _scratch(spark)
    c = table(spark, sf, "customer")
    cell = F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).otherwise("")
    c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), cell).alias("value")).unionByName(spark.range(1).select(F.lit("key|balance|segment").alias("value"))).write.text(path)
    part = lambda i: F.nullif(F.split_part("value", F.lit("|"), F.lit(i)), F.lit(""))
    rows = spark.read.text(path).where(~F.col("value").startswith("key|"))
    return rows.select(part(1).cast("long").alias("c_custkey"), part(2).cast("double").alias("c_acctbal"), part(3).alias("segment"))


@query(
    "src10_game_results",
    f"""{WITH_PITCHES}, i AS (SELECT game_id, half, pitch_no AS num, CAST(sum(velo) AS BIGINT) AS runs, min(pitcher_id) AS p FROM pitches GROUP BY ALL),
g AS (SELECT game_id, CAST(coalesce(sum(runs) FILTER (WHERE half = 'F'), 0) AS BIGINT) AS home, CAST(coalesce(sum(runs) FILTER (WHERE half = 'O'), 0) AS BIGINT) AS away, CASE WHEN count(DISTINCT num) FILTER (WHERE num <= 5) = 5 THEN CAST(sum(runs) FILTER (WHERE num <= 5) AS BIGINT) END AS f5, arg_min(p, (num, p)) AS starter FROM i GROUP BY game_id)
SELECT game_id, home, away, f5, CASE WHEN home > away THEN 'home' WHEN away > home THEN 'away' END AS winner, starter, 'U' || (game_id % 7) AS umpire FROM g""",
)
def game_results(spark, sf):
    """A document for each game, read back with higher-order functions: score, winner, first five, first pitcher, plate umpire."""
    i = pitches(spark, sf).groupBy("game_id", "half", F.col("pitch_no").alias("num")).agg(F.sum("velo").cast("long").alias("runs"), F.min("pitcher_id").alias("p"))
    person = lambda name: F.concat(F.lit(name), (F.col("game_id") % 7).cast("string")).alias("name")
    officials = F.array(F.struct(F.lit("First Base").alias("type"), person("B")), F.struct(F.lit("Home Plate").alias("type"), person("U"))).alias("officials")
    docs = i.groupBy("game_id").agg(F.collect_list(F.struct("num", "half", "runs", "p")).alias("innings")).select("game_id", F.to_json(F.struct("innings", officials)).alias("doc"))
    back = docs.select("game_id", F.from_json("doc", "innings array<struct<num:int,half:string,runs:bigint,p:bigint>>, officials array<struct<type:string,name:string>>").alias("d"))
    total = lambda keep: F.aggregate(F.filter("d.innings", keep), F.lit(0).cast("long"), lambda acc, x: acc + x["runs"])
    home, away = total(lambda x: x["half"] == "F"), total(lambda x: x["half"] == "O")
    five = F.size(F.array_distinct(F.transform(F.filter("d.innings", lambda x: x["num"] <= 5), lambda x: x["num"]))) == 5
    first = F.array_min(F.transform("d.innings", lambda x: F.struct(x["num"].alias("num"), x["p"].alias("p"))))
    plate = F.get(F.filter("d.officials", lambda x: x["type"] == "Home Plate"), F.lit(0))["name"]
    return back.select(
        "game_id", home.alias("home"), away.alias("away"), F.when(five, total(lambda x: x["num"] <= 5)).alias("f5"), F.when(home > away, "home").when(away > home, "away").alias("winner"), first["p"].alias("starter"), plate.alias("umpire")
    )


@query("src15_reliever_lines", f"{WITH_PITCHES} SELECT game_id, half, pitcher_id, count(*) AS bf FROM pitches WHERE pitch_no > 1 GROUP BY ALL")
def reliever_lines(spark, sf):
    """Both sides' players as maps in one document; only those with a pitching line become rows."""
    p = pitches(spark, sf)
    line = p.where("pitch_no > 1").groupBy("game_id", "half", "pitcher_id").agg(F.count("*").alias("bf"))
    key = lambda c: F.concat(F.lit("ID"), F.col(c).cast("string"))
    some = line.select("game_id", "half", key("pitcher_id").alias("k"), F.struct(F.struct("bf").alias("pitching")).alias("v"))
    idle = p.groupBy("game_id", "half").agg(F.min("batter_id").alias("b")).select("game_id", "half", F.concat(F.lit("B"), F.col("b").cast("string")).alias("k"), F.struct(F.lit(None).cast("struct<bf:bigint>").alias("pitching")).alias("v"))
    docs = some.unionByName(idle).groupBy("game_id", "half").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("players"))
    docs = docs.groupBy("game_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("half", F.struct("players")))).alias("teams"))).alias("doc"))
    sides = landed.exploded_json(docs, "doc", "teams map<string,struct<players:map<string,struct<pitching:struct<bf:bigint>>>>>", "teams")
    rows = sides.select("game_id", F.col("key").alias("half"), F.explode("value.players")).where("value.pitching is not null")
    return rows.select("game_id", "half", F.substring("key", 3, 20).cast("long").alias("pitcher_id"), F.col("value.pitching.bf").alias("bf"))


# writes


@query("snk2_sorted_files", "SELECT count(*) AS rows, TRUE AS sorted, TRUE AS disjoint FROM orders")
def sorted_files(spark, sf):
    """Many small files compacted into key-sorted ones; read back, each file is in order and no two files overlap."""
    small, path = _scratch(spark), _scratch(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").repartition(8).write.parquet(small)
    tables.compact(spark.read.parquet(small), path, ["o_orderkey"], 3)
    back = spark.read.parquet(path).select("o_orderkey", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at"))
    from pyspark.sql import Window

    out_of_order = F.col("o_orderkey") < F.lag("o_orderkey").over(Window.partitionBy("file").orderBy("at"))
    files = back.withColumn("bad", out_of_order).groupBy("file").agg(F.count("*").alias("n"), F.max(F.coalesce("bad", F.lit(False))).alias("bad"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    over = F.coalesce(F.col("lo") <= F.lag("hi").over(Window.orderBy("lo")), F.lit(False))  # a row a file
    return files.withColumn("over", over).agg(F.sum("n").alias("rows"), (~F.max("bad")).alias("sorted"), (~F.max("over")).alias("disjoint"))


@query("snk3_guarded_merge", "SELECT 'grew' AS step, count(*) AS rows, TRUE AS written FROM orders UNION ALL SELECT 'shrank', count(*), FALSE FROM orders")
def guarded_merge(spark, sf):
    """A day's rows merged into a table through a staged version; a version with fewer rows is refused and the old one stays."""
    path = _scratch(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    tables.write_version(o.where("o_orderkey % 5 <> 0"), path, [])
    merged = tables.merge_latest(tables.current(spark, path), o.where("o_orderkey % 5 = 0"), ["o_orderkey"])
    grew = tables.write_version(merged, path, [lambda new: gates.no_shrink(tables.current(spark, path), new)])
    first = tables.current(spark, path).agg(F.lit("grew").alias("step"), F.count("*").alias("rows")).withColumn("written", F.lit(grew))
    shrank = tables.write_version(o.where("o_orderkey % 5 = 1"), path, [lambda new: gates.no_shrink(tables.current(spark, path), new)])
    return first.unionByName(tables.current(spark, path).agg(F.lit("shrank").alias("step"), F.count("*").alias("rows")).withColumn("written", F.lit(shrank)))


@query("snk10_replaced_table", "SELECT count(*) AS rows, count(*) AS expected, TRUE AS written FROM customer")
def replaced_table(spark, sf):
    """A whole table replaced; its rows are counted after the write, before the switch."""
    path = _scratch(spark)
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    tables.write_version(c.where("c_custkey % 2 = 0"), path, [])
    n = c.count()
    done = tables.write_version(c, path, [lambda new: gates.gate(new, "rows", F.count("*"), lambda v: v == n)])
    return tables.current(spark, path).agg(F.count("*").alias("rows")).select("rows", F.lit(n).alias("expected"), F.lit(done).alias("written"))


@query("snk13_compared_copies", "SELECT 'customer' AS name, count(*) AS a, count(*) FILTER (WHERE c_custkey % 10 > 0) AS b, FALSE AS same FROM customer UNION ALL SELECT 'nation', count(*), count(*), TRUE FROM nation")
def compared_copies(spark, sf):
    """Two snapshots compared by their manifests: rows and an order-free content hash of each table."""
    one, other = _scratch(spark), _scratch(spark)
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    tables.snapshot({"customer": c, "nation": n}, one)
    tables.snapshot({"customer": c.where("c_custkey % 10 > 0"), "nation": n.repartition(3)}, other)
    left, right = (spark.read.parquet(f"{p}/_manifest_table") for p in (one, other))
    both = left.join(right.select("name", F.col("rows").alias("b"), F.col("content").alias("other")), "name", "full")
    return both.select("name", F.col("rows").alias("a"), "b", F.col("content").eqNullSafe(F.col("other")).alias("same"))


@query(
    "snk11_exports",
    f"""{WITH_PITCHES} SELECT 'games' AS name, count(*) AS rows, CAST(sum(epoch(CAST(date AS TIMESTAMP)) / 86400) AS BIGINT) AS total FROM games UNION ALL SELECT 'teams', count(DISTINCT home_team), CAST(sum(DISTINCT home_team) AS BIGINT) FROM games UNION ALL SELECT 'venues', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation
UNION ALL SELECT 'players', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL SELECT 'lineup', count(*), CAST(sum(slot) AS BIGINT) FROM (SELECT min(pitch_no) AS slot FROM pitches WHERE pitch_no <= 4 GROUP BY game_id, bat_team, batter_id)
UNION ALL SELECT 'season_lines', count(*), CAST(sum(so) AS BIGINT) FROM (SELECT count(*) FILTER (WHERE result = 'R') AS so FROM pitches GROUP BY pitcher_id, season) UNION ALL SELECT 'pf', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM games GROUP BY venue_id, season)
UNION ALL SELECT 'conditions', count(*), CAST(sum(CASE WHEN game_id % 13 > 0 THEN 50 + game_id % 40 ELSE 72 END) AS BIGINT) FROM games UNION ALL SELECT 'tr', 2 * count(*), CAST(sum(home_final + away_final) AS BIGINT) FROM games
UNION ALL SELECT 'rg', count(*), CAST(sum(d - DATE '1970-01-01') AS BIGINT) FROM (SELECT max(ship_date) AS d FROM pitches GROUP BY game_id HAVING max(ship_date) > min(date))""",
)
def several_exports(spark, sf):
    """The ten relational tables exported as the builder's inputs: renamed columns, missing values filled, epochs for instants, one
    file set each; read back with their schemas, counted and summed."""
    path, g, p = _scratch(spark), games(spark, sf), pitches(spark, sf)
    venue = F.col("venue_id")
    exports = {
        "games": (g.select("game_id", (F.unix_date("date") * F.lit(86400).cast("long")).alias("first_pitch_epoch")), F.col("first_pitch_epoch") / 86400),
        "teams": (g.select(F.col("home_team").alias("team_id")).distinct(), F.col("team_id")),
        "venues": (table(spark, sf, "nation").select(F.col("n_nationkey").alias("venue_id"), F.coalesce("n_name", F.lit("")).alias("name")), venue),
        "players": (table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name")), F.col("player_id")),
        "lineup": (p.where("pitch_no <= 4").groupBy("game_id", F.col("bat_team").alias("team_id"), F.col("batter_id").alias("player_id")).agg(F.min("pitch_no").alias("slot")), F.col("slot")),
        "season_lines": (p.groupBy(F.col("pitcher_id").alias("player_id"), "season").agg(F.count("*").alias("bf"), F.coalesce(F.count(F.when(F.col("result") == "R", 1)), F.lit(0)).alias("so")), F.col("so")),
        "pf": (g.groupBy(venue.alias("park_id"), F.col("season").alias("year")).agg(F.count("*").alias("n")), F.col("n")),
        "conditions": (g.select("game_id", F.coalesce(F.when(F.col("game_id") % 13 > 0, 50.0 + F.col("game_id") % 40), F.lit(72.0)).alias("temp_f")), F.col("temp_f")),
        "tr": (team_games(spark, sf).select("game_id", F.col("team").alias("team_id"), "is_home", F.col("runs").alias("runs_total")), F.col("runs_total")),
        "rg": (p.groupBy("game_id").agg(F.min("date").alias("original_date"), F.max("ship_date").alias("resume_date")).where("resume_date > original_date"), F.unix_date("resume_date")),
    }
    out = None
    for name, (df, measure) in exports.items():
        df.write.option("header", True).csv(f"{path}/{name}")
        back = spark.read.schema(df.schema).option("header", True).csv(f"{path}/{name}")
        one = back.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(measure).cast("long").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk17_split_files", f"{WITH_GAMES} SELECT season, count(*) AS features, count(*) FILTER (WHERE season = 1997) AS targets, CASE WHEN season < 1997 THEN CAST(sum(home_final) AS BIGINT) END AS known FROM games WHERE season <= 1997 GROUP BY season")
def split_files(spark, sf):
    """Features and held-out targets in two file sets: the first has no score of the test season."""
    path, g = f"{_scratch(spark)}-{uuid.uuid4().hex}", games(spark, sf).where("season <= 1997")
    g.select("game_id", "season", "venue_id", F.when(F.col("season") < 1997, F.col("home_final")).alias("home_final")).write.parquet(f"{path}/features")
    g.where("season = 1997").select("game_id", "home_final").write.parquet(f"{path}/targets")
    features, targets = spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/targets").select("game_id", F.lit(1).alias("held"))
    return features.join(targets, "game_id", "left").groupBy("season").agg(F.count("*").alias("features"), F.count("held").alias("targets"), F.sum("home_final").alias("known"))


# scalar kernels and order


@query("fn4_local_dates", "SELECT event_id, CAST(CAST(timezone('America/Chicago', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS VARCHAR) AS local FROM events")
def local_dates(spark, sf):
    """The calendar date in a zone of an instant in UTC."""
    return table(spark, sf, "events").select("event_id", fn.local_date(F.col("ts").cast("timestamp")).cast("string").alias("local"))


def _cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


Z = "((l_discount * 20 - 1) / 0.7)"


@query("fn20_capped_mean", f"SELECT l_discount, round(1 - (-(l_discount * 20 - 1) * (1 - {_cdf_sql(Z)}) + 0.7 * exp(-{Z} * {Z} / 2) / sqrt(2 * pi())), 8) AS capped FROM (SELECT DISTINCT l_discount FROM lineitem)")
def capped_means(spark, sf):
    """Mean of min(X, cap) for a normal X of mean 1 and deviation 0.7."""
    d = table(spark, sf, "lineitem").select("l_discount").distinct()
    return d.select("l_discount", r(fn.capped_mean(F.lit(1.0), F.lit(0.7), F.col("l_discount") * 20), 8).alias("capped"))


@query("udf1_norm_cdf", f"SELECT l_discount, round({_cdf_sql(Z)}, 8) AS p FROM (SELECT DISTINCT l_discount FROM lineitem)")
def norm_cdf(spark, sf):
    """The normal distribution function as an expression: no UDF is needed."""
    d = table(spark, sf, "lineitem").select("l_discount").distinct()
    return d.select("l_discount", r(fn.norm_cdf((F.col("l_discount") * 20 - 1) / 0.7), 8).alias("p"))


@query("fn14_roof_test", "SELECT n_nationkey, n_nationkey % 7 = 0 OR lower(n_name) IN ('france', 'peru') AS roofed FROM nation")
def roof_test(spark, sf):
    """By id, else by name without regard to case."""
    return table(spark, sf, "nation").select("n_nationkey", ((F.col("n_nationkey") % 7 == 0) | F.lower("n_name").isin("france", "peru")).alias("roofed"))


@query("srt4_tie_breaks", f"{WITH_GAMES} SELECT home_team, game_id, row_number() OVER (PARTITION BY home_team ORDER BY home_final DESC, date, game_id) AS place FROM games")
def tie_breaks(spark, sf):
    """Ranks under a full composite key: equal scores go by date, then by game."""
    out = asof.sequence_numbers(games(spark, sf), ["home_team"], [F.desc("home_final"), "date", "game_id"], "place")
    return out.select("home_team", "game_id", F.col("place").cast("long").alias("place"))


@query("agg19_venue_totals", f"{WITH_GAMES} SELECT venue_id, home_team, count(*) AS n, CAST(sum(home_final) AS BIGINT) AS home, CAST(sum(away_final) AS BIGINT) AS away FROM games GROUP BY ALL")
def venue_totals(spark, sf):
    return games(spark, sf).groupBy("venue_id", "home_team").agg(F.count("*").alias("n"), F.sum("home_final").alias("home"), F.sum("away_final").alias("away"))


# gates


DOMAIN = f"""{WITH_PITCHES}, l AS (SELECT game_id, bat_team, count(*) AS n, count(DISTINCT pitch_no) AS d, min(pitch_no) AS lo, max(pitch_no) AS hi, min(velo) AS least FROM pitches GROUP BY ALL), q AS (SELECT l_orderkey, l_discount, l_tax FROM lineitem)
SELECT 'slots once each' AS "check", round(avg(CASE WHEN n = d THEN 1.0 ELSE 0 END), 6) AS value, avg(CASE WHEN n = d THEN 1.0 ELSE 0 END) >= 0.99 AS passed FROM l
UNION ALL SELECT 'starts at one', round(avg(CASE WHEN lo = 1 THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN lo = 1 THEN 1.0 ELSE 0 END) >= 0.3 FROM l UNION ALL SELECT 'no gaps', round(avg(CASE WHEN hi - lo + 1 = d THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN hi - lo + 1 = d THEN 1.0 ELSE 0 END) BETWEEN 0.05 AND 0.6 FROM l
UNION ALL SELECT 'not negative', round(avg(CASE WHEN least >= 0 THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN least >= 0 THEN 1.0 ELSE 0 END) >= 1 FROM l
UNION ALL SELECT 'known games', CAST(count(*) AS DOUBLE), count(*) = 0 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'games covered', round(avg(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 1.0 ELSE 0 END) >= 0.995 FROM orders
UNION ALL SELECT 'prices in range', round(avg(CASE WHEN l_discount BETWEEN 0 AND 0.1 THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN l_discount BETWEEN 0 AND 0.1 THEN 1.0 ELSE 0 END) >= 1 FROM q"""


@query("dq1_dq3_dq20_gates", DOMAIN)
def grouped_gates(spark, sf):
    """Slots once each; half-innings that start at one, have no gaps and are not negative; known and covered games; price range."""
    p, line, o = pitches(spark, sf), table(spark, sf, "lineitem"), table(spark, sf, "orders")
    halves = p.groupBy("game_id", "bat_team").agg(F.count("*").alias("n"), F.countDistinct("pitch_no").alias("d"), F.min("pitch_no").alias("lo"), F.max("pitch_no").alias("hi"), F.min("velo").alias("least"))
    covered = o.join(line.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("have")).distinct(), "o_orderkey", "left")
    out = [
        gates.share_at_least(halves, F.col("n") == F.col("d"), 0.99, "slots once each"),
        gates.share_at_least(halves, F.col("lo") == 1, 0.3, "starts at one"),
        gates.band(halves, F.col("hi") - F.col("lo") + 1 == F.col("d"), 0.05, 0.6, "no gaps"),
        gates.share_at_least(halves, F.col("least") >= 0, 1.0, "not negative"),
        gates.known_members(line, o.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"], "known games"),
        gates.share_at_least(covered, F.col("have").isNotNull(), 0.995, "games covered"),
        gates.share_at_least(line, F.col("l_discount").between(0, 0.1), 1.0, "prices in range"),
    ]
    rows = out[0]
    for one in out[1:]:
        rows = rows.unionByName(one)
    return rows.withColumn("value", r(F.col("value")))


@query(
    "dq19_lock_manifest",
    """SELECT 'customer' AS name, TRUE AS ok, count(*) FILTER (WHERE c_custkey = 1) = 0 AS ok_after, 'A' AS fold, TRUE AS in_order FROM customer UNION ALL SELECT 'nation', TRUE, TRUE, 'A', TRUE
UNION ALL SELECT 'customer', TRUE, count(*) FILTER (WHERE c_custkey = 1) = 0, 'B', FALSE FROM customer UNION ALL SELECT 'nation', TRUE, TRUE, 'B', FALSE""",
)
def lock_manifest(spark, sf):
    """Two folds locked by manifests: all tables agree; once a table is written again with other rows, that one does not. Folds
    must be locked in order, each after the outcomes of the one before it were read; the second here was locked too early."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    out = None
    locked, scored = {"A": 1, "B": 2}, {"A": 3}  # steps of the run: fold B was locked before fold A was scored
    for fold, before in (("A", None), ("B", "A")):
        path = _scratch(spark)
        tables.snapshot({"customer": c, "nation": n}, path)
        ok = spark.createDataFrame(tables.verify_snapshot(spark, path).select("name", "ok").collect(), "name string, ok boolean")  # a row a table, taken before the change
        c.where("c_custkey <> 1").write.mode("overwrite").parquet(f"{path}/customer")
        one = ok.join(tables.verify_snapshot(spark, path).select("name", F.col("ok").alias("ok_after")), "name")
        one = one.select("*", F.lit(fold).alias("fold"), F.lit(before is None or scored[before] < locked[fold]).alias("in_order"))
        out = one if out is None else out.unionByName(one)
    return out
