"""Feature groups, model evaluation and domain gates built on the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitsports.functions import columns as fn
from pitsports.operators import asof, fit, gates, rates, tables
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, WITH_TEAM_GAMES, eliminated_sql, games, pitches, query, r, table, team_games
from pitsports.plans.table_queries import _scratch

@query("survey_op16_actual_lineup", f"{WITH_PITCHES}, f AS (SELECT game_id, bat_team, batter_id, min(pitch_no) AS first FROM pitches GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY game_id, bat_team ORDER BY first, batter_id) AS slot FROM f) SELECT game_id, bat_team, batter_id, slot FROM k WHERE slot <= 9")
def actual_lineup(spark, sf):
    f = pitches(spark, sf).groupBy("game_id", "bat_team", "batter_id").agg(F.min("pitch_no").alias("first"))
    k = asof.sequence_numbers(f, ["game_id", "bat_team"], ["first", "batter_id"], "slot").where("slot <= 9")
    return k.select("game_id", "bat_team", "batter_id", F.col("slot").cast("long").alias("slot"))


@query(
    "survey_op24_pitch_traits",
    f"""{WITH_PITCHES}, t AS (SELECT pitcher_id, season, result AS kind, count(*) AS n, avg(velo) AS v FROM pitches GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY pitcher_id, season ORDER BY n DESC, kind) AS k FROM t)
SELECT t.pitcher_id, t.season, t.kind, t.n, round(t.v - p.v, 6) AS velo_gap FROM t JOIN p ON p.pitcher_id = t.pitcher_id AND p.season = t.season AND p.k = 1""",
)
def traits(spark, sf):
    t = pitches(spark, sf).groupBy("pitcher_id", "season", F.col("result").alias("kind")).agg(F.count("*").alias("n"), F.avg("velo").alias("v"))
    main = t.groupBy("pitcher_id", "season").agg(F.min_by("v", F.struct(-F.col("n"), F.col("kind"))).alias("ref"))
    return t.join(main, ["pitcher_id", "season"]).select("pitcher_id", "season", "kind", "n", r(F.col("v") - F.col("ref")).alias("velo_gap"))


def _whiff_sql(steps: int) -> str:
    """CTEs b0, b1, ...: Newton steps of the logistic model over counted cells (x0 to x6, y, n), ridge 1 on all coefficients."""
    names = [f"c{i}" for i in range(7)]
    out = f"b0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in names)})"
    for s in range(steps):
        sums = ", ".join(f"sum(n * p * (1 - p) * x{i} * x{j}){' + 1.0' if i == j else ''} AS a{i}_{j}" for i in range(7) for j in range(7))
        right = ", ".join(f"sum(n * (y - p) * x{i}) - any_value(c{i}) AS a{i}_7, any_value(c{i}) AS c{i}" for i in range(7))
        eta = " + ".join(f"c{i} * x{i}" for i in range(7))
        out += f", h{s} AS (SELECT {sums}, {right} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM cells, b{s})), {eliminated_sql(f'h{s}', 7, ', '.join(names))}, b{s + 1} AS (SELECT {', '.join(f'c{i} + a{i}_7 AS c{i}' for i in range(7))} FROM h{s}_7)"
    return out


@query(
    "survey_op25_whiff_model",
    f"""{WITH_PITCHES}, st AS (SELECT avg(velo) AS mv, stddev_samp(velo) AS sv, avg(px) AS mx, stddev_samp(px) AS sx, avg(pz) AS mz, stddev_samp(pz) AS sz FROM pitches), z AS (SELECT pitcher_id, (velo - mv) / sv AS v, (px - mx) / sx AS x, (pz - mz) / sz AS w, CASE WHEN result = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM pitches, st),
cells AS (SELECT 1.0::DOUBLE AS x0, v AS x1, x AS x2, w AS x3, v * v AS x4, x * x AS x5, x * w AS x6, y, count(*) AS n FROM z GROUP BY ALL), {_whiff_sql(8)}
SELECT pitcher_id, count(*) AS n, CAST(sum(round(1e4 / (1 + exp(-(c0 + c1 * v + c2 * x + c3 * w + c4 * v * v + c5 * x * x + c6 * x * w))))) AS BIGINT) AS score FROM z, b8 GROUP BY pitcher_id""",
)
def whiff(spark, sf):
    """Logistic model of the outcome on standardised traits with squares, an interaction and a ridge; integer scores of pitchers."""
    z = fit.standardised(pitches(spark, sf).select("pitcher_id", "velo", "px", "pz", F.when(F.col("result") == "R", 1.0).otherwise(0.0).alias("y")), ["velo", "px", "pz"])
    v, x, w = (F.col(f"z_{c}") for c in ("velo", "px", "pz"))
    terms = [v, x, w, v * v, x * x, x * w]
    beta = fit.logistic(z, F.col("y"), terms, ridge=1.0, discrete=True)
    score = F.round(fn.expit(fit.predict(beta, terms)) * 1e4).cast("long")
    return z.select("pitcher_id", score.alias("s")).groupBy("pitcher_id").agg(F.count("*").alias("n"), F.sum("s").alias("score"))


@query(
    "survey_op28_relative_rates",
    """WITH l AS (SELECT l_suppkey AS player, CAST(year(l_shipdate) AS INT) AS season, l_linenumber % 3 AS level, count(*) AS pa, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY ALL), m AS (SELECT season, level, sum(k) * 1.0 / sum(pa) AS m FROM l GROUP BY ALL)
SELECT player, l.season, round(sum(pa * (1 - 0.2 * l.level) * k / pa / m) / sum(pa * (1 - 0.2 * l.level)), 6) AS rel FROM l JOIN m ON m.season = l.season AND m.level = l.level GROUP BY player, l.season""",
)
def relative(spark, sf):
    k = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("season"), (F.col("l_linenumber") % 3).alias("level")).agg(F.count("*").alias("pa"), k.alias("k"))
    m = rows.groupBy("season", "level").agg((F.sum("k") / F.sum("pa")).alias("m"))
    weight = F.col("pa") * (1 - 0.2 * F.col("level"))
    return rows.join(m, ["season", "level"]).groupBy("player", "season").agg(r(rates.weighted_mean(F.col("k") / F.col("pa") / F.col("m"), weight)).alias("rel"))


@query("survey_op56_level_table", f"{WITH_TEAM_GAMES}, l AS (SELECT season, is_home, avg(runs) AS level FROM team_games GROUP BY ALL) SELECT game_id, team, round(ln(level), 6) AS offset FROM team_games t JOIN l ON l.season = t.season AND l.is_home = t.is_home".replace("AS offset", 'AS "offset"'))
def levels(spark, sf):
    t = team_games(spark, sf)
    level = t.groupBy("season", "is_home").agg(F.avg("runs").alias("level"))
    return t.join(level, ["season", "is_home"]).select("game_id", "team", r(F.log("level")).alias("offset"))


@query("snk1_append_partitioned", f"{WITH_GAMES} SELECT season, count(*) AS n FROM games GROUP BY season")
def append(spark, sf):
    """Two chunks appended to a season-partitioned table; an empty chunk is skipped."""
    path, g = _scratch(spark), games(spark, sf)
    for chunk in (g.where("game_id % 2 = 0"), g.where("game_id % 2 = 1"), g.where("false")):
        if chunk.limit(1).count():
            chunk.repartition("season").write.mode("append").partitionBy("season").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n"))


@query("snk5_keyed_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_custkey % 5 = 0 AS stamped FROM customer")
def upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("loaded_at", F.current_timestamp())
    return tables.merge_latest(c, new, ["c_custkey"]).select("c_custkey", "c_acctbal", F.col("loaded_at").isNotNull().alias("stamped"))


@query(
    "snk11_snk14_exports",
    f"""{WITH_GAMES}, o AS (SELECT l_orderkey AS game_id, l_suppkey AS book, CASE l_linenumber % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'p1' ELSE 'close' END AS snap, l_shipdate AS ts, CAST(round(l_quantity * 10) AS BIGINT) AS odds FROM lineitem WHERE l_linenumber % 3 <> 1)
SELECT o.game_id, season, book, snap, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts, odds FROM o JOIN games ON games.game_id = o.game_id WHERE season BETWEEN 1996 AND 1998""",
)
def exports(spark, sf):
    """Prices exported for some seasons and two snapshots, instants as UTC text, sorted by key, one file a season; read back."""
    snap = F.element_at(F.array(F.lit("open"), F.lit("p1"), F.lit("close")), F.col("l_linenumber") % 3 + 1)
    o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("book"), snap.alias("snap"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), F.round(F.col("l_quantity") * 10).cast("long").alias("odds"))
    wanted = games(spark, sf).where(F.col("season").between(1996, 1998)).select("game_id", "season")
    rows = o.where(F.col("snap").isin("open", "close")).join(wanted, "game_id").select("game_id", "season", "book", "snap", "ts", "odds")
    path = _scratch(spark)
    rows.repartition("season").sortWithinPartitions("game_id", "book", "snap").write.partitionBy("season").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query(
    "src10_src15_nested_results",
    f"""{WITH_PITCHES}, h AS (SELECT game_id, half, sum(velo) AS s FROM pitches GROUP BY ALL) SELECT game_id, CAST(count(*) AS BIGINT) AS sides, CAST(max(s) AS BIGINT) AS best FROM h GROUP BY game_id""",
)
def nested(spark, sf):
    """Game documents with a map of sides, landed as JSON and read back with higher-order functions."""
    h = pitches(spark, sf).groupBy("game_id", "half").agg(F.sum("velo").cast("long").alias("s"))
    docs = h.groupBy("game_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("half", F.struct("s"))))).alias("doc"))
    path = f"{_scratch(spark)}-{uuid.uuid4().hex}"
    docs.write.json(path)
    back = spark.read.schema("game_id long, doc string").json(path).withColumn("m", F.from_json("doc", "map<string, struct<s: bigint>>"))
    return back.select("game_id", F.size(F.map_keys("m")).cast("long").alias("sides"), F.array_max(F.transform(F.map_values("m"), lambda x: x["s"])).alias("best"))


DOMAIN = f"""{WITH_PITCHES}, l AS (SELECT game_id, bat_team, count(DISTINCT batter_id) AS d, count(*) AS n FROM pitches GROUP BY ALL), s AS (SELECT game_id, count(*) AS n FROM pitches GROUP BY ALL)
SELECT 'one batter a pitch' AS "check", round(avg(CASE WHEN d = n THEN 1.0 ELSE 0 END), 6) AS value, avg(CASE WHEN d = n THEN 1.0 ELSE 0 END) >= 0.9 AS passed FROM l
UNION ALL SELECT 'pitch coverage', round(avg(CASE WHEN s.n IS NOT NULL THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN s.n IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.9 FROM games g LEFT JOIN s ON s.game_id = g.game_id WHERE status = 'F'
UNION ALL SELECT 'consecutive numbers', round(avg(CASE WHEN m = k THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN m = k THEN 1.0 ELSE 0 END) >= 0.995 FROM (SELECT game_id, max(pitch_no) AS m, count(DISTINCT pitch_no) AS k FROM pitches GROUP BY ALL)
UNION ALL SELECT 'prices in range', round(avg(CASE WHEN px BETWEEN 0 AND 0.1 AND pz BETWEEN 0 AND 0.08 THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN px BETWEEN 0 AND 0.1 AND pz BETWEEN 0 AND 0.08 THEN 1.0 ELSE 0 END) >= 1 FROM pitches"""


@query("dq_domain_gates", DOMAIN)
def domain_gates(spark, sf):
    p, g = pitches(spark, sf), games(spark, sf)
    sides = p.groupBy("game_id", "bat_team").agg(F.countDistinct("batter_id").alias("d"), F.count("*").alias("n"))
    covered = g.where("status = 'F'").join(p.groupBy("game_id").agg(F.count("*").alias("n")), "game_id", "left")
    numbers = p.groupBy("game_id").agg(F.max("pitch_no").alias("m"), F.countDistinct("pitch_no").alias("k"))
    out = gates.share_at_least(sides, F.col("d") == F.col("n"), 0.9, "one batter a pitch")
    out = out.unionByName(gates.share_at_least(covered, F.col("n").isNotNull(), 0.9, "pitch coverage"))
    out = out.unionByName(gates.share_at_least(numbers, F.col("m") == F.col("k"), 0.995, "consecutive numbers"))
    out = out.unionByName(gates.share_at_least(p, F.col("px").between(0, 0.1) & F.col("pz").between(0, 0.08), 1.0, "prices in range"))
    return out.withColumn("value", r(F.col("value")))
