"""Plate appearances, season bases, bullpen status, environment, factors, forms and umpires, as known before a game."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitsports.operators import asof, fit, rates, tables
from pitsports.plans.base import APPEARANCES, CENTRED, ORACLE_SQL, QUERIES, WITH_PITCHES, WITH_TEAM_GAMES, appearances, eliminated_sql, games, overridden, pitches, query, r, settled_appearances, starters, team_games
from pitsports.plans.pitching_queries import MUCH, POOL, relievers_used, twice

# plate appearances and season bases

_PA = """pa AS (SELECT *, row_number() OVER (PARTITION BY game_id, batter_id ORDER BY first, pitcher_id) AS times_through, row_number() OVER (PARTITION BY game_id, pitcher_id ORDER BY first, batter_id) AS pa_of_pitcher
  FROM (SELECT game_id, batter_id, pitcher_id, count(*) AS pitches, min(pitch_no) AS first, arg_max({'r': result, 'v': value}, (pitch_no, ship_date, value, result)) AS last FROM pitches GROUP BY ALL))"""


@query(
    "survey_op3_plate_appearances",
    f"{WITH_PITCHES}, {_PA} SELECT game_id, batter_id, pitcher_id, pitches, last.r AS outcome, CAST(last.r = 'R' AS INT) AS k, CAST(last.r = 'N' AS INT) AS bb, CAST(last.r = 'A' AS INT) AS in_play, round(last.v, 4) AS value, times_through, pa_of_pitcher FROM pa",
)
def plate_appearances(spark, sf):
    """One row for each batter and pitcher of a game: the pitch that carries the outcome, its flags, how often the batter has
    come up in the game and the pitcher's number of batters."""
    last = F.max(F.struct("pitch_no", "ship_date", "value", "result"))
    pa = pitches(spark, sf).groupBy("game_id", "batter_id", "pitcher_id").agg(last.alias("last"), F.count("*").alias("pitches"), F.min("pitch_no").alias("first"))
    times = F.row_number().over(Window.partitionBy("game_id", "batter_id").orderBy("first", "pitcher_id"))
    number = F.row_number().over(Window.partitionBy("game_id", "pitcher_id").orderBy("first", "batter_id"))
    flag = lambda kind: (F.col("last.result") == kind).cast("int")
    return pa.select(
        "game_id", "batter_id", "pitcher_id", "pitches", F.col("last.result").alias("outcome"), flag("R").alias("k"), flag("N").alias("bb"), flag("A").alias("in_play"), r(F.col("last.value"), 4).alias("value"), times.cast("long").alias("times_through"), number.cast("long").alias("pa_of_pitcher")
    )


#: A venue's factor in a season from what became known in the three seasons before: ``factor`` (season, venue_id, f).
_FACTOR = """vs AS (SELECT CAST(year(data_date) AS INT) AS season, venue_id, count(*) AS n, sum(value) AS v FROM pitches GROUP BY ALL), w3 AS (SELECT k.season, venue_id, sum(n) AS n, sum(v) AS v FROM (SELECT DISTINCT season FROM vs) k JOIN vs ON vs.season BETWEEN k.season - 3 AND k.season - 1 GROUP BY ALL),
factor AS (SELECT season, venue_id, 1 + (v / n / (sum(v) OVER s / sum(n) OVER s) - 1) * n / (n + 500.0) AS f FROM w3 WINDOW s AS (PARTITION BY season))"""


def _venue_factors(p):
    sums = p.groupBy(F.year("data_date").alias("season"), "venue_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    seasons = sums.select("season").distinct()
    w = asof.serve_seasons(sums, "season", 3).groupBy(F.col("target").alias("season"), "venue_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).join(seasons, "season", "left_semi")
    every = w.groupBy("season").agg((F.sum("v") / F.sum("n")).alias("every"))  # a row a season
    return w.join(F.broadcast(every), "season").select("season", "venue_id", rates.ratio_factor(F.col("v") / F.col("n"), F.col("every"), F.col("n"), 500.0, 0).alias("f"))


@query(
    "survey_op2_player_season_base",
    f"""{WITH_PITCHES}, {_FACTOR}, b AS (SELECT pitcher_id, CAST(year(data_date) AS INT) AS season, count(*) AS bf, count(*) FILTER (WHERE result = 'R') AS k, sum(velo) AS velo, sum(value / coalesce(f, 1)) AS neutral FROM pitches p LEFT JOIN factor ON factor.season = year(data_date) AND factor.venue_id = p.venue_id GROUP BY ALL)
SELECT pitcher_id, season, bf, k, round(velo / bf, 6) AS velo, round(100.0 * k / bf, 6) AS k_pct, round(neutral / bf / (sum(neutral) OVER s / sum(bf) OVER s), 8) AS neutral_ratio, round(100.0 * sum(k) OVER s / sum(bf) OVER s, 6) AS league_k_pct, round(sum(neutral) OVER s / sum(bf) OVER s, 4) AS league_neutral FROM b WINDOW s AS (PARTITION BY season)""",
)
def season_base(spark, sf):
    """Season totals, velocity, strikeouts and the value per pitch at a neutral venue against the league's, with the league's means."""
    p = pitches(spark, sf).withColumn("known", F.year("data_date"))
    f = _venue_factors(p).withColumnRenamed("season", "known")
    x = p.join(f, ["known", "venue_id"], "left").groupBy("pitcher_id", F.col("known").alias("season")).agg(
        F.count("*").alias("bf"), F.count(F.when(F.col("result") == "R", 1)).alias("k"), F.sum("velo").alias("v"), F.sum(F.col("value") / F.coalesce("f", F.lit(1.0))).alias("s")
    )
    league = x.groupBy("season").agg((100.0 * F.sum("k") / F.sum("bf")).alias("lk"), (F.sum("s") / F.sum("bf")).alias("ls"))  # a row a season
    return x.join(F.broadcast(league), "season").select(
        "pitcher_id", "season", "bf", "k", r(F.col("v") / F.col("bf")).alias("velo"), r(100.0 * F.col("k") / F.col("bf")).alias("k_pct"), r(F.col("s") / F.col("bf") / F.col("ls"), 8).alias("neutral_ratio"), r(F.col("lk")).alias("league_k_pct"), r(F.col("ls"), 4).alias("league_neutral")
    )


@query(
    "survey_op8_wls_skill_fit",
    f"""{WITH_PITCHES}, t AS (SELECT avg(value) AS y, count(*) AS w, 1.0::DOUBLE AS x0, avg(CASE WHEN result = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS x1, avg(CASE WHEN result = 'N' THEN 1.0::DOUBLE ELSE 0 END) AS x2, avg(velo) AS x3 FROM pitches GROUP BY pitcher_id, season),
m AS (SELECT {", ".join(f"sum(w * x{i} * x{j}) AS a{i}_{j}" for i in range(4) for j in range(4))}, {", ".join(f"sum(w * x{i} * y) AS a{i}_4" for i in range(4))} FROM t), {eliminated_sql("m", 4)}
SELECT round(a0_4, 2) AS intercept, round(a1_4, 2) AS k, round(a2_4, 2) AS bb, round(a3_4, 3) AS gb FROM m_4""",
)
def wls(spark, sf):
    """Value allowed on shares of strikeouts, of walks, and a third measure, by pitcher and season, weighted by volume."""
    share = lambda kind: F.avg(F.when(F.col("result") == kind, 1.0).otherwise(0.0))
    t = pitches(spark, sf).groupBy("pitcher_id", "season").agg(F.avg("value").alias("y"), share("R").alias("k"), share("N").alias("bb"), F.avg("velo").alias("gb"), F.count("*").alias("w"))
    b = fit.weighted_least_squares(t, F.col("y"), [F.col("k"), F.col("bb"), F.col("gb")], F.col("w"))
    return spark.range(1).select(*[F.lit(round(v, 3 if n == "gb" else 2)).alias(n) for n, v in zip(("intercept", "k", "bb", "gb"), b, strict=True)])


@query(
    "survey_op9_expected_length_ols",
    f"""{WITH_PITCHES}, a AS (SELECT game_id, pitcher_id, CAST(count(*) AS DOUBLE) AS y, 1.0::DOUBLE AS x0, avg(velo) AS x1, CASE WHEN min(pitch_no) = 1 THEN 1.0::DOUBLE ELSE 0 END AS x2, CASE WHEN min(pitch_no) > 4 THEN 1.0::DOUBLE ELSE 0 END AS x3 FROM pitches GROUP BY ALL),
m AS (SELECT {", ".join(f"sum(x{i} * x{j}) AS a{i}_{j}" for i in range(4) for j in range(4))}, {", ".join(f"sum(x{i} * y) AS a{i}_4" for i in range(4))} FROM a), {eliminated_sql("m", 4)},
e AS (SELECT game_id, pitcher_id, y, a0_4 + a1_4 * x1 + a2_4 * x2 + a3_4 * x3 AS p FROM a, m_4)
SELECT game_id, pitcher_id, CAST(y AS BIGINT) AS n, round(least(greatest(p, 0.5), 7.0), 6) AS expected, round((SELECT sqrt(avg((y - p) * (y - p))) FROM e), 7) AS rmse FROM e""",
)
def ols(spark, sf):
    """Batters faced by rest bucket dummies and velocity: clipped prediction for every appearance, and the fit's error."""
    a = pitches(spark, sf).groupBy("game_id", "pitcher_id").agg(F.count("*").alias("n"), F.avg("velo").alias("v"), F.min("pitch_no").alias("first"))
    terms = [F.col("v"), F.when(F.col("first") == 1, 1.0).otherwise(0.0), F.when(F.col("first") > 4, 1.0).otherwise(0.0)]
    beta = fit.weighted_least_squares(a, F.col("n"), terms)
    e = a.withColumn("p", fit.predict(beta, terms))
    rmse = e.agg(F.sqrt(F.avg(F.pow(F.col("n") - F.col("p"), 2))).alias("rmse"))
    return e.crossJoin(F.broadcast(rmse)).select("game_id", "pitcher_id", "n", r(rates.clamp(F.col("p"), 0.5, 7.0)).alias("expected"), r(F.col("rmse"), 7).alias("rmse"))


@query(
    "survey_op13_slot_weights",
    f"""{WITH_PITCHES}, o AS (SELECT pitch_no, (row_number() OVER (PARTITION BY game_id, bat_team ORDER BY pitch_no, batter_id, pitcher_id) - 1) % 9 + 1 AS slot FROM pitches WHERE year(data_date) = 1995), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT game_id, bat_team FROM pitches WHERE year(data_date) = 1995))
SELECT slot, round(count(*) FILTER (WHERE pitch_no <= 5) / any_value(n), 8) AS w_f5, round(count(*) / any_value(n), 8) AS w_all FROM o, n GROUP BY slot""",
)
def slot_weights(spark, sf):
    """Mean plate appearances by place in the batting order's cycle, in the first part and in all, measured on one season."""
    p = pitches(spark, sf).where("year(data_date) = 1995")
    order = Window.partitionBy("game_id", "bat_team").orderBy("pitch_no", "batter_id", "pitcher_id")
    slots = p.withColumn("slot", ((F.row_number().over(order) - 1) % 9 + 1).cast("long"))
    n = p.agg(F.countDistinct("game_id", "bat_team").alias("n"))
    return slots.crossJoin(F.broadcast(n)).groupBy("slot").agg(r(F.count(F.when(F.col("pitch_no") <= 5, 1)) / F.first("n"), 8).alias("w_f5"), r(F.count("*") / F.first("n"), 8).alias("w_all"))


# bullpens


@query(
    "survey_op12_reliever_availability",
    f"""{WITH_PITCHES}, {APPEARANCES}, {POOL}, rd AS (SELECT fld_team, known AS season, day, who, sum(n) AS n, sum(k) AS k, sum(late) AS late FROM app WHERE NOT started GROUP BY ALL),
cum AS (SELECT fld_team, season, day, {{'c': sum(late) OVER w, 'w': -who}} AS top FROM rd WINDOW w AS (PARTITION BY fld_team, season, who ORDER BY day)), dt AS (SELECT fld_team, season, day, max(top) AS top FROM cum GROUP BY ALL),
cl AS (SELECT fld_team, season, day, max(top) OVER (PARTITION BY fld_team, season ORDER BY day) AS top FROM dt), td AS (SELECT fld_team, day, sum(n) AS n, sum(k) AS k FROM rd GROUP BY ALL), ts AS (SELECT fld_team, season, day, sum(n) OVER w AS n, sum(k) OVER w AS k FROM (SELECT fld_team, season, day, sum(n) AS n, sum(k) AS k FROM rd GROUP BY ALL) WINDOW w AS (PARTITION BY fld_team, season ORDER BY day)),
un AS (SELECT fld_team, season, cutoff, count(*) FILTER (WHERE d1 AND d2) AS b2b, string_agg(CAST(who AS VARCHAR), ',' ORDER BY who) FILTER (WHERE NOT available) AS ids, list(who) FILTER (WHERE NOT available) AS whos FROM pool GROUP BY ALL),
w15 AS (SELECT st.game_id, st.fld_team, sum(n) FILTER (WHERE day >= st.date - 3) AS p3, sum(n) AS n, sum(k) AS k FROM st JOIN td ON td.fld_team = st.fld_team AND td.day < st.date AND td.day >= st.date - 15 GROUP BY ALL),
c1 AS (SELECT st.game_id, st.fld_team, st.season, st.date, cl.top FROM st ASOF LEFT JOIN cl ON cl.fld_team = st.fld_team AND cl.season = st.season AND st.date > cl.day), c2 AS (SELECT c1.*, ts.n AS sn, ts.k AS sk FROM c1 ASOF LEFT JOIN ts ON ts.fld_team = c1.fld_team AND ts.season = c1.season AND c1.date > ts.day)
SELECT c2.game_id, c2.fld_team, CAST(coalesce(w15.p3, 0) AS BIGINT) AS pitches_3d, coalesce(un.b2b, 0) AS back_to_back, coalesce(un.ids, '') AS unavailable, CASE WHEN top.c > 0 THEN -top.w END AS closer_id, coalesce(NOT list_contains(un.whos, -top.w), TRUE) OR coalesce(top.c, 0) = 0 AS closer_available,
  floor(2700.0 * (w15.n - w15.k) / nullif(w15.k, 0) + 0.500001) / 100 AS era_15d, floor(2700.0 * (sn - sk) / nullif(sk, 0) + 0.500001) / 100 AS era_season FROM c2 LEFT JOIN w15 ON w15.game_id = c2.game_id AND w15.fld_team = c2.fld_team LEFT JOIN un ON un.fld_team = c2.fld_team AND un.season = c2.season AND un.cutoff = c2.date""",
)
def availability(spark, sf):
    """The bullpen before a game: its work, who cannot pitch, the closer (most late work of the season so far; ties: the smaller
    id) and whether he can, and runs allowed per nine innings over fifteen days and the season."""
    a = settled_appearances(pitches(spark, sf))
    done = a.where("not started").select("fld_team", "who", F.col("known").alias("season"), "day", "n", "k", "late").repartition("fld_team", "who")
    daily = done.groupBy("fld_team", "season", "day", "who").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("late").alias("late"))
    own = Window.partitionBy("fld_team", "who").orderBy("season", "day")  # a season's total is the one since then; windows of a season would have a row or two each
    earlier = Window.partitionBy("fld_team", "who").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    top = F.struct((F.sum("late").over(own) - F.coalesce(F.sum("late").over(earlier), F.lit(0))).alias("c"), (-F.col("who")).alias("w"))
    # a reliever's own total only grows, so the most of all totals up to a day belongs to the leader of that day
    by_day = daily.withColumn("top", top).groupBy("fld_team", "season", "day").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    so_far = Window.partitionBy("fld_team", "season").orderBy("day")
    run = by_day.select("fld_team", "season", "day", F.max("top").over(so_far).alias("top"), F.sum("n").over(so_far).alias("sn"), F.sum("k").over(so_far).alias("sk"))
    asked = starters(a).select("game_id", "fld_team", "season", F.col("date").alias("cutoff"))
    work = by_day.groupBy("fld_team", "day").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    recent = asof.trailing_totals(asked, work, ["fld_team"], "cutoff", "day", 15, {"p3": (3, F.sum("n")), "n15": F.sum("n"), "k15": F.sum("k")})
    # who cannot pitch follows from the last two days; the rest of the pool is not asked for
    out = relievers_used(a).withColumns({"twice": twice(), "cutoff": F.date_add("day", 1)}).where(F.col("twice") | (F.col("bf") >= MUCH))
    pool = out.groupBy("fld_team", "cutoff").agg(F.count(F.when(F.col("twice"), 1)).alias("b2b"), F.sort_array(F.collect_list("who")).alias("ids"))
    x = asof.at_cutoffs(asked, run, ["fld_team", "season"], "cutoff", "day").join(F.broadcast(recent), ["fld_team", "cutoff"], "left").join(pool, ["fld_team", "cutoff"], "left")
    era = lambda n, k: F.floor(2700.0 * (F.col(n) - F.col(k)) / F.nullif(F.col(k), F.lit(0)) + 0.500001) / 100
    closer = F.when(F.col("top.c") > 0, -F.col("top.w"))
    return x.select(
        "game_id", "fld_team", F.coalesce("p3", F.lit(0)).alias("pitches_3d"), F.coalesce("b2b", F.lit(0)).alias("back_to_back"), F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("unavailable"),
        closer.alias("closer_id"), F.coalesce(~F.array_contains("ids", closer), F.lit(True)).alias("closer_available"), era("n15", "k15").alias("era_15d"), era("sn", "sk").alias("era_season"),
    )


# environment and factors

#: Team-games of last season's level, and games of a team's prior level, that are mixed in; how far that is pulled to the league.
K_LEAGUE, K_TEAM, REGRESS = 500, 30, 1 / 3


@query(
    "survey_op17_environment",
    f"""{WITH_TEAM_GAMES}, tot AS (SELECT season, venue_id, count(*) AS n, sum(home_final + away_final) AS x FROM games GROUP BY ALL), w3 AS (SELECT k.season, venue_id, sum(n) AS n, sum(x) AS x FROM (SELECT DISTINCT season FROM tot) k JOIN tot ON tot.season BETWEEN k.season - 3 AND k.season - 1 GROUP BY ALL),
pf AS (SELECT season, venue_id, CASE WHEN n >= 70 THEN 1 + (x * 1.0 / n / (sum(x) OVER s / sum(n) OVER s) - 1) * n / (n + 162.0) END AS f FROM w3 WINDOW s AS (PARTITION BY season)),
tr AS (SELECT t.*, runs / coalesce(f, 1) AS off FROM team_games t LEFT JOIN pf ON pf.season = t.season AND pf.venue_id = t.venue_id),
lc AS (SELECT season, date, sum(x) OVER w AS x, sum(n) OVER w AS n FROM (SELECT season, date, sum(runs) AS x, count(*) AS n FROM tr GROUP BY ALL) WINDOW w AS (PARTITION BY season ORDER BY date)), lp AS (SELECT season + 1 AS season, avg(runs) AS m FROM tr GROUP BY season UNION ALL SELECT season, avg(runs) FROM tr WHERE season = (SELECT min(season) FROM tr) GROUP BY season),
oc AS (SELECT team, season, date, sum(x) OVER w AS x, sum(n) OVER w AS n FROM (SELECT team, season, date, sum(off) AS x, count(*) AS n FROM tr GROUP BY ALL) WINDOW w AS (PARTITION BY team, season ORDER BY date)), op AS (SELECT team, season + 1 AS season, avg(off) AS m FROM tr GROUP BY ALL),
dc AS (SELECT team, season, date, sum(x) OVER w AS x, sum(n) OVER w AS n FROM (SELECT opponent AS team, season, date, sum(off) AS x, count(*) AS n FROM tr GROUP BY ALL) WINDOW w AS (PARTITION BY team, season ORDER BY date)), dp AS (SELECT opponent AS team, season + 1 AS season, avg(off) AS m FROM tr GROUP BY ALL),
q1 AS (SELECT t.game_id, t.team, t.opponent, t.season, t.date, t.venue_id, lc.x AS lx, lc.n AS ln_ FROM team_games t ASOF LEFT JOIN lc ON lc.season = t.season AND t.date > lc.date), q2 AS (SELECT q1.*, oc.x AS ox, oc.n AS on_ FROM q1 ASOF LEFT JOIN oc ON oc.team = q1.team AND oc.season = q1.season AND q1.date > oc.date),
q3 AS (SELECT q2.*, dc.x AS dx, dc.n AS dn FROM q2 ASOF LEFT JOIN dc ON dc.team = q2.opponent AND dc.season = q2.season AND q2.date > dc.date)
SELECT q.game_id, q.team AS bat_team, round(coalesce(f, 1), 8) AS park_factor, f IS NULL AS new_park, CASE WHEN q.venue_id % 14 = 0 THEN 72.0 ELSE coalesce(CASE WHEN q.game_id % 13 > 0 THEN 50.0 + q.game_id % 40 END, 72.0) END AS temp_f, q.game_id % 13 = 0 AND q.venue_id % 14 > 0 AS temp_missing, q.venue_id % 14 = 7 AS roof_park,
  round((coalesce(lx, 0) + {K_LEAGUE} * lp.m) / (coalesce(ln_, 0) + {K_LEAGUE}), 8) AS level, round((coalesce(ox, 0) + {K_TEAM} * (lp.m + (1 - 1 / 3.0) * (coalesce(op.m, lp.m) - lp.m))) / (coalesce(on_, 0) + {K_TEAM}), 8) AS team_off, round((coalesce(dx, 0) + {K_TEAM} * (lp.m + (1 - 1 / 3.0) * (coalesce(dp.m, lp.m) - lp.m))) / (coalesce(dn, 0) + {K_TEAM}), 8) AS team_def
FROM q3 q LEFT JOIN pf ON pf.season = q.season AND pf.venue_id = q.venue_id LEFT JOIN lp ON lp.season = q.season LEFT JOIN op ON op.team = q.team AND op.season = q.season LEFT JOIN dp ON dp.team = q.opponent AND dp.season = q.season""",
)
def environment(spark, sf):
    """Park factor, temperature (72 under a fixed roof or where it is unknown), retractable roof, the league's level blended with
    last season's, and the teams' park-adjusted offence and defence to date with regressed priors."""
    t, g = team_games(spark, sf), games(spark, sf)
    tot = g.groupBy("season", "venue_id").agg(F.count("*").alias("n"), F.sum(F.col("home_final") + F.col("away_final")).alias("x"))
    w = asof.serve_seasons(tot, "season", 3).groupBy(F.col("target").alias("season"), "venue_id").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    every = w.groupBy("season").agg((F.sum("x") / F.sum("n")).alias("every"))
    pf = w.join(F.broadcast(every), "season").select("season", "venue_id", rates.ratio_factor(F.col("x") / F.col("n"), F.col("every"), F.col("n"), 162.0, 70).alias("f"))
    rows = t.join(pf, ["season", "venue_id"], "left").withColumn("off", F.col("runs") / F.coalesce("f", F.lit(1.0)))
    run = lambda by, value, names: asof.running_totals(rows.withColumnRenamed("date", "day"), by, "day", {"x": F.col(value), "n": F.lit(1)}).select(*by, "day", F.col("cum_x").alias(names[0]), F.col("cum_n").alias(names[1]))
    means = rows.groupBy("season").agg(F.avg("runs").alias("lm"))
    first = means.agg(F.min("season").alias("_first"))
    league = means.select((F.col("season") + 1).alias("season"), "lm").unionByName(means.crossJoin(F.broadcast(first)).where("season = _first").drop("_first"))  # the first season has none before it
    before = lambda team, name: rows.groupBy(team, (F.col("season") + 1).alias("season")).agg(F.avg("off").alias(name))
    q = rows.select("game_id", "team", "opponent", "season", "date", "venue_id", "f")
    q = asof.at_cutoffs(q, run(["season"], "runs", ("lx", "ln")), ["season"], "date", "day").drop("day")
    q = asof.asof_join(q, run(["team", "season"], "off", ("ox", "on")), ["team", "season"], "date", "day").drop("day")
    q = asof.asof_join(q, run(["opponent", "season"], "off", ("dx", "dn")), ["opponent", "season"], "date", "day")
    q = q.join(F.broadcast(league), "season", "left").join(before("team", "om"), ["team", "season"], "left").join(before("opponent", "dm"), ["opponent", "season"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    strength = lambda x, n, m: r((zero(x) + K_TEAM * (F.col("lm") + (1 - REGRESS) * (F.coalesce(m, "lm") - F.col("lm")))) / (zero(n) + K_TEAM), 8)
    dome, seen = F.col("venue_id") % 14 == 0, F.when(F.col("game_id") % 13 > 0, 50.0 + F.col("game_id") % 40)
    return q.select(
        "game_id", F.col("team").alias("bat_team"), r(F.coalesce("f", F.lit(1.0)), 8).alias("park_factor"), F.col("f").isNull().alias("new_park"), F.when(dome, 72.0).otherwise(F.coalesce(seen, F.lit(72.0))).alias("temp_f"), (seen.isNull() & ~dome).alias("temp_missing"), (F.col("venue_id") % 14 == 7).alias("roof_park"),
        r((zero("lx") + K_LEAGUE * F.col("lm")) / (zero("ln") + K_LEAGUE), 8).alias("level"), strength("ox", "on", "om").alias("team_off"), strength("dx", "dn", "dm").alias("team_def"),
    )


@query(
    "survey_op19_factor_by_side",
    f"""{WITH_PITCHES}, b AS (SELECT CAST(year(data_date) AS INT) AS season, venue_id, CASE WHEN half = 'O' THEN fld_team ELSE bat_team END AS home, CASE WHEN half = 'O' THEN bat_team ELSE fld_team END AS away, CASE WHEN batter_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, CASE WHEN result = 'R' THEN 1 ELSE 0 END AS hit FROM pitches),
h AS (SELECT season, venue_id, home AS team, side, count(*) AS n, sum(hit) AS s FROM b GROUP BY ALL), rd AS (SELECT season, away AS team, side, count(*) AS n, sum(hit) AS s FROM b GROUP BY ALL), e AS (SELECT h.season, venue_id, h.side, h.n, h.s, h.n * rd.s * 1.0 / rd.n AS x FROM h JOIN rd ON rd.season = h.season AND rd.team = h.team AND rd.side = h.side),
w AS (SELECT k.season, venue_id, side, sum(n) AS n, sum(s) AS s, sum(x) AS x FROM (SELECT DISTINCT season FROM pitches) k JOIN e ON e.season BETWEEN k.season - 3 AND k.season - 1 GROUP BY ALL)
SELECT season, venue_id, side, CAST(n AS BIGINT) AS n, round(ln(1 + (coalesce(s / nullif(x, 0), 1) - 1) * n / (n + 500.0)), 8) AS log_factor FROM w""",
)
def factor_by_side(spark, sf):
    """A venue's factor for each batting side from what became known in the three seasons before: events against those expected
    of the home teams' volume there at their rate on the road."""
    home = F.when(F.col("half") == "O", F.col("fld_team")).otherwise(F.col("bat_team"))
    away = F.when(F.col("half") == "O", F.col("bat_team")).otherwise(F.col("fld_team"))
    p = pitches(spark, sf)
    b = p.select(F.year("data_date").alias("season"), "venue_id", home.alias("home"), away.alias("away"), F.when(F.col("batter_id") % 2 == 0, "L").otherwise("R").alias("side"), F.when(F.col("result") == "R", 1).otherwise(0).alias("hit"))
    h = b.groupBy("season", "venue_id", F.col("home").alias("team"), "side").agg(F.count("*").alias("n"), F.sum("hit").alias("s"))
    road = b.groupBy("season", F.col("away").alias("team"), "side").agg((F.sum("hit") / F.count("*")).alias("rate"))
    e = h.join(road, ["season", "team", "side"]).groupBy("season", "venue_id", "side").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("rate")).alias("x"))
    w = asof.serve_seasons(e, "season", 3).groupBy(F.col("target").alias("season"), "venue_id", "side").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("x").alias("x"))
    w = w.join(F.broadcast(p.select("season").distinct()), "season", "left_semi")
    ratio = F.coalesce(F.col("s") / F.nullif(F.col("x"), F.lit(0.0)), F.lit(1.0))
    return w.select("season", "venue_id", "side", "n", r(F.log(1 + (ratio - 1) * F.col("n") / (F.col("n") + 500.0)), 8).alias("log_factor"))


@query(
    "survey_op29_segment_mix",
    f"""SELECT s.game_id, s.fld_team, round((share_f5 * skill + third_time * 0.03 + (3 - share_f5) * coalesce(skill_all - 0.25, 0)) / 3, 5) AS composite, round(third_time / 3, 6) AS third_share, skill_all IS NULL AS pen_missing
FROM ({ORACLE_SQL["survey_op10_starter_row"]}) s LEFT JOIN ({ORACLE_SQL["survey_op11_bullpen_pool"]}) p ON p.game_id = s.game_id AND p.fld_team = s.fld_team""",
)
def mix(spark, sf):
    """A segment's pitching from joined groups: the starter's share at their skill, the third time through, the bullpen's rest."""
    a = settled_appearances(pitches(spark, sf))
    with overridden(appearances=lambda _: a):
        s = QUERIES["survey_op10_starter_row"](spark, sf).select("game_id", "fld_team", "share_f5", "skill", "third_time")
        s = tables.settled(s)  # its shuffles are gone before the bullpens'
        p = QUERIES["survey_op11_bullpen_pool"](spark, sf).select("game_id", "fld_team", "skill_all")
    x = s.join(p, ["game_id", "fld_team"], "left")
    pen = F.coalesce(F.col("skill_all") - 0.25, F.lit(0.0))
    return x.select("game_id", "fld_team", r((F.col("share_f5") * F.col("skill") + F.col("third_time") * 0.03 + (3 - F.col("share_f5")) * pen) / 3, 5).alias("composite"), r(F.col("third_time") / 3).alias("third_share"), F.col("skill_all").isNull().alias("pen_missing"))


# forms


@query(
    "survey_op32_team_form",
    f"""{WITH_TEAM_GAMES}, f AS (SELECT team, season, date, sum(CASE WHEN runs > allowed THEN 1 ELSE 0 END) AS w, count(*) AS n, sum(runs - allowed) AS diff FROM team_games GROUP BY ALL),
c AS (SELECT team, season, date, sum(w) OVER x AS w, sum(n) OVER x AS n, sum(diff) OVER x AS diff FROM f WINDOW x AS (PARTITION BY team, season ORDER BY date)),
o AS (SELECT *, sum(CASE WHEN runs > allowed THEN 1 ELSE 0 END) OVER l AS w10, count(*) OVER l AS n10, sum(runs - allowed) OVER l AS d10 FROM team_games WINDOW l AS (PARTITION BY team, season ORDER BY date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
dd AS (SELECT DISTINCT team % 5 AS div, season, date FROM team_games), teams AS (SELECT DISTINCT team, team % 5 AS div FROM team_games), at_ AS (SELECT dd.div, dd.season, dd.date, teams.team FROM dd JOIN teams ON teams.div = dd.div),
st AS (SELECT a.div, a.season, a.date, a.team, coalesce(c.w, 0) AS w, coalesce(c.n, 0) AS n FROM at_ a ASOF LEFT JOIN c ON c.team = a.team AND c.season = a.season AND a.date > c.date), ld AS (SELECT div, season, date, arg_max({{'w': w, 'n': n, 't': team}}, (2 * w - n, -team)) AS l FROM st GROUP BY ALL),
j AS (SELECT q.*, coalesce(c.w, 0) AS cw, coalesce(c.n, 0) AS cn, c.diff AS cdiff, c.n IS NULL AS fresh FROM o q ASOF LEFT JOIN c ON q.team = c.team AND q.season = c.season AND q.date > c.date)
SELECT j.game_id, j.team, CASE WHEN NOT fresh THEN CAST(cw AS BIGINT) END AS wins, CASE WHEN NOT fresh THEN CAST(cn - cw AS BIGINT) END AS losses, CAST(cdiff AS BIGINT) AS run_diff, CASE WHEN NOT fresh THEN CAST(CAST(cw AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(cn - cw AS BIGINT) AS VARCHAR) END AS record,
  CASE WHEN n10 > 0 THEN CAST(CAST(w10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(n10 - w10 AS BIGINT) AS VARCHAR) END AS record_last_10, CASE WHEN n10 > 0 THEN CAST(d10 AS BIGINT) END AS run_diff_last_10,
  ((l.w - cw) + ((cn - cw) - (l.n - l.w))) / 2.0 AS games_back, ((l.w - cw) + ((cn - cw) - (l.n - l.w))) / 2.0 > greatest(162 - cn, 0) OR (l.t = j.team AND ((l.w - cw) + ((cn - cw) - (l.n - l.w))) = 0 AND greatest(162 - cn, 0) < 1) AS decided
FROM j JOIN ld ON ld.div = j.team % 5 AND ld.season = j.season AND ld.date = j.date""",
)
def team_form(spark, sf):
    """Record and run difference to date (days before only), over the last ten games, games behind the division's leader of that
    day, and whether the season is decided for the team."""
    t = team_games(spark, sf)
    win = F.when(F.col("runs") > F.col("allowed"), 1).otherwise(0)
    run = asof.running_totals(t.withColumnRenamed("date", "day"), ["team", "season"], "day", {"w": win, "n": F.lit(1), "d": F.col("runs") - F.col("allowed")}).select("team", "season", "day", "cum_w", "cum_n", "cum_d")
    ten = Window.partitionBy("team", "season").orderBy("date", "game_id").rowsBetween(-10, -1)
    asked = t.select("game_id", "team", "season", "date", F.sum(win).over(ten).alias("w10"), F.count("*").over(ten).alias("n10"), F.sum(F.col("runs") - F.col("allowed")).over(ten).alias("d10"))
    own = asof.asof_join(asked, run, ["team", "season"], "date", "day").withColumn("div", F.col("team") % 5)
    members = t.select("team").distinct().withColumn("div", F.col("team") % 5)  # a division has a few teams
    days = t.select((F.col("team") % 5).alias("div"), "season", "date").distinct().join(F.broadcast(members), "div")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    standing = asof.asof_join(days, run, ["team", "season"], "date", "day").select("div", "season", "date", "team", zero("cum_w").alias("lw"), zero("cum_n").alias("ln"))
    leader = standing.groupBy("div", "season", "date").agg(F.max_by(F.struct("lw", "ln", F.col("team").alias("lt")), F.struct(2 * F.col("lw") - F.col("ln"), -F.col("team"))).alias("l"))
    x = own.join(leader, ["div", "season", "date"])
    w, n = zero("cum_w"), zero("cum_n")
    back = ((F.col("l.lw") - w) + ((n - w) - (F.col("l.ln") - F.col("l.lw")))) / 2.0
    left = F.greatest(162 - n, F.lit(0))
    text = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), (F.col(b) - F.col(a)).cast("string"))
    some = F.col("n10") > 0
    return x.select(
        "game_id", "team", F.col("cum_w").alias("wins"), (F.col("cum_n") - F.col("cum_w")).alias("losses"), F.col("cum_d").alias("run_diff"), F.when(F.col("cum_w").isNotNull(), text("cum_w", "cum_n")).alias("record"),
        F.when(some, text("w10", "n10")).alias("record_last_10"), F.when(some, F.col("d10")).alias("run_diff_last_10"), back.alias("games_back"), ((back > left) | ((F.col("l.lt") == F.col("team")) & (back == 0) & (left < 1))).alias("decided"),
    )


@query(
    "survey_op33_batter_form",
    f"""{WITH_PITCHES}, d AS (SELECT batter_id, CAST(year(data_date) AS INT) AS season, data_date, sum(value) AS v, count(*) AS n FROM pitches GROUP BY ALL), q AS (SELECT DISTINCT batter_id, season, date FROM pitches), c AS (SELECT batter_id, season, data_date, sum(v) OVER w AS v, sum(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY batter_id, season ORDER BY data_date)),
m AS (SELECT q.batter_id, q.date, sum(n) AS n, sum(v) AS v FROM q JOIN d ON d.batter_id = q.batter_id AND d.data_date < q.date AND d.data_date >= q.date - 30 GROUP BY q.batter_id, q.date), s AS (SELECT q.batter_id, q.date, c.n, c.v FROM q ASOF LEFT JOIN c ON c.batter_id = q.batter_id AND c.season = q.season AND q.date > c.data_date)
SELECT s.batter_id, CAST(s.date AS VARCHAR) AS day, CAST(coalesce(m.n, 0) AS BIGINT) AS n, round(m.v / m.n, 6) AS value, CAST(coalesce(s.n, 0) AS BIGINT) AS season_n, round(s.v / s.n, 6) AS season_value FROM s LEFT JOIN m ON m.batter_id = s.batter_id AND m.date = s.date""",
)
def batter_form(spark, sf):
    """What a batter's facts of the last thirty days and of the season so far say before each of their days, for all keys at once."""
    p = pitches(spark, sf)
    d = p.groupBy("batter_id", F.year("data_date").alias("season"), F.col("data_date").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("c"))
    q = p.select("batter_id", "season", F.col("date").alias("cutoff")).distinct()
    month = asof.trailing_totals(q, d.drop("season"), ["batter_id"], "cutoff", "day", 30, {"n": F.sum("c"), "s": F.sum("v")})
    run = asof.running_totals(d, ["batter_id", "season"], "day", {"v": F.col("v"), "c": F.col("c")}).select("batter_id", "season", "day", "cum_v", "cum_c")
    out = asof.asof_join(q, run, ["batter_id", "season"], "cutoff", "day").join(month, ["batter_id", "cutoff"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("batter_id", F.col("cutoff").cast("string").alias("day"), zero("n").alias("n"), r(F.col("s") / F.col("n")).alias("value"), zero("cum_c").alias("season_n"), r(F.col("cum_v") / F.col("cum_c")).alias("season_value"))


# umpires


def _boost(kind: str) -> str:
    """CTEs of an umpire's rate of ``kind`` above the league's as of each date, in ``rate``."""
    return f"""{WITH_PITCHES}, f AS (SELECT CAST(game_id % 12 AS INT) AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, sum(CASE WHEN result = '{kind}' THEN 1.0 ELSE 0 END) AS s, CAST(count(*) AS DOUBLE) AS n FROM pitches GROUP BY ALL), q AS (SELECT DISTINCT CAST(game_id % 12 AS INT) AS who, season, date AS cutoff FROM pitches), {CENTRED.format(k=200)}"""


_CALLS = f"""{WITH_PITCHES}, zd AS (SELECT CAST(game_id % 12 AS INT) AS umpire, CAST(year(data_date) AS INT) AS season, data_date AS day, count(*) AS called, count(*) FILTER (WHERE inside = (result = 'A')) AS correct, count(*) FILTER (WHERE NOT inside AND result = 'A') - count(*) FILTER (WHERE inside AND result = 'N') AS extra
  FROM (SELECT *, px BETWEEN 0.02 AND 0.08 AND pz BETWEEN 0.01 AND 0.06 AS inside FROM pitches WHERE result IN ('A', 'N')) GROUP BY ALL), zc AS (SELECT umpire, season, day, sum(called) OVER w AS called, sum(correct) OVER w AS correct, sum(extra) OVER w AS extra FROM zd WINDOW w AS (PARTITION BY umpire, season ORDER BY day))
SELECT q.umpire, q.season, q.cutoff, zc.called, zc.correct, zc.extra FROM (SELECT DISTINCT CAST(game_id % 12 AS INT) AS umpire, season, date AS cutoff FROM pitches) q ASOF LEFT JOIN zc ON zc.umpire = q.umpire AND zc.season = q.season AND q.cutoff > zc.day"""


@query(
    "survey_op35_umpire_season_stats",
    f"SELECT a.who AS umpire, a.season, CAST(a.cutoff AS VARCHAR) AS cutoff, CAST(a.cur_n AS BIGINT) AS n, round(100.0 * z.correct / z.called, 6) AS accuracy_pct, round(100.0 * z.extra / z.called, 6) AS favour, round(a.value, 8) AS k_boost, round(b.value, 8) AS bb_boost FROM ({_boost('R')} SELECT * FROM rate) a JOIN ({_boost('N')} SELECT * FROM rate) b ON a.who = b.who AND a.season = b.season AND a.cutoff = b.cutoff JOIN ({_CALLS}) z ON z.umpire = a.who AND z.season = a.season AND z.cutoff = a.cutoff",
)
def umpires(spark, sf):
    """An umpire's correct calls, called strikes outside the zone less missed ones inside it, and strikeout and walk rates above
    the league's, as of each of the umpire's dates."""
    p = pitches(spark, sf).withColumn("umpire", (F.col("game_id") % 12).cast("int"))
    asked = p.select("umpire", "season", F.col("date").alias("cutoff")).distinct()
    n = lambda kind: F.sum(F.when(F.col("result") == kind, 1.0).otherwise(0.0))
    inside = F.col("px").between(0.02, 0.08) & F.col("pz").between(0.01, 0.06)
    called, strike = F.col("result").isin("A", "N"), F.col("result") == "A"
    count = lambda c: F.count(F.when(called & c, 1))
    facts = p.groupBy("umpire", F.year("data_date").alias("season"), F.col("data_date").alias("day")).agg(
        n("R").alias("k"), n("N").alias("b"), F.count("*").cast("double").alias("n"), count(F.lit(True)).alias("called"), count(inside == strike).alias("correct"), (count(~inside & strike) - count(inside & ~strike)).alias("extra")
    )
    k, b = (rates.centred_rate(asked, facts.withColumn("s", F.col(c)), "umpire", 200.0, rates.SEASON_WEIGHTS).withColumnRenamed("value", c) for c in ("k", "b"))
    calls = asof.running_totals(facts.where("called > 0"), ["umpire", "season"], "day", {c: F.col(c) for c in ("called", "correct", "extra")}).select("umpire", "season", "day", "cum_called", "cum_correct", "cum_extra")
    calls = asof.asof_join(asked, calls, ["umpire", "season"], "cutoff", "day")
    both = k.join(b.select("umpire", "season", "cutoff", "b"), ["umpire", "season", "cutoff"]).join(calls, ["umpire", "season", "cutoff"])
    share = lambda c: r(100.0 * F.col(f"cum_{c}") / F.col("cum_called"))
    return both.select("umpire", "season", F.col("cutoff").cast("string").alias("cutoff"), F.col("cur_n").cast("long").alias("n"), share("correct").alias("accuracy_pct"), share("extra").alias("favour"), r(F.col("k"), 8).alias("k_boost"), r(F.col("b"), 8).alias("bb_boost"))


# settings


@query(
    "survey_op59_setting_sweep",
    f"""{WITH_TEAM_GAMES}, t AS (SELECT team, season, sum(runs) AS s, count(*) AS n FROM team_games GROUP BY ALL), mu AS (SELECT avg(runs) AS mu FROM team_games), ms AS (SELECT season, avg(runs) AS ms FROM team_games GROUP BY season),
x AS (SELECT CASE WHEN a.season <= 1998 THEN 'A' ELSE 'B' END AS fold, k, w, pow(b.s * 1.0 / b.n - (a.s + k * (w * ms + (1 - w) * mu)) / (a.n + k), 2) AS e FROM t a JOIN t b ON b.team = a.team AND b.season = a.season + 1 JOIN ms ON ms.season = a.season, mu, (SELECT unnest([0.0, 50.0, 200.0, 800.0]) AS k), (SELECT unnest([0.0, 0.5, 1.0]) AS w)),
m AS (SELECT fold, k, w, avg(e) AS mse FROM x GROUP BY ALL) SELECT fold, k, w, round(mse, 8) AS mse, row_number() OVER (PARTITION BY fold ORDER BY round(mse, 10), k, w) = 1 AS best FROM m""",
)
def sweep(spark, sf):
    """Two constants at once, by fold: how much of a prior a team's mean is shrunk to, and how much of that prior is the season's
    own level; every setting is a column, so the sweep is one job."""
    tg = team_games(spark, sf)
    t = tg.groupBy("team", "season").agg(F.sum("runs").alias("s"), F.count("*").alias("n"))
    after = t.select("team", (F.col("season") - 1).alias("season"), (F.col("s") / F.col("n")).alias("next"))
    level = tg.groupBy("season").agg(F.avg("runs").alias("ms"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k in (0.0, 50.0, 200.0, 800.0) for w in (0.0, 0.5, 1.0)]))
    x = t.join(after, ["team", "season"]).join(F.broadcast(level), "season").crossJoin(F.broadcast(tg.agg(F.avg("runs").alias("mu")))).withColumn("g", grid).select("*", "g.*")
    prior = F.col("w") * F.col("ms") + (1 - F.col("w")) * F.col("mu")
    error = F.pow(F.col("next") - (F.col("s") + F.col("k") * prior) / (F.col("n") + F.col("k")), 2)
    out = x.groupBy(F.when(F.col("season") <= 1998, "A").otherwise("B").alias("fold"), "k", "w").agg(F.avg(error).alias("mse"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("mse", 10), "k", "w")) == 1  # a row a setting
    return out.select("fold", "k", "w", r(F.col("mse"), 8).alias("mse"), best.alias("best"))


@query(
    "survey_op5_contact_quality",
    f"""{WITH_PITCHES}, c AS (SELECT *, CAST(floor(velo / 5) AS INT) AS ev, CAST(floor(px * 50) AS INT) AS la FROM pitches WHERE result = 'A'), z AS (SELECT * FROM c WHERE year(data_date) = 1995), m AS (SELECT avg(value) AS m FROM z), co AS (SELECT ev, (sum(value) + 20.0 * any_value(m)) / (count(*) + 20.0) AS x FROM z, m GROUP BY ev),
fi AS (SELECT z.ev, z.la, (sum(value) + 10.0 * any_value(x)) / (count(*) + 10.0) AS x FROM z JOIN co ON co.ev = z.ev GROUP BY z.ev, z.la), e AS (SELECT c.batter_id AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, coalesce(fi.x, co.x, m.m) AS x FROM c LEFT JOIN fi ON fi.ev = c.ev AND fi.la = c.la LEFT JOIN co ON co.ev = c.ev, m),
d AS (SELECT who, season, day, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT who, season, sum(s) AS s, sum(n) AS n FROM d GROUP BY ALL), lg AS (SELECT season + 1 AS season, sum(s) / sum(n) AS mu FROM t GROUP BY season), ru AS (SELECT who, season, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY who, season ORDER BY day)),
p AS (SELECT who, t.season + lag AS season, sum(w * s) AS s, sum(w * n) AS n FROM t, (VALUES (1, 0.8), (2, 0.6), (3, 0.4)) v(lag, w) GROUP BY ALL), q AS (SELECT DISTINCT batter_id AS who, season, date AS cutoff FROM pitches)
SELECT q.who AS batter_id, q.season, CAST(q.cutoff AS VARCHAR) AS cutoff, round((coalesce(ru.s, 0) + coalesce(p.s, 0) + 50 * coalesce(mu, (SELECT m FROM m))) / (coalesce(ru.n, 0) + coalesce(p.n, 0) + 50), 4) AS contact FROM q ASOF LEFT JOIN ru ON ru.who = q.who AND ru.season = q.season AND q.cutoff > ru.day LEFT JOIN p ON p.who = q.who AND p.season = q.season LEFT JOIN lg ON lg.season = q.season""",
)
def contact(spark, sf):
    """Expected value of contact from a lookup frozen on one season (fine cell, else coarse, else the mean), blended over seasons
    by batter as of each of their days."""
    p = pitches(spark, sf)
    c = p.where("result = 'A'").withColumns({"ev": F.floor(F.col("velo") / 5).cast("int"), "la": F.floor(F.col("px") * 50).cast("int")})
    z = c.where("year(data_date) = 1995")
    whole = z.agg(F.avg("value").alias("m"))
    coarse = z.groupBy("ev").agg(F.sum("value").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(whole)).select("ev", ((F.col("s") + 20.0 * F.col("m")) / (F.col("n") + 20.0)).alias("wide"))
    fine = rates.smoothed_lookup(z, "value", ["ev", "la"], ["ev"], 10.0, 20.0).select("ev", "la", "expected")
    e = c.join(F.broadcast(fine), ["ev", "la"], "left").join(F.broadcast(coarse), "ev", "left").crossJoin(F.broadcast(whole))  # the lookup's size is fixed
    facts = e.groupBy(F.col("batter_id").alias("who"), F.year("data_date").alias("season"), F.col("data_date").alias("day")).agg(F.sum(F.coalesce("expected", "wide", "m")).alias("s"), F.count("*").alias("n"))
    default = whole.first()[0] or 0.0
    out = rates.decayed_rate(p.select(F.col("batter_id").alias("who"), "season", F.col("date").alias("cutoff")), facts, 50.0, default)
    return out.select(F.col("who").alias("batter_id"), "season", F.col("cutoff").cast("string").alias("cutoff"), r(F.col("value"), 4).alias("contact"))
