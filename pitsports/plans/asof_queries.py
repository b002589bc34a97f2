"""As-of joins, running totals and decayed, shrunk rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitsports.operators import asof, rates
from pitsports.plans.base import WITH_PITCHES, WITH_TEAM_GAMES, games, pitches, query, r, table, team_games

EVENTS = """
WITH facts AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS hits, count(*) AS n FROM events GROUP BY ALL
), running AS (
  SELECT user_id, day, CAST(sum(hits) OVER w AS BIGINT) AS cum_hits, CAST(sum(n) OVER w AS BIGINT) AS cum_n FROM facts
  WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)
)"""


def _event_running(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return asof.running_totals(e, ["user_id"], "day", {"hits": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "n": F.lit(1)})


@query(
    "jn7_strict_asof_join",
    EVENTS
    + """
SELECT q.user_id, CAST(q.day AS VARCHAR) AS day, r.cum_hits, r.cum_n FROM facts q ASOF LEFT JOIN running r ON q.user_id = r.user_id AND q.day > r.day
""",
)
def strict_asof(spark, sf):
    run = _event_running(spark, sf)
    out = asof.asof_join(run.select("user_id", "day"), run.select("user_id", F.col("day").alias("fact_day"), "cum_hits", "cum_n"), ["user_id"], "day", "fact_day")
    return out.select("user_id", F.col("day").cast("string").alias("day"), "cum_hits", "cum_n")


@query(
    "win4_running_totals",
    EVENTS + "SELECT user_id, CAST(day AS VARCHAR) AS day, cum_hits, cum_n FROM running",
)
def running(spark, sf):
    return _event_running(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), "cum_hits", "cum_n")


@query(
    "survey_op1_decayed_shrunk_rate",
    f"""{WITH_PITCHES}, base AS (
  SELECT pitcher_id, CAST(year(data_date) AS INT) AS season, data_date, CAST(sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS k, count(*) AS n FROM pitches GROUP BY ALL
), cur AS (
  SELECT pitcher_id, season, data_date, sum(k) OVER w AS ck, sum(n) OVER w AS cn FROM base
  WINDOW w AS (PARTITION BY pitcher_id, season ORDER BY data_date ROWS UNBOUNDED PRECEDING)
), tot AS (SELECT pitcher_id, season, sum(k) AS k, sum(n) AS n FROM base GROUP BY ALL
), league AS (SELECT season + 1 AS season, sum(k) * 1.0 / sum(n) AS mu FROM tot GROUP BY season
), keys AS (SELECT DISTINCT pitcher_id, season, date AS cutoff FROM pitches
), asked AS (
  SELECT q.pitcher_id, q.season, q.cutoff, c.ck, c.cn FROM keys q
  ASOF LEFT JOIN cur c ON q.pitcher_id = c.pitcher_id AND q.season = c.season AND q.cutoff > c.data_date
)
SELECT a.pitcher_id, a.season, CAST(a.cutoff AS VARCHAR) AS cutoff,
  round((coalesce(ck, 0) + 0.8 * coalesce(s1.k, 0) + 0.6 * coalesce(s2.k, 0) + 0.4 * coalesce(s3.k, 0) + 60 * coalesce(mu, 0.25))
      / (coalesce(cn, 0) + 0.8 * coalesce(s1.n, 0) + 0.6 * coalesce(s2.n, 0) + 0.4 * coalesce(s3.n, 0) + 60), 6) AS rate
FROM asked a
LEFT JOIN tot s1 ON s1.pitcher_id = a.pitcher_id AND s1.season = a.season - 1
LEFT JOIN tot s2 ON s2.pitcher_id = a.pitcher_id AND s2.season = a.season - 2
LEFT JOIN tot s3 ON s3.pitcher_id = a.pitcher_id AND s3.season = a.season - 3
LEFT JOIN league l ON l.season = a.season
""",
)
def decayed_shrunk_rate(spark, sf):
    """One pass over the facts: each is a fact on its availability day, in that day's season, and a question on its own; both
    are summed by day, and a window in that order gives every question the facts before it."""
    hit = F.when(F.col("result") == "R", 1).otherwise(0)
    asks = F.struct("season", F.col("date").alias("at"), F.lit(0).alias("fact"), F.lit(0).alias("k"), F.lit(0).alias("n"))
    tells = F.struct(F.year("data_date").alias("season"), F.col("data_date").alias("at"), F.lit(1).alias("fact"), hit.alias("k"), F.lit(1).alias("n"))
    daily = pitches(spark, sf).select("pitcher_id", F.explode(F.array(asks, tells)).alias("e")).groupBy("pitcher_id", "e.season", "e.at", "e.fact").agg(F.sum("e.k").alias("k"), F.sum("e.n").alias("n"))
    before = Window.partitionBy("pitcher_id", "season").orderBy("at", "fact").rowsBetween(Window.unboundedPreceding, 0)
    asked = daily.withColumns({"cum_k": F.sum("k").over(before), "cum_n": F.sum("n").over(before)}).where("fact = 0")
    totals = daily.groupBy("pitcher_id", "season").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    lags = asof.serve_seasons(totals, "season", 3).groupBy("pitcher_id", F.col("target").alias("season"))
    prior = lags.agg(*[F.sum(F.when(F.col("lag") == s, F.col(c))).alias(f"{c}{s}") for s in (1, 2, 3) for c in ("k", "n")])
    league = totals.groupBy((F.col("season") + 1).alias("season")).agg((F.sum("k") / F.sum("n")).alias("mu"))
    asked = asked.select("pitcher_id", "season", F.col("at").alias("cutoff"), "cum_k", "cum_n").join(prior, ["pitcher_id", "season"], "left").join(F.broadcast(league), "season", "left")  # a row a season
    rate = rates.shrunk_rate(F.col("cum_k"), F.col("cum_n"), 60.0, F.coalesce("mu", F.lit(0.25)), [(w, F.col(f"k{s}"), F.col(f"n{s}")) for s, w in enumerate(rates.SEASON_WEIGHTS, 1)])
    return asked.select("pitcher_id", "season", F.col("cutoff").cast("string").alias("cutoff"), r(rate).alias("rate"))


@query(
    "jn9_trailing_window_join",
    f"""{WITH_TEAM_GAMES}
SELECT q.game_id, q.team, count(*) AS n_games, CAST(sum(f.runs) AS BIGINT) AS runs FROM team_games q JOIN team_games f
ON q.team = f.team AND f.date < q.date AND f.date >= q.date - 30 GROUP BY ALL
""",
)
def trailing(spark, sf):
    t = team_games(spark, sf)
    q = t.select("game_id", "team", F.col("date").alias("cutoff"))
    f = t.groupBy("team", F.col("date").alias("day")).agg(F.count("*").alias("g"), F.sum("runs").alias("x"))
    seen = asof.trailing_totals(q, f, ["team"], "cutoff", "day", 30, {"n_games": F.sum("g"), "runs": F.sum("x")})
    return q.join(seen, ["team", "cutoff"]).select("game_id", "team", "n_games", "runs")


@query(
    "jn8_asof_one_row_per_day",
    f"""{WITH_TEAM_GAMES}, f AS (SELECT team, date, max(game_id) AS last_game, arg_max(runs, game_id) AS last_runs FROM team_games GROUP BY ALL)
SELECT q.game_id, q.team, f.last_game, f.last_runs FROM team_games q ASOF LEFT JOIN f ON q.team = f.team AND q.date > f.date
""",
)
def asof_tieproof(spark, sf):
    t = team_games(spark, sf)
    last = asof.latest_per_day(t.select("team", F.col("date").alias("day"), F.col("game_id").alias("last_game"), F.col("runs").alias("last_runs")), ["team"], "day", [F.col("last_game")])
    return asof.asof_join(t.select("game_id", "team", "date"), last, ["team"], "date", "day").select("game_id", "team", "last_game", "last_runs")


SEQ = f"""{WITH_TEAM_GAMES}, seq AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game_id) AS s FROM team_games)"""


@query(
    "jn10_sequence_window_join",
    SEQ + " SELECT a.game_id, a.team, count(b.game_id) AS n, CAST(coalesce(sum(b.runs), 0) AS BIGINT) AS runs FROM seq a LEFT JOIN seq b ON a.team = b.team AND b.s BETWEEN a.s - 14 AND a.s - 1 GROUP BY ALL",
)
def sequence_window(spark, sf):
    t = asof.sequence_in_blocks(team_games(spark, sf), ["team"], "season", ["date", "game_id"])
    w = Window.partitionBy("team").orderBy("seq").rangeBetween(-14, -1)
    return t.select("game_id", "team", F.count("game_id").over(w).alias("n"), F.coalesce(F.sum("runs").over(w), F.lit(0)).alias("runs"))


@query("win5_team_game_sequence", SEQ + " SELECT game_id, team, s AS seq FROM seq")
def team_sequence(spark, sf):
    return asof.sequence_in_blocks(team_games(spark, sf), ["team"], "season", ["date", "game_id"]).select("game_id", "team", F.col("seq").cast("long").alias("seq"))


@query(
    "win9_last_ten_record",
    SEQ + """ SELECT game_id, team, CAST(count(*) FILTER (WHERE runs > allowed) OVER w AS BIGINT) AS wins, CAST(count(*) OVER w AS BIGINT) AS played
FROM seq WINDOW w AS (PARTITION BY team ORDER BY s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def last_ten(spark, sf):
    w = Window.partitionBy("team").orderBy("date", "game_id").rowsBetween(-10, -1)
    return team_games(spark, sf).select("game_id", "team", F.count(F.when(F.col("runs") > F.col("allowed"), 1)).over(w).alias("wins"), F.count("*").over(w).alias("played"))


@query(
    "win10_trailing_day_totals",
    f"""{WITH_PITCHES}, d AS (SELECT pitcher_id, data_date, count(*) AS n FROM pitches GROUP BY ALL)
SELECT pitcher_id, CAST(data_date AS VARCHAR) AS day,
  CAST(coalesce(sum(n) OVER (PARTITION BY pitcher_id ORDER BY data_date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS last3,
  CAST(coalesce(sum(n) OVER (PARTITION BY pitcher_id ORDER BY data_date RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS last15
FROM d""",
)
def trailing_days(spark, sf):
    d = pitches(spark, sf).groupBy("pitcher_id", "data_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pitcher_id").orderBy(F.unix_date("data_date"))
    last = lambda k: F.coalesce(F.sum("n").over(w.rangeBetween(-k, -1)), F.lit(0))
    return d.select("pitcher_id", F.col("data_date").cast("string").alias("day"), last(3).alias("last3"), last(15).alias("last15"))


@query(
    "jn11_prior_seasons",
    f"""{WITH_PITCHES}, t AS (SELECT pitcher_id, season, count(*) AS n FROM pitches GROUP BY ALL)
SELECT a.pitcher_id, a.season, b.n AS n1, c.n AS n2, d.n AS n3 FROM t a
LEFT JOIN t b ON b.pitcher_id = a.pitcher_id AND b.season = a.season - 1 LEFT JOIN t c ON c.pitcher_id = a.pitcher_id AND c.season = a.season - 2
LEFT JOIN t d ON d.pitcher_id = a.pitcher_id AND d.season = a.season - 3""",
)
def prior_seasons(spark, sf):
    t = pitches(spark, sf).groupBy("pitcher_id", "season").agg(F.count("*").alias("n"))
    lag = asof.serve_seasons(t, "season", 3).groupBy("pitcher_id", F.col("target").alias("season")).agg(*[F.sum(F.when(F.col("lag") == s, F.col("n"))).alias(f"n{s}") for s in (1, 2, 3)])
    return t.drop("n").join(lag, ["pitcher_id", "season"], "left")


@query(
    "jn12_season_range_join",
    f"""{WITH_TEAM_GAMES}, t AS (SELECT venue_id, season, count(*) AS n, sum(runs) AS runs FROM team_games GROUP BY ALL), s AS (SELECT DISTINCT season FROM t)
SELECT s.season, venue_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(runs) AS BIGINT) AS runs FROM s JOIN t ON t.season BETWEEN s.season - 3 AND s.season - 1 GROUP BY ALL""",
)
def season_range(spark, sf):
    t = team_games(spark, sf).groupBy("venue_id", "season").agg(F.count("*").alias("n"), F.sum("runs").alias("runs"))
    wanted = t.select("season").distinct()
    out = asof.serve_seasons(t, "season", 3).groupBy("target", "venue_id").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    return out.withColumnRenamed("target", "season").join(wanted, "season", "left_semi")


@query(
    "jn13_league_mean_to_date",
    f"""{WITH_TEAM_GAMES}
SELECT q.game_id, q.team, (SELECT round(avg(runs), 6) FROM team_games f WHERE f.season = q.season AND f.date < q.date) AS league_mean FROM team_games q""",
)
def league_mean(spark, sf):
    t = team_games(spark, sf)
    run = asof.running_totals(t.withColumnRenamed("date", "day"), ["season"], "day", {"x": F.col("runs"), "n": F.lit(1)})
    before = run.select("season", F.col("day").alias("date"), ((F.col("cum_x") - F.col("x")) / F.nullif(F.col("cum_n") - F.col("n"), F.lit(0))).alias("mean"))
    return t.join(before, ["season", "date"]).select("game_id", "team", r(F.col("mean")).alias("league_mean"))


@query(
    "survey_op18_ratio_factor",
    f"""{WITH_TEAM_GAMES}, g AS (SELECT season, venue_id, home_team, home_final + away_final AS total FROM games), s AS (SELECT DISTINCT season FROM g),
h AS (SELECT s.season, g.venue_id, avg(total) AS home, count(*) AS n FROM s JOIN g ON g.season BETWEEN s.season - 3 AND s.season - 1 GROUP BY ALL),
a AS (SELECT s.season, avg(total) AS every FROM s JOIN g ON g.season BETWEEN s.season - 3 AND s.season - 1 GROUP BY ALL)
SELECT h.season, h.venue_id, n, round(CASE WHEN n >= 70 THEN 1 + (home / every - 1) * n / (n + 162.0) END, 6) AS factor FROM h JOIN a ON a.season = h.season""",
)
def park_factor(spark, sf):
    g = games(spark, sf).select("season", "venue_id", (F.col("home_final") + F.col("away_final")).alias("total"))
    seasons = g.select("season").distinct()
    sums = g.groupBy("season", "venue_id").agg(F.sum("total").alias("x"), F.count("*").alias("n"))
    served = asof.serve_seasons(sums, "season", 3).groupBy(F.col("target").alias("season"), "venue_id").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    every = served.groupBy("season").agg((F.sum("x") / F.sum("n")).alias("every"))
    out = served.join(every, "season").join(seasons, "season", "left_semi")
    return out.select("season", "venue_id", "n", r(rates.ratio_factor(F.col("x") / F.col("n"), F.col("every"), F.col("n"), 162.0, 70)).alias("factor"))


@query(
    "survey_op34_pitcher_form",
    f"""{WITH_PITCHES}, d AS (SELECT pitcher_id, data_date, sum(velo) AS v, count(*) AS n, sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END) AS k, sum(CASE WHEN result = 'N' THEN 1 ELSE 0 END) AS gb FROM pitches GROUP BY ALL),
q AS (SELECT DISTINCT pitcher_id, date FROM pitches)
SELECT q.pitcher_id, CAST(q.date AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS n, round(sum(v) / sum(n), 6) AS velo, round(100.0 * sum(k) / sum(n), 6) AS whiff_pct, round(100.0 * sum(gb) / sum(n), 6) AS gb_pct,
  round(sum(v) FILTER (WHERE data_date >= q.date - 10) / sum(n) FILTER (WHERE data_date >= q.date - 10) - sum(v) / sum(n), 6) AS velo_trend, CAST(q.date - max(data_date) AS BIGINT) AS days_rest, CAST(arg_max(n, data_date) AS BIGINT) AS last_outing
FROM q JOIN d ON d.pitcher_id = q.pitcher_id AND d.data_date < q.date AND d.data_date >= q.date - 30 GROUP BY q.pitcher_id, q.date""",
)
def pitcher_form(spark, sf):
    """Thirty days before each outing: velocity and its trend of ten days, shares, days of rest, pitches of the last outing."""
    p = pitches(spark, sf)
    n = lambda kind: F.sum(F.when(F.col("result") == kind, 1).otherwise(0))
    d = p.groupBy("pitcher_id", F.col("data_date").alias("day")).agg(F.sum("velo").alias("v"), F.count("*").alias("c"), n("R").alias("w"), n("N").alias("g"))
    sums = {"n": F.sum("c"), "s": F.sum("v"), "k": F.sum("w"), "gb": F.sum("g"), "s10": (10, F.sum("v")), "n10": (10, F.sum("c")), "last": F.max("day"), "outing": F.max_by("c", "day")}
    out = asof.trailing_totals(p.select("pitcher_id", F.col("date").alias("cutoff")), d, ["pitcher_id"], "cutoff", "day", 30, sums)
    share = lambda c: r(100.0 * F.col(c) / F.col("n"))
    return out.select(
        "pitcher_id", F.col("cutoff").cast("string").alias("day"), "n", r(F.col("s") / F.col("n")).alias("velo"), share("k").alias("whiff_pct"), share("gb").alias("gb_pct"),
        r(F.col("s10") / F.col("n10") - F.col("s") / F.col("n")).alias("velo_trend"), F.datediff("cutoff", "last").cast("long").alias("days_rest"), F.col("outing").alias("last_outing"),
    )


