"""Translations between levels, prices in effect, bets on them, and fits, searches and intervals over games."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitsports.functions import columns as fn
from pitsports.operators import asof, fit, gates, rates, spread, stats, tables, translation
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, WITH_TEAM_GAMES, eliminated_sql, games, joint_bootstrap_sql, pitches, query, r, table, team_games
from pitsports.plans.composite_queries import _newton_sql
from pitsports.plans.table_queries import _scratch

# translation between levels

#: Seasons of the fit, the one without minor leagues, shrinkage by stat, chances that a first season needs.
FIT_SEASONS, SKIPPED, SHRINK, CHANCES = (1998, 1999, 2000), (1996,), {"k": 6.0, "v": 12.0}, 1
_WEIGHTS = "(VALUES (1, 0.8), (2, 0.64), (3, 0.48)) v(rank, w)"
_SEASONS = f"(SELECT target, season, row_number() OVER (PARTITION BY target ORDER BY season DESC) AS rank FROM (SELECT DISTINCT season AS target FROM lines) t, LATERAL (SELECT CAST(unnest(range(target - 5, target)) AS INT) AS season) WHERE season NOT IN ({', '.join(map(str, SKIPPED))}))"
TRANSLATION = f"""{WITH_PITCHES},
lines AS (SELECT batter_id * 5 + pitcher_id % 5 AS player, CAST(year(data_date) AS INT) AS season, CASE WHEN pitch_no <= 3 THEN 1 WHEN pitch_no <= 5 THEN 11 ELSE 12 END AS level, count(*) AS n, count(*) FILTER (WHERE result = 'R') AS k, sum(velo) AS v FROM pitches GROUP BY ALL),
long AS (SELECT player, season, level, n, 'k' AS stat, CAST(k AS DOUBLE) AS s FROM lines UNION ALL SELECT player, season, level, n, 'v', v FROM lines),
league AS (SELECT season, level, stat, sum(s) / sum(n) AS l FROM long GROUP BY ALL), rel AS (SELECT player, long.season, long.level, long.stat, n, s / n - l AS x FROM long JOIN league ON league.season = long.season AND league.level = long.level AND league.stat = long.stat),
served AS (SELECT target, season, w FROM {_SEASONS} JOIN {_WEIGHTS} USING (rank)),
firsts AS (SELECT player, min(season) AS target FROM lines WHERE level = 1 GROUP BY player), hist AS (SELECT player, target, stat, level, sum(w * n) AS n, sum(w * n * x) / sum(w * n) AS x FROM rel JOIN served USING (season) WHERE level IN (11, 12) GROUP BY ALL),
xs AS (SELECT player, target, stat, level, n, x * n / (n + CASE stat WHEN 'k' THEN {SHRINK['k']} ELSE {SHRINK['v']} END) AS xs FROM hist),
outcome AS (SELECT long.player, long.season AS target, long.stat, long.n AS w, s / long.n - l AS y FROM long JOIN firsts ON firsts.player = long.player AND firsts.target = long.season JOIN league ON league.season = long.season - 1 AND league.level = 1 AND league.stat = long.stat
  WHERE long.level = 1 AND long.season IN ({', '.join(map(str, FIT_SEASONS))}) AND long.n >= {CHANCES}),
mm AS (SELECT stat, level, sum(w) AS sw, sum(w * xs) AS sx, sum(w * y) AS sy, sum(w * xs * xs) AS sxx, sum(w * xs * y) AS sxy, count(*) AS players FROM xs JOIN outcome USING (player, target, stat) GROUP BY ALL),
consts AS (SELECT stat, level, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx / sw AS c, players FROM mm)"""


def _translation(spark, sf, every: bool):
    """From season lines of three levels: the outcomes of players' first major seasons, and the histories before these or, for
    ``every`` player, before each season."""
    level = F.when(F.col("pitch_no") <= 3, 1).when(F.col("pitch_no") <= 5, 11).otherwise(12).alias("level")
    lines = pitches(spark, sf).groupBy((F.col("batter_id") * 5 + F.col("pitcher_id") % 5).alias("player"), F.year("data_date").alias("season"), level)
    lines = tables.settled(lines.agg(F.count("*").alias("n"), F.count(F.when(F.col("result") == "R", 1)).alias("k"), F.sum("velo").alias("v")))  # read six times below
    relative = translation.relative_rates(lines, {"k": "k", "v": "v"})
    firsts = lines.where("level = 1").groupBy("player").agg(F.min("season").alias("season"))
    long = lines.where("level = 1").join(firsts, ["player", "season"]).where(F.col("season").isin(list(FIT_SEASONS)) & (F.col("n") >= CHANCES))
    long = long.select("player", F.col("season").alias("target"), F.col("n").alias("w"), F.explode(F.array(F.struct(F.lit("k").alias("stat"), F.col("k").cast("double").alias("sum")), F.struct(F.lit("v").alias("stat"), F.col("v").alias("sum")))).alias("e")).select("player", "target", "w", "e.*")
    major = lines.where("level = 1").groupBy((F.col("season") + 1).alias("target")).agg((F.sum("k") / F.sum("n")).alias("_k"), (F.sum("v") / F.sum("n")).alias("_v"))
    outcomes = long.join(F.broadcast(major), "target").select("player", "target", "stat", "w", (F.col("sum") / F.col("w") - F.when(F.col("stat") == "k", F.col("_k")).otherwise(F.col("_v"))).alias("y"))
    if every:
        seasons = lines.select(F.col("season").alias("target")).distinct()
        targets = lines.where("level in (11, 12)").select("player").distinct().crossJoin(F.broadcast(seasons))  # a row a season
    else:
        targets = outcomes.select("player", "target")
    return tables.settled(translation.histories(relative, targets, (11, 12), SHRINK, skipped=SKIPPED)), outcomes


@query("survey_op28_translation", f"{TRANSLATION} SELECT stat, level, round(b, 8) AS b, round(c, 8) AS c, players, TRUE AS matches FROM consts")
def translation_constants(spark, sf):
    """Constants from first seasons in the fit's seasons, stored as a version; a refit is compared with the stored ones."""
    path = _scratch(spark)
    xs, outcomes = _translation(spark, sf, every=False)
    tables.write_version(translation.fitted(xs, outcomes), path, [])
    frozen = tables.current(spark, path)
    again = gates.changed_rows(frozen, translation.fitted(xs, outcomes), ["stat", "level"], ["b", "c", "players"], tolerance=1e-9)
    out = frozen.crossJoin(F.broadcast(again))
    return out.select("stat", "level", r(F.col("b"), 8).alias("b"), r(F.col("c"), 8).alias("c"), "players", (F.col("changed") == 0).alias("matches"))


@query(
    "survey_op28_rookie_adjustment",
    f"""{TRANSLATION} SELECT player, target, round(max(adj) FILTER (WHERE stat = 'k'), 8) AS adj_k, round(max(adj) FILTER (WHERE stat = 'v'), 7) AS adj_v, round(max(n), 6) AS n_minor
FROM (SELECT player, target, stat, sum(n * (b * xs - c)) / sum(n) AS adj, sum(n) AS n FROM xs JOIN consts USING (stat, level) GROUP BY ALL) GROUP BY player, target""",
)
def rookie_adjustment(spark, sf):
    """What a player's minor-league seasons change about the rates expected of a first major season."""
    xs, outcomes = _translation(spark, sf, every=True)
    adj = translation.adjustments(xs, translation.fitted(xs, outcomes))
    of = lambda s: F.max(F.when(F.col("stat") == s, F.col("adj")))
    return adj.groupBy("player", "target").agg(r(of("k"), 8).alias("adj_k"), r(of("v"), 7).alias("adj_v"), r(F.max("n")).alias("n_minor"))


# prices and bets

#: Prices by game, book and time; the hour of the bet (90 minutes before the game's day ends its 40th day) and each book's close.
PRICES = """
ticks AS (SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS INT) AS book, CAST(l_shipdate AS TIMESTAMP) AS ts, 0.40 + max(l_quantity) / 200 AS a, 0.65 - max(l_quantity) / 200 AS b FROM lineitem GROUP BY ALL),
q AS (SELECT game_id, book, date, home_final, away_final, CAST(date AS TIMESTAMP) + INTERVAL 40 DAY - INTERVAL 90 MINUTE AS bet_at, CAST(date AS TIMESTAMP) + to_days(CAST(game_id % 61 AS INT)) AS close_at FROM games JOIN (SELECT DISTINCT game_id, book FROM ticks) USING (game_id)),
n1 AS (SELECT q.*, k.ts, k.a, k.b FROM q ASOF LEFT JOIN ticks k ON k.game_id = q.game_id AND k.book = q.book AND q.bet_at >= k.ts), n2 AS (SELECT q.game_id, q.book, k.ts, k.a, k.b FROM q ASOF LEFT JOIN ticks k ON k.game_id = q.game_id AND k.book = q.book AND q.close_at >= k.ts),
e0 AS (SELECT n1.*, n2.ts AS ts_c, n2.a AS a_c, n2.b AS b_c, coalesce(n1.ts > n1.close_at, FALSE) AS clipped FROM n1 JOIN n2 USING (game_id, book)),
eff AS (SELECT game_id, book, date, home_final, away_final, bet_at, close_at, clipped, a_c, b_c, coalesce(bet_at - INTERVAL 365 DAY > CASE WHEN clipped THEN ts_c ELSE ts END, FALSE) AS stale, CASE WHEN clipped THEN ts_c ELSE ts END AS ts0, CASE WHEN clipped THEN a_c ELSE a END AS a0, CASE WHEN clipped THEN b_c ELSE b END AS b0 FROM e0),
price AS (SELECT * EXCLUDE (ts0, a0, b0), CASE WHEN NOT stale THEN ts0 END AS ts, CASE WHEN NOT stale THEN a0 END AS a, CASE WHEN NOT stale THEN b0 END AS b FROM eff)"""


def _ticks(spark, sf):
    q = F.max("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).cast("int").alias("book"), F.col("l_shipdate").alias("ts")).agg((0.40 + q / 200).alias("a"), (0.65 - q / 200).alias("b"))


def _prices(spark, sf):
    """``price`` of ``PRICES``: the price in effect at the bet's time, by game and book, and the one at the close."""
    ticks = _ticks(spark, sf)
    day = F.col("date").cast("timestamp_ntz")
    g = games(spark, sf).select("game_id", "date", "home_final", "away_final", (day + F.expr("interval 40 days") - F.expr("interval 90 minutes")).alias("at"), (day + F.expr("make_dt_interval(cast(game_id % 61 as int))")).alias("close"))
    q = g.join(ticks.select("game_id", "book").distinct(), "game_id")
    now = asof.price_in_effect(q, ticks, ["game_id", "book"], "at", "close", "ts", 365)
    closing = ticks.select("game_id", "book", F.col("ts").alias("_at"), F.col("a").alias("a_c"), F.col("b").alias("b_c"))
    return asof.asof_join(now, closing, ["game_id", "book"], "close", "_at", strict=False)


@query("survey_op40_price_in_effect", f"{WITH_GAMES}, {PRICES} SELECT game_id, book, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tick_at, round(a, 6) AS a, round(b, 6) AS b, clipped, stale FROM price")
def price_in_effect(spark, sf):
    """The last tick at or before the bet's time, the close's where that tick came after the close, none where it is a year old."""
    p = _prices(spark, sf)
    return p.select("game_id", "book", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tick_at"), r(F.col("a")).alias("a"), r(F.col("b")).alias("b"), "clipped", "stale")


@query(
    "dq20_price_gates",
    f"""{WITH_GAMES}, {PRICES}, v AS (SELECT 'price in range' AS "check", avg(CASE WHEN a IS NULL OR (a BETWEEN 0.3 AND 0.7 AND b BETWEEN 0.3 AND 0.7) THEN 1.0 ELSE 0 END) AS value FROM price
UNION ALL SELECT 'not after the close', avg(CASE WHEN ts IS NULL OR ts <= close_at THEN 1.0 ELSE 0 END) FROM price UNION ALL SELECT 'not after the bet', avg(CASE WHEN ts IS NULL OR ts <= bet_at THEN 1.0 ELSE 0 END) FROM price
UNION ALL SELECT 'games known', avg(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = game_id) THEN 1.0 ELSE 0 END) FROM price) SELECT "check", value, value >= 1 AS passed FROM v""",
)
def price_gates(spark, sf):
    """What a load of prices must satisfy before it is written: range, not after the close, not after the bet's time, games known."""
    p = _prices(spark, sf)
    known = p.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), F.lit(True).alias("known")), "game_id", "left")
    fine = F.col("a").isNull() | (F.col("a").between(0.3, 0.7) & F.col("b").between(0.3, 0.7))
    rules = {"price in range": (p, fine), "not after the close": (p, F.col("ts").isNull() | (F.col("ts") <= F.col("close"))), "not after the bet": (p, F.col("ts").isNull() | (F.col("ts") <= F.col("at"))), "games known": (known, F.coalesce("known", F.lit(False)))}
    out = None
    for name, (rows, rule) in rules.items():
        one = gates.share_at_least(rows, rule, 1.0, name)
        out = one if out is None else out.unionByName(one)
    return out


#: Bets of the model on the side that it prefers: blended probability, value, line move, value at the close, and result.
BETS = """
mk AS (SELECT game_id, any_value(date) AS date, any_value(home_final) > any_value(away_final) AS home_won, avg(a / (a + b)) AS q_t, avg(a_c / (a_c + b_c)) AS q_c, max(1 / a) AS dec_h, max(1 / b) AS dec_a, 0.35 + (game_id % 30) / 100.0 AS p FROM price WHERE a IS NOT NULL AND a_c IS NOT NULL GROUP BY game_id),
bl AS (SELECT *, 1 / (1 + exp(-(ln(q_t / (1 - q_t)) + 0.5 * (ln(p / (1 - p)) - ln(q_t / (1 - q_t)))))) AS blend, p > q_t AS home FROM mk),
ev AS (SELECT *, CASE WHEN home THEN blend * dec_h - 1 ELSE (1 - blend) * dec_a - 1 END AS ev, CASE WHEN home THEN dec_h ELSE dec_a END AS dec FROM bl),
bets AS (SELECT game_id, date, home, ev, CASE WHEN home THEN q_c - q_t ELSE q_t - q_c END AS moved, CASE WHEN home THEN q_c ELSE 1 - q_c END * dec - 1 AS clv, CASE WHEN home = home_won THEN dec - 1 ELSE -1 END AS pnl FROM ev WHERE ev > 0.02 AND abs(p - q_t) <= 0.10 AND p <> q_t)"""


def _bets(spark, sf):
    priced = _prices(spark, sf).where("a is not null and a_c is not null")
    m = priced.groupBy("game_id", "date", (F.col("home_final") > F.col("away_final")).alias("home_won")).agg(
        F.avg(fn.devig_multiplicative(F.col("a"), F.col("b"))).alias("q_t"), F.avg(fn.devig_multiplicative(F.col("a_c"), F.col("b_c"))).alias("q_c"), F.max(1 / F.col("a")).alias("dec_h"), F.max(1 / F.col("b")).alias("dec_a")
    )
    m = m.withColumn("p", 0.35 + (F.col("game_id") % 30) / 100.0).withColumn("home", F.col("p") > F.col("q_t"))
    blend = fn.expit(fn.logit(F.col("q_t")) + 0.5 * (fn.logit(F.col("p")) - fn.logit(F.col("q_t"))))
    side = lambda h, a: F.when(F.col("home"), h).otherwise(a)
    dec = side(F.col("dec_h"), F.col("dec_a"))
    m = m.withColumns({"ev": side(blend, 1 - blend) * dec - 1, "moved": side(F.col("q_c") - F.col("q_t"), F.col("q_t") - F.col("q_c")), "clv": side(F.col("q_c"), 1 - F.col("q_c")) * dec - 1, "pnl": F.when(F.col("home") == F.col("home_won"), dec - 1).otherwise(-1.0)})
    return m.where((F.col("ev") > 0.02) & (F.abs(F.col("p") - F.col("q_t")) <= 0.10) & (F.col("p") != F.col("q_t"))).select("game_id", "date", "home", "ev", "moved", "clv", "pnl")


@query("survey_op42_bet_frame", f"{WITH_GAMES}, {PRICES}, {BETS} SELECT game_id, home, round(ev, 6) AS ev, round(moved, 6) AS moved, round(clv, 6) AS clv, round(pnl, 6) AS pnl FROM bets")
def bet_frame(spark, sf):
    return _bets(spark, sf).select("game_id", "home", *[r(F.col(c)).alias(c) for c in ("ev", "moved", "clv", "pnl")])


def _grouped(rows, groups):
    """Each row once for every group (name: condition) that it belongs to, in ``g``."""
    of = F.filter(F.array(*[F.when(c, name) for name, c in groups.items()]), lambda x: x.isNotNull())
    return rows.withColumn("g", F.explode(of))


@query(
    "survey_op47_bet_summary",
    f"""{WITH_GAMES}, {PRICES}, {BETS}, src AS (SELECT g, pnl, clv, pnl AS x, 1.0 AS w, (date - DATE '1970-01-01') // 7 AS block FROM bets, (VALUES ('all'), ('home'), ('away')) v(g) WHERE g = 'all' OR (g = 'home') = home),
{joint_bootstrap_sql("src", ["g"], 500, 3, "bs")}, i AS (SELECT g, quantile_cont(mean, 0.05) AS lo, quantile_cont(mean, 0.95) AS hi FROM bs GROUP BY g)
SELECT s.g, count(*) AS bets, round(avg(pnl), 6) AS mean, round(sum(pnl), 4) AS units, round(avg(clv), 6) AS clv, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS won, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM src s JOIN i ON i.g = s.g GROUP BY s.g""",
)
def bet_summary(spark, sf):
    """Bets, mean result, units, value at the close, share won, and the mean's interval, of all bets and by side on the same draws."""
    b = _grouped(_bets(spark, sf), {"all": F.lit(True), "home": F.col("home"), "away": ~F.col("home")}).withColumns({"w": F.lit(1.0), "block": F.floor(F.unix_date("date") / 7)})
    ranges = stats.interval(stats.joint_bootstrap(b, "pnl", "w", "block", ["g"], 500, 3), groups=["g"])
    out = b.groupBy("g").agg(F.count("*").alias("bets"), r(F.avg("pnl")).alias("mean"), r(F.sum("pnl"), 4).alias("units"), r(F.avg("clv")).alias("clv"), r(F.avg((F.col("pnl") > 0).cast("double"))).alias("won"))
    return out.join(F.broadcast(ranges), "g").select(*out.columns, r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"))


# comparisons

_PAIRED = f"""{WITH_GAMES}, d AS (SELECT season, date, CASE WHEN season <= 1998 THEN 0.5 ELSE 1.0 END AS w, (date - min(date) OVER (PARTITION BY season)) // 7 + season * 100 AS block, CASE WHEN home_final > away_final THEN 1.0 ELSE 0 END AS y, 0.30 + (game_id % 40) / 100.0 AS a, 0.45 AS b FROM games),
src AS (SELECT g, w, block, y * ln(a / b) + (1 - y) * ln((1 - a) / (1 - b)) AS x FROM d, (VALUES ('all'), ('fold A'), ('fold B'), ('early'), ('late')) v(g) WHERE g = 'all' OR g = CASE WHEN season <= 1998 THEN 'fold A' ELSE 'fold B' END OR g = CASE WHEN month(date) <= 4 THEN 'early' ELSE 'late' END)"""


@query(
    "survey_op46_model_comparison",
    f"""{_PAIRED}, {joint_bootstrap_sql("src", ["g"], 500, 7, "bs")}, i AS (SELECT g, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, stddev_samp(mean) AS se FROM bs GROUP BY g), e AS (SELECT g, count(*) AS n, sum(w * x) / sum(w) AS est FROM src GROUP BY g)
SELECT e.g, n, round(est, 7) AS est, round(lo, 7) AS lo, round(hi, 7) AS hi, round(se, 7) AS se, (SELECT min(lo) FROM i WHERE g = 'all') > 0 AND (SELECT min(est) FROM e WHERE g LIKE 'fold%') > 0 AS passes FROM e JOIN i ON i.g = e.g""",
)
def comparison(spark, sf):
    """Paired difference of two forecasts' log scores, in all, by fold and by part of the season, on the same resampled weeks;
    passes if the interval of all and both folds lie above 0."""
    g = games(spark, sf)
    first = g.groupBy("season").agg(F.min("date").alias("first"))
    y = F.when(F.col("home_final") > F.col("away_final"), 1.0).otherwise(0.0)
    a, b = 0.30 + (F.col("game_id") % 40) / 100.0, F.lit(0.45)
    early = F.col("season") <= 1998
    x = g.join(F.broadcast(first), "season").select("season", "date", F.when(early, 0.5).otherwise(1.0).alias("w"), (F.floor(F.datediff("date", "first") / 7) + F.col("season") * 100).alias("block"), (y * F.log(a / b) + (1 - y) * F.log((1 - a) / (1 - b))).alias("x"))
    spring = F.month("date") <= 4
    x = _grouped(x, {"all": F.lit(True), "fold A": early, "fold B": ~early, "early": spring, "late": ~spring})
    ranges = stats.interval(stats.joint_bootstrap(x, "x", "w", "block", ["g"], 500, 7), 0.95, ["g"])
    out = x.groupBy("g").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("est")).join(F.broadcast(ranges), "g")
    whole = out.agg(F.min(F.when(F.col("g") == "all", F.col("lo"))).alias("_lo"), F.min(F.when(F.col("g").startswith("fold"), F.col("est"))).alias("_fold"))
    out = out.crossJoin(F.broadcast(whole))
    return out.select("g", "n", *[r(F.col(c), 7).alias(c) for c in ("est", "lo", "hi", "se")], ((F.col("_lo") > 0) & (F.col("_fold") > 0)).alias("passes"))


@query(
    "survey_op60_adoption_rule",
    f"""{WITH_TEAM_GAMES}, src AS (SELECT venue_id % 4 AS g, runs - 3.9 AS x, 1.0 AS w, (date - DATE '1970-01-01') // 7 AS block FROM team_games), {joint_bootstrap_sql("src", ["g"], 500, 4, "bs")},
p AS (SELECT g, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0 END) AS p FROM bs GROUP BY g), k AS (SELECT *, row_number() OVER (ORDER BY p, g) AS rank FROM p)
SELECT g, p, CAST(rank AS INT) AS rank, max(CASE WHEN p <= 0.10 / (5 - rank) THEN 0 ELSE 1 END) OVER (ORDER BY rank) = 0 AS adopted FROM k""",
)
def adoption(spark, sf):
    """Holm ordering of groups by the share of shared bootstrap draws at or below 0: rank, share, adopted at 10 %."""
    t = team_games(spark, sf).select((F.col("venue_id") % 4).alias("g"), (F.col("runs") - 3.9).alias("x"), F.lit(1.0).alias("w"), F.floor(F.unix_date("date") / 7).alias("block"))
    out = stats.joint_bootstrap(t, "x", "w", "block", ["g"], 500, 4).groupBy("g").agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p"))
    rank = F.row_number().over(Window.orderBy("p", "g"))
    groups = F.count("*").over(Window.partitionBy())  # a row a group
    held = F.max(F.when(F.col("p") <= 0.10 / (groups + 1 - F.col("rank")), 0).otherwise(1)).over(Window.orderBy("rank"))
    return out.withColumn("rank", rank).withColumn("adopted", held == 0)


# fits

_CALIBRATION = "c AS (SELECT ln((0.2 + (o_orderkey % 997) / 1700.0) / (1 - (0.2 + (o_orderkey % 997) / 1700.0))) AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') // 7 AS cluster FROM orders), cells AS (SELECT x, y, count(*) AS n FROM c GROUP BY ALL)"


@query(
    "survey_op50_calibration_fit",
    f"""WITH {_CALIBRATION}, {_newton_sql(8)}, u AS (SELECT cluster, sum(y - p) AS u0, sum((y - p) * x) AS u1, sum(p * (1 - p)) AS a00, sum(p * (1 - p) * x) AS a01, sum(p * (1 - p) * x * x) AS a11 FROM (SELECT c.*, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM c, s8) GROUP BY cluster),
m AS (SELECT count(*) AS n, sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11, sum(a00) AS a00, sum(a01) AS a01, sum(a11) AS a11 FROM u), i AS (SELECT *, a11 / (a00 * a11 - a01 * a01) AS i00, -a01 / (a00 * a11 - a01 * a01) AS i01, a00 / (a00 * a11 - a01 * a01) AS i11 FROM m)
SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope, round(sqrt(n / (n - 1) * (i00 * (i00 * m00 + i01 * m01) + i01 * (i00 * m01 + i01 * m11))), 8) AS se_intercept, round(sqrt(n / (n - 1) * (i01 * (i01 * m00 + i11 * m01) + i11 * (i01 * m01 + i11 * m11))), 8) AS se_slope, n AS clusters FROM s8, i""",
)
def calibration(spark, sf):
    """Slope and intercept of outcomes on the logit of a forecast, and their errors with the weeks as clusters."""
    c = table(spark, sf, "orders").select((0.2 + (F.col("o_orderkey") % 997) / 1700.0).alias("p"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"), F.floor(F.unix_date(F.to_date("o_orderdate")) / 7).alias("week"))
    terms = [fn.logit(F.col("p"))]
    b = fit.logistic(c, F.col("y"), terms, discrete=True)
    se, clusters = fit.cluster_errors(c, F.col("y"), terms, b, F.col("week"))
    values = {"intercept": round(b[0], 6), "slope": round(b[1], 6), "se_intercept": round(se[0], 8), "se_slope": round(se[1], 8), "clusters": clusters}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).withColumn("clusters", F.col("clusters").cast("long"))


def _dispersion_sql(steps: int) -> str:
    """CTEs t0, t1, ...: Newton steps for mean and dispersion (b0, b1, b2, a0, a1) over ``cells`` (x1, x2, off, y, n), ridge 1."""
    names = ("b0", "b1", "b2", "a0", "a1")
    out = "t0 AS (SELECT ln(sum(n * y) / sum(n)) - sum(n * off) / sum(n) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2, ln(CAST(0.3 AS DOUBLE)) AS a0, CAST(0 AS DOUBLE) AS a1 FROM cells)"
    by_eta, by_log = ("1.0", "x1", "x2", "0.0", "0.0"), ("a1", "a1 * x1", "a1 * x2", "1.0", "eta")
    for s in range(steps):
        ridge = lambda i: " - 1.0" if i in (1, 2) else ""
        second = lambda i, j: f"ee * {by_eta[i]} * {by_eta[j]} + el * ({by_eta[i]} * {by_log[j]} + {by_log[i]} * {by_eta[j]}) + ll * {by_log[i]} * {by_log[j]}" + (f" + h * {by_eta[min(i, j)]}" if min(i, j) < 3 and max(i, j) == 4 else "")
        hess = ", ".join(f"-(sum(n * ({second(i, j)})){ridge(i) if i == j else ''}) AS a{i}_{j}" for i in range(5) for j in range(5))
        right = ", ".join(f"sum(n * (g * {by_eta[i]} + h * {by_log[i]})){f' - any_value({names[i]})' if i in (1, 2) else ''} AS a{i}_5" for i in range(5))
        out += f""", u{s} AS (SELECT *, exp(eta) AS mu, exp(-(a0 + a1 * eta)) AS r FROM (SELECT *, off + b0 + b1 * x1 + b2 * x2 AS eta FROM cells, t{s})),
v{s} AS (SELECT *, list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / (r + j))) AS q1, list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / ((r + j) * (r + j)))) AS q2 FROM u{s}),
w{s} AS (SELECT *, r * (y - mu) / (r + mu) AS g, -r * (coalesce(q1, 0) + ln(r / (r + mu)) + (mu - y) / (r + mu)) AS h, -mu * r * (r + y) / ((r + mu) * (r + mu)) AS ee, -r * mu * (y - mu) / ((r + mu) * (r + mu)) AS el,
  r * (coalesce(q1, 0) + ln(r / (r + mu)) + (mu - y) / (r + mu)) + r * r * (-coalesce(q2, 0) + 1 / r - 1 / (r + mu) - (mu - y) / ((r + mu) * (r + mu))) AS ll FROM v{s}),
y{s} AS (SELECT {hess}, {right}, {', '.join(f'any_value({n}) AS {n}' for n in names)} FROM w{s}), {eliminated_sql(f'y{s}', 5, ', '.join(names))}, t{s + 1} AS (SELECT {', '.join(f'{n} + a{i}_5 AS {n}' for i, n in enumerate(names))} FROM y{s}_5)"""
    return out


@query(
    "survey_op51_dispersion",
    f"""{WITH_TEAM_GAMES}, cells AS (SELECT CASE WHEN is_home THEN 1.0::DOUBLE ELSE 0 END AS x1, venue_id % 5 / 5.0 AS x2, ln(1 + venue_id % 3 * 0.1) AS off, CAST(runs AS DOUBLE) AS y, count(*) AS n FROM team_games GROUP BY ALL), {_dispersion_sql(10)}
SELECT x1 AS h, x2 AS v, round(off, 6) AS "offset", CAST(sum(n) AS BIGINT) AS n, round(any_value(exp(off + b0 + b1 * x1 + b2 * x2)), 5) AS mu, round(any_value(exp(a0 + a1 * (off + b0 + b1 * x1 + b2 * x2))), 5) AS alpha, TRUE AS converged FROM cells, t10 GROUP BY x1, x2, off""",
)
def dispersed_fit(spark, sf):
    """Runs on home field and venue group with a known offset: mean and dispersion of every cell, fitted jointly."""
    t = team_games(spark, sf).select(F.col("is_home").cast("double").alias("h"), (F.col("venue_id") % 5 / 5.0).alias("v"), F.log(1 + F.col("venue_id") % 3 * 0.1).alias("o"), "runs")
    terms = [F.col("h"), F.col("v")]
    m = fit.dispersed_counts(t, F.col("runs"), terms, F.col("o"), discrete=True)
    eta = F.col("o") + fit.predict(m["beta"], terms)
    cells = t.groupBy("h", "v", "o").agg(F.count("*").alias("n"))
    return cells.select("h", "v", r(F.col("o")).alias("offset"), "n", r(F.exp(eta), 5).alias("mu"), r(F.exp(m["a0"] + m["a1"] * eta), 5).alias("alpha"), F.lit(m["gradient"] <= 1e-7 * m["n"]).alias("converged"))


# spread of scores

TAUS = (0.4, 0.7, 1.0)
#: Linear predictors of both sides in two segments: a base part and a team part.
_PARTS = """parts AS (SELECT game_id, date, home_final AS yh, away_final AS ya, ln((3.0 + venue_id % 5 * 0.5) * 0.6) AS b1, ln((3.0 + venue_id % 5 * 0.5) * 0.4) AS b2, (home_team % 7 - 3) / 10.0 AS th, (away_team % 7 - 3) / 10.0 AS ta FROM games)"""
_SPREAD = f"""{_PARTS}, centre AS (SELECT *, avg((th + ta) / 2) OVER (PARTITION BY date) AS mbar, avg((th - ta) / 2) OVER () AS dbar FROM parts),
grid AS (SELECT centre.*, tt, tm, mbar + tt * ((th + ta) / 2 - mbar) + dbar + tm * ((th - ta) / 2 - dbar) AS eh, mbar + tt * ((th + ta) / 2 - mbar) - dbar - tm * ((th - ta) / 2 - dbar) AS ea FROM centre, (SELECT unnest([0.4, 0.7, 1.0]) AS tt) t, (SELECT unnest([0.4, 0.7, 1.0]) AS tm) m),
kept AS (SELECT game_id, tt, tm, yh, ya, exp(b1 + eh) * sum(exp(b1 + th)) OVER w / sum(exp(b1 + eh)) OVER w AS h1, exp(b2 + eh) * sum(exp(b2 + th)) OVER w / sum(exp(b2 + eh)) OVER w AS h2, exp(b1 + ea) * sum(exp(b1 + ta)) OVER w / sum(exp(b1 + ea)) OVER w AS a1, exp(b2 + ea) * sum(exp(b2 + ta)) OVER w / sum(exp(b2 + ea)) OVER w AS a2 FROM grid WINDOW w AS (PARTITION BY date, tt, tm))"""


def _pmf_sql(m1: str, m2: str, y: str) -> str:
    p = lambda m, k: f"(({k} + 1) * ({k} + 2) * ({k} + 3) / 6.0 * pow(4.0 / (4.0 + {m}), 4) * pow({m} / (4.0 + {m}), {k}))"
    return f"list_sum(list_transform(range(0, {y} + 1), lambda i: {p(m1, 'i')} * {p(m2, f'({y} - i)')}))"


def _game_parts(spark, sf):
    base = 3.0 + F.col("venue_id") % 5 * 0.5
    team = lambda c: (F.col(c) % 7 - 3) / 10.0
    return games(spark, sf).select("game_id", F.col("date").alias("day"), F.col("home_final").alias("home"), F.col("away_final").alias("away"), F.array(F.log(base * 0.6), F.log(base * 0.4)).alias("base"), team("home_team").alias("th"), team("away_team").alias("ta"))


@query("survey_op54_spread_shrink", f"{WITH_GAMES}, {_SPREAD} SELECT game_id, round(h1 + h2, 6) AS home_mean, round(a1 + a2, 6) AS away_mean, round({_pmf_sql('h1', 'h2', 'yh')}, 8) AS home_p, round({_pmf_sql('a1', 'a2', 'ya')}, 8) AS away_p FROM kept WHERE tt = 0.4 AND tm = 0.7")
def shrink(spark, sf):
    """Both sides' parts pulled to the day's mean (total) and to the overall difference (margin), the day's mean kept; expected
    scores and the probability of each side's score from the convolved segments."""
    out = spread.shrunk(_game_parts(spark, sf), [(0.4, 0.7)])
    p = lambda side: r(spread.probability(F.col(f"{side}_mu"), F.lit(4.0), F.col(side)), 8).alias(f"{side}_p")
    mean = lambda side: r(F.aggregate(f"{side}_mu", F.lit(0.0), lambda a, x: a + x)).alias(f"{side}_mean")
    return out.select("game_id", mean("home"), mean("away"), p("home"), p("away"))


@query(
    "survey_op55_spread_grid_search",
    f"""{WITH_GAMES}, {_SPREAD}, s AS (SELECT tt, tm, avg(ln({_pmf_sql('h1', 'h2', 'yh')}) + ln({_pmf_sql('a1', 'a2', 'ya')})) AS score FROM kept GROUP BY ALL) SELECT tt AS tau_total, tm AS tau_margin, round(score, 7) AS score, row_number() OVER (ORDER BY round(score, 10) DESC, tt, tm) = 1 AS best FROM s""",
)
def spread_grid(spark, sf):
    """Log score of the convolved distributions for every cell of the two factors, all cells in one job, and the best one."""
    cells = spread.shrunk(_game_parts(spark, sf), [(a, b) for a in TAUS for b in TAUS])
    score = sum(F.log(F.greatest(spread.probability(F.col(f"{side}_mu"), F.lit(4.0), F.col(side)), F.lit(1e-300))) for side in ("home", "away"))
    out = cells.groupBy("tau_total", "tau_margin").agg(F.avg(score).alias("score"))
    best = F.row_number().over(Window.orderBy(F.round("score", 10).desc(), "tau_total", "tau_margin")) == 1  # a row a cell
    return out.select("tau_total", "tau_margin", r(F.col("score"), 7).alias("score"), best.alias("best"))


# late innings

_LATE = f"""{WITH_PITCHES}, f AS (SELECT game_id, half, CAST(coalesce(sum(velo) FILTER (WHERE pitch_no < 4), 0) AS BIGINT) AS going_in, CAST(coalesce(sum(velo) FILTER (WHERE pitch_no >= 4), 0) AS BIGINT) AS scored, max(pitch_no) AS last FROM pitches GROUP BY ALL),
g AS (SELECT f.*, f.going_in - coalesce(o.going_in, 0) AS lead FROM f LEFT JOIN (SELECT game_id AS g2, half AS h2, going_in FROM f) o ON o.g2 = f.game_id AND o.h2 <> f.half)"""


def _late_innings(spark, sf):
    """Each half of a game: what was scored before its late part and in it, and the lead over the other half going in."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("velo"))), F.lit(0.0)).cast("long")
    f = pitches(spark, sf).groupBy("game_id", "half").agg(part(F.col("pitch_no") < 4).alias("going_in"), part(F.col("pitch_no") >= 4).alias("scored"), F.max("pitch_no").alias("last"))
    other = F.sum("going_in").over(Window.partitionBy("game_id")) - F.col("going_in")
    return f.withColumn("lead", F.col("going_in") - other)


@query("survey_op57_late_inning_facts", f"{_LATE} SELECT game_id, half, going_in, scored, lead FROM g WHERE scored >= 0")
def late(spark, sf):
    return _late_innings(spark, sf).where("scored >= 0").select("game_id", "half", "going_in", "scored", "lead")


_STATES = f"{_LATE}, s AS (SELECT scored, CAST(greatest(least(floor(lead / 25.0), 2), -3) AS BIGINT) AS state, CASE WHEN last >= 6 THEN 'extra' ELSE 'ninth' END AS part, least(CAST(ceil(scored / 20.0) AS BIGINT), 4) AS k FROM g)"


def _states(spark, sf):
    f = _late_innings(spark, sf)
    state = F.greatest(F.least(F.floor(F.col("lead") / 25), F.lit(2)), F.lit(-3))
    return f.select("scored", state.alias("state"), F.when(F.col("last") >= 6, "extra").otherwise("ninth").alias("part"), F.ceil(F.col("scored") / 20.0).alias("runs"))


@query("survey_op58_state_rates", f"{_STATES} SELECT part, state, count(*) AS n, round((count(*) FILTER (WHERE scored > 0) + 1.0) / (count(*) + 2), 6) AS rate FROM s GROUP BY ALL")
def state_rates(spark, sf):
    """Chance of scoring at all in each part and state (the lead going in), with one success and one failure added."""
    return _states(spark, sf).groupBy("part", "state").agg(F.count("*").alias("n"), r((F.count(F.when(F.col("scored") > 0, 1)) + 1.0) / (F.count("*") + 2)).alias("rate"))


LEAST = 40


@query(
    "survey_op58_run_shapes",
    f"""{_STATES}, states AS (SELECT DISTINCT part, state FROM s), pos AS (SELECT * FROM s WHERE k > 0), cf AS (SELECT part, state, k, count(*) AS c FROM pos GROUP BY ALL), cc AS (SELECT part, k, count(*) AS c FROM pos GROUP BY ALL), ca AS (SELECT k, count(*) AS c FROM pos GROUP BY ALL),
n AS (SELECT part, state, (SELECT count(*) FROM pos WHERE pos.part = states.part AND pos.state = states.state) AS nf, (SELECT count(*) FROM pos WHERE pos.part = states.part) AS nc, (SELECT count(*) FROM pos) AS na FROM states)
SELECT n.part, n.state, ks.k, CASE WHEN nf >= {LEAST} THEN 'fine' WHEN nc >= {LEAST} THEN 'coarse' ELSE 'all' END AS level, CASE WHEN nf >= {LEAST} THEN nf WHEN nc >= {LEAST} THEN nc ELSE na END AS n,
  round(CASE WHEN nf >= {LEAST} THEN coalesce(cf.c, 0) * 1.0 / nf WHEN nc >= {LEAST} THEN coalesce(cc.c, 0) * 1.0 / nc ELSE coalesce(ca.c, 0) * 1.0 / na END, 8) AS p
FROM n, (SELECT CAST(unnest(range(1, 5)) AS BIGINT) AS k) ks LEFT JOIN cf ON cf.part = n.part AND cf.state = n.state AND cf.k = ks.k LEFT JOIN cc ON cc.part = n.part AND cc.k = ks.k LEFT JOIN ca ON ca.k = ks.k""",
)
def run_shapes(spark, sf):
    """How many runs score where any do, by part and state; states seen too rarely take their part's shape, or that of all."""
    out = rates.shape_table(_states(spark, sf), "runs", ["part", "state"], ["part"], 4, LEAST)
    return out.select("part", "state", F.col("k").cast("long").alias("k"), "level", "n", r(F.col("p"), 8).alias("p"))
