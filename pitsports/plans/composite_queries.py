"""Composite analytics: derivations, forms, factors, grids, fits, market tests and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitsports.functions import columns as fn
from pitsports.operators import fit, rates, stats
from pitsports.plans.base import CENTRED, WITH_GAMES, WITH_PITCHES, WITH_TEAM_GAMES, bootstrap_sql, eliminated_sql, games, pitches, query, r, table, team_games


@query(
    "survey_op4_pitcher_appearances",
    f"{WITH_PITCHES}, a AS (SELECT game_id, half, pitcher_id, count(*) AS n, count(DISTINCT CASE WHEN pitch_no >= 4 THEN batter_id END) AS late, min(pitch_no) AS first FROM pitches GROUP BY ALL) SELECT game_id, half, pitcher_id, n, late, row_number() OVER (PARTITION BY game_id, half ORDER BY first, pitcher_id) = 1 AS started FROM a",
)
def appearances(spark, sf):
    a = pitches(spark, sf).groupBy("game_id", "half", "pitcher_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("pitch_no") >= 4, F.col("batter_id"))).alias("late"), F.min("pitch_no").alias("first"))
    first = F.row_number().over(Window.partitionBy("game_id", "half").orderBy("first", "pitcher_id")) == 1
    return a.select("game_id", "half", "pitcher_id", "n", "late", first.alias("started"))


@query(
    "survey_op5_smoothed_lookup",
    """WITH c AS (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT p_brand, (s + 20.0 * (SELECT avg(p_retailprice) FROM part)) / (n + 20.0) AS e FROM c),
f AS (SELECT p_brand, p_type, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY ALL) SELECT f.p_brand, p_type, n, round((s + 5.0 * e) / (n + 5.0), 6) AS expected FROM f JOIN w ON w.p_brand = f.p_brand""",
)
def lookup(spark, sf):
    out = rates.smoothed_lookup(table(spark, sf, "part"), "p_retailprice", ["p_brand", "p_type"], ["p_brand"], 5.0, 20.0)
    return out.withColumn("expected", r(F.col("expected")))


@query(
    "survey_op20_centred_wind",
    f"""{WITH_GAMES}, w AS (SELECT game_id, season, venue_id, home_final + 0.5 * away_final AS wind FROM games), h AS (SELECT s.season, w.venue_id, avg(wind) AS m, count(*) AS n FROM (SELECT DISTINCT season FROM w) s JOIN w ON w.season BETWEEN s.season - 3 AND s.season - 1 GROUP BY ALL)
SELECT w.game_id, round(CASE WHEN n >= 40 THEN wind - m END, 6) AS rel FROM w LEFT JOIN h ON h.season = w.season AND h.venue_id = w.venue_id""",
)
def wind(spark, sf):
    from pitsports.operators.asof import serve_seasons

    w = games(spark, sf).select("game_id", "season", "venue_id", (F.col("home_final") + 0.5 * F.col("away_final")).alias("wind"))
    sums = w.groupBy("season", "venue_id").agg(F.sum("wind").alias("s"), F.count("*").alias("n"))
    h = serve_seasons(sums, "season", 3).groupBy(F.col("target").alias("season"), "venue_id").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return w.join(h, ["season", "venue_id"], "left").select("game_id", r(F.when(F.col("n") >= 40, F.col("wind") - F.col("m"))).alias("rel"))


@query(
    "survey_op22_centred_pooled_residual",
    f"""{WITH_PITCHES}, f AS (SELECT pitcher_id AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, sum(CASE WHEN result = 'R' THEN 1.0 ELSE 0 END) AS s, CAST(count(*) AS DOUBLE) AS n FROM pitches GROUP BY ALL), q AS (SELECT DISTINCT pitcher_id AS who, season, date AS cutoff FROM pitches), {CENTRED.format(k=100)}
SELECT who AS pitcher_id, season, CAST(cutoff AS VARCHAR) AS cutoff, round(value, 8) AS effect FROM rate""",
)
def residual(spark, sf):
    """Outcomes above the league's, pooled over seasons, as of each game: this season and its league mean up to the day before."""
    return residuals(pitches(spark, sf))


def residuals(p):
    y = F.when(F.col("result") == "R", 1.0).otherwise(0.0)
    facts = p.groupBy("pitcher_id", F.year("data_date").alias("season"), F.col("data_date").alias("day")).agg(F.sum(y).alias("s"), F.count("*").cast("double").alias("n"))
    rate = rates.centred_rate(p.select("pitcher_id", "season", F.col("date").alias("cutoff")), facts, "pitcher_id", 100.0, rates.SEASON_WEIGHTS)
    return rate.select("pitcher_id", "season", F.col("cutoff").cast("string").alias("cutoff"), r(F.col("value"), 8).alias("effect"))


@query(
    "survey_op27_body_clock",
    f"""WITH RECURSIVE {WITH_TEAM_GAMES[5:]}, s AS (SELECT team, season, game_id, date, venue_id % 4 AS zone, row_number() OVER (PARTITION BY team, season ORDER BY date, game_id) AS i, coalesce(date - lag(date) OVER (PARTITION BY team, season ORDER BY date, game_id), 0) AS gap FROM team_games),
c AS (SELECT team, season, game_id, i, zone, CAST(zone AS BIGINT) AS body FROM s WHERE i = 1 UNION ALL
SELECT s.team, s.season, s.game_id, s.i, s.zone, CASE WHEN s.zone > c.body THEN least(s.zone, c.body + s.gap) ELSE greatest(s.zone, c.body - s.gap) END FROM c JOIN s ON s.team = c.team AND s.season = c.season AND s.i = c.i + 1)
SELECT team, game_id, CAST(zone - body AS BIGINT) AS lag FROM c""",
)
def body_clock(spark, sf):
    """A fold over each team-season's games in order: the body's zone moves one zone a day towards the venue's.

    Games stream through a task in order; only the last game's state is held from one batch to the next.
    """
    t = team_games(spark, sf).select("team", "season", "game_id", F.unix_date("date").alias("day"), (F.col("venue_id") % 4).cast("long").alias("zone"))

    def fold(frames):
        who, body, last = None, 0, 0
        for pdf in frames:
            lags = []
            for team, season, day, zone in zip(pdf["team"].tolist(), pdf["season"].tolist(), pdf["day"].tolist(), pdf["zone"].tolist(), strict=True):
                gap = day - last
                body = zone if (team, season) != who else min(zone, body + gap) if zone > body else max(zone, body - gap)
                who, last = (team, season), day
                lags.append(zone - body)
            yield pdf[["team", "game_id"]].assign(lag=lags)

    ordered = t.repartition("team", "season").sortWithinPartitions("team", "season", "day", "game_id")
    return ordered.mapInPandas(fold, "team int, game_id long, lag long")


@query(
    "survey_op30_half_innings_from_scores",
    "WITH h AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, l_linenumber, score - coalesce(lag(score) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS runs FROM h), bad AS (SELECT DISTINCT l_orderkey FROM d WHERE runs < -40) SELECT l_orderkey, l_linenumber, runs FROM d WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)",
)
def half_innings(spark, sf):
    h = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("score"))
    w = Window.partitionBy("l_orderkey")
    d = h.withColumn("runs", F.col("score") - F.coalesce(F.lag("score").over(w.orderBy("l_linenumber")), F.lit(0)))
    return d.withColumn("worst", F.min("runs").over(w)).where("worst >= -40").select("l_orderkey", "l_linenumber", "runs")


@query("survey_op31_team_game_targets", f"{WITH_PITCHES} SELECT game_id, bat_team, CAST(coalesce(sum(velo) FILTER (WHERE pitch_no <= 5), 0) AS BIGINT) AS runs_f5, CAST(sum(velo) AS BIGINT) AS runs_total FROM pitches GROUP BY ALL")
def targets(spark, sf):
    return pitches(spark, sf).groupBy("game_id", "bat_team").agg(F.coalesce(F.sum(F.when(F.col("pitch_no") <= 5, F.col("velo"))), F.lit(0.0)).cast("long").alias("runs_f5"), F.sum("velo").cast("long").alias("runs_total"))


@query("survey_op36_resumed_games", f"{WITH_PITCHES} SELECT game_id, CAST(min(date) AS VARCHAR) AS original, CAST(max(ship_date) AS VARCHAR) AS resumed FROM pitches GROUP BY game_id HAVING max(ship_date) > min(date)")
def resumed(spark, sf):
    out = pitches(spark, sf).groupBy("game_id").agg(F.min("date").alias("o"), F.max("ship_date").alias("s")).where("s > o")
    return out.select("game_id", F.col("o").cast("string").alias("original"), F.col("s").cast("string").alias("resumed"))


@query("survey_op37_schedule_dedupe", "SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS season, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderstatus = 'P', o_orderdate, o_orderkey) = 1")
def dedupe(spark, sf):
    row = F.struct((F.col("o_orderstatus") == "P").alias("p"), "o_orderdate", "o_orderkey")
    out = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.min(row).alias("b"))
    return out.select("o_custkey", "season", "b.o_orderkey")


@query(
    "survey_op39_odds_exclusions",
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_discount AS a, l_tax AS b, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS age FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT l_orderkey, quantile_cont(a, 0.5) AS med FROM q GROUP BY ALL),
c AS (SELECT l_orderkey, b, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, b) AS k FROM q GROUP BY l_orderkey, b),
e AS (SELECT q.*, age > 110 AS stale, abs(q.b - c.b) > 0.05 AS alternate, abs(a - med) > 0.03 AS off_market, a + q.b > 0.15 OR a + q.b < 0.01 AS incoherent FROM q JOIN m ON m.l_orderkey = q.l_orderkey JOIN c ON c.l_orderkey = q.l_orderkey AND c.k = 1)
SELECT l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_orderkey, stale, alternate, off_market, incoherent FROM e WHERE stale OR alternate OR off_market OR incoherent""",
)
def odds_exclusions(spark, sf):
    """Four rules: a stale close, an alternate line (far from the one most books quote), off the median, an incoherent sum."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("made"))
    q = table(spark, sf, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.datediff(F.to_date("l_shipdate"), "made").alias("age"))
    lines = q.groupBy("l_orderkey", "b").agg(F.count("*").alias("n"), F.collect_list("a").alias("as"))
    per = lines.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "b")).alias("x"), F.sort_array(F.flatten(F.collect_list("as"))).alias("s"))
    half = F.size("s") / 2
    median = (F.get("s", F.floor((F.size("s") - 1) / 2).cast("int")) + F.get("s", F.floor(half).cast("int"))) / 2  # a game has a few quotes
    m = per.select("l_orderkey", F.col("x.b").alias("line"), median.alias("med"))
    both = F.col("a") + F.col("b")
    flags = {"stale": F.col("age") > 110, "alternate": F.abs(F.col("b") - F.col("line")) > 0.05, "off_market": F.abs(F.col("a") - F.col("med")) > 0.03, "incoherent": (both > 0.15) | (both < 0.01)}
    out = q.join(m, "l_orderkey").withColumns(flags).where("stale or alternate or off_market or incoherent")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", *flags)


PRICES = "SELECT l_orderkey AS game_id, l_linenumber AS book, 0.40 + l_quantity / 200 AS a, 0.65 - l_quantity / 200 AS b, l_discount AS line FROM lineitem"


@query(
    "survey_op41_market_table",
    f"""WITH q AS ({PRICES}), c AS (SELECT game_id, line, count(*) AS n FROM q GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY n DESC, line) AS i FROM c)
SELECT q.game_id, round(avg(a / (a + b)), 6) AS fair, round(min(a) FILTER (WHERE book <= 3), 6) AS best_a, round(min(b) FILTER (WHERE book <= 3), 6) AS best_b, round(quantile_cont(a, 0.5), 6) AS med_a, round(quantile_cont(b, 0.5), 6) AS med_b, any_value(k.line) AS line, count(*) FILTER (WHERE q.line = k.line) AS on_line FROM q JOIN k ON k.game_id = q.game_id AND k.i = 1 GROUP BY q.game_id""",
)
def market(spark, sf):
    """Mean fair probability and medians over all books, best prices of three books, the line that most books quote."""
    q = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("book"), (0.40 + F.col("l_quantity") / 200).alias("a"), (0.65 - F.col("l_quantity") / 200).alias("b"), F.col("l_discount").alias("line"))
    lines = q.groupBy("game_id", "line").agg(F.count("*").alias("n")).groupBy("game_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "line")).alias("x")).select("game_id", "x.line", (-F.col("x.m")).alias("on_line"))
    best = lambda c: r(F.min(F.when(F.col("book") <= 3, F.col(c))))
    m = q.groupBy("game_id").agg(
        r(F.avg(fn.devig_multiplicative(F.col("a"), F.col("b")))).alias("fair"), best("a").alias("best_a"), best("b").alias("best_b"), r(F.median("a")).alias("med_a"), r(F.median("b")).alias("med_b")
    )
    return m.join(lines, "game_id")


@query(
    "survey_op44_devig_by_log_loss",
    f"""WITH RECURSIVE q AS ({PRICES}), pairs AS (SELECT DISTINCT a, b FROM q), bis AS (SELECT a, b, CAST(0.2 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi, 0 AS i FROM pairs UNION ALL SELECT a, b, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bis WHERE i < 60),
f AS (SELECT CASE WHEN game_id % 3 = 0 THEN 1 ELSE 0 END AS y, q.a / (q.a + q.b) AS mul, q.a - (q.a + q.b - 1) / 2 AS add, pow(q.a, (lo + hi) / 2) AS pw FROM q JOIN bis ON bis.a = q.a AND bis.b = q.b AND i = 60)
SELECT 'multiplicative' AS method, round(avg(-(y * ln(mul) + (1 - y) * ln(1 - mul))), 6) AS loss FROM f UNION ALL SELECT 'additive', round(avg(-(y * ln(add) + (1 - y) * ln(1 - add))), 6) FROM f UNION ALL SELECT 'power', round(avg(-(y * ln(pw) + (1 - y) * ln(1 - pw))), 6) FROM f""",
)
def devig_losses(spark, sf):
    """Three ways to take the margin out of two prices, by log loss; each distinct pair of prices is solved once."""
    q = table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0).alias("y"), (0.40 + F.col("l_quantity") / 200).alias("a"), (0.65 - F.col("l_quantity") / 200).alias("b"))
    q = q.groupBy("a", "b", "y").agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    q = q.select("y", "n", fn.devig_multiplicative(a, b).alias("multiplicative"), fn.devig_additive(a, b).alias("additive"), fn.devig_power(a, b).alias("power"))
    long = q.unpivot(["y", "n"], ["multiplicative", "additive", "power"], "method", "p")
    return long.groupBy("method").agg(r(F.sum(F.col("n") * fn.log_loss(F.col("y"), F.col("p"))) / F.sum("n")).alias("loss"))


@query(
    "survey_op45_block_bootstrap",
    f"""{WITH_TEAM_GAMES}, src AS (SELECT runs - 4.0 AS x, 1.0 AS w, (date - DATE '1970-01-01') // 7 AS block FROM team_games), {bootstrap_sql("src", 500, 7, "b")}
SELECT round(quantile_cont(mean, 0.05), 6) AS lo, round(quantile_cont(mean, 0.95), 6) AS hi, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0 END) AS above FROM b""",
)
def bootstrap(spark, sf):
    """Means of 500 resamples of 7-day blocks of team runs above 4, and their interval."""
    t = team_games(spark, sf).select((F.col("runs") - 4.0).alias("x"), F.lit(1.0).alias("w"), F.floor(F.unix_date("date") / 7).alias("block"))
    draws = stats.block_bootstrap(t, "x", "w", "block", 500)
    return stats.interval(draws).select(r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"), "above")


@query(
    "survey_op48_ranked_scores",
    f"""WITH RECURSIVE {WITH_TEAM_GAMES[5:]}, m AS (SELECT venue_id, 3.0 + venue_id % 5 * 0.5 AS mu FROM (SELECT DISTINCT venue_id FROM team_games)), g AS (SELECT venue_id, mu, 0 AS k, pow(4.0 / (4.0 + mu), 4.0) AS p FROM m UNION ALL SELECT venue_id, mu, k + 1, p * (k + 4.0) / (k + 1) * mu / (4.0 + mu) FROM g WHERE k < 15),
c AS (SELECT venue_id, k, p, sum(p) OVER (PARTITION BY venue_id ORDER BY k) AS f FROM g) SELECT t.venue_id, round(avg(s.rps), 6) AS rps, round(avg(s.ls), 6) AS log_score FROM team_games t JOIN (SELECT venue_id, y, sum(pow(f - CASE WHEN y <= k THEN 1 ELSE 0 END, 2)) AS rps, max(CASE WHEN k = y THEN -ln(p) END) AS ls FROM c, (SELECT unnest(range(0, 9)) AS y) GROUP BY ALL) s ON s.venue_id = t.venue_id AND s.y = t.runs GROUP BY t.venue_id""",
)
def scores(spark, sf):
    t = team_games(spark, sf).withColumn("pmf", fn.pmf_nb(3.0 + F.col("venue_id") % 5 * 0.5, F.lit(4.0), 15))
    y = F.col("runs").cast("int")
    return t.groupBy("venue_id").agg(r(F.avg(stats.ranked_probability_score(F.col("pmf"), y))).alias("rps"), r(F.avg(stats.log_score(F.col("pmf"), y))).alias("log_score"))


@query(
    "survey_op49_reliability_table",
    "WITH c AS (SELECT o_orderkey, 0.2 + (o_orderkey % 997) / 1700.0 AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), b AS (SELECT *, CAST((row_number() OVER (ORDER BY p, o_orderkey) - 1) * 10 // (SELECT count(*) FROM c) AS BIGINT) AS bin FROM c) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM b GROUP BY bin",
)
def reliability(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", (0.2 + (F.col("o_orderkey") % 997) / 1700.0).alias("p"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    out = stats.reliability(c, "p", "y", ["o_orderkey"])
    return out.select("bin", "n", r(F.col("mean_p")).alias("mean_p"), r(F.col("mean_y")).alias("mean_y"))


def _newton_sql(steps: int) -> str:
    """CTEs s0, s1, ...: Newton steps of a logistic fit of y on an intercept and x (with n) in ``cells``, ridge 1e-6."""
    out = "s0 AS (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1)"
    for i in range(steps):
        out += f""", g{i} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(n * p * (1 - p)) + 1e-6 AS a00, sum(n * p * (1 - p) * x) AS a01, sum(n * p * (1 - p) * x * x) + 1e-6 AS a11,
  sum(n * (y - p)) - 1e-6 * any_value(b0) AS h0, sum(n * (y - p) * x) - 1e-6 * any_value(b1) AS h1 FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM cells, s{i})),
s{i + 1} AS (SELECT b0 + (a11 * h0 - a01 * h1) / (a00 * a11 - a01 * a01) AS b0, b1 + (a00 * h1 - a01 * h0) / (a00 * a11 - a01 * a01) AS b1 FROM g{i})"""
    return out


def _scoring_sql(steps: int) -> str:
    """CTEs c0, c1, ...: Fisher scoring of counts y on x0, x1, x2 in ``cells``, dispersion 0.2, ridge 1e-6."""
    out = "c0 AS (SELECT ln(sum(n * y) / sum(n)) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM cells)"
    for s in range(steps):
        ridge = lambda i, j: " + 1e-6" if i == j else ""
        sums = ", ".join(f"sum(n * m / (1 + 0.2 * m) * x{i} * x{j}){ridge(i, j)} AS a{i}_{j}" for i in range(3) for j in range(3))
        right = ", ".join(f"sum(n * (y - m) / (1 + 0.2 * m) * x{i}) - 1e-6 * any_value(b{i}) AS a{i}_3, any_value(b{i}) AS b{i}" for i in range(3))
        out += f", h{s} AS (SELECT {sums}, {right} FROM (SELECT *, exp(b0 + b1 * x1 + b2 * x2) AS m FROM cells, c{s})), {eliminated_sql(f'h{s}', 3, 'b0, b1, b2')}, c{s + 1} AS (SELECT b0 + a0_3 AS b0, b1 + a1_3 AS b1, b2 + a2_3 AS b2 FROM h{s}_3)"
    return out


@query(
    "survey_op51_count_regression",
    f"""{WITH_TEAM_GAMES}, cells AS (SELECT 1.0::DOUBLE AS x0, CASE WHEN is_home THEN 1.0::DOUBLE ELSE 0 END AS x1, venue_id % 5 / 5.0 AS x2, CAST(runs AS DOUBLE) AS y, count(*) AS n FROM team_games GROUP BY ALL), {_scoring_sql(10)}
SELECT x1 AS h, x2 AS v, CAST(sum(n) AS BIGINT) AS n, round(sum(n * y) / sum(n), 6) AS mean, round(exp(any_value(b0 + b1 * x1 + b2 * x2)), 5) AS fitted FROM cells, c10 GROUP BY x1, x2""",
)
def count_fit(spark, sf):
    """Runs on home field and venue group: fitted means of every cell (negative binomial, log link)."""
    t = team_games(spark, sf).withColumn("h", F.col("is_home").cast("double")).withColumn("v", F.col("venue_id") % 5 / 5.0)
    terms = [F.col("h"), F.col("v")]
    beta = fit.count_regression(t, F.col("runs"), terms, 0.2, discrete=True)
    return t.groupBy("h", "v").agg(F.count("*").alias("n"), r(F.avg("runs")).alias("mean")).withColumn("fitted", r(F.exp(fit.predict(beta, terms)), 5))


@query("survey_op52_design_matrix", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def design(spark, sf):
    return fit.standardised(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r(F.col("z_c_acctbal")).alias("z"))


