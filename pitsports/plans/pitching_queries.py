"""Starters, bullpens, catchers and lineups as of a game: facts count from the day on which they became known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsports.functions import columns as fn
from pitsports.operators import asof, rates, tables
from pitsports.plans.base import APPEARANCES, CENTRED, DECAYED, WITH_PITCHES, appearances, pitches, query, r, settled_appearances, settled_pitches, starters
from pitsports.plans.table_queries import _scratch

WITH_APPEARANCES = f"{WITH_PITCHES}, {APPEARANCES}"


# starters


@query(
    "survey_op6_starter_history",
    f"""{WITH_APPEARANCES}, d AS (SELECT who, known AS season, day, count(*) FILTER (WHERE fresh) AS g, sum(n) AS bf, arg_max(n, (game_id, fld_team)) AS last_bf FROM app WHERE started GROUP BY ALL),
c AS (SELECT who, season, day, last_bf, sum(g) OVER w AS g, sum(bf) OVER w AS bf FROM d WINDOW w AS (PARTITION BY who, season ORDER BY day)), t AS (SELECT who, season, sum(g) AS g FROM d GROUP BY ALL)
SELECT a.game_id, a.fld_team, a.who AS pitcher_id, CAST(coalesce(c.g, 0) AS BIGINT) AS starts, CAST(coalesce(c.bf, 0) AS BIGINT) AS bf, CAST(c.last_bf AS BIGINT) AS last_bf, CAST(a.date - c.day AS BIGINT) AS rest, CAST(t.g AS BIGINT) AS prior_starts
FROM st a ASOF LEFT JOIN c ON c.who = a.who AND c.season = a.season AND a.date > c.day LEFT JOIN t ON t.who = a.who AND t.season = a.season - 1""",
)
def starter_history(spark, sf):
    """Starts and batters faced this season, the last outing and the rest since, and last season's starts, all as known before the game."""
    a = settled_appearances(pitches(spark, sf))
    daily = a.where("started").withColumn("season", F.col("known")).repartition("who", "season").groupBy("who", "season", "day").agg(F.count(F.when(F.col("fresh"), 1)).alias("g"), F.sum("n").alias("bf"), F.max_by("n", F.struct("game_id", "fld_team")).alias("last_bf"))
    before = Window.partitionBy("who", "season").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.select("who", "season", "day", F.col("day").alias("last"), "last_bf", F.sum("g").over(before).alias("starts"), F.sum("bf").over(before).alias("bf"))
    asked = starters(a, "who", "season").drop("bat_team")
    prior = daily.groupBy("who", (F.col("season") + 1).alias("season")).agg(F.sum("g").alias("prior_starts"))
    out = asof.asof_join(asked, run, ["who", "season"], "date", "day").join(prior, ["who", "season"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("game_id", "fld_team", F.col("who").alias("pitcher_id"), zero("starts"), zero("bf"), "last_bf", F.datediff("date", "last").cast("long").alias("rest"), "prior_starts")


@query(
    "survey_op7_team_hook",
    f"""{WITH_APPEARANCES}, l AS (SELECT known + 1 AS season, sum(n) / count(*) FILTER (WHERE fresh) AS m FROM app WHERE started GROUP BY known)
SELECT q.game_id, q.fld_team, round(sum(f.n) / nullif(count(*) FILTER (WHERE f.fresh), 0) - any_value(l.m), 6) AS hook FROM st q JOIN app f ON f.fld_team = q.fld_team AND f.day < q.date AND f.day >= q.date - 30 AND f.started JOIN l ON l.season = q.season GROUP BY q.game_id, q.fld_team""",
)
def team_hook(spark, sf):
    """Mean length of the team's starts that became known in the last thirty days, above the league's of last season."""
    a = settled_appearances(pitches(spark, sf))
    w, begun = a.where("started"), F.count(F.when(F.col("fresh"), 1))
    league = w.groupBy((F.col("known") + 1).alias("season")).agg((F.sum("n") / F.nullif(begun, F.lit(0))).alias("m"))
    q = starters(a).select("game_id", "fld_team", "season", F.col("date").alias("cutoff"))
    daily = w.groupBy("fld_team", "day").agg(F.sum("n").alias("s"), begun.alias("c"))
    seen = asof.trailing_totals(q, daily, ["fld_team"], "cutoff", "day", 30, {"s30": F.sum("s"), "c30": F.sum("c")})
    out = q.join(F.broadcast(seen), ["fld_team", "cutoff"]).join(F.broadcast(league), "season")  # a row a team and day, a row a season
    return out.select("game_id", "fld_team", r(F.col("s30") / F.nullif(F.col("c30"), F.lit(0)) - F.col("m")).alias("hook"))


def _cdf(z: str) -> str:
    """SQL of :func:`pitsports.functions.columns.norm_cdf`."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {poly}"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _excess(cap: str) -> str:
    """SQL of the mean of max(X - cap, 0) for X of mean ``e`` and deviation 1.2."""
    z = f"((e - {cap}) / 1.2)"
    return f"(1.2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) + (e - {cap}) * {_cdf(z)})"


@query(
    "survey_op10_starter_row",
    f"""{WITH_APPEARANCES}, d AS (SELECT who, known AS season, day, count(*) FILTER (WHERE fresh) AS apps, count(*) FILTER (WHERE started AND fresh) AS starts, coalesce(sum(n) FILTER (WHERE started), 0) AS bf, sum(k) AS k, sum(n) AS n, sum(v) AS v FROM app GROUP BY ALL),
c AS (SELECT who, season, day, starts > 0 AS last_started, sum(apps) OVER w AS apps, sum(starts) OVER w AS starts, sum(bf) OVER w AS bf, sum(k) OVER w AS k, sum(n) OVER w AS n, sum(v) OVER w AS v FROM d WINDOW w AS (PARTITION BY who, season ORDER BY day)),
y AS (SELECT who, season + 1 AS season, sum(apps) AS apps, sum(starts) AS starts, sum(bf) AS bf, sum(k) AS k, sum(n) AS n, sum(v) AS v FROM d GROUP BY ALL), m AS (SELECT season + 1 AS season, sum(k) * 1.0 / sum(n) AS k FROM d GROUP BY ALL),
j AS (SELECT st.game_id, st.fld_team, st.who, (coalesce(c.k, 0) + 0.6 * coalesce(y.k, 0) + 60 * coalesce(m.k, 0.2)) / (coalesce(c.n, 0) + 0.6 * coalesce(y.n, 0) + 60) AS k_rate, m.k AS mu, y.n IS NULL AS rookie, CASE WHEN c.n >= 3 AND y.n IS NOT NULL THEN c.v / c.n - y.v / y.n END AS velo_delta,
  (coalesce(c.bf, 0) + 3.0 * CASE WHEN y.starts > 0 THEN y.bf * 1.0 / y.starts ELSE 1.6 END) / (coalesce(c.starts, 0) + 3) AS e, st.date - c.day AS rest, c.last_started, c.apps AS ca, c.starts AS cs, y.apps AS ya, y.starts AS ys
  FROM st ASOF LEFT JOIN c ON c.who = st.who AND c.season = st.season AND st.date > c.day LEFT JOIN y ON y.who = st.who AND y.season = st.season LEFT JOIN m ON m.season = st.season)
SELECT game_id, fld_team, who AS starter_id, round(3 * (k_rate - coalesce(mu, 0.2)) + CASE WHEN rookie THEN 0.1 ELSE 0 END, 10) AS skill, rookie, round(velo_delta, 10) AS velo_delta, round(e, 10) AS exp_bf, CASE WHEN rest IS NULL THEN 'first' WHEN rest <= 4 THEN 'short' WHEN rest <= 6 THEN 'usual' ELSE 'long' END AS rest_bucket,
  round(e - {_excess("2.0")}, 5) AS share_f5, round({_excess("1.5")} - {_excess("2.5")}, 5) AS third_time,
  coalesce((NOT last_started AND rest <= 4) OR CASE WHEN ca > 0 THEN cs * 1.0 / ca WHEN ya > 0 THEN ys * 1.0 / ya END < 0.3 OR e < 1.3, FALSE) AS opener FROM j""",
)
def starter_row(spark, sf):
    """Skill against the league, rookie, velocity change, expected length, its share of a segment, third time through, opener."""
    a = settled_appearances(pitches(spark, sf))
    began = F.col("started")
    daily = a.withColumn("season", F.col("known")).repartition("who", "season").groupBy("who", "season", "day").agg(
        F.count(F.when(F.col("fresh"), 1)).alias("apps"), F.count(F.when(began & F.col("fresh"), 1)).alias("starts"), F.coalesce(F.sum(F.when(began, F.col("n"))), F.lit(0)).alias("bf"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("v").alias("v")
    )
    names = ["apps", "starts", "bf", "k", "n", "v"]
    run = asof.running_totals(daily, ["who", "season"], "day", {c: F.col(c) for c in names})
    run = run.select("who", "season", "day", F.col("day").alias("last"), (F.col("starts") > 0).alias("last_started"), *[f"cum_{c}" for c in names])
    before = daily.groupBy("who", (F.col("season") + 1).alias("season")).agg(*[F.sum(c).alias(f"y_{c}") for c in names])
    league = a.groupBy((F.col("known") + 1).alias("season")).agg((F.sum("k") / F.sum("n")).alias("mu"))
    asked = starters(a, "who", "season").drop("bat_team")
    x = asof.asof_join(asked, run, ["who", "season"], "date", "day").join(before, ["who", "season"], "left").join(F.broadcast(league), "season", "left")  # a row a season
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mu = F.coalesce("mu", F.lit(0.2))
    k_rate = (zero("cum_k") + 0.6 * zero("y_k") + 60 * mu) / (zero("cum_n") + 0.6 * zero("y_n") + 60)
    usual = F.when(F.col("y_starts") > 0, F.col("y_bf") / F.col("y_starts")).otherwise(1.6)
    x = x.withColumn("e", (zero("cum_bf") + 3.0 * usual) / (zero("cum_starts") + 3)).withColumn("rest", F.datediff("date", "last"))
    sd = F.lit(1.2)
    excess = lambda cap: F.col("e") - fn.capped_mean(F.col("e"), sd, F.lit(cap))
    share = F.when(F.col("cum_apps") > 0, F.col("cum_starts") / F.col("cum_apps")).when(F.col("y_apps") > 0, F.col("y_starts") / F.col("y_apps"))
    opener = (~F.col("last_started") & (F.col("rest") <= 4)) | (share < 0.3) | (F.col("e") < 1.3)
    rookie = F.col("y_n").isNull()
    return x.select(
        "game_id", "fld_team", F.col("who").alias("starter_id"), r(3 * (k_rate - mu) + F.when(rookie, 0.1).otherwise(0.0), 10).alias("skill"), rookie.alias("rookie"),
        r(F.when((F.col("cum_n") >= 3) & ~rookie, F.col("cum_v") / F.col("cum_n") - F.col("y_v") / F.col("y_n")), 10).alias("velo_delta"), r(F.col("e"), 10).alias("exp_bf"),
        F.when(F.col("rest").isNull(), "first").when(F.col("rest") <= 4, "short").when(F.col("rest") <= 6, "usual").otherwise("long").alias("rest_bucket"),
        r(F.col("e") - excess(2.0), 5).alias("share_f5"), r(excess(1.5) - excess(2.5), 5).alias("third_time"), F.coalesce(opener, F.lit(False)).alias("opener"),
    )


# bullpens


#: Relievers who pitched for the team in the thirty days before a date, as known by then, and whether they can pitch.
POOL = """
u AS (SELECT fld_team, who, day, sum(n) AS bf, sum(late) AS late FROM app WHERE NOT started GROUP BY ALL), tq AS (SELECT DISTINCT fld_team, season, date AS cutoff FROM app),
pool AS (SELECT *, NOT ((d1 AND d2) OR p1 >= 25) AS available, CASE WHEN sum(late) OVER t > 0 THEN late / sum(late) OVER t ELSE bf / sum(bf) OVER t END AS late_share, bf / sum(bf) OVER t AS bf_share FROM (
  SELECT tq.fld_team, tq.season, tq.cutoff, u.who, sum(bf) AS bf, sum(late) AS late, bool_or(cutoff - day = 1) AS d1, bool_or(cutoff - day = 2) AS d2, coalesce(sum(bf) FILTER (WHERE cutoff - day = 1), 0) AS p1
  FROM tq JOIN u ON u.fld_team = tq.fld_team AND u.day < cutoff AND u.day >= cutoff - 30 GROUP BY ALL) WINDOW t AS (PARTITION BY fld_team, season, cutoff))"""


def relievers_used(a: DataFrame) -> DataFrame:
    """``u`` of ``POOL``: what each reliever did for a team, by the day from which it was known."""
    done = a.where("not started").select("fld_team", "who", "day", "n", "late").repartition("fld_team", "who")  # the one shuffle of all that follows by team and reliever
    return done.groupBy("fld_team", "who", "day").agg(F.sum("n").alias("bf"), F.sum("late").alias("late"))


def twice() -> Column:
    """Whether a day of ``u`` comes right after another one of the same team and reliever."""
    return F.coalesce(F.col("day") == F.date_add(F.lag("day").over(Window.partitionBy("fld_team", "who").orderBy("day")), 1), F.lit(False))


#: Work of one day after which a reliever cannot pitch the next.
MUCH = 25


def pool_spells(a: DataFrame) -> DataFrame:
    """``pool`` of ``POOL`` as spells in which nothing changes about a team's reliever: fld_team, who, since, until (day numbers, the
    end left out), the last day with work, bf, late and available.

    A spell begins on the day after a day's work, after a day on which the reliever cannot pitch, and when work leaves the
    thirty days: rows follow the work, not the days on which it counts.
    """
    used = relievers_used(a).withColumn("out", twice() | (F.col("bf") >= MUCH))
    turns = F.explode(F.when(F.col("out"), F.array(*map(F.lit, (0, 1, 2, 31)))).otherwise(F.array(*map(F.lit, (0, 1, 31)))))
    x = used.withColumn("turn", turns).withColumns({"at": F.unix_date("day") + F.col("turn"), "fact": F.when(F.col("turn") == 0, F.struct(F.unix_date("day").alias("last"), "bf", "late", "out"))})
    own = Window.partitionBy("fld_team", "who").orderBy("at")
    seen = own.rangeBetween(-30, -1)
    x = x.select(
        "fld_team", "who", "turn", F.col("at").alias("since"), F.lead("at").over(own).alias("next"), F.max("fact.last").over(seen).alias("last"), F.sum("fact.bf").over(seen).alias("bf"), F.sum("fact.late").over(seen).alias("late"),
        (~F.coalesce(F.bool_or("fact.out").over(own.rangeBetween(-1, -1)), F.lit(False))).alias("available"),
    )
    return x.where("last is not null").withColumn("until", F.least("next", F.col("last") + 31)).where("since < until").select("fld_team", "who", "since", "until", "last", "bf", "late", "available")


def pool_seasons(a: DataFrame) -> DataFrame:
    """who and season of all cutoffs of the pool."""
    return a.where("not started").select("who", F.explode(F.array(F.year(F.date_add("day", 1)), F.year(F.date_add("day", 30)))).alias("season")).distinct()


def pool_totals(a: DataFrame, rated: DataFrame, values: list[str]) -> DataFrame:
    """Of each team's pool on each day (``cutoff``): pool, available, worked_yesterday, and for each of ``values`` of ``rated``
    (spells by who) the available relievers' mean by share of late work (``late_``) and of all work (``all_``).

    Days are taken out of the spells where they are added up, so what is shuffled is a row for each spell and then one for each team and day.
    """
    x = asof.overlaps(pool_spells(a), rated, ["who"]).withColumn("at", F.explode(F.sequence("since", F.col("until") - 1)))
    free = F.col("available")
    of = lambda c: F.sum(F.when(free, c))
    sums = [F.count("*").alias("pool"), F.count(F.when(free, 1)).alias("free"), F.count(F.when(F.col("at") == F.col("last") + 1, 1)).alias("worked_yesterday"), F.sum("late").alias("_late"), of(F.col("late")).alias("_lw"), of(F.col("bf")).alias("_bw")]
    sums += [of(F.col(w) * F.col(v)).alias(f"_{w}_{v}") for v in values for w in ("late", "bf")]
    t = x.groupBy("fld_team", "at").agg(*sums)
    every = lambda v: F.col(f"_bf_{v}") / F.nullif(F.col("_bw"), F.lit(0))
    late = lambda v: F.when(F.col("_late") > 0, F.col(f"_late_{v}") / F.nullif(F.col("_lw"), F.lit(0))).otherwise(every(v))
    means = [m for v in values for m in (late(v).alias(f"late_{v}"), every(v).alias(f"all_{v}"))]
    return t.select("fld_team", F.date_from_unix_date("at").alias("cutoff"), "pool", F.col("free").alias("available"), "worked_yesterday", *means)


@query(
    "survey_op11_bullpen_pool",
    f"""{WITH_APPEARANCES}, {POOL}, kf AS (SELECT who, known AS season, day, sum(k) AS s, sum(n) AS n FROM app GROUP BY ALL), {DECAYED.format(name="kr", q="pool", f="kf", k="60", mu="0.25")},
x AS (SELECT pool.fld_team, pool.season, pool.cutoff, count(*) AS pool, count(*) FILTER (WHERE available) AS available, count(*) FILTER (WHERE d1) AS worked_yesterday,
  sum(late_share * value) FILTER (WHERE available) / nullif(sum(late_share) FILTER (WHERE available), 0) AS skill_late, sum(bf_share * value) FILTER (WHERE available) / nullif(sum(bf_share) FILTER (WHERE available), 0) AS skill_all
  FROM pool JOIN kr ON kr.who = pool.who AND kr.season = pool.season AND kr.cutoff = pool.cutoff GROUP BY ALL)
SELECT a.game_id, a.fld_team, x.pool, x.available, x.worked_yesterday, round(skill_late, 8) AS skill_late, round(skill_all, 8) AS skill_all FROM st a JOIN x ON x.fld_team = a.fld_team AND x.season = a.season AND x.cutoff = a.date""",
)
def bullpen(spark, sf):
    """The pool and who of it can pitch; the available ones' decayed strikeout rate by share of late work and by share of all work."""
    a = settled_appearances(pitches(spark, sf))
    facts = a.select("who", F.col("known").alias("season"), "day", F.col("k").alias("s"), "n")
    x = tables.settled(pool_totals(a, rates.decayed_spells(pool_seasons(a), facts, 60.0, 0.25), ["value"]))
    games = starters(a).select("game_id", "fld_team", F.col("date").alias("cutoff"))
    out = games.join(F.broadcast(x), ["fld_team", "cutoff"])  # a row a team and day
    return out.select("game_id", "fld_team", "pool", "available", "worked_yesterday", r(F.col("late_value"), 8).alias("skill_late"), r(F.col("all_value"), 8).alias("skill_all"))


#: Columns of facts that appearances and lineups read.
FACTS = ("game_id", "pitch_no", "pitcher_id", "batter_id", "velo", "result", "date", "season", "data_date", "fld_team", "bat_team")

SCORE = "CAST(round((velo - 25) * 100 + px * 2000 - pz * 1500) AS BIGINT)"


@query(
    "survey_op26_stuff_rates",
    f"""{WITH_APPEARANCES}, {POOL}, f AS (SELECT pitcher_id AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, CAST(sum({SCORE}) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM pitches GROUP BY ALL),
q AS (SELECT who, season, date AS cutoff FROM st UNION SELECT who, season, cutoff FROM pool), {CENTRED.format(k=300)},
pen AS (SELECT fld_team, pool.season, pool.cutoff, sum(late_share * value) FILTER (WHERE available) / nullif(sum(late_share) FILTER (WHERE available), 0) AS pen FROM pool JOIN rate ON rate.who = pool.who AND rate.season = pool.season AND rate.cutoff = pool.cutoff GROUP BY ALL)
SELECT st.game_id, st.fld_team, round(coalesce(value, 0) / 100, 5) AS sp_stuff, round(coalesce(pen, 0) / 100, 5) AS pen_stuff FROM st LEFT JOIN rate ON rate.who = st.who AND rate.season = st.season AND rate.cutoff = st.date LEFT JOIN pen ON pen.fld_team = st.fld_team AND pen.season = st.season AND pen.cutoff = st.date""",
)
def stuff_rates(spark, sf):
    """Integer pitch scores as centred rates, for the starter and, by share of late work, for the relievers who can pitch."""
    p = settled_pitches(spark, sf, *FACTS, "px", "pz")
    a = settled_appearances(p.repartition("game_id"))
    score = F.round((F.col("velo") - 25) * 100 + F.col("px") * 2000 - F.col("pz") * 1500).cast("long")
    facts = p.select(F.col("pitcher_id").alias("who"), F.year("data_date").alias("season"), F.col("data_date").alias("day"), score.alias("s"), F.lit(1).alias("n"))
    league = rates.league_days(facts)
    pen = tables.settled(pool_totals(a, rates.centred_spells(pool_seasons(a), facts, league, 300.0), ["fixed", "slope"])).withColumn("season", F.year("cutoff"))
    pen = asof.at_cutoffs(pen, league[0], ["season"], "cutoff", "day").select("fld_team", "cutoff", (F.col("late_fixed") - F.col("late_slope") * F.coalesce("league", F.lit(0.0))).alias("pen"))
    starter = starters(a).select("game_id", "fld_team", "who", "season", F.col("date").alias("cutoff"))
    out = rates.centred_histories(starter, facts, league, 300.0).join(F.broadcast(pen), ["fld_team", "cutoff"], "left")  # a row a team and day
    zero = lambda c: r(F.coalesce(F.col(c), F.lit(0.0)) / 100, 5)
    return out.select("game_id", "fld_team", zero("value").alias("sp_stuff"), zero("pen").alias("pen_stuff"))


# the expected-call grid and catchers


#: Seasons whose facts (known in them) the grid is fitted on, and the grid's cells.
FIT_SEASONS, SHAPE = (1995,), (11, 9)


def _kernel_sql(name: str, sigma: float) -> str:
    d = f"(SELECT CAST(unnest(range(-{int(4 * sigma)}, {int(4 * sigma)} + 1)) AS INT) AS d)"
    return f"{name} AS (SELECT d, exp(-0.5 * pow(d / {sigma}, 2)) / (SELECT sum(exp(-0.5 * pow(d / {sigma}, 2))) FROM {d}) AS w FROM {d})"


def _grid_sql(seasons) -> str:
    """CTEs of the two-scale grid (``grid``: sd, cg, ix, iz, p) over ``taken``."""
    blur = ", ".join(
        f"{_kernel_sql(f'kern_{k}', sigma)}, {k}x AS (SELECT sd, cg, CAST(ix + d AS INT) AS ix, iz, sum(s * w) AS s, sum(n * w) AS n FROM cells, kern_{k} GROUP BY ALL), {k}z AS (SELECT sd, cg, ix, CAST(iz + d AS INT) AS iz, sum(s * w) AS s, sum(n * w) AS n FROM {k}x, kern_{k} GROUP BY ALL)"
        for k, sigma in (("f", 1.0), ("w", 6.0))
    )
    return f"""taken AS (SELECT *, CAST(batter_id % 2 AS INT) AS sd, CAST(pitch_no % 4 AS INT) AS cg, CAST(floor(px * 100 + 0.5) AS INT) AS ix, CAST(floor(pz * 100 + 0.5) AS INT) AS iz FROM pitches WHERE result <> 'R'),
cells AS (SELECT sd, cg, ix, iz, CAST(count(*) FILTER (WHERE result = 'A') AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM taken WHERE year(data_date) IN ({', '.join(map(str, seasons))}) GROUP BY ALL), {blur},
grid AS (SELECT g.sd, g.cg, x.ix, z.iz, (coalesce(fz.s, 0) + 2.0 * (coalesce(wz.s, 0) + 0.01 * m) / (coalesce(wz.n, 0) + 0.01)) / (coalesce(fz.n, 0) + 2.0) AS p FROM (SELECT sd, cg, sum(s) / sum(n) AS m FROM cells GROUP BY ALL) g, (SELECT CAST(unnest(range(0, {SHAPE[0]})) AS INT) AS ix) x, (SELECT CAST(unnest(range(0, {SHAPE[1]})) AS INT) AS iz) z
  LEFT JOIN fz ON fz.sd = g.sd AND fz.cg = g.cg AND fz.ix = x.ix AND fz.iz = z.iz LEFT JOIN wz ON wz.sd = g.sd AND wz.cg = g.cg AND wz.ix = x.ix AND wz.iz = z.iz)"""


def taken_pitches(p: DataFrame) -> DataFrame:
    """Pitches that were called, with batting side, count group and cell."""
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    return p.where("result <> 'R'").withColumns({"sd": (F.col("batter_id") % 2).cast("int"), "cg": (F.col("pitch_no") % 4).cast("int"), "ix": cell("px"), "iz": cell("pz")})


def fitted_grid(p: DataFrame, seasons=FIT_SEASONS) -> DataFrame:
    """The expected-call grid of the facts that became known in ``seasons``."""
    known = taken_pitches(p).where(F.year("data_date").isin(list(seasons)))
    cells = known.groupBy("sd", "cg", "ix", "iz").agg(F.count(F.when(F.col("result") == "A", 1)).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    return rates.two_scale_grid(cells, ["sd", "cg"], "ix", "iz", "s", "n", SHAPE)


def stored_grid(p: DataFrame, path: str, seasons=FIT_SEASONS) -> int:
    """Fit the grid and store it as the next version of the table at ``path``; later builds look that version up."""
    spark = p.sparkSession
    if not tables.write_version(fitted_grid(p, seasons), path, []):
        raise RuntimeError("another writer took the version")
    return tables.newest_version(spark, path)


@query("survey_op21_blurred_grid", f"{WITH_PITCHES}, {_grid_sql(FIT_SEASONS)} SELECT sd, cg, ix, iz, round(p, 8) AS p FROM grid")
def expectation_grid(spark, sf):
    """The two-scale grid of expected calls, fitted on named seasons, as it is stored."""
    path = _scratch(spark)
    version = stored_grid(pitches(spark, sf), path)
    return tables.current(spark, path, version).select("sd", "cg", "ix", "iz", r(F.col("p"), 8).alias("p"))


def framing(p: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs of called strikes above ``grid``'s expectation, by catcher: prior seasons centred by their own league, this one to date."""
    first = F.min("batter_id") % 25
    catcher = p.groupBy("game_id", "fld_team").agg(F.when(first > 0, first).alias("who"))
    facts = taken_pitches(p).join(F.broadcast(grid), ["sd", "cg", "ix", "iz"]).join(catcher, ["game_id", "fld_team"]).where("who is not null")  # the grid's size is fixed
    strike = F.when(F.col("result") == "A", 1).otherwise(0)
    facts = facts.groupBy("who", F.year("data_date").alias("season"), F.col("data_date").alias("day")).agg(F.sum(strike - F.col("p")).alias("s"), F.count("*").cast("double").alias("n"))
    asked = p.select("game_id", "fld_team", "season", F.col("date").alias("cutoff")).distinct().join(catcher, ["game_id", "fld_team"])
    rate = rates.centred_rate(asked.where("who is not null"), facts, "who", 500.0, rates.SEASON_WEIGHTS)
    out = asked.join(rate, ["who", "season", "cutoff"], "left")
    return out.select("game_id", "fld_team", F.col("who").alias("catcher_id"), r(0.13 * 100 * F.coalesce("value", F.lit(0.0))).alias("frm_runs"), F.col("who").isNull().alias("frm_missing"))


@query(
    "survey_op23_catcher_framing",
    f"""{WITH_PITCHES}, {_grid_sql(FIT_SEASONS)}, c AS (SELECT game_id, fld_team, CASE WHEN min(batter_id) % 25 > 0 THEN min(batter_id) % 25 END AS who FROM pitches GROUP BY ALL),
f AS (SELECT c.who, CAST(year(data_date) AS INT) AS season, data_date AS day, sum(CASE WHEN result = 'A' THEN 1 ELSE 0 END - p) AS s, CAST(count(*) AS DOUBLE) AS n FROM taken t JOIN grid ON grid.sd = t.sd AND grid.cg = t.cg AND grid.ix = t.ix AND grid.iz = t.iz JOIN c ON c.game_id = t.game_id AND c.fld_team = t.fld_team WHERE c.who IS NOT NULL GROUP BY ALL),
tg AS (SELECT DISTINCT t.game_id, t.fld_team, t.season, t.date AS cutoff, c.who FROM pitches t JOIN c ON c.game_id = t.game_id AND c.fld_team = t.fld_team), q AS (SELECT who, season, cutoff FROM tg WHERE who IS NOT NULL), {CENTRED.format(k=500)}
SELECT tg.game_id, tg.fld_team, tg.who AS catcher_id, round(0.13 * 100 * coalesce(value, 0), 6) AS frm_runs, tg.who IS NULL AS frm_missing FROM tg LEFT JOIN rate ON rate.who = tg.who AND rate.season = tg.season AND rate.cutoff = tg.cutoff""",
)
def catcher_framing(spark, sf):
    """Framing by the first stored version of the grid; a later refit on more seasons is a new version and changes nothing here."""
    p = pitches(spark, sf)
    path = _scratch(spark)
    version = stored_grid(p, path)
    stored_grid(p, path, (*FIT_SEASONS, 1996, 1997))
    return framing(p, tables.current(spark, path, version))


# lineups


#: The announced batters of a game (its first four pitches stand for them) in order, and the hand that they face; a game
#: counts from the day on which all of these pitches were known.
LINEUPS = """
lu AS (SELECT *, row_number() OVER (PARTITION BY game_id, bat_team ORDER BY first, batter_id) AS slot FROM (SELECT game_id, bat_team, date, season, batter_id, min(pitch_no) AS first, max(data_date) AS seen FROM pitches WHERE pitch_no <= 4 GROUP BY ALL)),
tg AS (SELECT lu.game_id, bat_team, any_value(lu.date) AS date, any_value(lu.season) AS season, max(seen) AS day, any_value(hand) AS hand FROM lu JOIN (SELECT game_id, bat_team, CASE WHEN who % 3 = 0 THEN 'L' ELSE 'R' END AS hand FROM st) s USING (game_id, bat_team) GROUP BY ALL)"""


def lineups(p: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``LINEUPS``: the batters of each game, and a row for each team and game."""
    b = p.where("pitch_no <= 4").groupBy("game_id", "bat_team", "date", "season", "batter_id").agg(F.min("pitch_no").alias("first"), F.max("data_date").alias("seen"))
    b = tables.settled(asof.sequence_numbers(b, ["game_id", "bat_team"], ["first", "batter_id"], "slot"))
    hand = starters(a).select("game_id", "bat_team", F.when(F.col("who") % 3 == 0, "L").otherwise("R").alias("hand"))
    return b, b.groupBy("game_id", "bat_team", "date", "season").agg(F.max("seen").alias("day")).join(hand, ["game_id", "bat_team"])


@query(
    "survey_op14_lineup_features",
    f"""{WITH_APPEARANCES}, {LINEUPS}, bf AS (SELECT batter_id AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, sum(velo) AS s, count(*) AS n FROM pitches GROUP BY ALL), bk AS (SELECT batter_id AS who, CAST(year(data_date) AS INT) AS season, data_date AS day, count(*) FILTER (WHERE result = 'R') - count(*) FILTER (WHERE result = 'N') AS s, count(*) AS n FROM pitches GROUP BY ALL),
q AS (SELECT DISTINCT batter_id AS who, season, date AS cutoff FROM lu), {DECAYED.format(name="wo", q="q", f="bf", k="60", mu="25.0")}, {DECAYED.format(name="kb", q="q", f="bk", k="60", mu="0.0")}
SELECT lu.game_id, lu.bat_team, count(*) AS n, round(sum(wo.value / slot) / sum(1.0 / slot), 7) AS strength, round(sum(kb.value / slot) / sum(1.0 / slot), 8) AS k_bb, round(sum(CASE WHEN (lu.batter_id % 2 = 0) = (tg.hand = 'L') THEN 0 ELSE 1.0 / slot END) / sum(1.0 / slot), 8) AS platoon, count(*) FILTER (WHERE wo.rookie) AS rookies
FROM lu JOIN tg USING (game_id, bat_team) JOIN wo ON wo.who = lu.batter_id AND wo.season = lu.season AND wo.cutoff = lu.date JOIN kb ON kb.who = lu.batter_id AND kb.season = lu.season AND kb.cutoff = lu.date GROUP BY ALL""",
)
def lineup_features(spark, sf):
    """Decayed rates of the batters as of the game, weighted by slot; share of them on the better side of the starter; rookies."""
    p = settled_pitches(spark, sf, *FACTS)
    by_game = p.repartition("game_id")
    b, team = lineups(by_game, appearances(by_game))
    kind = lambda c: F.when(F.col("result") == c, 1).otherwise(0)
    facts = p.select(F.col("batter_id").alias("who"), F.year("data_date").alias("season"), F.col("data_date").alias("day"), F.col("velo").alias("value"), (kind("R") - kind("N")).alias("kb"), F.lit(1).alias("n"))
    asked = b.select("game_id", "bat_team", "slot", F.col("batter_id").alias("who"), "season", F.col("date").alias("cutoff")).where("who is not null and season is not null and cutoff is not null")
    x = rates.decayed_rates(asked, facts, {"value": (60.0, 25.0), "kb": (60.0, 0.0)}).join(team.select("game_id", "bat_team", "hand"), ["game_id", "bat_team"])
    w = 1.0 / F.col("slot")
    mean = lambda v: F.sum(v * w) / F.sum(w)
    better = F.when((F.col("who") % 2 == 0) == (F.col("hand") == "L"), 0.0).otherwise(1.0)
    return x.groupBy("game_id", "bat_team").agg(F.count("*").alias("n"), r(mean(F.col("value")), 7).alias("strength"), r(mean(F.col("kb")), 8).alias("k_bb"), r(mean(better), 8).alias("platoon"), F.count(F.when(F.col("rookie"), 1)).alias("rookies"))


LOOK_BACK = 14


@query(
    "survey_op15_projected_starters",
    f"""{WITH_APPEARANCES}, {LINEUPS}, sq AS (SELECT *, row_number() OVER (PARTITION BY bat_team ORDER BY day, game_id) AS i FROM tg), by_day AS (SELECT bat_team, day, max(i) AS i FROM sq GROUP BY ALL),
q AS (SELECT tg.game_id, tg.bat_team, tg.hand, d.i AS last FROM tg ASOF JOIN by_day d ON d.bat_team = tg.bat_team AND tg.date > d.day),
win AS (SELECT q.game_id, q.bat_team, s.game_id AS past, s.hand = q.hand AS same FROM q JOIN sq s ON s.bat_team = q.bat_team AND s.i BETWEEN q.last - {LOOK_BACK - 1} AND q.last),
used AS (SELECT *, count(*) OVER g AS n FROM (SELECT *, bool_or(same) OVER (PARTITION BY game_id, bat_team) AS any_same FROM win) WHERE same OR NOT any_same WINDOW g AS (PARTITION BY game_id, bat_team)),
by_slot AS (SELECT u.game_id, u.bat_team, lu.batter_id, lu.slot, count(*) AS k, any_value(u.n) AS n FROM used u JOIN lu ON lu.game_id = u.past AND lu.bat_team = u.bat_team GROUP BY ALL)
SELECT game_id, bat_team, batter_id, round(sum(k) / any_value(n), 8) AS share, CAST(arg_max(slot, (k, -slot)) AS BIGINT) AS slot, count(*) OVER (PARTITION BY game_id, bat_team) AS pool FROM by_slot GROUP BY game_id, bat_team, batter_id""",
)
def projected(spark, sf):
    """Who may start: of the team's last fourteen games known before the date, those against a starter of today's hand (all if
    there is none); for each batter the share of them started and the most common slot (ties: the higher one).

    All games of a team on a day against the same hand have one answer, which is worked out once."""
    p = pitches(spark, sf)
    b, team = lineups(p, appearances(p))
    team = tables.settled(team)
    known = team.withColumn("known", F.year("day"))
    seq = asof.sequence_in_blocks(known, ["bat_team"], "known", [F.col("day"), F.col("game_id")], "i")
    question = ["bat_team", "date", "hand"]
    asked = team.select(*question, F.year("date").alias("known")).distinct()  # at most two a team and day, however many games
    last = asof.count_before(asked, known, ["bat_team"], "known", "date", "day", "last").where("last > 0")
    places = F.explode(F.sequence(F.greatest(F.col("last") - (LOOK_BACK - 1), F.lit(1)), F.col("last")))
    past = seq.select("bat_team", "i", F.col("game_id").alias("past"), F.col("hand").alias("past_hand"))
    win = last.select(*question, places.alias("i")).join(past, ["bat_team", "i"]).withColumn("same", F.col("hand") == F.col("past_hand"))
    whole = Window.partitionBy(*question)
    used = win.withColumn("n_same", F.sum(F.col("same").cast("int")).over(whole)).where("same or n_same = 0").withColumn("n", F.count("*").over(whole))
    batters = b.select(F.col("game_id").alias("past"), "bat_team", "batter_id", "slot")
    by_slot = used.select(*question, "past", "n").join(batters, ["past", "bat_team"]).groupBy(*question, "batter_id", "slot").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    shares = by_slot.groupBy(*question, "batter_id").agg(r(F.sum("k") / F.first("n"), 8).alias("share"), F.max_by("slot", F.struct("k", -F.col("slot"))).cast("long").alias("slot"))
    pools = shares.groupBy(*question).agg(F.collect_list(F.struct("batter_id", "share", "slot")).alias("of"))  # the batters of fourteen games
    out = team.select("game_id", *question).join(pools, question)
    return out.select("game_id", "bat_team", F.size("of").cast("long").alias("pool"), F.explode("of").alias("x")).select("game_id", "bat_team", "x.*", "pool")
