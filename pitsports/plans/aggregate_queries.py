"""Joins, aggregations, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitsports.operators import rates
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, WITH_TEAM_GAMES, games, pitches, query, r, table, team_games


@query("jn1_inner_equi_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query(
    "jn2_feature_assembly",
    f"""{WITH_TEAM_GAMES}, a AS (SELECT team, season, count(*) AS g FROM team_games GROUP BY ALL), b AS (SELECT venue_id, season, CAST(sum(runs) AS BIGINT) AS vr FROM team_games GROUP BY ALL),
c AS (SELECT opponent, season, CAST(sum(allowed) AS BIGINT) AS oa FROM team_games WHERE is_home GROUP BY ALL)
SELECT t.game_id, t.team, a.g, b.vr, c.oa FROM team_games t LEFT JOIN a ON a.team = t.team AND a.season = t.season - 1 LEFT JOIN b ON b.venue_id = t.venue_id AND b.season = t.season - 1 LEFT JOIN c ON c.opponent = t.opponent AND c.season = t.season - 1""",
)
def assembly(spark, sf):
    t = team_games(spark, sf)
    later = lambda df: df.withColumn("season", F.col("season") + 1)
    a = later(t.groupBy("team", "season").agg(F.count("*").alias("g")))
    b = later(t.groupBy("venue_id", "season").agg(F.sum("runs").alias("vr")))
    c = later(t.where("is_home").groupBy("opponent", "season").agg(F.sum("allowed").alias("oa")))
    return t.join(a, ["team", "season"], "left").join(b, ["venue_id", "season"], "left").join(c, ["opponent", "season"], "left").select("game_id", "team", "g", "vr", "oa")


@query(
    "jn3_full_outer_join",
    "SELECT coalesce(a.k, b.k) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) b ON a.k = b.k",
)
def full(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full")


@query("jn4_scalar_cross_join", "SELECT p_partkey, round(p_retailprice / (SELECT avg(p_retailprice) FROM part), 6) AS rel FROM part")
def scalar(spark, sf):
    p = table(spark, sf, "part")
    return p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("m")))).select("p_partkey", r(F.col("p_retailprice") / F.col("m")).alias("rel"))


GRID = "(SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w) CROSS JOIN (SELECT unnest([0.0, 10.0, 20.0]) AS tau)"


@query("jn5_op43_grid_search", f"SELECT w, tau, count(*) AS bets, round(sum(l_discount - w * l_tax), 6) AS moved FROM lineitem, (SELECT * FROM {GRID}) WHERE l_quantity * (1 - w) + w * 25 > tau + 15 GROUP BY ALL")
def grid_search(spark, sf):
    grid = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("tau")) for w in (0.0, 0.25, 0.5, 0.75, 1.0) for t in (0.0, 10.0, 20.0)]))
    x = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", grid.alias("g")).select("*", "g.w", "g.tau")
    x = x.where(F.col("l_quantity") * (1 - F.col("w")) + F.col("w") * 25 > F.col("tau") + 15)
    return x.groupBy("w", "tau").agg(F.count("*").alias("bets"), r(F.sum(F.col("l_discount") - F.col("w") * F.col("l_tax"))).alias("moved"))


@query(
    "jn14_fallback_lookup",
    """WITH f AS (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part WHERE p_size > 45 GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_size > 45 GROUP BY ALL)
SELECT p_partkey, round(coalesce(f.m, c.m, (SELECT avg(p_retailprice) FROM part)), 6) AS expected FROM part p LEFT JOIN f ON f.p_brand = p.p_brand AND f.p_type = p.p_type LEFT JOIN c ON c.p_brand = p.p_brand""",
)
def fallback(spark, sf):
    p = table(spark, sf, "part")
    big = p.where("p_size > 45")
    fine = big.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("fm"), F.count("*").alias("n")).where("n >= 2").drop("n")
    coarse = big.groupBy("p_brand").agg(F.avg("p_retailprice").alias("cm"))
    whole = p.agg(F.avg("p_retailprice").alias("am"))
    out = p.join(fine, ["p_brand", "p_type"], "left").join(coarse, "p_brand", "left").crossJoin(F.broadcast(whole))
    return out.select("p_partkey", r(F.coalesce("fm", "cm", "am")).alias("expected"))


@query(
    "jn15_best_alias",
    "WITH a AS (SELECT n_nationkey AS id, n_name AS name, 1 AS pr FROM nation UNION ALL SELECT n_nationkey + 100, upper(left(n_name, 3)), 2 FROM nation UNION ALL SELECT n_regionkey + 200, n_name, 3 FROM nation) SELECT n_nationkey, arg_min(id, pr) AS id FROM nation JOIN a ON a.name = n_name OR a.name = upper(left(n_name, 3)) GROUP BY n_nationkey, n_name",
)
def alias(spark, sf):
    n = table(spark, sf, "nation")
    short = F.upper(F.left("n_name", F.lit(3)))
    sides = [(F.col("n_nationkey"), F.col("n_name"), 1), (F.col("n_nationkey") + 100, short, 2), (F.col("n_regionkey") + 200, F.col("n_name"), 3)]
    aliases = n.select(F.explode(F.array(*[F.struct(i.alias("id"), name.alias("name"), F.lit(p).alias("pr")) for i, name, p in sides])).alias("a")).select("a.*")
    asked = n.select("n_nationkey", F.explode(F.array_distinct(F.array("n_name", short))).alias("name"))
    return asked.join(aliases, "name").groupBy("n_nationkey").agg(F.min_by("id", F.struct("pr", "id")).alias("id"))


@query(
    "jn16_nearest_in_time",
    f"""{WITH_GAMES}, o AS (SELECT l_suppkey % 25 AS venue_id, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice) AS temp FROM lineitem GROUP BY ALL),
m AS (SELECT game_id, temp, abs(d - date) AS gap, d, row_number() OVER (PARTITION BY game_id ORDER BY abs(d - date), d) AS k FROM games g JOIN o ON o.venue_id = g.venue_id AND d BETWEEN date - 3 AND date + 3) SELECT game_id, temp, CAST(gap AS INT) AS gap FROM m WHERE k = 1""",
)
def nearest(spark, sf):
    o = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 25).cast("int").alias("venue_id"), F.to_date("l_shipdate").alias("d")).agg(F.min("l_extendedprice").alias("temp"))
    g = games(spark, sf).select("game_id", "venue_id", "date", F.explode(F.sequence(F.date_sub("date", 3), F.date_add("date", 3))).alias("d"))
    best = g.join(o, ["venue_id", "d"]).groupBy("game_id").agg(F.min(F.struct(F.abs(F.datediff("d", "date")).alias("gap"), "d", "temp")).alias("b"))
    return best.select("game_id", "b.temp", "b.gap")


@query("jn17_same_line_join", "SELECT a.l_orderkey, a.l_linenumber AS n1, b.l_linenumber AS n2, a.l_partkey AS p1, b.l_partkey AS p2, a.l_extendedprice AS e1, b.l_extendedprice AS e2, round(b.l_tax - a.l_tax, 6) AS moved FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_discount = b.l_discount AND a.l_linenumber < b.l_linenumber")
def same_line(spark, sf):
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", F.col("l_linenumber").alias("n1"), F.col("l_partkey").alias("p1"), F.col("l_extendedprice").alias("e1"), F.col("l_tax").alias("t1"))
    b = a.select("l_orderkey", "l_discount", F.col("n1").alias("n2"), F.col("p1").alias("p2"), F.col("e1").alias("e2"), F.col("t1").alias("t2"))
    return a.join(b, ["l_orderkey", "l_discount"]).where("n1 < n2").select("l_orderkey", "n1", "n2", "p1", "p2", "e1", "e2", r(F.col("t2") - F.col("t1")).alias("moved"))


@query("jn18_starter_exclusion", "WITH s AS (SELECT l_orderkey, l_linestatus, arg_min(l_suppkey, (l_linenumber, l_suppkey, l_partkey)) AS starter FROM lineitem GROUP BY ALL) SELECT l.l_orderkey, l.l_linestatus, count(*) AS relief FROM lineitem l JOIN s ON s.l_orderkey = l.l_orderkey AND s.l_linestatus = l.l_linestatus WHERE l_suppkey <> starter GROUP BY ALL")
def relief(spark, sf):
    line = table(spark, sf, "lineitem")
    s = line.groupBy("l_orderkey", "l_linestatus").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("starter"))
    return line.join(s, ["l_orderkey", "l_linestatus"]).where("l_suppkey <> starter").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("relief"))


@query("agg1_group_by", f"{WITH_PITCHES} SELECT pitcher_id, season, count(*) AS n, round(sum(value), 2) AS total, round(avg(velo), 6) AS mean, min(velo) AS lo, max(velo) AS hi FROM pitches GROUP BY ALL")
def grouped(spark, sf):
    p = pitches(spark, sf).groupBy("pitcher_id", "season")
    return p.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), r(F.avg("velo")).alias("mean"), F.min("velo").alias("lo"), F.max("velo").alias("hi"))


@query("agg3_filtered_aggregates", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS bought FROM events GROUP BY user_id")
def filtered(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("bought"))


@query("agg4_conditional_distinct", "SELECT l_suppkey, count(DISTINCT CASE WHEN l_linenumber >= 4 THEN l_partkey END) AS late, count(DISTINCT l_partkey) AS every FROM lineitem GROUP BY l_suppkey")
def distinct_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct(F.when(F.col("l_linenumber") >= 4, F.col("l_partkey"))).alias("late"), F.countDistinct("l_partkey").alias("every"))


@query("agg5_arg_min_max", "SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS starter, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS closer FROM lineitem GROUP BY l_orderkey")
def arg(spark, sf):
    k = F.struct("l_linenumber", "l_suppkey")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", k).alias("starter"), F.max_by("l_suppkey", k).alias("closer"))


@query("agg6_bool_or", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey")
def bools(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"))


@query("agg8_weighted_mean", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 9) AS wmean FROM lineitem GROUP BY l_suppkey")
def wmean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(rates.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("wmean"))


@query(
    "agg9_share_of_total",
    "WITH w AS (SELECT l_orderkey, l_suppkey, sum(CASE WHEN l_linenumber >= 4 THEN l_quantity ELSE 0 END) AS late, sum(l_quantity) AS every FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(late) OVER (PARTITION BY l_orderkey) AS tl, sum(every) OVER (PARTITION BY l_orderkey) AS te FROM w) SELECT l_orderkey, l_suppkey, round(CASE WHEN tl > 0 THEN late / tl ELSE every / te END, 6) AS share FROM t",
)
def shares(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.when(F.col("l_linenumber") >= 4, F.col("l_quantity")).otherwise(0.0)).alias("late"), F.sum("l_quantity").alias("every"))
    o = Window.partitionBy("l_orderkey")
    tl, te = F.sum("late").over(o), F.sum("every").over(o)
    return w.select("l_orderkey", "l_suppkey", r(F.when(tl > 0, F.try_divide("late", tl)).otherwise(F.try_divide("every", te))).alias("share"))


@query("agg10_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 30")
def having(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 30")


@query("agg11_regression", f"{WITH_PITCHES} SELECT season, round(regr_slope(value, velo), 4) AS slope, round(regr_intercept(value, velo), 3) AS intercept FROM pitches GROUP BY season")
def regression(spark, sf):
    return pitches(spark, sf).groupBy("season").agg(F.round(F.regr_slope("value", "velo"), 4).alias("slope"), F.round(F.regr_intercept("value", "velo"), 3).alias("intercept"))


@query("agg12_spread", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 5) AS vp, round(avg(value), 6) AS m FROM events GROUP BY event_type")
def spread(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r(F.stddev_samp("value")).alias("sd"), F.round(F.var_pop("value"), 5).alias("vp"), r(F.avg("value")).alias("m"))


@query("agg13_exact_median", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS med FROM lineitem GROUP BY l_suppkey")
def medians(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.median("l_extendedprice")).alias("med"))


@query("agg14_mode", "WITH c AS (SELECT l_orderkey, l_discount, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_discount) AS i FROM c) SELECT l_orderkey, l_discount AS line, n FROM k WHERE i = 1")
def mode(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_discount").agg(F.count("*").alias("n"))
    best = c.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("l_discount").alias("line"))).alias("b"))
    return best.select("l_orderkey", "b.line", (-F.col("b.m")).alias("n"))


@query("agg15_distinct_tuples", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def tuples(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_suppkey", "l_partkey").alias("n"))


@query("agg16_sorted_set", "SELECT o_custkey, list_aggregate(list_sort(list_distinct(list(month(o_orderdate)))), 'string_agg', ',') AS months FROM orders GROUP BY o_custkey")
def sets(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.month("o_orderdate"))), ",").alias("months"))


@query(
    "agg17_combined_line_else_sum",
    """WITH l AS (SELECT l_suppkey AS player, CAST(year(l_shipdate) AS INT) AS season, l_linenumber AS teams, l_quantity AS pa FROM lineitem), g AS (
SELECT player, season, max(CASE WHEN teams = 7 THEN pa END) AS combined, sum(CASE WHEN teams < 7 THEN pa END) AS summed FROM l GROUP BY ALL) SELECT player, season, coalesce(combined, summed) AS pa FROM g""",
)
def combined(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("season"))
    g = g.agg(F.max(F.when(F.col("l_linenumber") == 7, F.col("l_quantity"))).alias("c"), F.sum(F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))).alias("s"))
    return g.select("player", "season", F.coalesce("c", "s").alias("pa"))


@query("agg18_career_before_season", f"{WITH_PITCHES}, t AS (SELECT pitcher_id, season, count(*) AS n FROM pitches GROUP BY ALL) SELECT pitcher_id, season, CAST(coalesce(sum(n) OVER (PARTITION BY pitcher_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS career, round(coalesce(sum(n) OVER (PARTITION BY pitcher_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3.0, 6) AS innings FROM t")
def career(spark, sf):
    t = pitches(spark, sf).groupBy("pitcher_id", "season").agg(F.count("*").alias("n"))
    c = F.coalesce(F.sum("n").over(Window.partitionBy("pitcher_id").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("pitcher_id", "season", c.alias("career"), r(c / 3.0).alias("innings"))


@query("agg20_capped_histogram", f"{WITH_TEAM_GAMES}, h AS (SELECT season, least(runs, 6) AS bin, count(*) AS n FROM team_games GROUP BY ALL) SELECT season, bin, n, round(n / sum(n) OVER (PARTITION BY season), 6) AS share FROM h")
def histogram(spark, sf):
    h = team_games(spark, sf).groupBy("season", F.least("runs", F.lit(6).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    return h.select("*", r(F.col("n") / F.sum("n").over(Window.partitionBy("season"))).alias("share"))


@query("agg21_laplace_rate", f"{WITH_TEAM_GAMES} SELECT venue_id, is_home, round((sum(CASE WHEN runs > allowed THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2), 6) AS rate FROM team_games GROUP BY ALL")
def laplace(spark, sf):
    return team_games(spark, sf).groupBy("venue_id", "is_home").agg(r((F.count(F.when(F.col("runs") > F.col("allowed"), 1)) + 1.0) / (F.count("*") + 2)).alias("rate"))


@query("agg23_integer_scaled_sum", "SELECT l_suppkey, CAST(sum(CAST(round_even(l_discount * l_extendedprice * 1e6, 0) AS BIGINT)) AS BIGINT) AS micro FROM lineitem GROUP BY l_suppkey")
def scaled(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.rint(F.col("l_discount") * F.col("l_extendedprice") * 1e6).cast("long")).alias("micro"))


@query("agg24_quality_summary", "SELECT count(*) AS n, count(c_mktsegment) AS filled, count(DISTINCT c_mktsegment) AS kinds, round(avg(c_acctbal), 6) AS mean FROM customer")
def summary(spark, sf):
    return table(spark, sf, "customer").agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("filled"), F.countDistinct("c_mktsegment").alias("kinds"), r(F.avg("c_acctbal")).alias("mean"))


FULL_ORDER = "l_linenumber, l_shipdate, l_suppkey, l_partkey, l_extendedprice"


@query("win1_row_number_filter", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) = 1")
def last_pitch(spark, sf):
    row = F.struct("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice")
    best = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(row).alias("b"))
    return best.select("l_orderkey", "l_linenumber", "b.l_suppkey", "b.l_partkey")


@query("win2_times_through_order", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {FULL_ORDER}) AS nth FROM lineitem")
def through_order(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*FULL_ORDER.split(", "))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.row_number().over(w).cast("long").alias("nth"))


@query("win3_cyclic_slot", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {FULL_ORDER}) - 1) % 9 + 1 AS slot FROM lineitem")
def slot(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy(*FULL_ORDER.split(", "))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", ((F.row_number().over(w) - 1) % 9 + 1).cast("long").alias("slot"))


@query("win6_lead_next_start", f"{WITH_TEAM_GAMES} SELECT game_id, team, coalesce(lead(runs) OVER (PARTITION BY team ORDER BY date, game_id), -1) AS next_runs FROM team_games")
def lead(spark, sf):
    w = Window.partitionBy("team").orderBy("date", "game_id")
    return team_games(spark, sf).select("game_id", "team", F.coalesce(F.lead("runs").over(w), F.lit(-1)).alias("next_runs"))


@query("win7_first_distinct", "WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) AS slot FROM f) SELECT l_orderkey, l_partkey, slot FROM k WHERE slot <= 3")
def first_distinct(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    k = f.withColumn("slot", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "l_partkey")).cast("long"))
    return k.where("slot <= 3").select("l_orderkey", "l_partkey", "slot")


@query("win8_op53_centred_by_day", f"{WITH_TEAM_GAMES} SELECT game_id, team, round(runs - avg(runs) OVER (PARTITION BY date), 6) AS rel FROM team_games")
def centred(spark, sf):
    t = team_games(spark, sf)
    return rates.centred(t, "runs", ["date"], "rel").select("game_id", "team", r(F.col("rel")).alias("rel"))


@query("win11_block_index", f"{WITH_GAMES} SELECT game_id, CAST((date - min(date) OVER (PARTITION BY season)) // 7 AS BIGINT) AS block FROM games")
def blocks(spark, sf):
    g = games(spark, sf)
    first = g.groupBy("season").agg(F.min("date").alias("first"))
    return g.join(first, "season").select("game_id", F.floor(F.datediff("date", "first") / 7).cast("long").alias("block"))


@query("win12_equal_count_bins", "SELECT c_nationkey, c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 10 // count(*) OVER (PARTITION BY c_nationkey) AS BIGINT) AS bin FROM customer")
def equal_bins(spark, sf):
    w = Window.partitionBy("c_nationkey")
    i = F.row_number().over(w.orderBy("c_acctbal", "c_custkey")) - 1
    return table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.floor(i * 10 / F.count("*").over(w)).cast("long").alias("bin"))


@query("win13_cumulative_distribution", f"{WITH_TEAM_GAMES}, h AS (SELECT season, runs, count(*) AS n FROM team_games GROUP BY ALL) SELECT season, runs, round(sum(n) OVER (PARTITION BY season ORDER BY runs) / sum(n) OVER (PARTITION BY season), 6) AS cdf FROM h")
def cdf(spark, sf):
    h = team_games(spark, sf).groupBy("season", "runs").agg(F.count("*").alias("n"))
    w = Window.partitionBy("season")
    return h.select("season", "runs", r(F.sum("n").over(w.orderBy("runs")) / F.sum("n").over(w)).alias("cdf"))


@query("srt3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("srt5_best_with_margin", "WITH s AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY ALL), d AS (SELECT min(p_brand) AS base FROM s) SELECT CASE WHEN (SELECT max(m) FROM s) - (SELECT m FROM s, d WHERE p_brand = base) > 5 THEN (SELECT arg_max(p_brand, (m, p_brand)) FROM s) ELSE (SELECT base FROM d) END AS chosen")
def best(spark, sf):
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    one = s.agg(F.max(F.struct("m", "p_brand")).alias("top"), F.min(F.struct("p_brand", "m")).alias("base"))
    return one.select(F.when(F.col("top.m") - F.col("base.m") > 5, F.col("top.p_brand")).otherwise(F.col("base.p_brand")).alias("chosen"))


@query("set1_union_all", "SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_all(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("set2_union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, r_name AS region FROM region")
def union_by_name(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(g.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region")), allowMissingColumns=True)


@query("set3_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set4_set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05")
def difference(spark, sf):
    p, line = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_quantity > 49 and l_discount > 0.05")
    return p.join(line, p["p_partkey"] == line["l_partkey"], "left_anti").select("p_partkey")


@query("set5_subset_assertion", "SELECT count(*) AS outside FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def subset(spark, sf):
    line, s = table(spark, sf, "lineitem").select("l_suppkey").distinct(), table(spark, sf, "supplier")
    return line.join(s, line["l_suppkey"] == s["s_suppkey"], "left_anti").agg(F.count("*").alias("outside"))
