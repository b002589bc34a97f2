"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitsports.functions import columns as fn
from pitsports.operators import rates
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, WITH_TEAM_GAMES, games, pitches, query, r, table, team_games


@query("prj1_team_game_fanout", f"{WITH_TEAM_GAMES} SELECT game_id, team, opponent, is_home, runs FROM team_games")
def fanout(spark, sf):
    return team_games(spark, sf).select("game_id", "team", "opponent", "is_home", "runs")


@query(
    "prj2_outcome_flags",
    f"""{WITH_PITCHES} SELECT game_id, pitch_no, pitcher_id, batter_id, value, CAST(result = 'R' AS INT) AS is_k, CAST(result = 'A' AS INT) AS is_bb, CAST(result IN ('N', 'A') AS INT) AS in_play FROM pitches""",
)
def flags(spark, sf):
    flag = lambda c: c.cast("int")
    return pitches(spark, sf).select(
        "game_id", "pitch_no", "pitcher_id", "batter_id", "value", flag(F.col("result") == "R").alias("is_k"), flag(F.col("result") == "A").alias("is_bb"),
        flag(F.col("result").isin("N", "A")).alias("in_play"),
    )


@query(
    "prj3_availability_date",
    f"""{WITH_PITCHES} SELECT game_id, CAST(max(data_date) AS VARCHAR) AS data_date, bool_or(ship_date > date) AS resumed FROM pitches GROUP BY game_id""",
)
def availability(spark, sf):
    p = pitches(spark, sf)
    return p.groupBy("game_id").agg(F.max("data_date").cast("string").alias("data_date"), F.bool_or(F.col("ship_date") > F.col("date")).alias("resumed"))


@query(
    "prj4_batting_side",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END WHEN p_size % 3 = 1 THEN 'L' ELSE 'R' END AS side FROM part""",
)
def batting_side(spark, sf):
    bats = F.when(F.col("p_size") % 3 == 0, "S").when(F.col("p_size") % 3 == 1, "L").otherwise("R")
    throws = F.when(F.col("p_partkey") % 2 == 0, "R").otherwise("L")
    side = F.when(bats == "S", F.when(throws == "R", "L").otherwise("R")).otherwise(bats)
    return table(spark, sf, "part").select("p_partkey", side.alias("side"))


@query(
    "prj5_count_group",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 3 = 2 THEN 'two strikes' WHEN l_linenumber % 4 = 3 THEN 'three balls' WHEN l_linenumber % 4 = 0 THEN 'full' ELSE 'other' END AS grp FROM lineitem""",
)
def count_group(spark, sf):
    n = F.col("l_linenumber")
    grp = F.when(n % 3 == 2, "two strikes").when(n % 4 == 3, "three balls").when(n % 4 == 0, "full").otherwise("other")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", grp.alias("grp"))


@query(
    "prj6_rest_bucket",
    f"""{WITH_TEAM_GAMES}, s AS (SELECT game_id, team, date, lag(date) OVER (PARTITION BY team, season ORDER BY date, game_id) AS last FROM team_games)
SELECT game_id, team, CASE WHEN last IS NULL THEN 'first' WHEN date - last <= 1 THEN 'short' WHEN date - last <= 3 THEN 'normal' ELSE 'long' END AS rest FROM s""",
)
def rest_bucket(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("team", "season").orderBy("date", "game_id")
    days = F.datediff("date", F.lag("date").over(w))
    rest = F.when(days.isNull(), "first").when(days <= 1, "short").when(days <= 3, "normal").otherwise("long")
    return team_games(spark, sf).select("game_id", "team", rest.alias("rest"))


@query("prj7_clamp", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clamped FROM customer")
def clamped(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", rates.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"))


@query(
    "prj8_two_dimensional_bins",
    """SELECT CAST(least(greatest(floor(l_quantity / 5), 0), 8) AS INT) AS ix, CAST(least(greatest(floor(l_extendedprice / 10000), 0), 6) AS INT) AS iz, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def bins(spark, sf):
    ix = rates.clamp(F.floor(F.col("l_quantity") / 5), 0, 8).cast("int").alias("ix")
    iz = rates.clamp(F.floor(F.col("l_extendedprice") / 10000), 0, 6).cast("int").alias("iz")
    return table(spark, sf, "lineitem").groupBy(ix, iz).agg(F.count("*").alias("n"))


@query("prj9_replace_columns", "SELECT * EXCLUDE (n_regionkey) REPLACE (upper(n_name) AS n_name) FROM nation")
def replaced(spark, sf):
    return table(spark, sf, "nation").withColumn("n_name", F.upper("n_name")).drop("n_regionkey")


@query(
    "prj10_stack_long",
    """SELECT s_suppkey, unnest(['acctbal', 'nation']) AS stat, unnest([s_acctbal, CAST(s_nationkey AS DOUBLE)]) AS value FROM supplier""",
)
def stacked(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["acctbal", "nation"], "stat", "value")


@query(
    "prj11_pivot_wide",
    f"""{WITH_GAMES} SELECT season, max(CASE WHEN status = 'F' THEN home_final END) AS f, max(CASE WHEN status = 'O' THEN home_final END) AS o, max(CASE WHEN status = 'P' THEN home_final END) AS p FROM games GROUP BY season""",
)
def wide(spark, sf):
    out = games(spark, sf).groupBy("season").pivot("status", ["F", "O", "P"]).agg(F.max("home_final"))
    return out.toDF("season", "f", "o", "p")


@query(
    "prj12_home_away_columns",
    f"""{WITH_TEAM_GAMES} SELECT game_id, max(runs) FILTER (WHERE is_home) AS home_runs, max(runs) FILTER (WHERE NOT is_home) AS away_runs FROM team_games GROUP BY game_id""",
)
def both_sides(spark, sf):
    return team_games(spark, sf).groupBy("game_id").agg(F.max(F.when(F.col("is_home"), F.col("runs"))).alias("home_runs"), F.max(F.when(~F.col("is_home"), F.col("runs"))).alias("away_runs"))


@query(
    "flt1_usable_rows",
    f"""{WITH_TEAM_GAMES}, u AS (SELECT game_id, team, runs, count(*) OVER (PARTITION BY game_id) AS c FROM team_games WHERE runs IS NOT NULL AND runs < 8) SELECT game_id, team, runs FROM u WHERE c = 2""",
)
def usable(spark, sf):
    from pyspark.sql import Window

    t = team_games(spark, sf).where("runs is not null and runs < 8")
    return t.withColumn("c", F.count("*").over(Window.partitionBy("game_id"))).where("c = 2").select("game_id", "team", "runs")


@query("flt2_masked_outcomes", f"{WITH_TEAM_GAMES} SELECT game_id, team, CASE WHEN season IN (2000, 2001) THEN NULL ELSE runs END AS target FROM team_games")
def masked(spark, sf):
    return team_games(spark, sf).select("game_id", "team", F.when(~F.col("season").isin(2000, 2001), F.col("runs")).alias("target"))


@query(
    "flt3_membership_filters",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def membership(spark, sf):
    o, c, line = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    o = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    o = o.join(c.where("c_mktsegment = 'BUILDING'"), o["o_custkey"] == c["c_custkey"], "left_semi")
    return o.join(line.where("l_returnflag = 'R'"), o["o_orderkey"] == line["l_orderkey"], "left_anti").select("o_orderkey", "o_totalprice")


@query(
    "flt4_has_prior_history",
    f"""{WITH_PITCHES}, s AS (SELECT DISTINCT pitcher_id, season FROM pitches) SELECT pitcher_id, season, EXISTS (SELECT 1 FROM s b WHERE b.pitcher_id = a.pitcher_id AND b.season < a.season) AS has_prior FROM s a""",
)
def prior_history(spark, sf):
    s = pitches(spark, sf).select("pitcher_id", "season").distinct()
    first = s.groupBy("pitcher_id").agg(F.min("season").alias("first"))
    return s.join(first, "pitcher_id").select("pitcher_id", "season", (F.col("first") < F.col("season")).alias("has_prior"))


RULES = "(VALUES (1, 'F', NULL), (2, NULL, '5-LOW'), (3, 'P', '1-URGENT')) AS x(rule, st, pr)"


@query(
    "flt5_wildcard_exclusions",
    f"{WITH_GAMES} SELECT game_id, status, priority FROM games g WHERE NOT EXISTS (SELECT 1 FROM {RULES} WHERE (st IS NULL OR st = g.status) AND (pr IS NULL OR pr = g.priority))",
)
def exclusions(spark, sf):
    rules = spark.createDataFrame([(1, "F", None), (2, None, "5-LOW"), (3, "P", "1-URGENT")], "rule int, st string, pr string")
    g = games(spark, sf).select("game_id", "status", "priority")
    hit = (F.col("st").isNull() | (F.col("st") == F.col("status"))) & (F.col("pr").isNull() | (F.col("pr") == F.col("priority")))
    return g.join(F.broadcast(rules), hit, "left_anti")


@query("flt7_rolling_lower_bound", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-10'")
def rolling_bound(spark, sf):
    return table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-10' - interval 7 days and ts < timestamp_ntz'2024-01-10'").select("event_id", "user_id")


@query(
    "flt8_live_games",
    f"{WITH_GAMES}, m AS (SELECT max(date) AS last FROM games WHERE status = 'F') SELECT game_id, status FROM games, m WHERE status = 'F' OR date > last",
)
def live(spark, sf):
    g = games(spark, sf)
    last = g.where("status = 'F'").agg(F.max("date").alias("last"))
    return g.crossJoin(F.broadcast(last)).where("status = 'F' or date > last").select("game_id", "status")


@query(
    "fn1_fn3_parsed_codes",
    """SELECT event_id, CASE WHEN c % 100 = 0 AND c BETWEEN 100 AND 900 THEN CAST(c // 100 AS INT) END AS slot,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS rate FROM (SELECT event_id, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 10) * 100 + event_id % 3 END AS c FROM events)""",
)
def parsed(spark, sf):
    e = table(spark, sf, "events")
    code = F.when(F.col("event_id") % 4 == 0, F.lit("sub")).otherwise(((F.col("event_id") % 10) * 100 + F.col("event_id") % 3).cast("string"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("-.--")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", fn.starting_slot(code).alias("slot"), fn.parsed_rate(text).alias("rate"))


@query(
    "fn2_status_enum",
    f"""{WITH_GAMES} SELECT game_id, CASE WHEN starts_with(lower(priority), '1-') OR starts_with(lower(priority), '2-') THEN 'final' WHEN starts_with(lower(priority), '3-') THEN 'live' WHEN starts_with(lower(priority), '4-') THEN 'postponed' ELSE 'scheduled' END AS st, status NOT IN ('F', 'O') AS unknown FROM games""",
)
def status_enum(spark, sf):
    p = F.lower("priority")
    st = F.when(p.startswith("1-") | p.startswith("2-"), "final").when(p.startswith("3-"), "live").when(p.startswith("4-"), "postponed").otherwise("scheduled")
    return games(spark, sf).select("game_id", st.alias("st"), (~F.col("status").isin("F", "O")).alias("unknown"))


@query("fn8_barrel", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity * 2.3 >= 98 AND l_discount * 500 BETWEEN 26 - (least(l_quantity * 2.3, 116.0) - 98) AND 30 + (least(l_quantity * 2.3, 116.0) - 98) AS barrel FROM lineitem")
def barrels(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", fn.barrel(F.col("l_quantity") * 2.3, F.col("l_discount") * 500).alias("barrel"))


@query("fn9_in_zone", "SELECT p_partkey, abs(p_size - 25) <= 10.0 AND p_retailprice BETWEEN 1000 AND 1500 AS in_zone FROM part")
def zone(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.in_zone(F.col("p_size") - 25, F.col("p_retailprice"), F.lit(1000), F.lit(1500), 10.0).alias("in_zone"))


@query(
    "fn10_age_factor",
    f"{WITH_GAMES} SELECT game_id, round(CASE WHEN a < 29 THEN 1 + (29 - a) * 0.006 ELSE 1 - (a - 29) * 0.003 END, 6) AS factor FROM (SELECT game_id, (date - (DATE '1960-01-01' + CAST(venue_id * 400 AS INT))) / 365.25 AS a FROM games)",
)
def age(spark, sf):
    birth = F.date_add(F.lit("1960-01-01").cast("date"), F.col("venue_id") * 400)
    return games(spark, sf).select("game_id", r(fn.age_factor(birth, F.col("date"))).alias("factor"))


WIND = "SELECT l_orderkey AS id, l_linenumber AS n, l_extendedprice AS price, l_partkey AS pk, l_quantity / 2.0 AS speed, CAST(l_suppkey * 37 % 360 AS DOUBLE) AS d, CAST(l_partkey * 13 % 360 AS DOUBLE) AS b FROM lineitem"


@query(
    "fn12_fn13_wind",
    f"""SELECT id, n, price, pk, round(least(greatest(speed * cos(radians((d + 180) % 360 - b)), -25.0), 25.0), 6) AS wind_out,
CASE WHEN speed < 5 THEN 'neutral' WHEN least((d + 180 - b + 360) % 360, 360 - (d + 180 - b + 360) % 360) <= 45 THEN 'out' WHEN least((d + 180 - b + 360) % 360, 360 - (d + 180 - b + 360) % 360) >= 135 THEN 'in' ELSE 'cross' END AS class FROM ({WIND})""",
)
def wind(spark, sf):
    w = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("pk"), (F.col("l_quantity") / 2.0).alias("speed"),
        (F.col("l_suppkey") * 37 % 360).cast("double").alias("d"), (F.col("l_partkey") * 13 % 360).cast("double").alias("b"),
    )
    return w.select("id", "n", "price", "pk", r(fn.wind_out(F.col("speed"), F.col("d"), F.col("b"))).alias("wind_out"), fn.wind_class(F.col("speed"), F.col("d"), F.col("b")).alias("class"))


ODDS = """SELECT l_orderkey AS game_id, l_linenumber AS book, l_suppkey AS s, l_partkey AS p, l_extendedprice AS price, CAST(CASE WHEN l_quantity > 25 THEN l_quantity * 5 ELSE -(100 + l_quantity * 4) END AS DOUBLE) AS am FROM lineitem"""


@query("fn16_odds", f"SELECT game_id, book, s, p, price, round(CASE WHEN am > 0 THEN 1 + am / 100 ELSE 1 + 100 / abs(am) END, 6) AS dec, round(1 / CASE WHEN am > 0 THEN 1 + am / 100 ELSE 1 + 100 / abs(am) END, 6) AS prob FROM ({ODDS})")
def odds(spark, sf):
    am = F.when(F.col("l_quantity") > 25, F.col("l_quantity") * 5).otherwise(-(100 + F.col("l_quantity") * 4))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("book"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("price"),
        r(fn.decimal_odds(am)).alias("dec"), r(fn.implied(am)).alias("prob"),
    )


@query(
    "fn17_devig",
    """WITH RECURSIVE q AS (SELECT p_partkey AS id, 0.45 + (p_size % 20) * 0.01 AS a, 0.60 - (p_size % 20) * 0.01 AS b FROM part),
bis AS (SELECT id, a, b, 0.2::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS i FROM q UNION ALL
  SELECT id, a, b, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bis WHERE i < 60)
SELECT id, round(a / (a + b), 6) AS multiplicative, round(a - (a + b - 1) / 2, 6) AS additive, round(pow(a, (lo + hi) / 2), 6) AS power FROM bis WHERE i = 60""",
)
def devig(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (0.45 + (F.col("p_size") % 20) * 0.01).alias("a"), (0.60 - (F.col("p_size") % 20) * 0.01).alias("b"))
    a, b = F.col("a"), F.col("b")
    return q.select("id", r(fn.devig_multiplicative(a, b)).alias("multiplicative"), r(fn.devig_additive(a, b)).alias("additive"), r(fn.devig_power(a, b)).alias("power"))


@query(
    "fn18_logit_log_loss",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, round(ln(p / (1 - p)), 6) AS logit, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss FROM (SELECT *, l_quantity / 51 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)""",
)
def losses(spark, sf):
    p, y = F.col("l_quantity") / 51, F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", r(fn.logit(p)).alias("logit"), r(fn.log_loss(y, p)).alias("loss"))


@query(
    "fn19_nb_pmf",
    """WITH RECURSIVE q AS (SELECT p_partkey AS id, 2.0 + p_size / 10.0 AS mu, 3.0 + p_size % 5 AS r FROM part),
g AS (SELECT id, mu, r, 0 AS k, pow(r / (r + mu), r) AS p FROM q UNION ALL SELECT id, mu, r, k + 1, p * (k + r) / (k + 1) * mu / (r + mu) FROM g WHERE k < 25)
SELECT id, k, round(p, 9) AS p FROM g""",
)
def nb(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (2.0 + F.col("p_size") / 10.0).alias("mu"), (3.0 + F.col("p_size") % 5).alias("size"))
    return q.select("id", F.posexplode(fn.pmf_nb(F.col("mu"), F.col("size"))).alias("k", "p")).select("id", "k", r(F.col("p"), 9).alias("p"))


@query("fn21_safe_division", "SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS ratio FROM lineitem GROUP BY l_orderkey")
def safe(spark, sf):
    n = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.try_divide(F.sum("l_quantity"), n).alias("ratio"))


@query(
    "fn22_date_arithmetic",
    f"{WITH_GAMES} SELECT game_id, CAST(date - DATE '1995-01-01' AS BIGINT) AS days, CAST(date - 30 AS VARCHAR) AS month_before, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS epoch FROM games",
)
def dates(spark, sf):
    return games(spark, sf).select(
        "game_id", F.datediff("date", F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_sub("date", 30).cast("string").alias("month_before"), (F.unix_date("date").cast("long") * 86400).alias("epoch")
    )


@query("fn23_text_functions", "SELECT c_custkey, left(c_name, 8) AS head, lower(c_mktsegment) AS seg, split_part(c_name, '#', 2) AS tail, nullif(c_mktsegment, 'BUILDING') AS not_building FROM customer")
def text(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.left("c_name", F.lit(8)).alias("head"), F.lower("c_mktsegment").alias("seg"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("not_building")
    )


@query("fn24_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("fn25_generator", "SELECT n_nationkey, unnest(range(1, n_regionkey + 2)) AS i FROM nation")
def generated(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_regionkey") + F.lit(1).cast("long"))).alias("i"))


NB_TWO = """q AS (SELECT s_suppkey AS id, 2.0 + s_suppkey % 7 * 0.3 AS ma, 1.5 + s_suppkey % 5 * 0.4 AS mb FROM supplier),
ga AS (SELECT id, ma AS mu, 4.0 AS r, 0 AS k, pow(4.0 / (4.0 + ma), 4.0) AS p FROM q UNION ALL SELECT id, mu, r, k + 1, p * (k + r) / (k + 1) * mu / (r + mu) FROM ga WHERE k < 12),
gb AS (SELECT id, mb AS mu, 4.0 AS r, 0 AS k, pow(4.0 / (4.0 + mb), 4.0) AS p FROM q UNION ALL SELECT id, mu, r, k + 1, p * (k + r) / (k + 1) * mu / (r + mu) FROM gb WHERE k < 12)"""


def _two(spark, sf):
    s = table(spark, sf, "supplier")
    ma, mb = 2.0 + F.col("s_suppkey") % 7 * 0.3, 1.5 + F.col("s_suppkey") % 5 * 0.4
    return s.select(F.col("s_suppkey").alias("id"), fn.pmf_nb(ma, F.lit(4.0), 12).alias("a"), fn.pmf_nb(mb, F.lit(4.0), 12).alias("b"))


@query("fn26_convolution", f"WITH RECURSIVE {NB_TWO} SELECT ga.id, ga.k + gb.k AS total, round(sum(ga.p * gb.p), 9) AS p FROM ga JOIN gb ON ga.id = gb.id WHERE ga.k + gb.k <= 12 GROUP BY ALL")
def convolution(spark, sf):
    out = _two(spark, sf).select("id", F.posexplode(fn.convolve(F.col("a"), F.col("b"), 12)).alias("total", "p"))
    return out.select("id", "total", r(F.col("p"), 9).alias("p"))


@query(
    "fn27_grid_marginals",
    f"""WITH RECURSIVE {NB_TWO} SELECT ga.id, round(sum(ga.p * gb.p) FILTER (WHERE ga.k > gb.k), 8) AS win, round(sum(ga.p * gb.p) FILTER (WHERE ga.k = gb.k), 8) AS tie, round(sum(ga.p * gb.p) FILTER (WHERE ga.k - gb.k >= 2), 8) AS cover, round(sum(ga.p * gb.p) FILTER (WHERE ga.k + gb.k >= 8), 8) AS over FROM ga JOIN gb ON ga.id = gb.id GROUP BY ga.id""",
)
def marginals(spark, sf):
    g = _two(spark, sf).select("id", F.posexplode("a").alias("i", "p"), "b").select("id", "i", "p", F.posexplode("b").alias("j", "q"))
    mass = lambda c: r(F.sum(F.when(c, F.col("p") * F.col("q"))), 8)
    i, j = F.col("i"), F.col("j")
    return g.groupBy("id").agg(mass(i > j).alias("win"), mass(i == j).alias("tie"), mass(i - j >= 2).alias("cover"), mass(i + j >= 8).alias("over"))


@query("fn29_missing_values", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def missing(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", fn.missing_to_null(v).alias("v"))
