"""Stand-in frames of the sports domain on the given tables, and the same views for DuckDB.

Orders are games, line items are pitches, customers' nations are venues, suppliers are pitchers and parts are batters.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsports.operators import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GAMES = """
games AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS season, c_nationkey AS venue_id,
         CAST(o_custkey % 30 AS INT) AS home_team, CAST((o_custkey + 1 + o_orderkey % 28) % 30 AS INT) AS away_team,
         CAST(floor(o_totalprice) AS BIGINT) % 9 AS home_final, CAST(floor(o_totalprice / 9) AS BIGINT) % 9 AS away_final,
         o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
PITCHES = """
pitches AS (
  SELECT l_orderkey AS game_id, l_linenumber AS pitch_no, l_suppkey AS pitcher_id, l_partkey AS batter_id, l_quantity AS velo,
         l_discount AS px, l_tax AS pz, l_extendedprice AS value, l_returnflag AS result, l_linestatus AS half,
         CAST(l_shipdate AS DATE) AS ship_date, date, season, greatest(date, CAST(l_shipdate AS DATE)) AS data_date, venue_id,
         CASE WHEN l_linestatus = 'O' THEN home_team ELSE away_team END AS fld_team,
         CASE WHEN l_linestatus = 'O' THEN away_team ELSE home_team END AS bat_team
  FROM lineitem JOIN games ON l_orderkey = game_id
)"""
TEAM_GAMES = """
team_games AS (
  SELECT game_id, date, season, venue_id, home_team AS team, away_team AS opponent, TRUE AS is_home, home_final AS runs, away_final AS allowed FROM games
  UNION ALL
  SELECT game_id, date, season, venue_id, away_team, home_team, FALSE, away_final, home_final FROM games
)"""
#: What each pitcher did for a side of a game, by the day from which it was known (that day's year is the season it counts
#: in): ``fresh`` marks the first of these days, on which the appearance itself counts. Who started is known at the game.
APPEARANCES = """
app AS (SELECT * EXCLUDE (first), CAST(year(day) AS INT) AS known, day = min(day) OVER (PARTITION BY game_id, fld_team, who) AS fresh, who = (min({'f': first, 'w': who}) OVER (PARTITION BY game_id, fld_team)).w AS started
  FROM (SELECT pitcher_id AS who, game_id, fld_team, bat_team, date, season, data_date AS day, count(*) AS n, count(*) FILTER (WHERE pitch_no >= 5) AS late, min(pitch_no) AS first,
    count(*) FILTER (WHERE result = 'R') AS k, sum(velo) AS v FROM pitches GROUP BY ALL)),
st AS (SELECT DISTINCT who, game_id, fld_team, bat_team, date, season FROM app WHERE started)"""
#: SQL of ``operators.rates.decayed_rate`` over views ``{q}`` (who, season, cutoff) and ``{f}`` (who, season, day, s, n): {name}.
DECAYED = """
{name}_q AS (SELECT DISTINCT who, season, cutoff FROM {q}), {name}_d AS (SELECT who, season, day, sum(s) AS s, sum(n) AS n FROM {f} GROUP BY ALL),
{name}_r AS (SELECT who, season, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM {name}_d WINDOW w AS (PARTITION BY who, season ORDER BY day)), {name}_t AS (SELECT who, season, sum(s) AS s, sum(n) AS n FROM {name}_d GROUP BY ALL),
{name}_l AS (SELECT season + 1 AS season, sum(s) * 1.0 / sum(n) AS mu FROM {name}_t GROUP BY season), {name}_p AS (SELECT who, season + lag AS season, sum(w * s) AS s, sum(w * n) AS n FROM {name}_t, (VALUES (1, 0.8), (2, 0.6), (3, 0.4)) v(lag, w) GROUP BY ALL),
{name} AS (SELECT q.who, q.season, q.cutoff, r.n IS NULL AND p.n IS NULL AS rookie, (coalesce(r.s, 0) + coalesce(p.s, 0) + {k} * coalesce(mu, {mu})) / (coalesce(r.n, 0) + coalesce(p.n, 0) + {k}) AS value FROM {name}_q q
  ASOF LEFT JOIN {name}_r r ON r.who = q.who AND r.season = q.season AND q.cutoff > r.day LEFT JOIN {name}_p p ON p.who = q.who AND p.season = q.season LEFT JOIN {name}_l l ON l.season = q.season)"""
#: SQL of ``operators.rates.centred_rate`` over views ``q`` (who, season, cutoff) and ``f`` (who, season, day, s, n).
CENTRED = """
q0 AS (SELECT DISTINCT who, season, cutoff FROM q),
fd AS (SELECT who, season, day, sum(s) AS s, sum(n) AS n FROM f GROUP BY ALL),
fr AS (SELECT who, season, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM fd WINDOW w AS (PARTITION BY who, season ORDER BY day)),
ld AS (SELECT season, day, sum(s) AS s, sum(n) AS n FROM fd GROUP BY ALL),
lr AS (SELECT season, day, sum(s) OVER w / sum(n) OVER w AS l FROM ld WINDOW w AS (PARTITION BY season ORDER BY day)),
ls AS (SELECT season, sum(s) / sum(n) AS m FROM ld GROUP BY season),
fs AS (SELECT who, fd.season, sum(s) - sum(n) * any_value(m) AS rc, sum(n) AS n FROM fd JOIN ls ON ls.season = fd.season GROUP BY ALL),
pr AS (SELECT k.who, k.season, sum(w * rc) AS rc, sum(w * n) AS n FROM (SELECT DISTINCT who, season FROM q) k JOIN fs ON fs.who = k.who JOIN (VALUES (1, 0.8), (2, 0.6), (3, 0.4)) v(lag, w) ON fs.season = k.season - lag GROUP BY ALL),
rate AS (SELECT q0.who, q0.season, q0.cutoff, coalesce(fr.n, 0) AS cur_n, coalesce(pr.n, 0) AS pri_n,
  (coalesce(fr.s, 0) - coalesce(fr.n, 0) * coalesce(lr.l, 0) + coalesce(pr.rc, 0)) / (coalesce(fr.n, 0) + coalesce(pr.n, 0) + {k}) AS value
  FROM q0 ASOF LEFT JOIN fr ON fr.who = q0.who AND fr.season = q0.season AND q0.cutoff > fr.day
  ASOF LEFT JOIN lr ON lr.season = q0.season AND q0.cutoff > lr.day LEFT JOIN pr ON pr.who = q0.who AND pr.season = q0.season)"""
WITH_GAMES = f"WITH {GAMES}"
WITH_PITCHES = f"WITH {GAMES}, {PITCHES}"
WITH_TEAM_GAMES = f"WITH {GAMES}, {TEAM_GAMES}"


#: Bytes of the given tables' files for each partition of a shuffle, partitions up to which a session is left as it is, the
#: bytes to which adaptive execution joins partitions (64 MB of lines, its default, are 2.3 GB in a task), and the bytes of a
#: file that a task reads (it keeps their rows until it writes its shuffle file; a row group is never split).
PART, FEW, JOINED, READ = 4 << 20, 8, "8m", 16 << 20


def sized(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session, or for tables of more than ``FEW`` parts of ``PART`` bytes a session like it that has at least as many shuffle
    partitions as they have parts, small when joined, and reads files in small splits: what a task holds then does not grow with
    the tables; shuffle files go when the step that wrote them ends. The given session's settings stay as they are."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        path = hadoop(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    if size <= PART * FEW:
        return spark
    parts = max(-(-size // PART), int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": JOINED, "spark.sql.files.maxPartitionBytes": str(READ), **tables.TIDY}
    if all(spark.conf.get(key, None) == value for key, value in wanted.items()):  # a query of a query
        return spark
    own = tables.same_settings(spark)
    for key, value in wanted.items():
        own.conf.set(key, value)
    return own


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) and its DuckDB counterpart; it runs in a session :func:`sized` for its tables."""

    def keep(f):
        QUERIES[name] = wraps(f)(lambda spark, sf_dir: f(sized(spark, sf_dir), sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_changes: dict[str, Callable[[DataFrame], DataFrame]] = {}


@contextmanager
def overridden(**changes: Callable[[DataFrame], DataFrame]):
    """Inside this block, queries that are built read the named tables through these functions; ``pitches`` names the joined
    view of all facts, and its function is given None; ``appearances`` what is derived from it."""
    before = dict(_changes)
    _changes.update(changes)
    try:
        yield
    finally:
        _changes.clear()
        _changes.update(before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _changes[name](rows) if name in _changes else rows


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("date"),
        F.year("o_orderdate").alias("season"),
        F.col("c_nationkey").alias("venue_id"),
        (F.col("o_custkey") % 30).cast("int").alias("home_team"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 28) % 30).cast("int").alias("away_team"),
        (F.floor("o_totalprice").cast("long") % 9).alias("home_final"),
        (F.floor(F.col("o_totalprice") / 9).cast("long") % 9).alias("away_final"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    if "pitches" in _changes:
        return _changes["pitches"](None)
    pitch, g = table(spark, sf_dir, "lineitem"), games(spark, sf_dir)
    home = F.col("l_linestatus") == "O"
    return pitch.join(g, pitch["l_orderkey"] == g["game_id"]).select(
        "game_id",
        F.col("l_linenumber").alias("pitch_no"),
        F.col("l_suppkey").alias("pitcher_id"),
        F.col("l_partkey").alias("batter_id"),
        F.col("l_quantity").alias("velo"),
        F.col("l_discount").alias("px"),
        F.col("l_tax").alias("pz"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_returnflag").alias("result"),
        F.col("l_linestatus").alias("half"),
        F.to_date("l_shipdate").alias("ship_date"),
        "date",
        "season",
        F.greatest("date", F.to_date("l_shipdate")).alias("data_date"),
        "venue_id",
        F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("fld_team"),
        F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("bat_team"),
    )


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game twice, once for each batting team."""
    sides = F.explode(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home"), F.col("home_final").alias("runs"), F.col("away_final").alias("allowed")),
            F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home"), F.col("away_final").alias("runs"), F.col("home_final").alias("allowed")),
        )
    )
    return games(spark, sf_dir).select("game_id", "date", "season", "venue_id", sides.alias("s")).select("game_id", "date", "season", "venue_id", "s.*")


def appearances(p: DataFrame) -> DataFrame:
    """``app`` of ``APPEARANCES`` over ``pitches``."""
    return _changes["appearances"](p) if "appearances" in _changes else appearances_of(p)


def settled_appearances(p: DataFrame) -> DataFrame:
    """:func:`appearances`, settled; where a block overrides them, they are already."""
    return _changes["appearances"](p) if "appearances" in _changes else tables.settled(appearances_of(p))


def appearances_of(p: DataFrame) -> DataFrame:
    """What ``appearances`` gives where no block overrides it."""
    a = p.groupBy(F.col("pitcher_id").alias("who"), "game_id", "fld_team", "bat_team", "date", "season", F.col("data_date").alias("day")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("pitch_no") >= 5, 1)).alias("late"), F.min("pitch_no").alias("first"), F.count(F.when(F.col("result") == "R", 1)).alias("k"), F.sum("velo").alias("v")
    )
    side = Window.partitionBy("game_id", "fld_team")
    began = F.min(F.struct("first", "who")).over(side)
    own = side.orderBy("who").rangeBetween(Window.currentRow, Window.currentRow)  # groups of a side; those of a pitcher have one row or two, and each costs
    fresh = F.col("day") == F.min("day").over(own)
    return a.withColumns({"known": F.year("day"), "fresh": fresh, "started": F.col("who") == began["who"]}).drop("first")


def settled_pitches(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of :func:`pitches`, settled: facts and games are joined once; where a block overrides them, they are already."""
    p = pitches(spark, sf_dir)
    return p if "pitches" in _changes else tables.settled(p.select(*columns))


def starters(a: DataFrame, *by: str) -> DataFrame:
    """``st`` of ``APPEARANCES``: a row for each side of a game; with ``by``, shuffled by these of its columns, and only once."""
    st = a.where("started").select("who", "game_id", "fld_team", "bat_team", "date", "season")
    return (st.repartition(*by) if by else st).distinct()


def r(c, places: int = 6):
    return F.round(c, places)


def drawn_sql(seed: int, draw: str = "draw", i: str = "i") -> str:
    """SQL of :func:`pitsports.operators.stats.drawn`."""
    x = f"(({draw} * 48271 + {i} * 69621 + {seed + 1} * 16807) % 2147483647)"
    for step in (48271, 69621, 16807):
        x = f"(({x} * {step} + {draw} * 7919 + {i} * 104729) % 2147483647)"
    return x


def bootstrap_sql(source: str, draws: int, seed: int, name: str) -> str:
    """CTEs of :func:`pitsports.operators.stats.block_bootstrap` over ``source`` (x, w, block): ``<name>`` has (draw, mean)."""
    return f"""{name}_s AS (SELECT block, sum(w * x) AS x, sum(w) AS w, row_number() OVER (ORDER BY block) - 1 AS i FROM {source} GROUP BY block), {name}_n AS (SELECT count(*) AS n FROM {name}_s),
{name}_p AS (SELECT draw, {drawn_sql(seed)} % n AS pick FROM {name}_s, {name}_n, (SELECT CAST(unnest(range(0, {draws})) AS BIGINT) AS draw)), {name} AS (SELECT draw, sum(x) / sum(w) AS mean FROM {name}_p JOIN {name}_s ON {name}_s.i = pick GROUP BY draw)"""


def joint_bootstrap_sql(source: str, groups: list[str], draws: int, seed: int, name: str) -> str:
    """CTEs of :func:`pitsports.operators.stats.joint_bootstrap` over ``source`` (groups, x, w, block): ``<name>`` has (groups, draw, mean)."""
    g = ", ".join(groups)
    return f"""{name}_s AS (SELECT {g}, block, sum(w * x) AS x, sum(w) AS w FROM {source} GROUP BY ALL), {name}_b AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i FROM (SELECT DISTINCT block FROM {source})), {name}_n AS (SELECT count(*) AS n FROM {name}_b),
{name}_p AS (SELECT draw, {drawn_sql(seed)} % n AS pick, count(*) AS times FROM {name}_b, {name}_n, (SELECT CAST(unnest(range(0, {draws})) AS BIGINT) AS draw) GROUP BY ALL),
{name} AS (SELECT {g}, draw, sum(times * x) / nullif(sum(times * w), 0) AS mean FROM {name}_s JOIN {name}_b USING (block) JOIN {name}_p ON pick = i GROUP BY ALL)"""


def eliminated_sql(name: str, k: int, carry: str = "") -> str:
    """CTEs that solve the k equations in the columns a<i>_<j> of the one-row ``name`` (right side: a<i>_<k>) by elimination;
    the solution is a<i>_<k> of ``<name>_<k>``. Columns ``carry`` are passed on."""
    out, before = [], name
    for p in range(k):
        columns = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" for j in range(p, k + 1)]
        columns += [f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(k) if i != p for j in range(p, k + 1)]
        out.append(f"{name}_{p + 1} AS (SELECT {', '.join(columns)}{', ' + carry if carry else ''} FROM {before})")
        before = f"{name}_{p + 1}"
    return ", ".join(out)
