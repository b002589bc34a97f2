"""Table operations, landed sources, gates and streaming jobs over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsports.operators import gates, tables
from pitsports.operators.tables import scratch as _scratch
from pitsports.plans.base import WITH_GAMES, WITH_PITCHES, games, pitches, query, r, table
from pitsports.sources import landed
from pitsports.streaming import jobs

LATEST = "l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC"
ORDER = ("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice")


@query(
    "snk3_merge_latest",
    f"""WITH b AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS src FROM lineitem) SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity FROM b
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src DESC, {LATEST}) = 1""",
)
def merge_latest(spark, sf):
    line = table(spark, sf, "lineitem")
    out = tables.merge_latest(line.where("l_orderkey % 3 <> 0"), line.where("l_orderkey % 3 = 0"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ORDER])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")


@query("snk4_conform", "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS c_acctbal, c_name, CAST(NULL AS VARCHAR) AS note FROM customer")
def conform(spark, sf):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("note", T.StringType())])
    return tables.conform(table(spark, sf, "customer"), schema)


@query(
    "snk6_replace_groups",
    """WITH old AS (SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'by hand ' || c_custkey END AS note FROM customer), new AS (SELECT c_custkey, c_nationkey, 0.0 AS c_acctbal, 'loaded' AS note FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey % 2 = 0)
SELECT c_custkey, c_nationkey, c_acctbal, note FROM old WHERE c_nationkey NOT IN (SELECT c_nationkey FROM new) UNION ALL SELECT n.c_custkey, n.c_nationkey, n.c_acctbal, coalesce(o.note, n.note) FROM new n LEFT JOIN old o ON o.c_custkey = n.c_custkey""",
)
def replace_groups(spark, sf):
    """All rows of two nations replaced by fewer new ones; a note set by hand is carried over from the old row of the same key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("by hand "), F.col("c_custkey").cast("string"))).alias("note"))
    new = c.where("c_nationkey in (1, 2) and c_custkey % 2 = 0").withColumns({"c_acctbal": F.lit(0.0), "note": F.lit("loaded")})
    return tables.replace_groups(c, new, ["c_nationkey"], ["c_custkey"], ["note"])


@query("snk7_insert_missing", "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT DISTINCT l_suppkey + 50 FROM lineitem WHERE l_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_missing(spark, sf):
    return tables.insert_missing(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, sf, "lineitem").select((F.col("l_suppkey") + 50).alias("id")).distinct(), ["id"])


@query("snk8_fill_nulls", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, n_name) AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey")
def fill_nulls(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    t = c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    return tables.fill_nulls(t, n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("seg")), ["c_nationkey"], ["seg"]).select("c_custkey", "seg")


@query("snk9_update_values", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 1.5 ELSE p_retailprice END AS p_retailprice FROM part")
def update_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return tables.update_values(p, p.where("p_partkey % 10 = 0").withColumn("p_retailprice", F.lit(1.5)), ["p_partkey"], ["p_retailprice"])


@query("snk2_compaction", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey")
def compaction(spark, sf):
    """Written as key-sorted files, read back."""
    path = _scratch(spark)
    tables.compact(table(spark, sf, "lineitem"), path, ["l_orderkey", "l_linenumber"], 8)
    return spark.read.parquet(path).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("snk12_snk13_snapshot", "SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS rows, TRUE AS ok UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), TRUE UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), TRUE")
def snapshot(spark, sf):
    path = _scratch(spark)
    tables.snapshot({t: table(spark, sf, t) for t in ("nation", "customer", "orders")}, path)
    return tables.verify_snapshot(spark, path).select("name", "rows", "ok")


@query("snk17_split_targets", f"{WITH_GAMES} SELECT game_id, season, CASE WHEN season <> 2001 THEN home_final END AS target FROM games")
def split_targets(spark, sf):
    return games(spark, sf).select("game_id", "season", F.when(F.col("season") != 2001, F.col("home_final")).alias("target"))


@query("snk18_checked_overwrite", "SELECT 'unique key' AS \"check\", 0.0::DOUBLE AS value, TRUE AS passed UNION ALL SELECT 'c_acctbal varies', (SELECT round(stddev_samp(c_acctbal), 4) FROM customer), TRUE")
def checked_overwrite(spark, sf):
    checks = [lambda d: gates.unique_key(d, ["c_custkey"]), lambda d: gates.non_constant(d, "c_acctbal")]
    out = tables.checked_overwrite(table(spark, sf, "customer"), checks, _scratch(spark))
    return out.withColumn("value", F.round("value", 4))


@query("src4_fact_view", f"{WITH_PITCHES} SELECT game_id, fld_team, bat_team, count(*) AS n FROM pitches GROUP BY ALL")
def fact_view(spark, sf):
    return pitches(spark, sf).groupBy("game_id", "fld_team", "bat_team").agg(F.count("*").alias("n"))


@query("src6_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv(spark, sf):
    path = _scratch(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).option("compression", "gzip").csv(path)
    return landed.scan_csv(spark, path, T.StructType.fromDDL("c_custkey long, c_name string, c_acctbal double, c_mktsegment string"))


@query("src8_json_to_rows", "SELECT o_custkey, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'")
def json_rows(spark, sf):
    """Orders nested as JSON documents of each customer, then parsed and exploded back."""
    docs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("games"))).alias("doc"))
    out = landed.exploded_json(docs, "doc", "games array<struct<id:bigint,status:string>>", "games")
    return out.select("o_custkey", "col.id", "col.status").where("status <> 'P'")


@query("src9_json_map_to_rows", "SELECT DISTINCT l_orderkey, 'ID' || l_partkey AS player FROM lineitem WHERE l_returnflag = 'R'")
def json_map(spark, sf):
    line = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.concat(F.lit("ID"), F.col("l_partkey").cast("string")).alias("player")).distinct()
    docs = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("player", F.lit(1)))).alias("players"))).alias("doc"))
    return landed.exploded_json(docs, "doc", "players map<string,int>", "players").select("l_orderkey", F.col("key").alias("player"))


@query("src16_canonical_rows", "SELECT event_id AS id, user_id AS player, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events WHERE event_type <> 'refund' AND user_id % 50 <> 0")
def canonical(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("user_id", F.when(F.col("user_id") % 50 != 0, F.col("user_id")))
    return landed.natural_rows(e, {"event_id": "id", "user_id": "player", "value": "v"}, ["id", "player"], F.col("event_type") == "refund")


@query("src17_date_chunks", "SELECT CAST(lo AS VARCHAR) AS lo, n FROM (SELECT DATE '2024-01-01' + CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 7 * 7 AS INT) AS lo, count(*) AS n FROM events GROUP BY ALL)")
def chunks(spark, sf):
    w = landed.weeks("2024-01-01", "2024-01-31", spark)
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.join(F.broadcast(w), (F.col("day") >= F.col("lo")) & (F.col("day") <= F.col("hi"))).groupBy(F.col("lo").cast("string").alias("lo")).agg(F.count("*").alias("n"))


GATES = f"""{WITH_GAMES}
SELECT 'unique key' AS "check", CAST(count(*) AS DOUBLE) AS value, count(*) = 0 AS passed FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'season has values', CAST(count(season) AS DOUBLE), count(season) > 0 FROM games
UNION ALL SELECT 'known members', CAST(count(*) AS DOUBLE), count(*) = 0 FROM (SELECT DISTINCT venue_id FROM games WHERE venue_id NOT IN (SELECT n_nationkey FROM nation))
UNION ALL SELECT 'coverage', round(avg(CASE WHEN status IN ('F', 'O') THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN status IN ('F', 'O') THEN 1.0 ELSE 0 END) >= 0.9 FROM games
UNION ALL SELECT 'band', round(avg(CASE WHEN home_final > away_final THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN home_final > away_final THEN 1.0 ELSE 0 END) BETWEEN 0.05 AND 0.6 FROM games
UNION ALL SELECT 'home_final varies', round(stddev_samp(home_final), 6), stddev_samp(home_final) > 0 FROM games
UNION ALL SELECT 'no shrink', CAST(-(SELECT count(*) FROM games WHERE season = 1995) AS DOUBLE), FALSE
UNION ALL SELECT 'required columns', 1.0, FALSE
UNION ALL SELECT 'seasons allowed', CAST(count(*) AS DOUBLE), count(*) = 0 FROM (SELECT DISTINCT season FROM games WHERE season NOT BETWEEN 1995 AND 2001)"""


@query("dq_gates", GATES)
def all_gates(spark, sf):
    g, line = games(spark, sf), table(spark, sf, "lineitem")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("venue_id"))
    seasons = spark.range(1995, 2002).select(F.col("id").cast("int").alias("season"))
    rows = [
        gates.unique_key(line, ["l_orderkey", "l_linenumber"]),
        gates.not_all_null(g, "season"),
        gates.known_members(g, nations, ["venue_id"]),
        gates.share_at_least(g, F.col("status").isin("F", "O"), 0.9, "coverage"),
        gates.band(g, F.col("home_final") > F.col("away_final"), 0.05, 0.6, "band"),
        gates.non_constant(g, "home_final"),
        gates.no_shrink(g, g.where("season <> 1995")),
        gates.columns_present(g, ["game_id", "umpire_id"]),
        gates.known_members(g, seasons, ["season"], "seasons allowed"),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.withColumn("value", r(F.col("value")))


@query(
    "dq8_expected_counts",
    """WITH h AS (SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n FROM orders WHERE o_orderkey % 1000 <> 32 GROUP BY ALL)
SELECT 'before' AS "check", CAST(count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS DOUBLE) AS value, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) = 0 AS passed FROM h a FULL JOIN h b ON a.season = b.season
UNION ALL SELECT 'after', CAST(count(*) FILTER (WHERE h.n IS DISTINCT FROM l.n) AS DOUBLE), count(*) FILTER (WHERE h.n IS DISTINCT FROM l.n) = 0 FROM h FULL JOIN l ON l.season = h.season""",
)
def expected(spark, sf):
    """Rows of each season against the expected counts, before a load and after one that lost some rows."""
    g = games(spark, sf)
    wanted = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(F.count("*").alias("n"))
    return gates.expected_counts(g, ["season"], wanted, "before").unionByName(gates.expected_counts(g.where("game_id % 1000 <> 32"), ["season"], wanted, "after"))


@query(
    "str1_stream_merge_latest",
    f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LATEST}) = 1",
)
def stream_merge(spark, sf):
    """The line items as a file stream in three batches, oldest ship dates first; later batches replace keys of earlier ones. A
    batch is as many files as its writers make; the job is started anew for each."""
    source, path, mark = _scratch(spark), _scratch(spark), _scratch(spark)
    line = table(spark, sf, "lineitem")
    for lo, hi in (("1900-01-01", "1994-01-01"), ("1994-01-01", "1996-01-01"), ("1996-01-01", "2100-01-01")):
        line.where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(line.schema).parquet(source)
        jobs.merge_stream(stream, path, mark, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ORDER]).awaitTermination()
    return jobs.merged_table(spark, path).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("str4_stream_running_totals", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(hits) OVER w AS BIGINT) AS cum_hits FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def stream_totals(spark, sf):
    """Running totals kept in state by user, over three batches: the first lacks every third day, the second brings those
    days late, the third adds events to days that were there; the job is started anew for each batch."""
    source, path, mark = _scratch(spark), _scratch(spark), _scratch(spark)
    e = table(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"), F.lit(1).cast("long").alias("n"), (F.col("event_type") == "purchase").cast("long").alias("hits"), "event_id")
    late, more = F.col("day") % 3 == 0, F.col("event_id") % 5 == 0
    for part in (~late & ~more, late & ~more, more):
        e.where(part).drop("event_id").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.drop("event_id").schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.running_totals_stream(stream, "user_id", "day", ["n", "hits"], path, mark).awaitTermination()
    return jobs.latest_rows(spark, path, ["user_id", "day"]).select("user_id", F.date_from_unix_date("day").cast("string").alias("day"), "cum_n", "cum_hits")
