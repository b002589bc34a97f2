"""Inference and scoring: block bootstrap, reliability, calibration and ranked scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of the range of probabilities that are ranked apart.
CELLS = 1000


#: A prime and three multipliers of the minimal-standard generators (fixed values).
PRIME, STEPS = 2147483647, (48271, 69621, 16807)


def drawn(seed: int, draw: Column, i: Column) -> Column:
    """A long in [0, PRIME) for each (seed, draw, i), by modular products, so that any SQL engine draws the same."""
    a, b, c = STEPS
    x = (draw.cast("long") * a + i.cast("long") * b + (seed + 1) * c) % PRIME
    for step in STEPS:
        x = (x * step + draw.cast("long") * 7919 + i.cast("long") * 104729) % PRIME
    return x


def block_bootstrap(rows: DataFrame, value: str, weight: str, block: str, draws: int, seed: int = 7) -> DataFrame:
    """Weighted means of ``draws`` resamples of whole blocks: (draw, mean).

    Rows are first summed by block. Block i of a resample is drawn by :func:`drawn` from (seed, draw, i), so the result
    does not depend on partitions. Only block sums meet the draws.
    """
    sums = rows.groupBy(block).agg(F.sum(F.col(weight) * F.col(value)).alias("x"), F.sum(weight).alias("w"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)  # a row a block, not a row a fact
    n = sums.agg(F.count("*").alias("n"))
    places = numbered.select("i").crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = places.withColumn("pick", (drawn(seed, F.col("draw"), F.col("i")) % F.col("n")).cast("int"))
    picked = picks.join(numbered.select(F.col("i").alias("pick"), "x", "w"), "pick")
    return picked.groupBy("draw").agg((F.sum("x") / F.sum("w")).alias("mean"))


def joint_bootstrap(rows: DataFrame, value: str, weight: str, block: str, groups: list[str], draws: int, seed: int = 7) -> DataFrame:
    """Weighted means by group of ``draws`` resamples of whole blocks that all groups share: (groups, draw, mean).

    How often a block is in a resample is drawn once, by :func:`drawn`, as a table (draw, block, times); the sums of every
    group and block meet it in one join, so groups are paired and need no job each. A group without weight in a resample
    has a null mean. Only block sums meet the draws.
    """
    sums = rows.groupBy(*groups, block).agg(F.sum(F.col(weight) * F.col(value)).alias("_x"), F.sum(weight).alias("_w"))
    blocks = rows.select(block).distinct()
    numbered = blocks.withColumn("_i", F.row_number().over(Window.orderBy(block)) - 1)  # a row a block, not a row a fact
    n = blocks.agg(F.count("*").alias("_n"))
    places = numbered.select("_i").crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = places.select("draw", (drawn(seed, F.col("draw"), F.col("_i")) % F.col("_n")).cast("int").alias("_i"))
    times = picks.groupBy("draw", "_i").agg(F.count("*").alias("_k")).join(numbered, "_i").select("draw", block, "_k")
    out = sums.join(times, block).groupBy(*groups, "draw")
    return out.agg((F.sum(F.col("_k") * F.col("_x")) / F.nullif(F.sum(F.col("_k") * F.col("_w")), F.lit(0.0))).alias("mean"))


def interval(draws: DataFrame, level: float = 0.9, groups: list[str] | None = None) -> DataFrame:
    """One row (for each of ``groups``): lo, hi, share of draws above 0, and their standard deviation."""
    tail = (1 - level) / 2
    return draws.groupBy(*(groups or [])).agg(
        F.percentile("mean", F.lit(tail)).alias("lo"), F.percentile("mean", F.lit(1 - tail)).alias("hi"), F.avg((F.col("mean") > 0).cast("double")).alias("above"), F.stddev_samp("mean").alias("se")
    )


def reliability(rows: DataFrame, p: str, y: str, order: list[str], bins: int = 10) -> DataFrame:
    """Equal-count bins by predicted probability: bin, n, mean_p, mean_y.

    Each bin's share is fixed by rank. Rows fall into ``CELLS`` cells of the range of ``p`` (nulls have none); the rows in
    lower cells are a sum over cells, and only the rows of a cell are ranked together.
    """
    ends = rows.agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count(p).alias("_n"))
    step = (F.col("_hi") - F.col("_lo")) / CELLS
    cell = F.when(step > 0, F.least(F.floor((F.col(p) - F.col("_lo")) / step), F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("long")
    placed = rows.where(F.col(p).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("_cell", cell)
    sizes = placed.groupBy("_cell").agg(F.count("*").alias("_in"))
    before = sizes.select("_cell", (F.sum("_in").over(Window.orderBy("_cell")) - F.col("_in")).alias("_before"))  # CELLS rows at most
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(p, *order)) - 1
    ranked = placed.join(F.broadcast(before), "_cell").withColumn("_i", F.col("_before") + inside)
    binned = ranked.withColumn("bin", F.floor(F.col("_i") * bins / F.col("_n")).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def ranked_probability_score(pmf: Column, y: Column) -> Column:
    """Sum over k of (F(k) - [y <= k]) ** 2 for an array of probabilities."""
    start = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))

    def step(acc, p):
        f = acc["f"] + p
        hit = F.when(y <= acc["k"], 1.0).otherwise(0.0)
        return F.struct(f.alias("f"), (acc["s"] + (f - hit) * (f - hit)).alias("s"), (acc["k"] + 1).alias("k"))

    return F.aggregate(pmf, start, step, lambda acc: acc["s"])


def log_score(pmf: Column, y: Column, least: float = 1e-12) -> Column:
    return -F.log(F.greatest(F.coalesce(F.get(pmf, y), F.lit(0.0)), F.lit(least)))
