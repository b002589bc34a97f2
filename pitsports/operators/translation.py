"""Rates between levels of play: relative rates, weighted and shrunk histories, and a weighted fit of one level on another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative_rates(lines: DataFrame, stats: dict[str, str], n: str = "n") -> DataFrame:
    """Each line's rates less those of its whole season and level: player, season, level, stat, n, x.

    ``lines`` holds player, season, level, the chances ``n`` and a sum for each of ``stats`` (name: column).
    """
    long = lines.select("player", "season", "level", n, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(c).cast("double").alias("sum")) for s, c in stats.items()])).alias("v")).select("player", "season", "level", F.col(n).alias("n"), "v.*")
    league = long.groupBy("season", "level", "stat").agg((F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))).alias("_l"))
    out = long.where("n > 0").join(league, ["season", "level", "stat"])
    return out.select("player", "season", "level", "stat", "n", (F.col("sum") / F.col("n") - F.col("_l")).alias("x"))


def histories(relative: DataFrame, targets: DataFrame, levels: Sequence[int], k: dict[str, float], weights: Sequence[float] = (0.8, 0.64, 0.48), skipped: Sequence[int] = (), reach: int = 5) -> DataFrame:
    """Weighted, shrunk relative rates before a season: player, target, stat, level, n, xs.

    A season serves the later ones for which it is among the last ``len(weights)`` seasons that are not ``skipped``, at most
    ``reach`` before. ``targets`` holds player and target season; ``k`` is the shrinkage of each stat.
    """
    between = F.filter(F.sequence(F.col("season"), F.col("target") - 1), lambda s: ~s.isin(list(skipped)) if skipped else F.lit(True))
    served = relative.where(F.col("level").isin(list(levels)) & (~F.col("season").isin(list(skipped)) if skipped else F.lit(True)))
    served = served.withColumn("target", F.explode(F.sequence(F.col("season") + 1, F.col("season") + reach)))
    served = served.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.size(between) - 1)).where("w is not null")
    n, x = F.sum(F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("n") * F.col("x"))
    out = served.join(targets.select("player", "target").distinct(), ["player", "target"]).groupBy("player", "target", "stat", "level").agg(n.alias("n"), (x / n).alias("x"))
    shrink = F.element_at(F.create_map(*[v for s, value in k.items() for v in (F.lit(s), F.lit(float(value)))]), F.col("stat"))
    return out.select("player", "target", "stat", "level", "n", (F.col("x") * F.col("n") / (F.col("n") + shrink)).alias("xs"))


def fitted(xs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Constants of each stat and level: b (slope of the outcome on the history, weighted by chances, with an intercept), c (the
    weighted mean of b times the history, so that applying both moves no average) and the number of players.

    ``outcomes`` holds player, target, stat, w (chances) and y. One aggregation; nothing reaches the driver.
    """
    rows = xs.join(outcomes, ["player", "target", "stat"])
    w, x, y = F.col("w"), F.col("xs"), F.col("y")
    m = rows.groupBy("stat", "level").agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count("*").alias("players"))
    b = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return m.select("stat", "level", b.alias("b"), (b * F.col("sx") / F.col("sw")).alias("c"), "players")


def adjustments(xs: DataFrame, constants: DataFrame) -> DataFrame:
    """player, target, stat, adj and n: what a history changes about a player's expected rate, over the levels by chances."""
    rows = xs.join(F.broadcast(constants), ["stat", "level"])  # a row a stat and level
    return rows.groupBy("player", "target", "stat").agg((F.sum(F.col("n") * (F.col("b") * F.col("xs") - F.col("c"))) / F.sum("n")).alias("adj"), F.sum("n").alias("n"))
