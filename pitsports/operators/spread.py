"""Scores of both sides of a game as distributions, with their spread pulled in by two factors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shrunk(games: DataFrame, factors: Sequence[tuple[float, float]]) -> DataFrame:
    """Expected scores by segment of every game and pair of ``factors`` (tau_total, tau_margin): ``home_mu``, ``away_mu``.

    ``games`` holds game_id, day, the log base rates of the segments (array ``base``) and the team parts ``th`` and ``ta`` of
    their logarithms. The mean of both parts is pulled to the day's mean by tau_total, half their difference to its overall
    mean by tau_margin. Each side's expected scores are then scaled so that the day's sum in each segment stays what it was.
    The pairs are a column, so a search over them is one job; days meet in one aggregation.
    """
    mean, half = (F.col("th") + F.col("ta")) / 2, (F.col("th") - F.col("ta")) / 2
    days = games.groupBy("day").agg(F.avg(mean).alias("_mbar"))
    whole = games.agg(F.avg(half).alias("_dbar"))
    centre = days.crossJoin(F.broadcast(whole))  # a row a day
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("tau_total"), F.lit(float(m)).alias("tau_margin")) for t, m in factors])
    total = F.col("_mbar") + F.col("_f.tau_total") * (mean - F.col("_mbar"))
    margin = F.col("_dbar") + F.col("_f.tau_margin") * (half - F.col("_dbar"))
    long = games.select("day", "th", "ta", F.posexplode("base").alias("_i", "_b")).join(centre, "day").withColumn("_f", F.explode(pairs))
    kept = lambda team, now: (F.sum(F.exp(F.col("_b") + F.col(team))) / F.sum(F.exp(F.col("_b") + now)))
    scale = long.groupBy("day", "_f", "_i").agg(kept("th", total + margin).alias("sh"), kept("ta", total - margin).alias("sa"))
    scale = scale.groupBy("day", "_f").agg(F.sort_array(F.collect_list(F.struct("_i", "sh", "sa"))).alias("_s"))  # a segment each
    scale = centre.join(scale.groupBy("day").agg(F.collect_list(F.struct("_f", "_s")).alias("_p")), "day")  # a pair each
    x = games.join(scale, "day").withColumn("_one", F.explode("_p")).select(*games.columns, "_mbar", "_dbar", "_one.*")
    mu = lambda part, s: F.transform(F.arrays_zip(F.col("base").alias("b"), F.col("_s").alias("s")), lambda z: F.exp(z["b"] + part) * z["s"][s])
    x = x.withColumns({"_h": total + margin, "_a": total - margin})
    return x.select(*games.columns, "_f.tau_total", "_f.tau_margin", mu(F.col("_h"), "sh").alias("home_mu"), mu(F.col("_a"), "sa").alias("away_mu"))


def probability(mu: Column, size: Column, y: Column) -> Column:
    """Probability that negative binomial segments of means ``mu`` (an array of two) and ``size`` add up to ``y``.

    With ``q = mu / (size + mu)`` and the coefficients ``c`` of the negative binomial, it is the sum over i of
    ``c[i] c[y-i] q1^i q2^(y-i)``, by Horner's rule, times both chances of 0: as many steps as the largest y of a batch has.
    """

    @F.pandas_udf("double")
    def added(a: pd.Series, b: pd.Series, r: pd.Series, y: pd.Series) -> pd.Series:
        a, b, r, k = (x.to_numpy(float) for x in (a, b, r, y))
        known = k >= 0  # not null
        k = np.where(known, np.floor(k), 0.0)
        p, q = a / (r + a), b / (r + b)
        top = int(k.max(initial=0.0))
        t = np.ones(len(k))
        with np.errstate(divide="ignore", invalid="ignore"):  # only in places that are not used
            for i in range(1, top + 1):
                t = np.where(i <= k, t * (i - 1 + r) / i, t)
            s = t
            for i in range(1, top + 1):
                t = t * p * (i - 1 + r) / i * (k - i + 1) / (k - i + r)
                s = np.where(i <= k, s * q + t, s)
        return pd.Series(np.where(known, s * (r / (r + a)) ** r * (r / (r + b)) ** r, np.nan))

    return added(F.get(mu, F.lit(0)), F.get(mu, F.lit(1)), size.cast("double"), y.cast("double"))
