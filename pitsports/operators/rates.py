"""Decayed and shrunk rates, ratio factors, smoothed lookups and centred residuals, as columns and DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsports.operators import asof, tables

#: Weights of the three seasons before, latest first (fixed values).
SEASON_WEIGHTS = (0.8, 0.6, 0.4)


def shrunk_rate(count: Column, n: Column, k: float, mu: Column, prior: Sequence[tuple[float, Column, Column]] = ()) -> Column:
    """``(count + sum(w * count_s) + k * mu) / (n + sum(w * n_s) + k)``; missing parts count as 0, no history gives mu."""
    zero = F.lit(0.0)
    top = F.coalesce(count, zero) + k * mu
    bottom = F.coalesce(n, zero) + k
    for weight, c, m in prior:
        top = top + weight * F.coalesce(c, zero)
        bottom = bottom + weight * F.coalesce(m, zero)
    return top / bottom


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of non-null values by weight, null if there is no weight."""
    used = F.when(value.isNotNull(), weight)
    return F.sum(value * used) / F.nullif(F.sum(used), F.lit(0.0))


def ratio_factor(home: Column, road: Column, games: Column, k: float, least: int) -> Column:
    """Home to road ratio, shrunk to 1 by ``k`` games; null below ``least`` games."""
    raw = home / F.nullif(road, F.lit(0.0))
    return F.when(games >= least, 1 + (raw - 1) * games / (games + k))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothed_lookup(rows: DataFrame, value: str, fine: Sequence[str], coarse: Sequence[str], k_fine: float, k_coarse: float) -> DataFrame:
    """Mean of ``value`` for each fine cell, shrunk to its coarse cell's mean, which is shrunk to the mean of all."""
    whole = rows.agg(F.avg(value).alias("_all"))
    wide = rows.groupBy(*coarse).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")).crossJoin(F.broadcast(whole))
    wide = wide.select(*coarse, ((F.col("_s") + k_coarse * F.col("_all")) / (F.col("_n") + k_coarse)).alias("_coarse"))
    cells = rows.groupBy(*dict.fromkeys([*fine, *coarse])).agg(F.sum(value).alias("_s"), F.count(value).alias("n"))
    out = cells.join(wide, list(coarse))
    return out.select(*cells.columns[: len(dict.fromkeys([*fine, *coarse]))], "n", ((F.col("_s") + k_fine * F.col("_coarse")) / (F.col("n") + k_fine)).alias("expected"))


def blurred_grid(cells: DataFrame, keys: Sequence[str], x: str, z: str, measures: Sequence[str], sigma: float, radius: int) -> DataFrame:
    """Gaussian blur of measures on an integer grid: separable, each pass a join to the kernel's offsets and a sum."""
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    kernel = [(d, w / sum(weights)) for d, w in zip(range(-radius, radius + 1), weights, strict=True)]
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel])
    out = cells
    for axis in (x, z):
        spread = out.withColumn("_o", F.explode(offsets))
        spread = spread.select(
            *keys, *[(F.col(c) + F.col("_o.d")).alias(c) if c == axis else F.col(c) for c in (x, z)], *[(F.col(m) * F.col("_o.w")).alias(m) for m in measures]
        )
        out = spread.groupBy(*keys, x, z).agg(*[F.sum(m).alias(m) for m in measures])
    return out


def centred(rows: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """``value`` less its group's mean."""
    means = rows.groupBy(*group).agg(F.avg(value).alias("_mean"))
    return rows.join(means, list(group)).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def centred_parts(facts: DataFrame, who: str, weights: Sequence[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`centred_rate` reads, from ``facts``: sums by day (settled once), the league's rate up to each day of a season
    (season, day, ``league``), and the last seasons' weighted sums (``who``, season, pri_rc, pri_n)."""
    facts = tables.settled(facts.groupBy(who, "season", "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    by_day = facts.groupBy("season", "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))  # a row a day from here
    league_run = asof.running_totals(by_day, ["season"], "day", {"s": F.col("s"), "n": F.col("n")})
    league_run = league_run.select("season", "day", (F.col("cum_s") / F.col("cum_n")).alias("league"))
    whole = by_day.groupBy("season").agg((F.sum("s") / F.sum("n")).alias("mean"))
    seasons = facts.groupBy(who, "season").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(whole, "season")
    seasons = seasons.select(who, "season", (F.col("s") - F.col("n") * F.col("mean")).alias("rc"), "n")
    served = asof.serve_seasons(seasons, "season", len(weights)).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("lag")))
    prior = served.groupBy(who, F.col("target").alias("season")).agg(F.sum(F.col("w") * F.col("rc")).alias("pri_rc"), F.sum(F.col("w") * F.col("n")).alias("pri_n"))
    return facts, league_run, prior


def centred_rate(questions: DataFrame, facts: DataFrame, who: str, k: float, weights: Sequence[float], parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Shrunk, centred rate of each question (``who``, ``season``, ``cutoff``): value, cur_n, pri_n.

    ``facts`` (``who``, ``season``, ``day``, ``s``, ``n``) are sums by the day on which they became known; ``season`` is that
    day's, so that a fact that came late is no part of an earlier season. This season counts up to the day before the
    cutoff, less the league's rate up to then; the last seasons count in full, each less its own league rate, by ``weights``
    (last season first). The sum is divided by the weighted number of facts plus ``k``. The sums by day are settled once and
    all else is derived from them; league totals are met by (season, cutoff), so no season is one partition. ``parts`` of the
    same facts may be given.
    """
    facts, league_run, prior = parts or centred_parts(facts, who, weights)
    asked = questions.select(who, "season", "cutoff").distinct()
    run = asof.running_totals(facts, [who, "season"], "day", {"s": F.col("s"), "n": F.col("n")}).select(who, "season", "day", "cum_s", "cum_n")
    own = asof.asof_join(asked, run, [who, "season"], "cutoff", "day")
    out = asof.at_cutoffs(own.drop("day"), league_run, ["season"], "cutoff", "day").join(prior, [who, "season"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    value = (zero("cum_s") - zero("cum_n") * zero("league") + zero("pri_rc")) / (zero("cum_n") + zero("pri_n") + k)
    return out.select(who, "season", "cutoff", value.alias("value"), zero("cum_n").alias("cur_n"), zero("pri_n").alias("pri_n"))


def histories(questions: DataFrame, facts: DataFrame, sums: Sequence[str], lags: int = len(SEASON_WEIGHTS)) -> DataFrame:
    """Each question (who, season, cutoff and any other columns), repeated ones too, with the sums of its own facts: ``cum_<sum>``
    of its season before the cutoff and ``last<l>_<sum>`` of the ``l``-th season before; null where there are none.

    ``facts`` (who, season, day and ``sums``) may have many rows a day. Both meet in one shuffle by who, which all windows share; a
    question with a null key or cutoff has no facts.
    """
    asked = questions.select("who", "season", F.col("cutoff").alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in questions.columns]).alias("_asked"))
    known = facts.select("who", "season", F.col("day").alias("_at"), F.lit(1).alias("_side"), *sums)
    both = asked.unionByName(known, allowMissingColumns=True).repartition("who")
    now = Window.partitionBy("who", "season").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = both.select("who", "season", "_at", "_asked", *sums, *[F.sum(c).over(now).alias(f"cum_{c}") for c in sums])
    x = x.select("_asked", "who", "season", "_at", *[f"cum_{c}" for c in sums], *_last_seasons(sums, lags)).where("_asked is not null")
    usable = F.col("who").isNotNull() & F.col("season").isNotNull() & F.col("_at").isNotNull()
    names = [f"cum_{c}" for c in sums] + [f"last{i}_{c}" for c in sums for i in range(1, lags + 1)]
    return x.select("_asked.*", *[F.when(usable, F.col(c)).alias(c) for c in names])


def _last_seasons(sums: Sequence[str], lags: int) -> list[Column]:
    """``last<l>_<sum>``: sums of who's rows of the ``l``-th season before."""
    back = lambda i: Window.partitionBy("who").orderBy("season").rangeBetween(-i, -i)
    return [F.sum(c).over(back(i)).alias(f"last{i}_{c}") for c in sums for i in range(1, lags + 1)]


def _spells(facts: DataFrame, asked: DataFrame, lags: int) -> DataFrame:
    """Running sums ``cum_s`` and ``cum_n`` of each who and season as spells of cutoffs that see the same facts, with the sums of
    the last seasons (``last<l>_s``, ``last<l>_n``): who, season, since, until (day numbers, the end left out).

    ``facts`` holds who, season (that of the day), day, s and n; the seasons ``asked`` (who, season) are covered from their first day on.
    """
    start = asked.select("who", "season", F.make_date(F.col("season") - 1, F.lit(12), F.lit(31)).alias("day"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    both = start.distinct().unionByName(facts.select("who", "season", "day", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))).repartition("who")
    own = Window.partitionBy("who", "season").orderBy("day")
    end = F.unix_date(F.make_date(F.col("season") + 1, F.lit(1), F.lit(1)))
    known = F.unix_date("day") + 1
    out = both.select("who", "season", "s", "n", known.alias("since"), F.coalesce(F.lead(known).over(own), end).alias("until"), *[F.sum(c).over(own).alias(f"cum_{c}") for c in ("s", "n")])
    return out.select("who", "season", "since", "until", "cum_s", "cum_n", *_last_seasons(["s", "n"], lags)).where("since < until")  # of facts of one day the last


def _served(c: str, weights: Sequence[float]) -> Column:
    """The sums ``last<l>_<c>`` by weight, null where there are none."""
    some = F.coalesce(*[F.col(f"last{i}_{c}") for i in range(1, len(weights) + 1)]).isNotNull()
    return F.when(some, sum((float(w) * F.coalesce(F.col(f"last{i}_{c}"), F.lit(0)) for i, w in enumerate(weights, 1)), F.lit(0.0)))


def _less_league(weights: Sequence[float]) -> Column:
    """Of a row with :func:`histories`' or spells' columns and ``means`` (season to the league's rate): the last seasons' sums by
    weight, each less its own league's rate."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sum((float(w) * (zero(f"last{i}_s") - zero(f"last{i}_n") * F.coalesce(F.col("means")[F.col("season") - i], F.lit(0.0))) for i, w in enumerate(weights, 1)), F.lit(0.0))


def league_days(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``facts`` (season, day, s, n): the league's rate up to each day of a season (season, day, ``league``), and one row with
    each season's rate as the map ``means``. Both are small: a row a day, an entry a season."""
    by_day = tables.settled(facts.groupBy("season", "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    run = asof.running_totals(by_day, ["season"], "day", {"s": F.col("s"), "n": F.col("n")})
    means = by_day.where("season is not null").groupBy("season").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return run.select("season", "day", (F.col("cum_s") / F.col("cum_n")).alias("league")), means.agg(F.map_from_entries(F.collect_list(F.struct("season", "mean"))).alias("means"))


def centred_histories(questions: DataFrame, facts: DataFrame, league: tuple[DataFrame, DataFrame], k: float, weights: Sequence[float] = SEASON_WEIGHTS) -> DataFrame:
    """``questions`` (who, season, cutoff and other columns), repeated ones too, with the ``value`` of :func:`centred_rate`; ``league``
    is :func:`league_days` of the facts, which may have many rows a day."""
    x = histories(questions, facts, ["s", "n"], len(weights)).crossJoin(F.broadcast(league[1]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    x = x.select(*questions.columns, "cum_s", "cum_n", _less_league(weights).alias("pri_rc"), F.coalesce(_served("n", weights), F.lit(0.0)).alias("pri_n"))
    days = asof.asof_join(questions.select("season", "cutoff").distinct(), league[0], ["season"], "cutoff", "day").select("season", "cutoff", "league")
    x = x.join(F.broadcast(days), ["season", "cutoff"], "left")  # a row a day
    value = (zero("cum_s") - zero("cum_n") * zero("league") + F.col("pri_rc")) / (zero("cum_n") + F.col("pri_n") + k)
    return x.select(*questions.columns, value.alias("value"))


def centred_spells(asked: DataFrame, facts: DataFrame, league: tuple[DataFrame, DataFrame], k: float, weights: Sequence[float] = SEASON_WEIGHTS) -> DataFrame:
    """:func:`centred_rate` of every day of the seasons ``asked`` (who, season): who, since, until, ``fixed`` and ``slope``; the
    value at a cutoff is ``fixed`` less ``slope`` times the league's rate then. ``league`` is :func:`league_days` of the facts."""
    x = _spells(facts, asked, len(weights)).crossJoin(F.broadcast(league[1]))
    all_n = F.col("cum_n") + F.coalesce(_served("n", weights), F.lit(0.0)) + k
    return x.select("who", "since", "until", ((F.col("cum_s") + _less_league(weights)) / all_n).alias("fixed"), (F.col("cum_n") / all_n).alias("slope"))


def _league_before(facts: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The league's rates of the season before (season, mu_<sum>): a row a season."""
    return facts.groupBy((F.col("season") + 1).alias("season")).agg(*[(F.sum(c) / F.sum("n")).alias(f"mu_{c}") for c in sums])


def decayed_rates(questions: DataFrame, facts: DataFrame, rates: dict[str, tuple[float, float]], weights: Sequence[float] = SEASON_WEIGHTS) -> DataFrame:
    """``questions`` (who, season, cutoff and other columns), repeated ones too, with a rate by ``n`` for each sum of ``facts`` that
    ``rates`` names with its k and default, as in :func:`decayed_rate`, and ``rookie``. ``facts`` may have many rows a day; they are
    read twice (for the league's rates, and with the questions)."""
    lags = len(weights)
    x = histories(questions, facts, [*rates, "n"], lags).join(F.broadcast(_league_before(facts, list(rates))), "season", "left")
    own = lambda c, k, default: shrunk_rate(F.col(f"cum_{c}"), F.col("cum_n"), k, F.coalesce(f"mu_{c}", F.lit(default)), [(1.0, _served(c, weights), _served("n", weights))])
    rookie = F.col("cum_n").isNull() & _served("n", weights).isNull()
    return x.select(*questions.columns, rookie.alias("rookie"), *[own(c, k, default).alias(c) for c, (k, default) in rates.items()])


def decayed_rate(questions: DataFrame, facts: DataFrame, k: float, default: float, weights: Sequence[float] = SEASON_WEIGHTS) -> DataFrame:
    """Rate ``s`` by ``n`` of each question (``who``, ``season``, ``cutoff``): value, and rookie (nothing known before).

    ``facts`` (``who``, ``season``, ``day``, ``s``, ``n``) are dated by the day on which they became known, ``season`` is that
    day's. This season's facts before the cutoff and the last seasons' by ``weights`` are shrunk by ``k`` towards last
    season's league rate, or ``default`` where there is none.
    """
    asked = questions.select("who", "season", "cutoff").distinct()
    out = decayed_rates(asked, tables.settled(facts.select("who", "season", "day", "s", "n")), {"s": (k, default)}, weights)
    return out.select("who", "season", "cutoff", "rookie", F.col("s").alias("value"))


def decayed_spells(asked: DataFrame, facts: DataFrame, k: float, default: float, weights: Sequence[float] = SEASON_WEIGHTS) -> DataFrame:
    """:func:`decayed_rate` of every day of the seasons ``asked`` (who, season), as spells: who, since, until, value. ``facts`` may have
    many rows a day; they are read twice."""
    x = _spells(facts, asked, len(weights)).join(F.broadcast(_league_before(facts, ["s"])), "season", "left")  # a row a season
    value = shrunk_rate(F.col("cum_s"), F.col("cum_n"), k, F.coalesce("mu_s", F.lit(default)), [(1.0, _served("s", weights), _served("n", weights))])
    return x.select("who", "since", "until", value.alias("value"))


def two_scale_grid(cells: DataFrame, keys: Sequence[str], x: str, z: str, s: str, n: str, shape: tuple[int, int], fine: float = 1.0, wide: float = 6.0, pull_fine: float = 2.0, pull_wide: float = 0.01) -> DataFrame:
    """Expected rate ``s`` by ``n`` for every cell of a grid of ``shape``, for each of ``keys``: (keys, x, z, ``p``).

    Counts are blurred twice, to a wide and to a fine scale (in cells; mass beyond the edges is lost). The wide rate is
    pulled to the group's rate by ``pull_wide`` pseudo-counts, the fine one to the wide one by ``pull_fine``. The grid's size
    does not depend on the number of facts.
    """
    means = cells.groupBy(*keys).agg((F.sum(s) / F.sum(n)).alias("_m"))
    full = means.withColumn(x, F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1)))).withColumn(z, F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))))
    at = [*keys, x, z]
    for sigma, name in ((wide, "_w"), (fine, "_f")):
        blurred = blurred_grid(cells.select(*at, s, n), keys, x, z, [s, n], sigma, math.ceil(4 * sigma))
        full = full.join(blurred.select(*at, F.col(s).alias(f"{name}s"), F.col(n).alias(f"{name}n")), at, "left")
    rate = lambda name, pull, to: (F.coalesce(f"{name}s", F.lit(0.0)) + pull * to) / (F.coalesce(f"{name}n", F.lit(0.0)) + pull)
    return full.select(*at, rate("_f", pull_fine, rate("_w", pull_wide, F.col("_m"))).alias("p"))


def shape_table(rows: DataFrame, value: str, fine: Sequence[str], coarse: Sequence[str], top: int, least: int) -> DataFrame:
    """How ``value`` (counts above 0, held to ``top``) is distributed in each state: (fine, k, p, n, level) for k in 1..top.

    A state with fewer than ``least`` rows takes the distribution of its coarser state, and that, if it has too few as well,
    the one of all rows: ``level`` is fine, coarse or all, and ``n`` its rows. Each state's p add up to 1.
    """
    counted = rows.where(F.col(value) > 0).withColumn("k", F.least(F.col(value), F.lit(top)).cast("int"))
    states = rows.select(*fine, *[c for c in coarse if c not in fine]).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top))))
    out = states
    for level, by in (("fine", fine), ("coarse", coarse), ("all", [])):
        cells = counted.groupBy(*by, "k").agg(F.count("*").alias(f"_{level}"))
        whole = counted.groupBy(*by).agg(F.count("*").alias(f"_n_{level}"))
        out = out.join(F.broadcast(cells), [*by, "k"], "left")  # a row a state and count
        out = out.join(F.broadcast(whole), list(by), "left") if by else out.crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pick = lambda of: F.when(zero("_n_fine") >= least, of("fine")).when(zero("_n_coarse") >= least, of("coarse")).otherwise(of("all"))
    p = pick(lambda level: zero(f"_{level}") / F.col(f"_n_{level}"))
    return out.select(*states.columns, p.alias("p"), pick(lambda level: F.col(f"_n_{level}")).alias("n"), pick(lambda level: F.lit(level)).alias("level"))
