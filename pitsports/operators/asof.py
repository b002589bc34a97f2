"""Point-in-time joins and running totals.

All of them are strict by default: a row may only use facts dated before its cutoff. Facts and questions meet in one
shuffle on the partition keys; nothing is collected and no side is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(questions: DataFrame, facts: DataFrame, by: Sequence[str], cutoff: str, fact_time: str, strict: bool = True) -> DataFrame:
    """Each question with the latest fact row of its keys before (or, if not strict, at) its cutoff; nulls if there is none.

    Facts must be unique by keys and time (see :func:`latest_per_day`). Both sides are stacked and sorted once; the last
    fact seen is carried forward. A question with a null key or cutoff matches nothing. Fact columns whose names a
    question has as well are dropped.
    """
    carried = [c for c in facts.columns if c not in by and c not in questions.columns]
    fact = F.struct(*[F.col(c) for c in carried])
    asked = F.struct(*[F.col(c) for c in questions.columns])
    right = facts.select(*by, F.col(fact_time).alias("_at"), F.lit(1 if strict else 0).alias("_side"), fact.alias("_fact"))
    left = questions.select(*by, F.col(cutoff).alias("_at"), F.lit(0 if strict else 1).alias("_side"), asked.alias("_asked"))
    both = left.unionByName(right, allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(window)).where("_asked is not null")
    usable = F.col("_at").isNotNull()
    for key in by:
        usable = usable & F.col(key).isNotNull()
    return joined.select("_asked.*", *[F.when(usable, F.col(f"_last.{c}")).alias(c) for c in carried])


def latest_per_day(facts: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key and day: the last by ``order`` (a total order, so ties cannot change the result)."""
    rows = F.struct(*[F.col(c) for c in facts.columns])
    last = facts.groupBy(*keys, day).agg(F.max_by(rows, F.struct(*order)).alias("_row"))
    return last.select("_row.*")


def running_totals(facts: DataFrame, keys: Sequence[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """Totals by key and day, and their running sums (``cum_`` names) up to and including each day."""
    daily = facts.groupBy(*keys, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    window = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("*", *[F.sum(n).over(window).alias(f"cum_{n}") for n in sums])


def trailing_join(questions: DataFrame, facts: DataFrame, by: Sequence[str], cutoff: str, day: str, days: int) -> DataFrame:
    """Inner join of questions and the facts of their keys dated in ``[cutoff - days, cutoff)``.

    Days fall into buckets of ``days`` days; a question looks into the two buckets that its window can touch, so each
    meets its facts in an equi-join and fan-out is bounded by the window.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(days)).cast("int")
    left = questions.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col(cutoff)), bucket(F.date_sub(F.col(cutoff), days))))))
    right = facts.withColumn("_bucket", bucket(F.col(day)))
    joined = left.join(right, [*by, "_bucket"])
    return joined.where((F.col(day) < F.col(cutoff)) & (F.col(day) >= F.date_sub(F.col(cutoff), days))).drop("_bucket")


def sequence_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Number the rows of each key from 1 in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def sequence_in_blocks(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Number the rows of each key from 1 as :func:`sequence_numbers`, where ``order`` runs through the values of ``block`` one
    after another (such as seasons): rows are numbered inside a block, and the sizes of earlier blocks, a row a block, are added."""
    sizes = rows.groupBy(*keys, block).agg(F.count("*").alias("_size"))
    before = sizes.select(*keys, block, (F.sum("_size").over(Window.partitionBy(*keys).orderBy(block)) - F.col("_size")).alias("_before"))
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)))
    return inside.join(before, [*keys, block]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def count_before(questions: DataFrame, facts: DataFrame, keys: Sequence[str], block: str, cutoff: str, day: str, name: str) -> DataFrame:
    """``questions`` with the number of facts of their keys before their cutoff, over all blocks; 0 if there is none.

    ``block`` is a function of the day (such as its year) and names a column of both sides, so that no key's whole history
    is one partition: days of the same block meet in a window, earlier blocks, a row each, in another.
    """
    per_day = facts.groupBy(*keys, block, day).agg(F.count("*").alias("_n"))
    run = per_day.select(*keys, block, F.col(day), F.sum("_n").over(Window.partitionBy(*keys, block).orderBy(day)).alias("_inside"))
    inside = asof_join(questions, run, [*keys, block], cutoff, day)
    sizes = per_day.groupBy(*keys, block).agg(F.sum("_n").alias("_n")).select(*keys, F.col(block).alias("_block"), F.sum("_n").over(Window.partitionBy(*keys).orderBy(block)).alias("_earlier"))
    asked = questions.select(*keys, block).distinct()
    earlier = asof_join(asked, sizes, keys, block, "_block").select(*keys, block, "_earlier")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return inside.join(earlier, [*keys, block], "left").withColumn(name, zero("_inside") + zero("_earlier")).select(*questions.columns, name)


def serve_seasons(facts: DataFrame, season: str, lags: int) -> DataFrame:
    """Each fact once for each later season that it serves: ``target`` season and ``lag`` 1 to ``lags``."""
    return facts.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("target", F.col(season) + F.col("lag"))


def trailing_totals(questions: DataFrame, daily: DataFrame, by: Sequence[str], cutoff: str, day: str, days: int, totals: dict[str, Column | tuple[int, Column]]) -> DataFrame:
    """Each distinct question (``by``, ``cutoff``) with aggregates over the ``daily`` rows of its keys in ``[cutoff - days, cutoff)``.

    Questions and daily rows are stacked and sorted once, and a range window does the rest: nothing fans out. Questions
    without a row in their window are left out, as in an inner join. ``totals`` are aggregates of ``daily``'s columns, over
    the window or, as a pair (days, aggregate), over another number of days.
    """
    asked = questions.select(*by, F.col(cutoff).alias("_at")).distinct().withColumn("_asked", F.lit(True))
    both = asked.unionByName(daily.withColumn("_at", F.col(day)), allowMissingColumns=True)
    window = lambda n: Window.partitionBy(*by).orderBy(F.unix_date("_at")).rangeBetween(-n, -1)
    wanted = {name: c if isinstance(c, tuple) else (days, c) for name, c in totals.items()}
    out = both.select(*by, "_at", "_asked", F.count(day).over(window(days)).alias("_seen"), *[c.over(window(n)).alias(name) for name, (n, c) in wanted.items()])
    return out.where("_asked and _seen > 0").select(*by, F.col("_at").alias(cutoff), *totals)


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], width: int = 32) -> DataFrame:
    """Join of two tables of spells (day numbers ``since`` to ``until``, its end left out) on ``by`` where spells overlap: both
    sides' other columns and the common days as ``since`` and ``until``.

    Spells fall into buckets of ``width`` days and meet in an equi-join; a pair that shares several buckets gives a row for
    each, cut at their borders, so every common day is in exactly one row.
    """
    bucket = lambda d: F.floor(d / width).cast("int")
    cut = lambda rows: rows.where("since < until").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.col("until") - 1))))
    other = cut(right).withColumnsRenamed({"since": "_since", "until": "_until"})
    first = F.greatest("since", "_since", F.col("_bucket") * width)
    end = F.least("until", "_until", (F.col("_bucket") + 1) * width)
    both = cut(left).join(other, [*by, "_bucket"]).where((F.col("since") < F.col("_until")) & (F.col("_since") < F.col("until")))
    return both.withColumns({"since": first, "until": end}).where("since < until").drop("_bucket", "_since", "_until")


def at_cutoffs(questions: DataFrame, daily: DataFrame, by: Sequence[str], cutoff: str, day: str) -> DataFrame:
    """``questions`` with the latest row of the small table ``daily`` before their cutoff.

    For tables with few keys, such as a league's days: only the distinct cutoffs meet them in an as-of join, and the
    questions join its result, a row a key and day, by key and cutoff, so no key's questions are one partition and none are shuffled.
    """
    found = asof_join(questions.select(*by, cutoff).distinct(), daily, by, cutoff, day)
    return questions.join(F.broadcast(found), [*by, cutoff], "left")


def price_in_effect(questions: DataFrame, ticks: DataFrame, by: Sequence[str], at: str, close: str, ts: str, max_days: int) -> DataFrame:
    """Each question with the tick in effect at its time ``at``: the last one at or before it, but none after ``close``.

    Adds the tick's columns, ``clipped`` (the last tick at ``at`` came after the close, so the one in effect at the close
    holds) and ``stale`` (it is more than ``max_days`` days older than ``at``; its columns are null then). ``ticks`` are
    unique by ``by`` and ``ts``.
    """
    values = [c for c in ticks.columns if c not in by]
    facts = ticks.select(*by, F.col(ts).alias("_ts"), F.struct(*values).alias("_now"))
    now = asof_join(questions, facts, by, at, "_ts", strict=False)
    both = asof_join(now, facts.withColumnRenamed("_now", "_closing"), by, close, "_ts", strict=False)
    clipped = F.coalesce(F.col(f"_now.{ts}") > F.col(close), F.lit(False))
    used = F.when(clipped, F.col("_closing")).otherwise(F.col("_now"))
    out = both.withColumn("_used", used).withColumn("clipped", clipped)
    out = out.withColumn("stale", F.coalesce(F.col(at) - F.expr(f"interval {max_days} days") > F.col(f"_used.{ts}"), F.lit(False)))
    return out.select(*questions.columns, *[F.when(~F.col("stale"), F.col(f"_used.{c}")).alias(c) for c in values], "clipped", "stale")
