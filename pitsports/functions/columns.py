"""Scalar functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def starting_slot(code: Column) -> Column:
    """Batting-order code to the starting slot: '300' gives 3; substitutes ('301') and anything else give null."""
    n = F.expr("try_cast({} as int)".format("code")) if isinstance(code, str) else code.try_cast("int")
    return F.when((n % 100 == 0) & n.between(100, 900), (n / 100).cast("int"))


def parsed_rate(text: Column) -> Column:
    """Text to double; '-.--', nan and infinities give null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def local_date(instant: Column, zone: str = "America/Chicago") -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100.0).when(american < 0, 1 + 100.0 / F.abs(american))


def implied(american: Column) -> Column:
    return 1 / decimal_odds(american)


def devig_multiplicative(a: Column, b: Column) -> Column:
    """Fair probability of the first of two sides from implied probabilities."""
    return a / (a + b)


def devig_additive(a: Column, b: Column) -> Column:
    """Fair probability with the margin shared equally (Shin's method for two sides)."""
    return a - (a + b - 1) / 2


def devig_power(a: Column, b: Column, steps: int = 60) -> Column:
    """Fair probability ``a ** k`` with ``a ** k + b ** k = 1``, by bisection on k in [0.2, 5]."""
    start = F.struct(F.lit(0.2).alias("lo"), F.lit(5.0).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        high = F.pow(a, mid) + F.pow(b, mid) > 1
        return F.struct(F.when(high, mid).otherwise(acc["lo"]).alias("lo"), F.when(high, acc["hi"]).otherwise(mid).alias("hi"))

    k = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.pow(a, k)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(y: Column, p: Column, least: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def wind_out(speed: Column, direction: Column, bearing: Column, cap: float = 25.0) -> Column:
    """Wind component from home plate outwards; positive blows out."""
    toward = F.pmod(direction + 180, F.lit(360.0))
    return F.least(F.greatest(speed * F.cos(F.radians(toward - bearing)), F.lit(-cap)), F.lit(cap))


def wind_class(speed: Column, direction: Column, bearing: Column) -> Column:
    """'neutral' below 5, else 'out', 'in' or 'cross' by the folded angle between wind and centre field."""
    d = F.pmod(direction + 180 - bearing, F.lit(360.0))
    folded = F.least(d, 360 - d)
    return F.when(speed < 5, "neutral").when(folded <= 45, "out").when(folded >= 135, "in").otherwise("cross")


def barrel(velo: Column, angle: Column) -> Column:
    """Barrel zone: from 98 on, a window of angles that widens with speed."""
    extra = F.least(velo, F.lit(116.0)) - 98
    return (velo >= 98) & angle.between(26 - extra, 30 + extra)


def in_zone(x: Column, z: Column, low: Column, high: Column, half_width: float) -> Column:
    """Three-valued: null if any input is."""
    return F.abs(x).between(F.lit(0.0), F.lit(half_width)) & z.between(low, high)


def age_factor(birth: Column, day: Column, peak: float = 29.0, young: float = 0.006, old: float = 0.003) -> Column:
    age = F.datediff(day, birth) / 365.25
    return F.when(age < peak, 1 + (peak - age) * young).otherwise(1 - (age - peak) * old)


def pmf_nb(mu: Column, size: Column, top: int = 25) -> Column:
    """Negative binomial probabilities of 0..top as an array, by recurrence (``p[k+1] = p[k] (k+r)/(k+1) mu/(r+mu)``)."""
    q = mu / (size + mu)
    first = F.pow(size / (size + mu), size)

    def grow(acc, k):
        return F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + size) / k * q))

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), F.array(first), grow)


def convolve(a: Column, b: Column, top: int) -> Column:
    """Sum of two counts: truncated convolution of their probability arrays."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(top)),
        lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(a, i), F.lit(0.0)) * F.coalesce(F.get(b, k - i), F.lit(0.0))),
    )


def norm_cdf(z: Column) -> Column:
    """Normal distribution function, by a rational approximation (absolute error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def capped_mean(mean: Column, sd: Column, cap: Column) -> Column:
    """Mean of ``min(X, cap)`` for a normal X."""
    z = (cap - mean) / sd
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return mean - ((mean - cap) * (1 - norm_cdf(z)) + sd * density)


def missing_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def any_national(broadcasts: Column, names: list[str]) -> Column:
    """Whether any broadcast (name, type, isNational) is national: by its flag, its type or its name."""
    return F.exists(broadcasts, lambda b: F.coalesce(b["isNational"], F.lit(False)) | (F.upper(b["type"]) == "NATIONAL") | F.trim(b["name"]).isin(names))


def first_five(innings: Column) -> Column:
    """Runs of the first five innings (num, runs); null unless all five are there with their runs."""
    five = F.filter(innings, lambda x: x["num"] <= 5)
    whole = (F.size(five) >= 5) & ~F.exists(five, lambda x: x["runs"].isNull())
    return F.when(whole, F.aggregate(five, F.lit(0).cast("long"), lambda acc, x: acc + x["runs"]))


def woba(ab: Column, bb: Column, hbp: Column, sf: Column, hits: Column, doubles: Column, triples: Column, homers: Column) -> Column:
    """Weighted on-base average from counting stats, walks without intentional ones; null without any."""
    top = 0.690 * bb + 0.722 * hbp + 0.888 * (hits - doubles - triples - homers) + 1.271 * doubles + 1.616 * triples + 2.101 * homers
    return top / F.nullif(ab + bb + sf + hbp, F.lit(0))
