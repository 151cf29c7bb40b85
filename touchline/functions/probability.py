"""Count distributions, score grids and market probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the reference goal model.
HOME_INTERCEPT, AWAY_INTERCEPT = 0.5755681919094765, 0.36701546733986806
ATTACK, DEFENSE, MEAN_GOALS = 0.49009330973564896, 0.13651053115837344, 1.5588235294117647
WILSON_Z = 1.959963984540054
EARTH_KM = 6371.0088


def c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: ln n! of the first whole numbers, by rule.
_LN_FACTORIALS = [math.lgamma(n + 1) for n in range(64)]


def ln_factorial(n: Column) -> Column:
    """ln n! of a whole number: a constant array for small ones, a sum of logarithms beyond (Spark's factorial ends at 20)."""
    small = F.array(*[F.lit(x) for x in _LN_FACTORIALS])
    start = len(_LN_FACTORIALS) - 1
    beyond = F.aggregate(F.sequence(F.lit(start + 1), F.greatest(n, F.lit(start + 1)).cast("int")), F.lit(_LN_FACTORIALS[-1]), lambda a, i: a + F.ln(i.cast("double")))
    return F.when(n <= start, F.get(small, n.cast("int"))).otherwise(beyond)


def poisson(k: Column, rate: Column) -> Column:
    """Poisson probability of k."""
    return F.exp(k * F.ln(rate) - rate - ln_factorial(k))


def poisson_cdf(k: Column, rate: Column) -> Column:
    """Poisson probability of at most k."""
    return F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, i: a + poisson(i, rate))


def negative_binomial(k: Column, mean: Column, alpha: Column) -> Column:
    """NB2 probability of k (variance mean + alpha mean^2) by its recursion; alpha 0 is Poisson."""
    size = 1 / alpha
    p = size / (size + mean)
    start = F.exp(size * F.ln(p))
    nb = F.when(k < 1, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, lambda a, i: a * (i - 1 + size) / i * (1 - p)))
    return F.when(alpha <= 0, poisson(k, mean)).otherwise(nb)


def tau(h: Column, a: Column, lh: Column, la: Column, rho: Column) -> Column:
    """The Dixon-Coles correction of the four lowest scores."""
    return (
        F.when((h == 0) & (a == 0), 1 - lh * la * rho)
        .when((h == 0) & (a == 1), 1 + lh * rho)
        .when((h == 1) & (a == 0), 1 + la * rho)
        .when((h == 1) & (a == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def score_cells(lh: Column, la: Column, rho: Column, top: int = 10) -> Column:
    """array<struct(home, away, p)>: the score grid up to ``top`` goals a side; what lies beyond stays out, nothing is scaled up to 1."""
    goals = F.sequence(F.lit(0), F.lit(top))
    pmf = lambda rate: F.transform(goals, lambda k: poisson(k, rate))
    # the two marginals are held in an array of one, so that they are computed once and not per cell
    sides = F.array(F.struct(pmf(lh).alias("h"), pmf(la).alias("a")))

    def grid(side: Column) -> Column:
        return F.flatten(F.transform(side["h"], lambda x, h: F.transform(side["a"], lambda y, a: F.struct(h.alias("home"), a.alias("away"), (x * y * tau(h, a, lh, la, rho)).alias("p")))))

    return F.get(F.transform(sides, grid), F.lit(0))


def mass(cells: Column, where) -> Column:
    """The probability of the cells for which ``where(home, away)`` holds."""
    return F.aggregate(F.filter(cells, lambda x: where(x["home"], x["away"])), F.lit(0.0), lambda acc, x: acc + x["p"])


def champion_rate(intercept: float, scored: Column, conceded: Column) -> Column:
    """Expected goals of the reference model from a side's scored and its opponent's conceded means."""
    return F.exp(intercept + ATTACK * F.ln(F.greatest(scored, F.lit(0.1)) / MEAN_GOALS) + DEFENSE * F.ln(F.greatest(conceded, F.lit(0.1)) / MEAN_GOALS))


def elo_expected(own: Column, other: Column) -> Column:
    """Expected score of the logistic rating curve, its exponent held within +-700."""
    return 1 / (1 + F.pow(F.lit(10.0), F.least(F.greatest((other - own) / 400, F.lit(-700.0)), F.lit(700.0))))


def elo_decay(rating: Column, base: float, days: Column, half_life: float = 365) -> Column:
    return base + (rating - base) * F.pow(F.lit(0.5), days / half_life)


def davidson(home: Column, away: Column, nu: float) -> list[Column]:
    """Home, draw and away probabilities from two strengths (natural log scale), with a draw weight nu."""
    h, d, a = F.exp(home), nu * F.exp((home + away) / 2), F.exp(away)
    return [x / (h + d + a) for x in (h, d, a)]


def wilson(hits: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """The Wilson interval of a rate."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def entropy(ps: list[Column]) -> Column:
    return -sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in ps), F.lit(0.0))


def settle_quarters(margin4: Column, line4: Column) -> Column:
    """Settlement of a handicap on quarter lines in whole quarter units: FULL_WIN, HALF_WIN, PUSH, HALF_LOSS or FULL_LOSS of margin + line.

    A quarter line is half a stake on each of the two neighbouring half lines.
    """
    x = margin4 + line4
    return F.when(x >= 2, "FULL_WIN").when(x == 1, "HALF_WIN").when(x == 0, "PUSH").when(x == -1, "HALF_LOSS").otherwise("FULL_LOSS")
