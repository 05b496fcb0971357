"""Column expressions: guarded ratios, seasons, distances, bins, and the normal and t distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# Left edges of the distance bins, in km, and seasons by month.
DISTANCE_EDGES = (0, 1, 2, 5, 10, 20, 50)
METEOROLOGICAL = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
MONSOON = {"pre_monsoon": (3, 4, 5), "monsoon": (6, 7, 8, 9), "post_monsoon": (10, 11), "winter": (12, 1, 2)}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, null where ``b`` is 0 or null."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def percent(a: str | Column, b: str | Column) -> Column:
    return 100 * ratio(a, b)


def season(month: str | Column, scheme: dict[str, tuple[int, ...]] = METEOROLOGICAL) -> Column:
    out = F.lit(None).cast("string")
    for name, months in scheme.items():
        out = F.when(col(month).isin(*months), F.lit(name)).otherwise(out)
    return out


def monday(date: str | Column) -> Column:
    """The Monday that ends the week of a date: itself on Mondays."""
    return F.next_day(F.date_sub(col(date), 1), "MON")


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance_bin(km: str | Column) -> Column:
    """The left edge of a distance's bin; bins hold their left edge."""
    out = F.lit(None).cast("int")
    for edge in DISTANCE_EDGES:
        out = F.when(col(km) >= edge, F.lit(edge)).otherwise(out)
    return out


def collocation_group(name: str | Column) -> Column:
    """A station's name without the number of its collocated instrument."""
    return F.regexp_replace(col(name), r"(?i)\s+Collocation\s+\d+\s*$", " Collocation")


def fpc(n: str | Column, population: str | Column) -> Column:
    """Finite-population correction; 0 for whole populations."""
    n, big = col(n).cast("double"), col(population).cast("double")
    return F.when((big <= 1) | (n >= big), F.lit(0.0)).otherwise(F.sqrt((big - n) / F.nullif(big - 1, F.lit(0.0))))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the rows where both are there; null under three of them or without variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)).cast("double"), F.when(both, col(y)).cast("double")
    n = F.count(a)
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.avg(a * a) - F.avg(a) * F.avg(a)) * F.greatest(F.lit(0.0), F.avg(b * b) - F.avg(b) * F.avg(b)))
    return F.when((n >= 3) & (spread > 1e-12), cov / F.nullif(spread, F.lit(0.0)))


def average_rank(value: str, *partition: str) -> Column:
    """Ranks from 1; equal values share the mean of their ranks."""
    order = Window.partitionBy(*partition).orderBy(value)
    same = Window.partitionBy(*partition, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def t_quantile(p: float, df: float) -> float:
    """Student's t quantile by the Cornish-Fisher expansion."""
    z = normal_quantile(p)
    if math.isinf(df) or df <= 0:
        return z
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum(term / df**k for k, term in enumerate(terms))
