"""Statistics with their edge cases: sample variance 0 for one value, nearest-rank percentiles, bias-corrected moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sd(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.when(F.count(x) == 1, F.lit(0.0)))


def skewness(x: Column) -> Column:
    n, s = F.count(x).cast("double"), F.stddev_samp(x)
    return F.when((n > 2) & (s > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    n, s = F.count(x).cast("double"), F.stddev_samp(x)
    return F.when((n > 3) & (s > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def percentile(x: Column, p: float) -> Column:
    """Nearest rank, int(0.5 + (n - 1) p / 100)."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(0.5 + (F.size(values) - 1) * p / 100).cast("int"))


def gistar(local_sum: Column, local_n: Column, mean: Column, spread: Column, n: Column) -> Column:
    """Getis-Ord Gi* with weights 1; null without local data, 0 where the denominator is 0."""
    below = spread * F.sqrt(F.greatest((n * local_n - local_n * local_n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    return F.when(local_n > 0, F.coalesce(F.try_divide(local_sum - local_n * mean, below), F.lit(0.0)))
