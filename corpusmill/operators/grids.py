"""Facts on grids: latest values, changes, guarded correlation, thresholds, stretches and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ordered import running
from corpusmill.operators.quantiles import exact_quantiles


def latest(facts: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The last value that isn't null of every key."""
    return facts.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"), F.max(F.struct(*order))[order[0]].alias("at"))


def changes(facts: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """``previous`` and ``delta`` of every fact against the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def pearson(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """``n, skipped, r``: correlation of finite pairs; null below ``least`` pairs or where one side doesn't vary.

    Sums of centred moments, so that a constant column gives null and no division by zero; ``skipped`` counts rows with one finite side.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    both, one = finite(x) & finite(y), F.coalesce(finite(x), F.lit(False)) != F.coalesce(finite(y), F.lit(False))
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    agg = rows.groupBy(*keys).agg(F.count(px).alias("n"), F.count_if(one).alias("skipped"), F.covar_pop(px, py).alias("c"), F.var_pop(px).alias("vx"), F.var_pop(py).alias("vy"))
    ok = (F.col("n") >= least) & (F.col("vx") * F.col("n") > 1e-12) & (F.col("vy") * F.col("n") > 1e-12)
    return agg.select(*keys, "n", "skipped", F.when(ok, F.col("c") / F.sqrt(F.when(ok, F.col("vx") * F.col("vy")))).alias("r"))


def percentile_limits(rows: DataFrame, keys: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values at places floor(n * low) and floor(n * high) of each key's ascending list, not interpolated; no key is sorted."""
    return exact_quantiles(rows, keys, value, {"lo": low, "hi": high})


def thinned(points: DataFrame, keys: list[str], order: list[str], most: int = 12_000, opacity: str | None = None, least: float = 0.05) -> DataFrame:
    """Every k-th point of a key in its order, k so that between ``most`` and twice as many stay, less those of a lower ``opacity`` than ``least``."""
    placed = running(points, keys, order)
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / most))
    kept = placed.where(F.col("pos") % step == 0)
    return (kept.where(F.col(opacity) >= least) if opacity else kept).drop("pos", "n")


def boxes(points: DataFrame, keys: list[str], axes: list[str], weight: str) -> DataFrame:
    """Least and greatest of each axis and the mean of ``weight``."""
    ends = [f(a).alias(f"{name}_{a}") for a in axes for name, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*keys).agg(F.count("*").alias("points"), *ends, F.avg(weight).alias("mean"))


def in_all_bands(scenes: DataFrame, scene: str, band: str, bands: list[str]) -> DataFrame:
    """Scenes that every one of ``bands`` has."""
    return scenes.where(F.col(band).isin(bands)).groupBy(scene).agg(F.count_distinct(band).alias("k")).where(F.col("k") == len(bands)).select(scene)


def stretch(value: Column, lo: Column, hi: Column, gamma: float = 0.8) -> Column:
    """0 to 255 by limits and gamma."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / F.when(hi > lo, hi - lo)))
    return F.floor(F.pow(share, gamma) * 255 + 0.5).cast("bigint")
