"""Exact order statistics of a key by histograms that are refined where a rank lies, so that no key is sorted or gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import written

BINS = 4_096
#: So many values of a rank's interval are gathered and sorted in a row; more are counted again in narrower bins.
GATHERED = 4_096
#: Intervals up to this count are broadcast (about 60 bytes each); more are joined.
BROADCAST_STATES = 500_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS, gathered: int = GATHERED) -> DataFrame:
    """``keys``, ``n`` and the value at place floor(n * share) of each key's ascending list of finite values, a column for each of ``shares``; not interpolated.

    A pass counts the values inside each rank's interval by bins and keeps the bin that holds the rank, with the least and greatest value in it; a row for each key, rank, bin and task is shuffled, no row of the input.
    Bins are even in one pass and even by order of magnitude in the next, so neither outliers nor clusters hold it up. Bins are made by functions that never fall as values grow, so ranks stay exact.

    Defined: nulls, NaN and infinite values don't count; a key without values has no row; a null key is a key; a share of 1 gives the greatest value.
    """
    v = F.col(value).cast("double")
    valid = rows.select(F.struct(*keys).alias("k"), (v + F.lit(0.0)).alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sums = written(valid.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sums")
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()]))
    state = sums.select("k", "n", "lo", "hi", names.alias("s")).select("k", "s.name", F.least(F.floor(F.col("n") * F.col("s.q")), F.col("n") - 1).alias("rank"), "lo", "hi", F.col("n").alias("c"))
    state = written(state, "quantile-state")

    def inside(intervals: DataFrame) -> DataFrame:
        """Values with the intervals they lie in."""
        told = intervals.withColumnRenamed("k", "of")
        told = F.broadcast(told) if intervals.count() <= BROADCAST_STATES else told
        return valid.join(told, (F.col("k") == F.col("of")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

    turn = 0
    while (wide := state.where((F.col("lo") < F.col("hi")) & (F.col("c") > gathered))).limit(1).count():
        # Halves, so that the span of the widest interval is a double.
        part = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        scaled = part if turn % 2 == 0 else F.log1p(part * 1e15) / F.log1p(F.lit(1e15))
        counted = inside(wide).groupBy("k", "name", "rank", F.least(F.floor(scaled * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("b"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("b").over(Window.partitionBy("k", "name").orderBy("bin"))
        kept = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("b") <= F.col("rank")))
        kept = kept.select("k", "name", (F.col("rank") - F.col("upto") + F.col("b")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("b").alias("c"))
        state = written(state.where((F.col("lo") == F.col("hi")) | (F.col("c") <= gathered)).unionByName(kept), "quantile-state")
        turn += 1
    few = state.where("lo < hi")
    picked = inside(few).groupBy("k", "name").agg(F.get(F.array_sort(F.collect_list("v")), F.first("rank").cast("int")).alias("v"))
    found = written(state.where("lo = hi").select("k", "name", F.col("lo").alias("v")).unionByName(picked), "quantiles")
    wide_rows = found.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return wide_rows.join(sums.select(F.col("k").alias("of"), "n"), F.col("k") == F.col("of")).select("k.*", "n", *shares)
