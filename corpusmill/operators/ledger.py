"""Event ledgers: derived task state, witnesses, linked entries, caps and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def task_states(events: DataFrame, horizon: Column) -> DataFrame:
    """State of each request from its events (``request, kind, from_key, to_key, at``).

    Verified by any other key than the one asked, else delivered by the one asked, else claimed, else expired at ``horizon``, else requested.
    """
    asked = F.max(F.when(F.col("kind") == "request", F.col("to_key")))
    whole = Window.partitionBy("request")
    e = events.withColumn("asked", asked.over(whole))
    delivered = F.count_if((F.col("kind") == "deliver") & (F.col("from_key") == F.col("asked")))
    verifiers = F.count_distinct(F.when((F.col("kind") == "verify") & (F.col("from_key") != F.col("asked")), F.col("from_key")))
    s = e.groupBy("request").agg(verifiers.alias("verifiers"), delivered.alias("delivered"), F.count_if(F.col("kind") == "claim").alias("claimed"), F.max("at").alias("last"))
    state = (
        F.when((F.col("verifiers") > 0) & (F.col("delivered") > 0), F.concat(F.lit("verified by "), F.col("verifiers").cast("string"), F.lit(" keys")))
        .when(F.col("delivered") > 0, F.lit("delivered"))
        .when(F.col("claimed") > 0, F.lit("claimed"))
        .when(F.col("last") < horizon, F.lit("expired"))
        .otherwise(F.lit("requested"))
    )
    return s.select("request", "verifiers", state.alias("state"))


def last_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_rows(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in an order, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def linked(entries: DataFrame, chain: str, order: str, name: Column, previous: Column) -> DataFrame:
    """``ok`` of every entry: it names the entry before it; the first names none."""
    before = F.lag(name).over(Window.partitionBy(chain).orderBy(order))
    return entries.withColumn("ok", before.eqNullSafe(previous))


def trailing_count(events: DataFrame, key: str, seconds: Column, span: int) -> Column:
    """Events of a key in the ``span`` seconds up to each one."""
    return F.count("*").over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-span, 0))


def within_budget(steps: DataFrame, key: str, order: str, size: str, most: int, budget: float) -> DataFrame:
    """``ok`` of every step until the first that finds its run's count or bytes used up."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used, n = F.coalesce(F.sum(size).over(before), F.lit(0)), F.count("*").over(before)
    return steps.withColumns({"used": used, "ok": (n < most) & (used < budget)})


def token_bucket(writes: DataFrame, key: str, at: str, capacity: float = 40, rate: float = 3.5) -> DataFrame:
    """When each write may start: a bucket of ``capacity`` tokens refills at ``rate`` a second; writes wait in order.

    Sequential by nature: a write's wait depends on all before it, so a key's writes meet in one group.
    """

    def pace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, "event_id"], ignore_index=True)
        tokens, now, starts = capacity, None, []
        for t in pdf[at]:
            start = t if now is None else max(t, now)
            tokens = capacity if now is None else min(capacity, tokens + (start - now) * rate)
            if tokens < 1:
                start, tokens = start + (1 - tokens) / rate, 1.0
            tokens, now = tokens - 1, start
            starts.append(start)
        pdf["start"] = starts
        return pdf[[key, "event_id", at, "start"]]

    kinds = dict(writes.dtypes)
    return writes.select(key, "event_id", at).groupBy(key).applyInPandas(pace, f"{key} {kinds[key]}, event_id bigint, {at} double, start double")
