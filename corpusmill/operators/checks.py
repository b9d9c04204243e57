"""Checks of a table: a list of rules compiled into one pass, with the rows that break them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``holds`` is a SQL condition on a row; where it is null, nothing can be said of the row."""

    name: str
    title: str
    holds: str


def _named(rules: list[Rule]) -> list[Rule]:
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    return rules


def _counts(rules: list[Rule]) -> list[Column]:
    """The rows, and for each rule those that break it and those of which nothing can be said."""
    out = [F.count(F.lit(1)).alias("rows")]
    for r in _named(rules):
        out += [F.count_if(~F.expr(r.holds)).alias(f"broken_{r.name}"), F.count_if(F.expr(r.holds).isNull()).alias(f"open_{r.name}")]
    return out


def report(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, title, rows, broken, open, verdict`` of every rule, from one aggregate over ``rows``: holds, breaks, or open where no row lets it be checked. An empty table leaves all open."""
    lines = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.title).alias("title"), "rows", F.col(f"broken_{r.name}").alias("broken"), F.col(f"open_{r.name}").alias("open")) for r in rules]
    each = rows.agg(*_counts(rules)).select(F.explode(F.array(*lines)).alias("l")).select("l.*")
    return each.withColumn("verdict", F.when(F.col("broken") > 0, "breaks").when(F.col("open") < F.col("rows"), "holds").otherwise("open"))


def violations(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """``keys`` and the names of the rules that a row breaks, in their order; rows that break none are left out. No shuffle."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(r.holds), F.lit(r.name)) for r in _named(rules)]))
    return rows.select(*keys, broken.alias("broken")).where(F.size("broken") > 0)


def written_checked(rows: DataFrame, rules: list[Rule], path: str) -> dict[str, int]:
    """Writes ``rows`` as Parquet and gives the counts of the rules, observed on the way: no second pass. The observed counts hold for the write that succeeded."""
    seen = Observation("rules")
    rows.observe(seen, *_counts(rules)).write.parquet(path)
    return {k: int(v) for k, v in seen.get.items()}
