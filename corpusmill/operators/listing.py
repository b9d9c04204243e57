"""Listings: which files are read, in what order, how far a budget goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ordered import running

# Folders and files that are never read, and endings that are.
SKIPPED = "(?i)(^|/)(node_modules|dist|build|out|vendor|third_party|\\.git|\\.next|target|coverage|__pycache__|\\.venv)/"
LOCKS = "(?i)(\\.min\\.|\\.map$|(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|Cargo\\.lock|poetry\\.lock|go\\.sum|composer\\.lock)$)"
READABLE = ("md", "mdx", "rst", "txt", "html", "csv", "tsv", "json", "yaml", "yml", "toml", "py", "js", "ts", "go", "rs", "java", "c", "cpp", "h", "sh", "sql")
DATA = ("csv", "tsv", "json", "yaml", "yml", "toml")


def readable_file(path: Column, size: Column, limit: int = 400_000) -> Column:
    ending = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return (size < limit) & ending.isin(*READABLE) & ~path.rlike(SKIPPED) & ~path.rlike(LOCKS)


def file_rank(path: Column) -> Column:
    """0 root readme, 1 documentation, 2 other prose, 3 code, 4 history and tests, 5 data; the first rule that holds decides."""
    ending = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    prose = ending.isin("md", "mdx", "rst")
    return (
        F.when(path.rlike("(?i)^/readme(\\.\\w+)?$"), 0)
        .when(path.rlike("(?i)(^|/)(history|changelog|changes|news|releases?)(\\.\\w+)?$"), 4)
        .when(path.rlike("(?i)^/readme") | (path.rlike("(?i)(^|/)docs?/") & (prose | (ending == "txt"))), 1)
        .when(prose, 2)
        .when(path.rlike("(?i)(^|/)(tests?|__tests__|spec|fixtures?|examples?|benchmarks?)/"), 4)
        .when(ending.isin(*DATA), 5)
        .otherwise(3)
    )


def budgeted(files: DataFrame, listing: str, order: list[str], budget: int, most: int) -> DataFrame:
    """The files of each listing, in order, before the first that would exceed the budget or the count. Sizes are never negative, so what fits is a prefix."""
    placed = running(files, [listing], order, {"before": F.col("size")})
    return placed.withColumn("total", F.col("before") + F.coalesce("size", F.lit(0))).where((F.col("total") <= budget) & (F.col("pos") < most)).drop("before", "pos", "n")
