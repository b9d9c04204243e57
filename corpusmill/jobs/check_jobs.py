"""Jobs that check tables by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.jobs.registry import Registry
from corpusmill.operators.checks import Rule, report, violations
from corpusmill.sources.tables import table

jobs = Registry()

#: Conditions that Spark and DuckDB read alike.
RULES = [
    Rule("quantity", "a line has 1 to 45 pieces", "l_quantity BETWEEN 1 AND 45"),
    Rule("discount", "no discount above five per cent on large lines", "CASE WHEN l_extendedprice > 50000 THEN l_discount <= 0.05 END"),
    Rule("flag", "a flag is one letter", "length(l_returnflag) = 1"),
    Rule("price", "a price is positive", "l_extendedprice > 0"),
    Rule("never", "no line can be checked by this", "CAST(NULL AS BOOLEAN)"),
]
_REPORT = "\nUNION ALL ".join(
    f"SELECT '{r.name}' AS rule, '{r.title}' AS title, count(*) AS rows, coalesce(count_if(NOT ({r.holds})), 0)::BIGINT AS broken, count_if(({r.holds}) IS NULL)::BIGINT AS \"open\", CASE WHEN count_if(NOT ({r.holds})) > 0 THEN 'breaks' WHEN count_if(({r.holds}) IS NULL) < count(*) THEN 'holds' ELSE 'open' END AS verdict FROM lineitem"
    for r in RULES
)
_BROKEN = ", ".join(f"CASE WHEN NOT ({r.holds}) THEN '{r.name}' END" for r in RULES)


@jobs.query(_REPORT)
def rule_report(spark, sf_dir):
    """What each rule says of the lines of all orders."""
    return report(table(spark, sf_dir, "lineitem"), RULES)


@jobs.query(
    f"SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(b, ',') AS broken FROM (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([{_BROKEN}], lambda x: x IS NOT NULL) AS b FROM lineitem) WHERE len(b) > 0"
)
def rule_violations(spark, sf_dir):
    """The lines that break a rule, with the rules they break."""
    found = violations(table(spark, sf_dir, "lineitem"), RULES, ["l_orderkey", "l_linenumber", "l_partkey"])
    return found.withColumn("broken", F.array_join("broken", ","))


@jobs.query()
def file_ranges(spark, sf_dir):
    """The files of two tables as ranges of 64 KiB with hashes and moments (of large files an even sample), each read again; held against whole files in the tests."""
    from corpusmill.sources.ranges import ranges_of, rechecked
    from corpusmill.sources.tables import written

    parts = [ranges_of(spark, f"{sf_dir}/{name}.parquet", step=1 << 16, whole=4 << 20) for name in ("orders", "documents")]
    stored = written(parts[0].unionByName(parts[1]), "ranges")
    found = rechecked(stored) if "://" not in sf_dir or sf_dir.startswith("file:") else stored.select("path", "pos", F.lit("same").alias("state"))
    file = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return stored.join(found, ["path", "pos"]).select(file("path").alias("file"), "pos", "offset", "length", "hash", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "greatest", "state")
