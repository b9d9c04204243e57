"""Frames cut across messages, surveys that end, and an append that may run twice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.sources.tables import scratch_path, written

#: Frames end in a blank line, whatever its line ends.
_END = re.compile(r"\r?\n\r?\n")


def fields_of(frame: str) -> tuple[str, str]:
    """Event and data of a frame: the last ``event:`` line, all ``data:`` lines joined by line ends. Comments and other fields count for nothing."""
    event, data = "message", []
    for line in re.split(r"\r?\n", frame):
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "event":
            event = value
        elif name == "data":
            data.append(value)
    return event, "\n".join(data)


def frames(messages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, frame, event, data`` of every whole frame of a stream of ``messages``, numbered from 0 in its key.

    Messages of a key come in the order of ``order``, from batch to batch and inside one; a frame may be cut anywhere, so what is left of a message waits in the key's state for the next one. The state is that rest and a number.
    Defined: an unfinished frame gives no row, an empty one neither; a null text adds nothing; rows with equal order follow in some order.
    """

    def parse(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        # A carriage return may be cut from its line end: it waits too, as part of the rest.
        *whole, rest = _END.split(rest + "".join(x for x in pdf[text] if x is not None))
        rows = [fields_of(x) for x in whole if x.strip("\r\n")]
        state.update((rest, n + len(rows)))
        if rows:
            yield pd.DataFrame({key: [keys[0]] * len(rows), "frame": range(n, n + len(rows)), "event": [e for e, _ in rows], "data": [d for _, d in rows]})

    kind = dict(messages.dtypes)[key]
    schema = f"{key} {kind}, frame bigint, event string, data string"
    return messages.select(key, order, text).groupBy(key).applyInPandasWithState(parse, schema, "rest string, n bigint", "append", GroupStateTimeout.NoTimeout)


def last_of(found: DataFrame, key: str, event: str) -> DataFrame:
    """The last frame of a kind in each key: a later answer takes the place of an earlier one."""
    return found.where(F.col("event") == event).groupBy(key).agg(F.max_by("data", "frame").alias("data"), F.max("frame").alias("frame"))


def counted_surveys(stream: DataFrame, key: str, order: str, most: int = 12) -> DataFrame:
    """The first ``most`` rows of every key of a stream, with their number ``survey`` and ``ended`` at the last; the rest is refused without a row.

    State of a key is one number; a key that has ended keeps just that, so it stays ended however late rows come.
    """

    def count(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        if done >= most:
            return
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable").head(most - done)
        state.update((done + len(pdf),))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "survey": range(done + 1, done + 1 + len(pdf)), "ended": [i == most for i in range(done + 1, done + 1 + len(pdf))]})

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, survey bigint, ended boolean"
    return stream.select(key, order).groupBy(key).applyInPandasWithState(count, schema, "done bigint", "append", GroupStateTimeout.NoTimeout)


#: Entries of a chain that a window takes at once, as a power of two.
RUN_BITS = 14


def _name() -> Column:
    return F.sha2(F.concat_ws("\n", "chain", "body"), 256)


def _before(entries: DataFrame, name: Column, bits: int = RUN_BITS) -> DataFrame:
    """``entries`` (``chain, entry`` and more) with their ``name``, and the least and greatest name (``least``, ``most``) at the number before in the chain: equal if one entry or none has it. A null chain has no entry before.

    Entries meet in runs of ``2 ** bits`` numbers, so no window holds a chain and the log is dealt once, not joined to itself; between runs only the last numbers' names pass. Names that are made are made where runs meet.
    """
    runs = entries.withColumn("run", F.shiftright("entry", bits))
    inside = Window.partitionBy("chain", "run").orderBy("entry").rangeBetween(-1, -1)
    held = runs.repartition("chain", "run").withColumn("name", name).withColumns({"least": F.min("name").over(inside), "most": F.max("name").over(inside)})
    ends = runs.where(F.shiftright(F.col("entry") + 1, bits) > F.col("run")).withColumn("name", name)
    ends = ends.groupBy(F.col("chain").alias("of"), (F.col("run") + 1).alias("into")).agg(F.min("name").alias("low"), F.max("name").alias("high"))
    told = held.join(ends, (F.col("chain") == F.col("of")) & (F.col("run") == F.col("into")), "left")
    starts = F.col("entry") == F.shiftleft("run", bits)
    kept = dict.fromkeys([*entries.columns, "name"])
    return told.select(*kept, *[F.when(starts, F.col(end)).when(F.col("chain").isNotNull(), F.col(inner)).alias(inner) for inner, end in (("least", "low"), ("most", "high"))])


class NamedLog:
    """A log in the shared folder whose entries are named by their content, chain by chain: each names the one before.

    An append looks before it writes: what a chain holds already is left out, so a batch, a task or a whole job may run again and the log stays the same. One writer at a time; a batch is a folder that is
    written whole or not at all, by the name of what it holds.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "named-log")

    def read(self) -> DataFrame:
        """``chain, entry, name, previous, body``."""
        schema = "chain string, entry bigint, name string, previous string, body string"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        if there:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])

    def append(self, rows: DataFrame) -> int:
        """Appends ``rows`` (``chain, at, body``) that the log doesn't hold, in the order of ``at`` and then of bodies; returns how many. Equal bodies of a chain are one entry, the earliest."""
        from corpusmill.operators.ordered import running

        # One group of hashes finds what is new, with texts as keys only: rows would be sorted for a text that is a group's value, and for a join with the log.
        held = self.read()
        asked = rows.where(F.col("chain").isNotNull() & F.col("body").isNotNull()).select("chain", "body", "at", F.lit(False).alias("held"))
        found = asked.unionByName(held.select("chain", "body", F.lit(True).alias("held")), allowMissingColumns=True).groupBy("chain", "body").agg(F.min("at").alias("at"), F.max("held").alias("held"))
        new = written(found.where(~F.col("held")).select("chain", "at", "body"), "log-new")
        # The same new entries always go to the same folder.
        n, batch = new.agg(F.count("*"), F.sha2(F.concat(F.count("*").cast("string"), F.sum(F.xxhash64(_name()).cast("decimal(38,0)")).cast("string")), 256)).first()
        if not n:
            return 0
        tops = written(held.groupBy("chain").agg(F.max("entry").alias("entry")), "log-tops")
        heads = written(held.join(tops, ["chain", "entry"]).select("chain", (F.col("entry") + 1).alias("from"), F.col("name").alias("head")), "log-heads")
        placed = running(new, ["chain"], ["at", "body"]).join(heads, "chain", "left").withColumn("entry", F.coalesce("from", F.lit(0)) + F.col("pos"))
        entries = _before(placed.select("chain", "entry", "body", "head"), _name()).select("chain", "entry", "name", F.coalesce("most", "head", F.lit("")).alias("previous"), "body")
        entries.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        return n


def checked(log: DataFrame) -> DataFrame:
    """``chain, entry, name, previous`` of a log with ``expected``, the name of the entry before, and ``linked``: the name is the content's, and what comes before is named."""
    told = _before(log.select("chain", "entry", "name", "previous", (F.col("name") == _name()).alias("own")), F.col("name"))
    none = F.when(F.col("entry") == 0, F.lit("")).otherwise(F.lit("missing"))
    linked = F.col("own") & (F.col("previous") == F.coalesce("least", none)) & (F.col("previous") == F.coalesce("most", none))
    return told.select("chain", "entry", "name", "previous", F.when(F.col("previous") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("expected"), F.coalesce(linked, F.lit(False)).alias("linked"))


def broken_links(log: DataFrame) -> DataFrame:
    """Entries whose name isn't their content's, or that don't name the entry before them."""
    return checked(log).where(~F.col("linked")).drop("linked")
