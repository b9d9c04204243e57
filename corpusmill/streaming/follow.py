"""Streams: live windows, newest entries and growing logs, as Structured Streaming queries.

A stream reads files from a folder as they come; state lives in the checkpoint folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.sources.tables import scratch_path


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files at ``path`` with the schema of ``like``."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        # Later batches replace the rows they update: the last batch that wrote a key counts.
        write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` makes of every batch of a stream, as a table. A batch that runs again replaces its own rows; no state is kept."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    write = lambda df, batch: step(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def monotonic(stream: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """``ok`` of every head of a log: its size isn't below the largest seen before it. State per key is one number."""

    def check(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        pdf = pd.concat(list(frames)).sort_values(order, ignore_index=True)
        before = pdf[size].cummax().shift(1).fillna(-1).clip(lower=top)
        pdf["ok"] = pdf[size] >= before
        state.update((int(max(top, pdf[size].max())),))
        yield pdf[[key, order, size, "ok"]]

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {size} {kinds[size]}, ok boolean"
    return stream.select(key, order, size).groupBy(key).applyInPandasWithState(check, schema, "top bigint", "append", GroupStateTimeout.NoTimeout)
