"""Token ids as ORC: ascending document ids, run-length encoded integers, row indexes and Bloom filters.

Documents are dealt by range of (id, place in the input), sorted within each range, encoded and written, one file a range.
Readers take stripes in parallel, and a filter on ``doc_id`` skips files, stripes and row groups by their metadata.

Defined results: a null text is empty and has the end id alone; repeated ``doc_id`` rows each keep a row, in input order; rows
with a null ``doc_id`` come first; an empty table gives an empty result; other input columns are ignored. A third of all rows
under one id is dealt over several ranges, as the place in the input is part of the key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import encoder, small_batches
from corpusmill.sources.tables import scratch_path, table

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.compress": "ZSTD",
}
#: Bytes of chunks that a worker remembers.
CACHE_BYTES = 160 << 20
#: part and row give the place of a document in the whole order.
SCHEMA = "doc_id bigint, part int, row bigint, n_tokens bigint, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, keeps_blanks: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text below ``path``."""
    small_batches(docs.sparkSession)

    def encode(batches):
        part, row = TaskContext.get().partitionId(), 0
        with encoder(tokenizer, keeps_blanks, CACHE_BYTES) as enc:
            for batch in batches:
                ids = list(enc.encode(batch.column("text").to_pylist()))
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                rows = pa.array(np.arange(row, row + len(ids)))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)), rows, pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=_ARROW)

    placed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows written; ``doc_ids`` becomes a pushed filter that statistics and Bloom filters answer."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    small_batches(spark)
    stored = read_token_orc(spark, path)

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "part", "row", "ids").mapInArrow(digest, "doc_id bigint, part int, row bigint, n_tokens bigint, ids_crc32 bigint")
    # One row a file: the ids in the files before it.
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_orc_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)


QUERIES = {"op4_orc_tokens": op4_orc_tokens}
ORACLE: dict[str, str] = {}
