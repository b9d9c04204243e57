"""Best-fit decreasing: indivisible groups of equal texts go to the shard with the tightest room that holds them.

Room is kept in a balanced tree (a treap over (room, shard)), whose successor search finds the tightest shard. Neither the driver nor one task sees all groups.

``capacity``: shards of a fixed capacity, as few as best-fit decreasing needs. Groups below ``1 / FINE_PARTS`` of the capacity are first joined by hash into lumps of
about that size; lumps and larger groups are dealt by hash to tasks of about ``BUCKET_SHARDS`` shards, and each task opens a shard where no room is left. No shard exceeds the
capacity, but that a group larger than it has a shard of its own.

``n_shards``: that many shards of near equal size, law ``bytes``. Groups of at least ``1 / (n_shards * BIG_PARTS)`` of all bytes, of which there
can be only ``n_shards * BIG_PARTS``, are placed first; all others are dealt by hash into buckets, and each bucket fills its share of the
room that the large groups left. What fits nowhere enters the shard with the most room.

Defined results: a null text counts as empty (size 16, checksum 0); equal texts always share a shard, so with ``n_shards`` a group above the mean
makes its shard larger than the rest; equal sizes go by the text's digest; repeated ``doc_id`` rows are separate rows; an empty table
gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import table, written

N_SHARDS = 40
ROW_BYTES = 16
#: Groups of at least this part of a shard are placed first, all together.
BIG_PARTS = 64
BUCKET_GROUPS = 20_000
#: With a capacity: parts of a shard below which groups are joined to lumps, and shards that a task fills.
FINE_PARTS = 128
BUCKET_SHARDS = 64
#: Rows of a shard numbered by one task.
SLOT_ROWS = 500


class RoomTree:
    """A treap of (room, shard): balanced by random priorities, with successor search, insertion and removal."""

    def __init__(self, seed: int = 7):
        self.root, self.random = None, random.Random(seed)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.root, (room, shard))
        self.root = self._join(self._join(low, [(room, shard), self.random.random(), None, None]), high)

    def take(self, need: int, most: bool = True) -> tuple[int, int] | None:
        """Removes and returns the tightest (room, shard) with ``room >= need``; else the one with the most room, or None if ``most`` is not wanted."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= need:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is None:
            if not most:
                return None
            node = self.root
            while node[3] is not None:
                node = node[3]
            best = node[0]
        low, rest = self._split(self.root, best)
        _, high = self._split(rest, (best[0], best[1] + 1))
        self.root = self._join(low, high)
        return best


def best_fit(sizes: list[int], rooms: list[int]) -> list[int]:
    """The bin of every size, given in falling order; ``rooms`` is updated and may fall below 0."""
    tree = RoomTree()
    for shard, room in enumerate(rooms):
        tree.add(room, shard)
    out = []
    for size in sizes:
        room, shard = tree.take(size)
        rooms[shard] = room - size
        tree.add(room - size, shard)
        out.append(shard)
    return out


def best_fit_opening(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every size, given in falling order; a bin is opened where none has room. Only a size above ``capacity`` overfills one, alone."""
    tree, out, opened = RoomTree(), [], 0
    for size in sizes:
        found = tree.take(size, most=False)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, shard = found
        out.append(shard)
        tree.add(room - size, shard)
    return out


def shards_of_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """``key, shard`` for ``groups`` (``key`` string, ``bytes`` bigint), which has been written: shards of at most ``capacity`` bytes, numbered from 0."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    fine = -(-capacity // FINE_PARTS)
    lumps = max(1, -(-total // fine))
    buckets = max(1, total // (BUCKET_SHARDS * capacity))
    item = F.when(F.col("bytes") >= fine, F.col("key")).otherwise(F.concat(F.lit("lump "), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(lumps)).cast("string")))
    named = groups.select("key", "bytes", item.alias("item"))
    items = named.groupBy("item").agg(F.sum("bytes").alias("bytes")).withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(2)), F.lit(buckets)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        pdf["place"] = best_fit_opening(pdf["bytes"].tolist(), capacity)
        return pdf[["item", "bucket", "place"]]

    packed = written(items.groupBy("bucket").applyInPandas(fill, "item string, bucket int, place int"), "shard-items")
    # A row a task: shards opened before it.
    opened = packed.groupBy("bucket").agg((F.max("place") + 1).alias("n"))
    before = opened.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    return named.join(packed.join(F.broadcast(before), "bucket"), "item").select("key", (F.col("before") + F.col("place")).cast("int").alias("shard"))


def shard_groups(groups: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``key, shard`` for ``groups`` (``key`` string, ``bytes`` bigint), which has been written: ``n_shards`` shards of near equal size."""
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity = -(-total // n_shards)
    least_big = max(1, capacity // BIG_PARTS)
    # At most n_shards * (BIG_PARTS + 1) rows, as each holds that part of all bytes.
    big = groups.where(F.col("bytes") >= least_big).orderBy(F.desc("bytes"), "key").collect()
    rooms = [capacity] * n_shards
    placed = list(zip((r["key"] for r in big), best_fit([r["bytes"] for r in big], rooms)))
    first = spark.createDataFrame(placed, "key string, shard int")
    left = sum(max(0, x) for x in rooms) or 1
    shares = [max(0, x) / left for x in rooms]
    buckets = max(1, -(-n // BUCKET_GROUPS))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        bytes_ = int(pdf["bytes"].sum())
        pdf["shard"] = best_fit(pdf["bytes"].tolist(), [round(bytes_ * x) for x in shares])
        return pdf[["key", "shard"]]

    small = groups.where(F.col("bytes") < least_big).select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return first.unionByName(small.groupBy("bucket").applyInPandas(fill, "key string, shard int"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n") , F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key")).select("doc_id", (F.col("n") + ROW_BYTES).alias("size"), "text_crc32", "key"),
        "shard-rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    homes = written(shard_groups(groups, n_shards) if capacity is None else shards_of_capacity(groups, capacity), "shard-homes")
    # The place in the written rows tells repeated rows apart and spreads a large group over parts.
    parts = max(1, -(-rows.count() // (n_shards * SLOT_ROWS)))
    housed = written(
        rows.withColumn("place", F.monotonically_increasing_id()).join(homes, "key").select("doc_id", "size", "text_crc32", "shard", "place", F.pmod(F.xxhash64("place"), F.lit(parts)).alias("part")),
        "shard-housed",
    )
    counts = housed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "place")) - 1
    return housed.withColumn("inside", inside).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def op3_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_best_fit_shards": op3_best_fit_shards}
ORACLE: dict[str, str] = {}
