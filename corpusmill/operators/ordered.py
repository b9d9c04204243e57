"""Rules that run along an ordered key, without a task or a window that holds a key.

Rows are dealt by ranges of key and order, sorted and written with a line number; lines of one block (a run of at most ``2 ** bits`` lines of one part) make a summary, summaries are put
together in order, and what has come before a block goes back to its rows. A key that holds a third of all rows is many blocks; only summaries, a row for each block and key, meet by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import written

#: Lines of a block, as a power of two.
BLOCK_BITS = 17
#: Summaries that are put together at once.
FAN = 64
#: Rows that a task sorts, if no key has more.
TASK_ROWS = 1 << 18
_STEPS = "array<struct<low:bigint,exit:bigint,breaks:bigint>>"
_SUMMARY = f"least bigint, total bigint, steps {_STEPS}"


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to tasks of about ``TASK_ROWS``, so that what windows over the key sort in a task doesn't grow with the table.

    A given number of partitions is not coalesced. Rows are counted first, so bring columns that are read, not made. All rows of a key still meet in one task, which spills.
    """
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), key)


def in_lines(rows: DataFrame, key: list[str], order: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """``rows``, written, with ``line`` (ascends with key and order, nulls first) and ``block``."""
    by = [F.asc_nulls_first(c) for c in (*key, *order)]
    # The number of a row holds when a task runs again only once it is written.
    lines = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("line", F.monotonically_increasing_id())
    return written(lines, "lines").withColumn("block", F.shiftright("line", bits))


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    out = a["block"] == b["block"]
    for c in key:
        out &= a[c].eqNullSafe(b[f"of_{c}"])
    return out


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in its key), ``n`` (rows of the key), and what the rows before hold: ``sums`` (0 at first) and ``lasts`` (the last value that isn't null).

    Defined: nulls are a key of their own and come first; ties of the order are numbered in some order, so an order that tells all rows apart gives the same numbers every time.
    """
    sums, lasts = sums or {}, lasts or {}
    lined = in_lines(rows, key, order, bits).withColumns({f"v_{n}": c for n, c in {**sums, **lasts}.items()})
    ends = [F.sum(f"v_{n}").alias(f"b_{n}") for n in sums] + [F.max_by(f"v_{n}", F.when(F.col(f"v_{n}").isNotNull(), F.col("line"))).alias(f"b_{n}") for n in lasts]
    blocks = lined.groupBy("block", *key).agg(F.min("line").alias("first"), F.count("*").alias("c"), *ends)
    so_far = Window.partitionBy(*key).orderBy("block")
    past = so_far.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"shift": F.sum("c").over(so_far) - F.col("c") - F.col("first"), "n": F.sum("c").over(Window.partitionBy(*key))})
    blocks = blocks.withColumns({f"b_{n}": F.coalesce(F.sum(f"b_{n}").over(past), F.lit(0)) for n in sums} | {f"b_{n}": F.last(f"b_{n}", ignorenulls=True).over(past) for n in lasts})
    blocks = written(blocks.select("block", *[F.col(c).alias(f"of_{c}") for c in key], "shift", "n", *[f"b_{n}" for n in (*sums, *lasts)]), "blocks")
    out = lined.join(blocks.withColumnRenamed("block", "of_block"), (lined["block"] == F.col("of_block")) & _all([lined[c].eqNullSafe(F.col(f"of_{c}")) for c in key]))
    inside = Window.partitionBy("block", *key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.coalesce(F.sum(f"v_{n}").over(inside), F.lit(0)) + F.col(f"b_{n}") for n in sums} | {n: F.coalesce(F.last(f"v_{n}", ignorenulls=True).over(inside), f"b_{n}") for n in lasts}
    return out.select(*[lined[c] for c in rows.columns], (F.col("line") + F.col("shift")).alias("pos"), "n", *[c.alias(n) for n, c in found.items()])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


# ---- packing: the state of a sequence is what its open section holds


def _from(sums: np.ndarray, flagged: np.ndarray, start: np.ndarray, limit: int) -> np.ndarray:
    """First pieces that open a section, for sections whose content before piece 0 would be ``start`` (negative: prefix sums that a section begins at)."""
    over = np.searchsorted(sums, limit - start, "right") - 1
    # Half is exceeded in whole characters: 2 * size > limit.
    half = np.searchsorted(2 * sums, limit - 2 * start, "right")
    return np.minimum(over, flagged[np.minimum(half, len(flagged) - 1)])


class Sequence:
    """Pieces of a block in order: where sections open that begin at each of them, and what is open at the end."""

    def __init__(self, sizes: np.ndarray, opens: np.ndarray, limit: int):
        n = self.n = len(sizes)
        self.limit, self.sums = limit, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.where(np.append(opens, True), np.arange(n + 1), n)
        self.flagged = np.minimum.accumulate(at[::-1])[::-1]
        self.next = np.minimum(_from(self.sums, self.flagged, -self.sums[:-1], limit), n)
        # A section that begins at a piece opens no other there, whatever its size.
        self.next = np.maximum(self.next, np.arange(n) + 1)
        self.opens = opens

    def summary(self) -> tuple[int, int, list[dict]]:
        """``least`` content before that makes a section open here, the ``total`` added where none does, and from which content on what is open at the end, after how many new sections."""
        n, limit = self.n, self.limit
        left, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        following = self.next.tolist()
        for j in range(n - 1, -1, -1):
            k = following[j]
            left[j], count[j] = (left[k], count[k] + 1) if k < n else (self.sums[n] - self.sums[j], 1)
        need = limit - self.sums[1:] + 1
        need = np.where(self.opens, np.minimum(need, (limit - 2 * self.sums[:-1]) // 2 + 1), need)
        steps, least = [], limit + 1
        for k in range(n):
            if need[k] < least:
                least = max(0, int(need[k]))
                steps.append({"low": least, "exit": int(left[k]), "breaks": int(count[k])})
                if not least:
                    break
        return least, int(self.sums[n]), steps[::-1]

    def sections(self, content: int, before: int) -> np.ndarray:
        """Section of every piece, with ``content`` open and ``before`` sections opened after the first one."""
        start = np.zeros(self.n + 1, np.int64)
        k = int(min(_from(self.sums, self.flagged, np.array([content]), self.limit)[0], self.n))
        while k < self.n:
            start[k] = 1
            k = int(self.next[k])
        return before + np.cumsum(start[:-1])


def through(content: int, least: int, total: int, steps: list[dict]) -> tuple[int, int]:
    """What is open after a block, and how many sections it opened."""
    if content < least:
        return content + total, 0
    step = next(s for s in reversed(steps) if s["low"] <= content)
    return step["exit"], step["breaks"]


def joined(a: tuple, b: tuple) -> tuple[int, int, list[dict]]:
    """The summary of two blocks in a row."""
    (least, total, steps), (least2, total2, steps2) = a, b
    out = []
    if least2 - total < least:
        # Content that passes the first block whole may open a section in the second.
        for s in steps2:
            low = max(s["low"] - total, 0)
            if low < least:
                while out and out[-1]["low"] >= low:
                    out.pop()
                out.append({"low": low, "exit": s["exit"], "breaks": s["breaks"]})
    for s in steps:
        left, more = through(s["exit"], least2, total2, steps2)
        out.append({"low": s["low"], "exit": left, "breaks": s["breaks"] + more})
    return max(0, min(least, least2 - total)), total + total2, out


def _summaries(table: pa.Table) -> list[tuple]:
    return list(zip(*[table.column(c).to_pylist() for c in ("least", "total", "steps")]))


def packed(pieces: DataFrame, key: str, order: list[str], size: str, opens: str, limit: int, bits: int = BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """``pieces`` with ``section_no``: packed in order, on through the whole of a key.

    A section opens where ``limit`` would be passed, or at a piece with ``opens`` once more than half of it is filled. No piece is longer than ``limit``. What a block does to an open section is a step function
    of its content; these functions are put together in a tree, ``fan`` at a time, and walked down again, so a key's sections are the sequential rule's whatever its length.
    Bring numbers only: texts are joined to the result.

    Defined: a null key is a key of its own; nulls of the order come first; empty pieces stay where they stand; an empty table gives an empty result.
    """
    lined = in_lines(pieces.withColumnRenamed(key, "key"), ["key"], order, bits)
    kind = dict(lined.dtypes)["key"]

    def one(values, table: pa.Table, columns: dict) -> pa.Table:
        return pa.table({"key": table.column("key").slice(0, 1), **{n: pa.array([v], t) for (n, t), v in zip(columns.items(), values)}})

    steps_type = pa.list_(pa.struct([("low", pa.int64()), ("exit", pa.int64()), ("breaks", pa.int64())]))
    long = pa.int64()

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("line")
        s = Sequence(table.column("size").to_numpy(), table.column("opens").to_numpy(), limit).summary()
        return one((table.column("block")[0].as_py(), *s), table, {"block": long, "least": long, "total": long, "steps": steps_type})

    numbers = lined.select("key", "block", "line", F.col(size).cast("bigint").alias("size"), F.coalesce(F.col(opens), F.lit(False)).alias("opens"))
    runs = numbers.groupBy("key", "block").applyInArrow(summarise, f"key {kind}, block bigint, {_SUMMARY}")
    place = (F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1).cast("bigint")
    levels = [written(runs.withColumn("idx", place), "pack-level")]

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        found = _summaries(table)
        out = found[0]
        for s in found[1:]:
            out = joined(out, s)
        return one((table.column("idx")[0].as_py() // fan, *out), table, {"idx": long, "least": long, "total": long, "steps": steps_type})

    while levels[-1].where("idx > 0").limit(1).count():
        up = levels[-1].groupBy("key", F.floor(F.col("idx") / fan).alias("up")).applyInArrow(compose, f"key {kind}, idx bigint, {_SUMMARY}")
        levels.append(written(up, "pack-level"))

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        content, before = table.column("content")[0].as_py(), table.column("before")[0].as_py()
        at = []
        for s in _summaries(table):
            at.append((content, before))
            content, more = through(content, *s)
            before += more
        return pa.table({"key": table.column("key"), "idx": table.column("idx"), "content": pa.array([x for x, _ in at], long), "before": pa.array([x for _, x in at], long)})

    known = levels[-1].select("key", "idx", F.lit(0).cast("bigint").alias("content"), F.lit(0).cast("bigint").alias("before"))
    for level in reversed(levels[:-1]):
        above = known.select(F.col("key").alias("of"), F.col("idx").alias("up"), "content", "before")
        told = level.withColumn("at", F.floor(F.col("idx") / fan)).join(above, (F.col("at") == F.col("up")) & F.col("key").eqNullSafe(F.col("of"))).drop("of", "up")
        known = written(told.groupBy("key", "at").applyInArrow(walk, f"key {kind}, idx bigint, content bigint, before bigint"), "pack-known")

    blocks = levels[0].select("key", "idx", "block").alias("l").join(known.alias("k"), (F.col("l.idx") == F.col("k.idx")) & F.col("l.key").eqNullSafe(F.col("k.key")))
    blocks = written(blocks.select(F.col("l.key").alias("of"), F.col("block").alias("of_block"), "content", "before"), "pack-blocks")

    def assign(table: pa.Table) -> pa.Table:
        table = table.sort_by("line")
        found = Sequence(table.column("size").to_numpy(), table.column("opens").to_numpy(), limit).sections(table.column("content")[0].as_py(), table.column("before")[0].as_py())
        return pa.table({"line": table.column("line"), "section_no": pa.array(found, long)})

    told = numbers.join(blocks, (F.col("block") == F.col("of_block")) & F.col("key").eqNullSafe(F.col("of")))
    sections = told.groupBy("key", "block").applyInArrow(assign, "line bigint, section_no bigint")
    return lined.join(sections, "line").drop("line", "block").withColumnRenamed("key", key)
