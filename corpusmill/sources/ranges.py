"""Byte ranges of large files: a data source whose partitions are ranges, so that a file costs what is asked for.

``spark.read.format("byte_ranges").load(path)`` gives a row for each range with its hash and moments. Files lie where every executor can open them (a shared mount); for other stores
``ranges_of`` falls back on Spark's own reader, which reads a file whole and cuts it in its row.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and the size up to which all ranges of a file are read; of a larger file so many, evenly spread.
STEP = 4 << 20
WHOLE = 256_000_000
SPREAD = 32
#: Ranges of one task.
RANGES_PER_TASK = 8
SCHEMA = "path string, pos bigint, offset bigint, length bigint, hash string, mean double, sd double, least int, greatest int"
_ARROW = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("pos", "offset", "length")], ("hash", pa.string()), ("mean", pa.float64()), ("sd", pa.float64()), ("least", pa.int32()), ("greatest", pa.int32())])


def local_name(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def read_range(path: str, offset: int, length: int) -> bytes:
    """``length`` bytes from ``offset``, fewer at the end of a file; nothing else of it is read."""
    with open(local_name(path), "rb", buffering=0) as f:
        f.seek(offset)
        parts, left = [], length
        while left > 0 and (part := f.read(left)):
            parts.append(part)
            left -= len(part)
    return b"".join(parts)


def described(content: bytes) -> tuple:
    """Hash, mean, population deviation, least and greatest byte; no moments of nothing. Sums are whole numbers, so they are the same however a file is read."""
    name = hashlib.sha256(content).hexdigest()
    if not content:
        return name, None, None, None, None
    counts = np.bincount(np.frombuffer(content, np.uint8), minlength=256).tolist()
    n, total, squares = len(content), sum(i * c for i, c in enumerate(counts)), sum(i * i * c for i, c in enumerate(counts))
    held = [i for i, c in enumerate(counts) if c]
    return name, total / n, max(0, n * squares - total * total) ** 0.5 / n, held[0], held[-1]


def places(size: int, step: int = STEP, whole: int = WHOLE, spread: int = SPREAD) -> list[int]:
    """Which ranges of a file are read: all of one up to ``whole`` bytes, else ``spread`` from the first to the last."""
    n = -(-size // step)
    if size <= whole or n <= spread:
        return list(range(n))
    return sorted({int(i * (n - 1) / max(1, spread - 1) + 0.5) for i in range(spread)})


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.step = int(options.get("step", STEP))
        self.whole, self.spread = int(options.get("whole", WHOLE)), int(options.get("spread", SPREAD))
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            name = local_name(path)
            names = sorted(os.path.join(d, f) for d, _, files in os.walk(name) for f in files if not f.startswith(("_", "."))) if os.path.isdir(name) else [name]
            for file in names:
                size = os.path.getsize(file)
                found += [(file, k, k * self.step, min(self.step, size - k * self.step)) for k in places(size, self.step, self.whole, self.spread)]
        return [_Ranges(found[i : i + RANGES_PER_TASK]) for i in range(0, len(found), RANGES_PER_TASK)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for path, pos, offset, length in partition.ranges:
            content = read_range(path, offset, length)
            row = (path, pos, offset, len(content), *described(content))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW.types)], schema=_ARROW)


class ByteRanges(DataSource):
    """Options: ``path`` (a file or folder) or ``paths`` (JSON list), ``step``, ``whole``, ``spread``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def ranges_of(spark: SparkSession, path: str, step: int = STEP, whole: int = WHOLE, spread: int = SPREAD) -> DataFrame:
    """The ranges of a file, or of the files in a folder, with hashes and moments (columns of ``SCHEMA``). An empty file has none."""
    if "://" in path and not path.startswith("file:"):
        return _from_whole_files(spark, path, step, whole, spread)
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(step=step, whole=whole, spread=spread).load(path)


def _from_whole_files(spark: SparkSession, path: str, step: int, whole: int, spread: int) -> DataFrame:
    """The same rows from files that only Spark can open; each is read whole."""
    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for k in places(len(content), step, whole, spread):
                    part = content[k * step : (k + 1) * step]
                    row = (name, k, k * step, len(part), *described(part))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW.types)], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, SCHEMA)


def rechecked(stored: DataFrame) -> DataFrame:
    """``path, pos, state`` of stored rows (``path, pos, offset, length, hash``) by reading just their bytes again: same, changed, short, or gone with its file. A null path is gone, a null hash changed."""

    def run(batches):
        for batch in batches:
            states = []
            for path, offset, length, name in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length", "hash")]):
                if path is None or not os.path.exists(local_name(path)):
                    states.append("gone")
                    continue
                content = read_range(path, offset, length)
                states.append("short" if len(content) < length else "same" if hashlib.sha256(content).hexdigest() == name else "changed")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("pos"), pa.array(states, pa.string())], names=["path", "pos", "state"])

    rows = stored.select("path", F.col("pos").cast("bigint").alias("pos"), F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"), "hash")
    return rows.mapInArrow(run, "path string, pos bigint, state string")
