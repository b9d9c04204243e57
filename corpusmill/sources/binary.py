"""Structure readers for binary files: every chunk of a file as a manifest row, from headers alone.

Files arrive through Spark's ``binaryFile`` source, so any store that Spark reads will do. A file that can't be parsed gives one row
whose ``error`` tells why.
"""

from __future__ import annotations

import io
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.ranges import local_name

CHUNKS = "source string, kind string, pos bigint, label string, offset bigint, length bigint, detail string, error string"


def _rows_of(reader, by_name: bool = False):
    """Rows of files by their content, or by their name where tasks can open them."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], map(local_name, pdf["path"]) if by_name else map(bytes, pdf["content"])):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows += [(name, *row, None) for row in reader(content)]
                except (ValueError, KeyError, struct.error, IndexError, zlib.error, UnicodeDecodeError) as e:
                    rows.append((name, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")]).astype({"pos": "Int64", "offset": "Int64", "length": "Int64"})

    return run


def read_chunks(spark: SparkSession, path: str, reader) -> DataFrame:
    """Manifest rows of all files at ``path`` by ``reader`` (bytes to rows of kind, pos, label, offset, length, detail)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(_rows_of(reader), CHUNKS)


def parquet_reader(data: bytes | str):
    """Column chunks with codec, values and null counts, of a file's content or of a file by its name; of the latter only the footer is read."""
    import pyarrow.parquet as pq

    meta, pos = pq.read_metadata(io.BytesIO(data) if isinstance(data, bytes) else data), 0
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            x = meta.row_group(g).column(c)
            start = x.dictionary_page_offset or x.data_page_offset
            nulls = x.statistics.null_count if x.is_stats_set and x.statistics.has_null_count else None
            yield "parquet", pos, f"row group {g} {x.path_in_schema}", start, x.total_compressed_size, json.dumps({"codec": x.compression, "values": x.num_values, "nulls": nulls})
            pos += 1


def parquet_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Column chunks of all Parquet files at ``path``. Where executors can open the files, a task reads their footers alone; of other stores Spark's reader gives whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    if all(r.path.startswith("file:") for r in files.limit(1).collect()):
        found = files.mapInPandas(_rows_of(parquet_reader, by_name=True), CHUNKS)
    else:
        found = read_chunks(spark, path, parquet_reader)
    return found.select("kind", "pos", "label", "offset", "length", "detail")


def safetensors_reader(data: bytes):
    """Tensors in order of their offsets."""
    (size,) = struct.unpack_from("<Q", data)
    if size > min(len(data) - 8, 50_000_000):
        raise ValueError("header longer than the file or than 50 MB")
    header = json.loads(data[8 : 8 + size])
    tensors = sorted(((k, v) for k, v in header.items() if k != "__metadata__"), key=lambda kv: kv[1]["data_offsets"][0])
    for pos, (name, t) in enumerate(tensors):
        a, b = t["data_offsets"]
        shape = ",".join(map(str, t["shape"]))
        yield "safetensors", pos, f"tensor {name} {t['dtype']}[{shape}]", 8 + size + a, b - a, t["dtype"]


def netcdf3_reader(data: bytes):
    """Fixed variables as one chunk, record variables as one chunk a record."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    wide, at = data[3] == 5, 4

    def number(fmt: str) -> int:
        nonlocal at
        (x,) = struct.unpack_from(">" + fmt, data, at)
        at += struct.calcsize(fmt)
        return x

    count = lambda: number("q" if wide else "i")

    def name() -> str:
        nonlocal at
        n = count()
        text = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return text

    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8, 7: 1, 8: 2, 9: 4, 10: 8, 11: 8}

    def attributes() -> None:
        nonlocal at
        number("i")
        for _ in range(count()):
            name()
            kind = number("i")
            at += -(-count() * sizes[kind] // 4) * 4

    records = count()
    number("i")
    dims = [(name(), count()) for _ in range(count())]
    attributes()
    number("i")
    variables = []
    for _ in range(count()):
        label = name()
        ids = [count() for _ in range(count())]
        attributes()
        kind, size = number("i"), count()
        begin = number("i" if data[3] == 1 else "q")
        variables.append((label, ids, kind, size, begin))
    is_record = lambda v: bool(v[1]) and dims[v[1][0]][1] == 0
    record_vars = [v for v in variables if is_record(v)]
    step = sum(v[3] for v in record_vars)
    pos = 0
    for v in variables:
        for r in range(records if is_record(v) else 1):
            yield "netcdf3", pos, f"{v[0]} record {r}" if is_record(v) else v[0], v[4] + r * step if is_record(v) else v[4], v[3], str(v[2])
            pos += 1


def ply_reader(data: bytes, block: int = 65_536):
    """Blocks of packed vertices of a little-endian PLY file."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    header = data[:end].decode("ascii").split("\n")
    if "format binary_little_endian 1.0" not in header:
        raise ValueError("only little-endian PLY")
    sizes = {"char": 1, "uchar": 1, "int8": 1, "uint8": 1, "short": 2, "ushort": 2, "int16": 2, "uint16": 2, "int": 4, "uint": 4, "int32": 4, "uint32": 4, "float": 4, "float32": 4, "double": 8, "float64": 8}
    n = next(int(x.split()[2]) for x in header if x.startswith("element vertex "))
    stride = sum(sizes[x.split()[1]] for x in header if x.startswith("property "))
    for pos, first in enumerate(range(0, n, block)):
        k = min(block, n - first)
        yield "ply", pos, f"points {first} to {first + k - 1}", end + first * stride, k * stride, str(stride)


def fixed_ranges_reader(data: bytes, step: int = 4 << 20):
    """Ranges of a file of unknown structure."""
    for pos, at in enumerate(range(0, len(data), step)):
        yield "ranges", pos, f"bytes {at}", at, min(step, len(data) - at), ""


def hls_reader(data: bytes):
    """Segments of a media playlist, named by sequence number; the durations add up in ``detail``."""
    lines = [x.strip() for x in data.decode().splitlines()]
    if not lines or lines[0] != "#EXTM3U":
        raise ValueError("not a playlist")
    first = next((int(x.split(":")[1]) for x in lines if x.startswith("#EXT-X-MEDIA-SEQUENCE:")), 0)
    length, pos = "", 0
    for x in lines:
        if x.startswith("#EXTINF:"):
            length = x[8:].split(",")[0]
        elif x and not x.startswith("#"):
            yield "hls", pos, f"segment {first + pos}", None, None, f"{x} {length}"
            pos += 1


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned base-128 number and the place after it."""
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def pmtiles_reader(data: bytes):
    """Tiles of the root directory of a version 3 archive."""
    import gzip

    if data[:7] != b"PMTiles" or data[7] != 3:
        raise ValueError("not a PMTiles version 3 archive")
    root, size, _, _, _, _, tiles = struct.unpack_from("<7Q", data, 8)
    raw = data[root : root + size]
    directory = gzip.decompress(raw) if data[97] == 2 else raw
    n, at = varint(directory, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            x, at = varint(directory, at)
            column.append(x)
        columns.append(column)
    tile = end = 0
    for pos, (delta, run, length, place) in enumerate(zip(*columns)):
        tile += delta
        # 0 means directly after the tile before; other places are stored plus one.
        start = end if place == 0 and pos else place - 1
        end = start + length
        yield "pmtiles", pos, f"tile {tile}" if run else f"leaf {tile}", tiles + start, length, str(run)


def gguf_reader(data: bytes):
    """Tensors of a GGUF file; lengths run to the next tensor, or to the end."""
    if data[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    version, tensors, pairs = struct.unpack_from("<IQQ", data, 4)
    if version < 2:
        raise ValueError("GGUF version below 2")
    at = 24

    def number(fmt: str):
        nonlocal at
        (x,) = struct.unpack_from("<" + fmt, data, at)
        at += struct.calcsize("<" + fmt)
        return x

    def text() -> str:
        nonlocal at
        n = number("Q")
        at += n
        return data[at - n : at].decode()

    scalars = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}

    def value(kind: int):
        if kind == 8:
            return text()
        if kind == 9:
            inner = number("I")
            return [value(inner) for _ in range(number("Q"))]
        return number(scalars[kind])

    meta = {}
    for _ in range(pairs):
        key = text()
        meta[key] = value(number("I"))
    found = []
    for _ in range(tensors):
        name = text()
        shape = [number("Q") for _ in range(number("I"))]
        found.append((name, shape, number("I"), number("Q")))
    align = meta.get("general.alignment", 32)
    base = -(-at // align) * align
    found.sort(key=lambda t: t[3])
    for pos, (name, shape, kind, offset) in enumerate(found):
        stop = found[pos + 1][3] if pos + 1 < len(found) else len(data) - base
        yield "gguf", pos, f"tensor {name} [{','.join(map(str, shape))}]", base + offset, stop - offset, str(kind)
