import gzip
import json
import struct

import pytest

from corpusmill.sources import binary as B


def test_safetensors():
    header = json.dumps({"b": {"dtype": "F32", "shape": [2], "data_offsets": [4, 12]}, "a": {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]}, "__metadata__": {"x": "y"}}).encode()
    rows = list(B.safetensors_reader(struct.pack("<Q", len(header)) + header + bytes(12)))
    base = 8 + len(header)
    assert [(r[2], r[3], r[4]) for r in rows] == [("tensor a F16[2]", base, 4), ("tensor b F32[2]", base + 4, 8)]
    with pytest.raises(ValueError):
        list(B.safetensors_reader(struct.pack("<Q", 1 << 40) + b"{}"))


def test_gguf():
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head = b"GGUF" + struct.pack("<IQQ", 3, 2, 2) + text("general.alignment") + struct.pack("<II", 4, 64) + text("names") + struct.pack("<IIQ", 9, 8, 2) + text("x") + text("y")
    head += text("w") + struct.pack("<IQQIQ", 2, 4, 8, 0, 0) + text("v") + struct.pack("<IQIQ", 1, 4, 0, 128)
    base = -(-len(head) // 64) * 64
    rows = list(B.gguf_reader(head.ljust(base, b"\0") + bytes(144)))
    assert [(r[2], r[3], r[4]) for r in rows] == [("tensor w [4,8]", base, 128), ("tensor v [4]", base + 128, 16)]


def test_netcdf3():
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    none = struct.pack(">ii", 0, 0)
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3)
    variables = struct.pack(">ii", 11, 2) + name("x") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 5, 12, 400) + name("t") + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">iii", 5, 12, 412)
    data = b"CDF\x01" + struct.pack(">i", 2) + dims + none + variables
    assert [(r[2], r[3], r[4]) for r in B.netcdf3_reader(data)] == [("x", 400, 12), ("t record 0", 412, 12), ("t record 1", 424, 12)]


def test_ply_and_ranges_and_playlist():
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 5\nproperty float x\nproperty uchar r\nend_header\n"
    assert [(r[2], r[3], r[4]) for r in B.ply_reader(head + bytes(25), 2)] == [("points 0 to 1", len(head), 10), ("points 2 to 3", len(head) + 10, 10), ("points 4 to 4", len(head) + 20, 5)]
    assert [(r[3], r[4]) for r in B.fixed_ranges_reader(bytes(10), 4)] == [(0, 4), (4, 4), (8, 2)]
    rows = list(B.hls_reader(b"#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:4.0,\na.ts\n#EXTINF:3.5,\nb.ts\n"))
    assert [(r[2], r[5]) for r in rows] == [("segment 7", "a.ts 4.0"), ("segment 8", "b.ts 3.5")]


def test_pmtiles():
    entries = bytes([3, 0, 1, 5, 1, 2, 1, 10, 20, 5, 1, 0, 100])
    root = gzip.compress(entries)
    head = bytearray(127)
    head[:8] = b"PMTiles\x03"
    struct.pack_into("<7Q", head, 8, 127, len(root), 0, 0, 0, 0, 1000)
    head[97] = 2
    rows = list(B.pmtiles_reader(bytes(head) + root))
    assert [(r[2], r[3], r[4]) for r in rows] == [("tile 0", 1000, 10), ("tile 1", 1010, 20), ("tile 6", 1099, 5)]


def test_broken_files_become_errors(spark, tmp_path):
    (tmp_path / "bad.gguf").write_bytes(b"nope")
    rows = B.read_chunks(spark, f"file://{tmp_path}", B.gguf_reader).collect()
    assert len(rows) == 1 and rows[0].error == "not a GGUF file" and rows[0].pos is None


def test_parquet_footers_of_large_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    small, large = tmp_path / "small.parquet", tmp_path / "large.parquet"
    pq.write_table(pa.table({"a": [1, 2, None], "b": ["x", "y", "z"]}), small)
    data = small.read_bytes()
    footer = data[-8 - int.from_bytes(data[-8:-4], "little") :]
    # Three gigabytes without blocks on the disk, more than a binary value holds, then the footer.
    with open(large, "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(footer)
    got = [tuple(r) for r in B.parquet_chunks(spark, str(large)).orderBy("pos").collect()]
    assert got == [tuple(r[:6]) for r in B.parquet_reader(data)] and [r[1] for r in got] == [0, 1]
