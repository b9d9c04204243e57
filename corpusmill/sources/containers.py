"""More structure readers: images, video, scientific arrays and office files, as manifest rows or markdown blocks."""

from __future__ import annotations

import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.html import to_markdown

#: Bytes of each TIFF field type.
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_TIFF_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tiff_directories(data: bytes, most: int = 16) -> list[dict[int, list]]:
    """Fields by tag of each directory of a TIFF or BigTIFF."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{end or '<'}H", data, 2)[0]
    if end is None or version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(end + ("Q" if big else "I"), data, 8 if big else 4)[0]
    out: list[dict[int, list]] = []
    while at and len(out) < most:
        n = struct.unpack_from(end + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        fields = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(end + "HH", data, at)
            count = struct.unpack_from(end + ("Q" if big else "I"), data, at + 4)[0]
            here, room = at + (12 if big else 8), 8 if big else 4
            size = _TIFF_SIZES.get(kind, 1) * count
            place = here if size <= room else struct.unpack_from(end + ("Q" if big else "I"), data, here)[0]
            if kind in (5, 10):
                pairs = struct.unpack_from(f"{end}{2 * count}{'I' if kind == 5 else 'i'}", data, place)
                fields[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            elif kind in _TIFF_CODES:
                fields[tag] = list(struct.unpack_from(f"{end}{count}{_TIFF_CODES[kind]}", data, place))
            at += 20 if big else 12
        out.append(fields)
        at = struct.unpack_from(end + ("Q" if big else "I"), data, at)[0]
    return out


def tiff_reader(data: bytes):
    """Tiles or strips of every level; mask directories are left out."""
    pos = level = 0
    for fields in tiff_directories(data):
        if fields.get(254, [0])[0] & 4:
            continue
        width, height = fields[256][0], fields[257][0]
        tiled = 324 in fields
        offsets, lengths = fields[324 if tiled else 273], fields[325 if tiled else 279]
        across = -(-width // fields[322][0]) if tiled else 1
        for i, (a, n) in enumerate(zip(offsets, lengths)):
            where = f"tile {i % across},{i // across}" if tiled else f"strip {i}"
            yield "tiff", pos, f"level {level} {where}", a, n, json.dumps({"width": width, "height": height, "compression": fields.get(259, [1])[0]})
            pos += 1
        level += 1


def exif_of(data: bytes) -> dict:
    """Make, model, time and place of a JPEG photograph, what is there of them."""
    at = 2
    while data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            block = data[at + 10 : at + 2 + size]
            first = tiff_directories(block, 1)[0]
            text = lambda v: bytes(v).split(b"\0")[0].decode("latin-1") if v else None
            out = {"make": text(first.get(271)), "model": text(first.get(272)), "time": text(first.get(306))}
            if 34853 in first:
                end = "<" if block[:2] == b"II" else ">"
                moved = bytearray(block)
                struct.pack_into(end + "I", moved, 4, first[34853][0])
                gps = tiff_directories(bytes(moved), 1)[0]
                degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
                if 2 in gps and 4 in gps:
                    out["lat"] = degrees(gps[2]) * (-1 if text(gps.get(1)) == "S" else 1)
                    out["lng"] = degrees(gps[4]) * (-1 if text(gps.get(3)) == "W" else 1)
            return out
        at += 2 + size
    return {}


def jpeg_reader(data: bytes, step: int = 1 << 20):
    """Ranges of 1 MiB; the first row tells the camera and place."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    about = json.dumps(exif_of(data), sort_keys=True)
    for pos, at in enumerate(range(0, len(data), step)):
        yield "jpeg", pos, f"bytes {at}", at, min(step, len(data) - at), about if pos == 0 else ""


def boxes(data: bytes, at: int = 0, stop: int | None = None):
    """Kind, start of content and end of every box in a range of an MP4 file."""
    stop = len(data) if stop is None else stop
    while at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        end = stop if size == 0 else at + size
        if end < at + head or end > stop:
            return
        yield kind.decode("latin-1"), at + head, end
        at = end


def _box(data: bytes, span: tuple[int, int], *path: str) -> tuple[int, int] | None:
    for kind in path:
        span = next(((a, b) for k, a, b in boxes(data, *span) if k == kind), None)
        if span is None:
            return None
    return span


def mp4_reader(data: bytes):
    """Groups of pictures of the video track: first sample, bytes, frames; samples are placed by running sums inside chunks."""
    moov = _box(data, (0, len(data)), "moov")
    if moov is None:
        raise ValueError("no moov box")
    video = None
    for kind, a, b in boxes(data, *moov):
        handler = _box(data, (a, b), "mdia", "hdlr") if kind == "trak" else None
        if handler and data[handler[0] + 8 : handler[0] + 12] == b"vide":
            video = _box(data, (a, b), "mdia", "minf", "stbl")
    if video is None:
        raise ValueError("no video track")
    table = lambda kind: _box(data, video, kind)
    ints = lambda at, n: struct.unpack_from(f">{n}I", data, at)
    a = table("stsz")[0]
    fixed, count = ints(a + 4, 2)
    sizes = [fixed] * count if fixed else list(ints(a + 12, count))
    wide = table("co64")
    a = (wide or table("stco"))[0]
    chunks = struct.unpack_from(f">{ints(a + 4, 1)[0]}{'Q' if wide else 'I'}", data, a + 8)
    a = table("stsc")[0]
    runs = [ints(a + 8 + 12 * i, 3) for i in range(ints(a + 4, 1)[0])]
    keys = [1]
    if table("stss"):
        a = table("stss")[0]
        keys = list(ints(a + 8, ints(a + 4, 1)[0]))
    places, sample = [], 0
    for c, start in enumerate(chunks, 1):
        per = next(n for first, n, _ in reversed(runs) if first <= c)
        for size in sizes[sample : sample + per]:
            places.append(start)
            start += size
        sample += per
    for pos, (first, after) in enumerate(zip(keys, [*keys[1:], count + 1])):
        group = range(first - 1, after - 1)
        yield "mp4", pos, f"group {pos}", places[first - 1], sum(sizes[i] for i in group), json.dumps({"frames": len(group)})


def flatgeobuf_nodes(features: int, node_size: int) -> int:
    """Nodes of a packed R-tree: each level has one node for every ``node_size`` below, up to one root."""
    total, level = features, features
    while level > 1:
        level = -(-level // node_size)
        total += level
    return total


def las_reader(data: bytes, block: int = 50_000):
    """Blocks of points of a LAS file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    points, stride = struct.unpack_from("<I", data, 96)[0], struct.unpack_from("<H", data, 105)[0]
    n = struct.unpack_from("<Q", data, 247)[0] if data[25] >= 4 else struct.unpack_from("<I", data, 107)[0]
    for pos, first in enumerate(range(0, n, block)):
        k = min(block, n - first)
        yield "las", pos, f"points {first} to {first + k - 1}", points + first * stride, k * stride, str(stride)


def dicom_reader(data: bytes, step: int = 1 << 20):
    """Blocks of 1 MiB of the pixel data of an explicit little-endian file, with its technical tags."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, tags = 132, {}
    # Rows, columns, bits, slope and intercept.
    wanted = {(0x28, 0x10): "rows", (0x28, 0x11): "columns", (0x28, 0x100): "bits", (0x28, 0x1052): "intercept", (0x28, 0x1053): "slope"}
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        kind = data[at + 4 : at + 6].decode("latin-1")
        long = kind in ("OB", "OW", "OF", "OD", "SQ", "UN", "UT", "UC", "UR")
        size = struct.unpack_from("<I", data, at + 8)[0] if long else struct.unpack_from("<H", data, at + 6)[0]
        start = at + (12 if long else 8)
        if size == 0xFFFFFFFF:
            raise ValueError("a sequence of undefined length")
        if (group, element) == (0x7FE0, 0x10):
            about = json.dumps(tags, sort_keys=True)
            for pos, a in enumerate(range(0, size, step)):
                yield "dicom", pos, f"pixels {a}", start + a, min(step, size - a), about
            return
        if name := wanted.get((group, element)):
            raw = data[start : start + size]
            tags[name] = struct.unpack("<H", raw)[0] if kind == "US" else float(raw.decode("ascii").strip(" \0"))
        at = start + size


def zarr_chunks(meta: dict, most: int = 20_000) -> list[tuple[str, list[int]]]:
    """Keys and coordinates of the chunks of a version 2 array; an even selection if there are more than ``most``."""
    grid = [-(-s // c) for s, c in zip(meta["shape"], meta["chunks"])]
    total = 1
    for n in grid:
        total *= n
    marks = range(total) if total <= most else sorted({int(i * (total - 1) / (most - 1) + 0.5) for i in range(most)})
    out = []
    for index in marks:
        at, rest = [], index
        for n in reversed(grid):
            at.append(rest % n)
            rest //= n
        at.reverse()
        out.append((meta.get("dimension_separator", ".").join(map(str, at)), at))
    return out


# ---- office files: blocks of markdown

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_blocks(data: bytes) -> list[str]:
    """Paragraphs of a document, headings by their style."""
    root, out = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") if style is not None else "") or ""
        depth = 1 if name == "Title" else 2 if name == "Subtitle" else int(m[1]) if (m := re.match(r"Heading([1-6])$", name)) else 0
        if text:
            out.append("#" * depth + " " * bool(depth) + text)
    return out


def pptx_blocks(data: bytes) -> list[str]:
    """A heading for each slide in numeric order, then its other paragraphs."""
    z, out = zipfile.ZipFile(io.BytesIO(data)), []
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        texts = [t for p in ET.fromstring(z.read(name)).iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]
        out += [f"## Slide {number}: {texts[0] if texts else ''}".rstrip(": "), *texts[1:]]
    return out


def xlsx_blocks(data: bytes) -> list[str]:
    """A heading for each sheet, then its rows as comma-separated values without blank ones."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for i, name in enumerate(names, 1):
        out.append(f"# Sheet: {name}")
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                text = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells.append(f'"{text}"' if re.search(r'[",\n]', text) else text)
            if any(cells):
                out.append(",".join(cells))
    return out


def epub_blocks(data: bytes) -> list[str]:
    """Blocks of a book's pages in the order of its spine."""
    z = zipfile.ZipFile(io.BytesIO(data))
    local = lambda root, tag: [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == tag]
    opf = local(ET.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
    book, folder = ET.fromstring(z.read(opf)), opf.rpartition("/")[0]
    pages = {e.get("id"): e.get("href") for e in local(book, "item")}
    out = []
    for ref in local(book, "itemref"):
        path = "/".join(x for x in (folder, pages[ref.get("idref")]) if x)
        out += to_markdown(z.read(path).decode("utf-8", "replace"))[1]
    return out


OFFICE = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks, "epub": epub_blocks}


def office_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``source, block_no, block, error`` of every office file below ``path``, by its ending."""

    def run(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                reader, source = OFFICE.get(name.rsplit(".", 1)[-1].lower()), name.rsplit("/", 1)[-1]
                if reader is None:
                    continue
                try:
                    rows += [(source, i, b, None) for i, b in enumerate(reader(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError) as e:
                    rows.append((source, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["source", "block_no", "block", "error"]).astype({"block_no": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "source string, block_no bigint, block string, error string")
