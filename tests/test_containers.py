import io
import struct
import zipfile

import pytest

from corpusmill.sources import containers as C


def tiff(entries, data=b""):
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        body += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")[:4]
    return body + struct.pack("<I", 0) + data


def test_tiff_strips():
    rows = list(C.tiff_reader(tiff([(256, 3, [10]), (257, 3, [20]), (273, 4, [200]), (279, 4, [50])])))
    assert [(r[2], r[3], r[4]) for r in rows] == [("level 0 strip 0", 200, 50)]
    with pytest.raises(ValueError):
        list(C.tiff_reader(b"XX*\0" + bytes(20)))


def test_jpeg_tells_its_camera():
    exif = tiff([(271, 2, [])])[:10] + struct.pack("<HHI", 271, 2, 3) + b"Ab\0\0" + struct.pack("<I", 0)
    app1 = b"Exif\0\0" + exif
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"
    (row,) = C.jpeg_reader(data)
    assert '"make": "Ab"' in row[5] and row[4] == len(data)


def test_mp4_groups():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    full = lambda kind, body: box(kind, bytes(4) + body)
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", full(b"stsz", ints(0, 4, 10, 20, 30, 40)) + full(b"stco", ints(2, 1000, 2000)) + full(b"stsc", ints(1, 1, 2, 1)) + full(b"stss", ints(2, 1, 4)))
    hdlr = full(b"hdlr", bytes(4) + b"vide" + bytes(12))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", hdlr + box(b"minf", stbl))))
    assert [(r[2], r[3], r[4], r[5]) for r in C.mp4_reader(data)] == [("group 0", 1000, 60, '{"frames": 3}'), ("group 1", 2030, 40, '{"frames": 1}')]


def test_las_dicom_tree_and_zarr():
    head = bytearray(375)
    head[:4], head[25] = b"LASF", 4
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<H", head, 105, 30)
    struct.pack_into("<Q", head, 247, 5)
    assert [(r[3], r[4]) for r in C.las_reader(bytes(head), 3)] == [(375, 90), (465, 60)]
    tag = lambda g, e, vr, v: struct.pack("<HH2sH", g, e, vr, len(v)) + v
    data = bytes(128) + b"DICM" + tag(0x28, 0x10, b"US", struct.pack("<H", 4)) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 32) + bytes(32)
    assert [(r[2], r[3], r[4], r[5]) for r in C.dicom_reader(data)] == [("pixels 0", len(data) - 32, 32, '{"rows": 4}')]
    assert C.flatgeobuf_nodes(16, 16) == 17 and C.flatgeobuf_nodes(17, 16) == 17 + 2 + 1
    assert [k for k, _ in C.zarr_chunks({"shape": [5, 4], "chunks": [2, 4]})] == ["0.0", "1.0", "2.0"]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w, a, s = (f'xmlns:x="{u[1:-1]}"' for u in (C._W, C._A, C._S))
    docx = zipped({"word/document.xml": f'<x:d {w}><x:p><x:pPr><x:pStyle x:val="Heading2"/></x:pPr><x:t>Head</x:t></x:p><x:p><x:t>a</x:t><x:t>b</x:t></x:p><x:p/></x:d>'})
    pptx = zipped({f"ppt/slides/slide{i}.xml": f"<x:s {a}><x:p><x:t>T{i}</x:t></x:p><x:p><x:t>more</x:t></x:p></x:s>" for i in (10, 2)})
    xlsx = zipped({"xl/workbook.xml": f'<x:w {s}><x:sheet name="One"/></x:w>', "xl/sharedStrings.xml": f"<x:t {s}><x:si><x:t>a,b</x:t></x:si></x:t>", "xl/worksheets/sheet1.xml": f'<x:w {s}><x:row><x:c t="s"><x:v>0</x:v></x:c><x:c><x:v>2</x:v></x:c></x:row><x:row/></x:w>'})
    epub = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/b.opf"/></c>', "o/b.opf": '<p><item id="2" href="z.html"/><item id="1" href="a.html"/><itemref idref="2"/><itemref idref="1"/></p>', "o/a.html": "<p>last</p>", "o/z.html": "<h1>First</h1>"})
    for name, body in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.epub", epub), ("e.docx", b"broken"), ("f.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    rows = C.office_blocks(spark, f"file://{tmp_path}").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.source, r.block_no or 0)):
        got.setdefault(r.source, []).append(r.block if r.error is None else "error")
    assert got == {"a.docx": ["## Head", "ab"], "b.pptx": ["## Slide 2: T2", "more", "## Slide 10: T10", "more"], "c.xlsx": ["# Sheet: One", '"a,b",2'], "d.epub": ["# First", "last"], "e.docx": ["error"]}
