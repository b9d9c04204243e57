"""Mosaics, shading and bookmarks against whole pictures and plain loops."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rasters

TILES = "image string, w int, h int, nodata double, tile int, x int, y int, tw int, th int, pix array<double>, v string"


def plain_mosaic(tiles, w, h):
    out = np.full((h, w), np.nan)
    for _, _, _, nodata, _, x, y, tw, th, pix, _ in sorted(tiles, key=lambda t: t[4]):
        for j in range(th):
            for i in range(tw):
                if 0 <= x + i < w and 0 <= y + j < h:
                    q = pix[j * tw + i]
                    out[y + j, x + i] = math.nan if q is None or q == nodata else q
    return out


def plain_shade(e):
    h, w = e.shape
    out = np.full((h, w), np.nan)
    for y in range(h):
        for x in range(w):
            dx = e[y, min(w - 1, x + 1)] - e[y, max(0, x - 1)]
            dy = e[min(h - 1, y + 1), x] - e[max(0, y - 1), x]
            if e[y, x] > 0:
                out[y, x] = math.nan if math.isnan(dx - dy) else max(0.55, min(1.25, 1 - (dx - dy) / 60))
            elif not math.isnan(e[y, x]):
                out[y, x] = 1
    return out


@pytest.mark.parametrize(("w", "h", "side"), [(20, 13, 256), (20, 13, 4), (17, 9, 5), (1, 7, 3), (8, 8, 8)])
def test_mosaics_in_blocks_are_the_whole_picture(spark, w, h, side):
    rng = random.Random(w * h + side)
    tiles = []
    for image in ("a", "b", None):
        for k in range(9):
            tw, th = rng.randrange(1, 9), rng.randrange(1, 7)
            pix = [rng.choice([-9.0, None, rng.uniform(-50, 300), rng.uniform(0, 90), rng.uniform(0, 90)]) for _ in range(tw * th)]
            tiles.append((image, w, h, -9.0 if k % 4 else None, k, rng.randrange(-4, w + 2), rng.randrange(-4, h + 2), tw, th, pix, "clash"))
    odd = [("a", w, h, None, 50, 0, 0, 3, 3, [1.0], "short"), ("a", w, h, None, 51, 0, 0, 0, 3, [], "none"), ("a", w, h, None, 52, None, 0, 1, 1, [1.0], "nowhere"), ("a", w, h, None, 53, 0, 0, 1, 1, None, "null")]
    df = spark.createDataFrame(tiles + odd, TILES).repartition(3)
    got = rasters.pixels(rasters.shaded(rasters.mosaic(df, "image", side), "image", side), "image", ["v", "shade"], side).collect()
    assert {(r.image, r.x, r.y) for r in got} and len({(r.image, r.x, r.y) for r in got}) == len(got)
    for image in ("a", "b", None):
        want = plain_mosaic([t for t in tiles if t[0] == image], w, h)
        shade = plain_shade(want)
        mine = {(r.x, r.y): (r.v, r.shade) for r in got if r.image == image}
        assert set(mine) == {(x, y) for y in range(h) for x in range(w) if not math.isnan(want[y, x])}
        for (x, y), (v, s) in mine.items():
            assert v == want[y, x] and (s is None) == math.isnan(shade[y, x]) and (s is None or abs(s - shade[y, x]) < 1e-12)
    assert rasters.shaded(rasters.mosaic(df.limit(0), "image"), "image").count() == 0


def plain_aligned(marks, lines):
    alnum = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    cursor, out = 0, []
    for m in map(alnum, marks):
        hit = None
        for i in range(cursor, len(lines)):
            h = alnum(lines[i])
            if h and (h == m or (h.endswith(m) and len(h) <= len(m) + 12) or (len(m) > 8 and h.startswith(m) and len(h) <= len(m) + 6)):
                hit = i
                break
        out.append((hit, cursor if hit is None else None))
        cursor = cursor if hit is None else hit + 1
    return out


def test_bookmarks_move_forward(spark):
    rng = random.Random(9)
    words = ["Intro", "duction", "1.2", "Methods", "and", "Results", "of", "the", "A", "...", "—"]
    pages = [(0, [], ["a"]), (1, ["x"], []), (2, ["Methods", "Methods", "Intro"], ["1 Intro", "2. METHODS", "3.1 (Methods) 7", "Methods"])]
    for k in range(3, 60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 12))]
        pages.append((k, [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 3))) if rng.random() < 0.5 else rng.choice(lines)[: rng.randrange(1, 30)] for _ in range(5)], lines))
    df = spark.createDataFrame(pages, "id int, marks array<string>, lines array<string>")
    for r in df.select("id", rasters.aligned(F.col("marks"), F.col("lines")).alias("at")).collect():
        assert [(x.line, x.before) for x in r["at"]] == plain_aligned(pages[r.id][1], pages[r.id][2]), pages[r.id]


def test_previews_need_the_stored_hash(spark):
    from corpusmill.operators.records import previewed, stepped

    structure = spark.createDataFrame([("tensor transformer.a F32[2,3]", "h1"), ("tile 1", "h2"), ("tile 2", None), ("tile 3", "h3"), (None, "h4")], "label string, hash string")
    stored = spark.createDataFrame([("tensor a", "old", 1), ("tensor a", "h1", 2), ("tile 1", "h2", 1), ("tile 1", "x", 2), ("tile 2", "h", 1), ("tile 9", "h", 1)], "label string, hash string, pos int")
    assert sorted((r.label, r.shown) for r in previewed(structure, stored).collect()) == [("tensor transformer.a F32[2,3]", True), ("tile 1", False), ("tile 2", False)]
    rows = spark.createDataFrame([("a", d, i) for i, d in enumerate([3, 3, 30, 12, 7])] + [("b", 5, 9), ("c", None, 1)], "k string, d bigint, e int")
    got = {(r.k, r.d): r.e for r in stepped(rows, "k", "d", 4, F.max("e").alias("e")).collect()}
    assert got == {("a", 3): 1, ("a", 10): None, ("a", 17): None, ("a", 24): None, ("b", 5): 9}
    assert stepped(rows.limit(0), "k", "d", 4, F.max("e").alias("e")).count() == 0 and previewed(structure.limit(0), stored).count() == 0
