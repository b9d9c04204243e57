"""Pictures in blocks: mosaics from tiles that lie anywhere, and stencils whose blocks borrow an edge from their neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a block's side.
SIDE = 256
_DOUBLES = pa.list_(pa.float64())


def _span(at: Column, size: Column, whole: Column, side: int) -> Column:
    """Numbers of the blocks that ``size`` pixels from ``at`` touch, clipped to the picture."""
    first, last = F.greatest(at, F.lit(0)), F.least(at + size, whole) - 1
    return F.when(last >= first, F.sequence(F.floor(first / side), F.floor(last / side))).otherwise(F.array().cast("array<bigint>"))


def mosaic(tiles: DataFrame, image: str, side: int = SIDE) -> DataFrame:
    """``image, w, h, bx, by, v``: blocks of ``side`` pixels and less at the right and lower edge, row by row, of the pictures that ``tiles`` make.

    ``tiles`` has ``image``, ``w, h, nodata`` of its picture and ``tile, x, y, tw, th, pix`` (values row by row). Tiles are clipped to the picture; where they overlap the one with the greatest ``tile`` counts, its ``nodata`` included; a value that is
    ``nodata`` or in no tile is NaN. A tile travels to the blocks that it touches and no further, and a block is the largest group. Defined: tiles of no pixels, with too few values or nulls in their place give nothing; blocks that no tile touches have no row.
    """
    fits = (F.col("tw") > 0) & (F.col("th") > 0) & (F.size("pix") >= F.col("tw") * F.col("th")) & F.col("x").isNotNull() & F.col("y").isNotNull()
    sized = tiles.where(fits).select(F.col(image).alias("image"), *[F.col(c).cast("bigint").alias(c) for c in ("w", "h", "tile", "x", "y", "tw", "th")], F.col("nodata").cast("double").alias("nodata"), F.col("pix").cast("array<double>").alias("pix"))
    placed = sized.withColumn("bx", F.explode(_span(F.col("x"), F.col("tw"), F.col("w"), side))).withColumn("by", F.explode(_span(F.col("y"), F.col("th"), F.col("h"), side)))

    def assemble(table: pa.Table) -> pa.Table:
        bx, by, w, h = (table.column(c)[0].as_py() for c in ("bx", "by", "w", "h"))
        left, top = bx * side, by * side
        out = np.full((min(side, h - top), min(side, w - left)), np.nan)
        for r in table.sort_by("tile").drop_columns(["image"]).to_pylist():
            pix = np.array([np.nan if v is None else v for v in r["pix"][: r["tw"] * r["th"]]], np.float64).reshape(r["th"], r["tw"])
            if r["nodata"] is not None:
                pix = np.where(pix == r["nodata"], np.nan, pix)
            y, x = r["y"] - top, r["x"] - left
            part = pix[max(0, -y) : out.shape[0] - y, max(0, -x) : out.shape[1] - x]
            out[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("image", "w", "h", "bx", "by")}, "v": pa.array([out.ravel()], _DOUBLES)})

    kind = dict(tiles.dtypes)[image]
    return placed.groupBy("image", "bx", "by").applyInArrow(assemble, f"image {kind}, w bigint, h bigint, bx bigint, by bigint, v array<double>").withColumnRenamed("image", image)


def _shade(e: np.ndarray, framed: np.ndarray) -> np.ndarray:
    """Light from the north-west on heights above 0, by differences of neighbours."""
    dx = framed[1:-1, 2:] - framed[1:-1, :-2]
    dy = framed[2:, 1:-1] - framed[:-2, 1:-1]
    # Least and greatest light, and the slope of one step.
    return np.where(e > 0, np.clip(1 - (dx - dy) / 60, 0.55, 1.25), np.where(np.isnan(e), np.nan, 1.0))


def shaded(blocks: DataFrame, image: str, side: int = SIDE) -> DataFrame:
    """``blocks`` (of ``mosaic``) with ``shade``, the light of every pixel; NaN where it or a neighbour that it needs is NaN.

    Each block sends its four edges to its neighbours; a block and the edges it gets are a group. Outside the picture the pixel itself stands in for its neighbour, as it does for a block that isn't there by NaN.
    """
    own = blocks.withColumnRenamed(image, "image").select("image", "w", "h", "bx", "by", F.lit("own").alias("part"), "v")
    width = F.least(F.lit(side).cast("bigint"), F.col("w") - F.col("bx") * side).cast("int")
    height = F.floor(F.size("v") / width).cast("int")
    column = lambda at: F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.get(F.col("v"), i * width + at))
    edge = lambda part, dx, dy, v: F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"), F.lit(part).alias("part"), v.alias("v"))
    edges = F.array(
        edge("left", 1, 0, column(width - 1)),
        edge("right", -1, 0, column(F.lit(0))),
        edge("above", 0, 1, F.slice("v", F.size("v") - width + 1, width)),
        edge("below", 0, -1, F.slice("v", F.lit(1), width)),
    )
    inside = (F.col("bx") >= 0) & (F.col("by") >= 0) & (F.col("bx") * side < F.col("w")) & (F.col("by") * side < F.col("h"))
    sent = own.select("image", "w", "h", F.explode(edges).alias("e")).select("image", "w", "h", "e.bx", "e.by", "e.part", "e.v").where(inside)

    def light(table: pa.Table) -> pa.Table:
        parts = dict(zip(table.column("part").to_pylist(), table.column("v").to_pylist()))
        names = {c: table.column(c).slice(0, 1) for c in ("image", "w", "h", "bx", "by")}
        if "own" not in parts:
            return pa.table({**names, "v": pa.array([None], _DOUBLES), "shade": pa.array([None], _DOUBLES)}).slice(0, 0)
        bx, by, w, h = (names[c][0].as_py() for c in ("bx", "by", "w", "h"))
        e = np.array(parts["own"], np.float64).reshape(-1, min(side, w - bx * side))
        framed = np.pad(e, 1, mode="edge")
        beyond = {"left": bx > 0, "right": (bx + 1) * side < w, "above": by > 0, "below": (by + 1) * side < h}
        places = {"left": np.s_[1:-1, 0], "right": np.s_[1:-1, -1], "above": np.s_[0, 1:-1], "below": np.s_[-1, 1:-1]}
        for part, there in beyond.items():
            if there:
                framed[places[part]] = parts.get(part, np.nan)
        return pa.table({**names, "v": pa.array([parts["own"]], _DOUBLES), "shade": pa.array([_shade(e, framed).ravel()], _DOUBLES)})

    kind = dict(blocks.dtypes)[image]
    schema = f"image {kind}, w bigint, h bigint, bx bigint, by bigint, v array<double>, shade array<double>"
    return own.unionByName(sent).groupBy("image", "bx", "by").applyInArrow(light, schema).withColumnRenamed("image", image)


def pixels(blocks: DataFrame, image: str, values: list[str], side: int = SIDE) -> DataFrame:
    """``image, x, y`` and ``values`` of every pixel that has one in the first of them (NaN is null)."""
    width = F.least(F.lit(side).cast("bigint"), F.col("w") - F.col("bx") * side)
    each = blocks.select(image, "bx", "by", width.alias("width"), F.posexplode(F.arrays_zip(*values)).alias("k", "p"))
    known = lambda c: F.when(~F.isnan(F.col(f"p.{c}")), F.col(f"p.{c}")).alias(c)
    out = each.select(image, (F.col("bx") * side + F.col("k") % F.col("width")).alias("x"), (F.col("by") * side + F.floor(F.col("k") / F.col("width"))).alias("y"), *[known(c) for c in values])
    return out.where(F.col(values[0]).isNotNull())


def letters_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def aligned(marks: Column, lines: Column) -> Column:
    """Where the bookmarks of a page (titles, in order) stand among its lines: ``line`` (null if none fits) and ``before``, the line that a missing title goes before.

    A cursor only moves forward: a title takes the first line from it on whose letters and digits are the title's, end in them after 12 more at most, or, for titles above 8, begin with them before 6 more at most.
    """
    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<line:int,before:int>>").alias("out"))
    have = F.transform(lines, letters_of)

    def take(a: Column, want: Column) -> Column:
        n = F.length(want)
        fits = lambda h: (h != "") & ((h == want) | (h.endswith(want) & (F.length(h) <= n + 12)) | ((n > 8) & h.startswith(want) & (F.length(h) <= n + 6)))
        after = F.filter(F.transform(have, lambda h, i: F.when((i >= a["cursor"]) & fits(h), i)), lambda i: i.isNotNull())
        hit = F.get(after, F.lit(0))
        return F.struct(F.coalesce(hit + 1, a["cursor"]).alias("cursor"), F.concat(a["out"], F.array(F.struct(hit.alias("line"), F.when(hit.isNull(), a["cursor"]).alias("before")))).alias("out"))

    return F.aggregate(F.transform(marks, letters_of), begin, take)["out"]
