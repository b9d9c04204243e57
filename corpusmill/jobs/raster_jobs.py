"""Jobs on pictures and pages with bookmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import one_line
from corpusmill.jobs.registry import Registry
from corpusmill.operators import rasters
from corpusmill.sources.tables import table

jobs = Registry()

#: Pixels of a picture's sides, of a tile's side, and from one tile to the next; tiles overlap by one and stand out on the right and below.
W, H, TILE, APART, SIDE = 38, 35, 4, 3, 8


@jobs.query(
    f"""
WITH r AS (SELECT event_type AS image, user_id, floor(value) - 200 AS v, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS k FROM events WHERE value IS NOT NULL),
p AS (SELECT image, user_id AS tile, (user_id % 13) * {APART} + k % {TILE} AS x, (user_id // 13) * {APART} + k // {TILE} AS y, v FROM r WHERE k < {TILE * TILE}),
a AS (SELECT image, user_id AS tile, (user_id % 13) * {APART} + k % {TILE} AS x, (user_id // 13) * {APART} + k // {TILE} AS y FROM (SELECT DISTINCT image, user_id FROM r), range({TILE * TILE}) g(k)),
m AS (SELECT image, x, y, max(tile) AS tile FROM a WHERE x < {W} AND y < {H} GROUP BY ALL),
e AS (SELECT m.image, m.x, m.y, CASE WHEN p.v <> -100 THEN p.v END AS v FROM m LEFT JOIN p ON p.image = m.image AND p.tile = m.tile AND p.x = m.x AND p.y = m.y),
n AS (SELECT e.*, r.v - l.v AS dx, b.v - t.v AS dy FROM e LEFT JOIN e r ON r.image = e.image AND r.y = e.y AND r.x = least({W - 1}, e.x + 1) LEFT JOIN e l ON l.image = e.image AND l.y = e.y AND l.x = greatest(0, e.x - 1)
      LEFT JOIN e b ON b.image = e.image AND b.x = e.x AND b.y = least({H - 1}, e.y + 1) LEFT JOIN e t ON t.image = e.image AND t.x = e.x AND t.y = greatest(0, e.y - 1))
SELECT image, x::BIGINT AS x, y::BIGINT AS y, v, CASE WHEN v <= 0 THEN 1.0 ELSE round(CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN greatest(0.55, least(1.25, 1 - (dx - dy) / 60)) END, 9) END::DOUBLE AS shade FROM n WHERE v IS NOT NULL"""
)
def mosaic_shading(spark, sf_dir):
    """Pictures of every kind of event: a user's first sixteen values are a tile, tiles overlap and are clipped, and heights are lit from the north-west."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    from corpusmill.operators.ledger import first_rows

    first = first_rows(events, ["event_type", "user_id"], TILE * TILE, F.col("event_id")).groupBy("event_type", "user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.floor("value") - 200).cast("double").alias("v")))), lambda p: p["v"]).alias("known"))
    pix = F.concat("known", F.array_repeat(F.lit(None).cast("double"), F.lit(TILE * TILE) - F.size("known")))
    tiles = first.select(
        F.col("event_type").alias("image"), F.lit(W).alias("w"), F.lit(H).alias("h"), F.lit(-100.0).alias("nodata"), F.col("user_id").alias("tile"), (F.col("user_id") % 13 * APART).alias("x"), (F.floor(F.col("user_id") / 13) * APART).alias("y"), F.lit(TILE).alias("tw"), F.lit(TILE).alias("th"), pix.alias("pix")
    )
    lit = rasters.pixels(rasters.shaded(rasters.mosaic(tiles, "image", SIDE), "image", SIDE), "image", ["v", "shade"], SIDE)
    return lit.withColumn("shade", F.round("shade", 9))


_LETTERS = "regexp_replace(lower({t}), '[^a-z0-9]', '', 'g')"


@jobs.query(
    f"""
WITH RECURSIVE p AS (SELECT page_id, html, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?is)<(head|script|style)[^>]*>.*?</(head|script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages),
h AS (SELECT page_id, lines, list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) || regexp_extract_all(html, '(?is)<a [^>]*>([^<]*)</a>', 1) || regexp_extract_all(html, '(?is)<b>(.*?)</b>', 1) || [left(lines[len(lines)], 12), 'no such title'], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS marks FROM p),
w AS (SELECT page_id, 0 AS k, 0 AS cur, NULL::BIGINT AS line, NULL::BIGINT AS before, list_transform(lines, lambda x: {_LETTERS.replace("{t}", "x")}) AS have, list_transform(marks, lambda x: {_LETTERS.replace("{t}", "x")}) AS want, marks FROM h
      UNION ALL SELECT page_id, k + 1, coalesce(hit + 1, cur), hit, CASE WHEN hit IS NULL THEN cur END, have, want, marks FROM (
        SELECT *, list_min(list_filter(range(cur, len(have)), lambda i: have[i + 1] <> '' AND (have[i + 1] = want[k + 1] OR (suffix(have[i + 1], want[k + 1]) AND len(have[i + 1]) <= len(want[k + 1]) + 12) OR (len(want[k + 1]) > 8 AND prefix(have[i + 1], want[k + 1]) AND len(have[i + 1]) <= len(want[k + 1]) + 6)))) AS hit FROM w WHERE k < len(want)))
SELECT page_id, k - 1 AS mark, marks[k] AS title, line, before::BIGINT AS before FROM w WHERE k > 0"""
)
def bookmark_lines(spark, sf_dir):
    """Titles, links and bold runs of every page as its bookmarks, placed among its lines by a cursor that only moves forward."""
    html = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, "(?is)<(head|script|style)[^>]*>.*?</(head|script|style)>", "\n"), "<[^>]*>", "\n")
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.filter(F.transform(F.split(plain, "\n+"), one_line), lambda x: x != "").alias("lines"))
    found = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    marks = F.concat(found("(?is)<h1[^>]*>(.*?)</h1>"), found("(?is)<a [^>]*>([^<]*)</a>"), found("(?is)<b>(.*?)</b>"), F.array(F.left(F.element_at("lines", -1), F.lit(12)), F.lit("no such title")))
    placed = pages.select("page_id", F.transform(marks, one_line).alias("marks"), "lines").select("page_id", "marks", rasters.aligned(F.col("marks"), F.col("lines")).alias("at"))
    each = placed.select("page_id", F.posexplode(F.arrays_zip("marks", "at")).alias("mark", "m"))
    return each.select("page_id", F.col("mark").cast("bigint").alias("mark"), F.col("m.marks").alias("title"), F.col("m.at.line").cast("bigint").alias("line"), F.col("m.at.before").cast("bigint").alias("before"))
