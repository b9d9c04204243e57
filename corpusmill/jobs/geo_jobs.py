"""Jobs on facts, grids and places; events stand for facts, customers for cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import geo
from corpusmill.jobs.registry import Registry
from corpusmill.operators import grids
from corpusmill.sources.tables import table, written

jobs = Registry()


@jobs.query("SELECT user_id, event_type, round(arg_max(value, {'ts': ts, 'event_id': event_id}), 6) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latest_per_key(spark, sf_dir):
    """Last value of every cell and band."""
    found = grids.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts", "event_id")
    return found.select("user_id", "event_type", F.round("value", 6).alias("value"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@jobs.query("SELECT event_id, round(lag(value) OVER w, 6) AS previous, round(value - lag(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def delta_prev_now(spark, sf_dir):
    """Change of every fact against the one before it."""
    found = grids.changes(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts", "event_id")
    return found.select("event_id", F.round("previous", 6).alias("previous"), F.round("delta", 6).alias("delta"))


@jobs.query(
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, 0::BIGINT AS skipped, CASE WHEN count(*) >= 8 AND var_pop(l_quantity) * count(*) > 1e-12 AND var_pop(l_extendedprice) * count(*) > 1e-12 THEN round(corr(l_quantity, l_extendedprice), 6) END AS r
FROM lineitem GROUP BY ALL"""
)
def pearson_guarded(spark, sf_dir):
    r = grids.pearson(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "l_linestatus", "n", "skipped", F.round("r", 6).alias("r"))


@jobs.query(
    """
SELECT l_returnflag, count_if(l_quantity >= 10)::BIGINT AS forest, count_if(l_quantity >= 10 AND year(l_shipdate) < 1996)::BIGINT AS before, count_if(l_quantity >= 10 AND year(l_shipdate) >= 1996)::BIGINT AS after, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL"""
)
def threshold_counts(spark, sf_dir):
    """Cells above a threshold, split at a year; two-digit years are of this century, none is no loss."""
    year = F.year("l_shipdate") % 100 + 1900
    lines = table(spark, sf_dir, "lineitem").withColumn("loss", F.when(year > 0, F.when(year < 100, year + 2000).otherwise(F.year("l_shipdate"))))
    forest = F.col("l_quantity") >= 10
    return lines.groupBy("l_returnflag").agg(
        F.count_if(forest).alias("forest"), F.count_if(forest & (F.col("loss") < 1996)).alias("before"), F.count_if(forest & (F.col("loss") >= 1996)).alias("after"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")
    )


@jobs.query(
    """
SELECT p_brand, count(*) AS n, round(avg(CASE WHEN l_extendedprice + p_retailprice <> 0 THEN (l_extendedprice - p_retailprice) / (l_extendedprice + p_retailprice) END), 6) AS index, round(max(abs(l_extendedprice - p_retailprice * l_quantity)), 4) AS gap
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""
)
def cross_check_gap(spark, sf_dir):
    """Normalised difference of two bands, and the widest gap between two sources of one value."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a, b = F.col("l_extendedprice"), F.col("p_retailprice")
    index = F.when(a + b != 0, (a - b) / F.when(a + b != 0, a + b))
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(index), 6).alias("index"), F.round(F.max(F.abs(a - b * F.col("l_quantity"))), 4).alias("gap"))


@jobs.query(
    """
SELECT event_id, CASE WHEN event_type = 'view' THEN round(value - 273.15, 6) ELSE round(value, 6) END AS value, CASE WHEN value / 500 > 0.5 THEN 'dense' WHEN value / 500 > 0.3 THEN 'moderate' WHEN value / 500 > 0.1 THEN 'sparse' ELSE 'little or none' END AS cover,
  coalesce(MAP {10: 'tree cover', 20: 'shrubland', 30: 'grassland', 40: 'cropland', 50: 'built-up', 60: 'bare or sparse vegetation', 70: 'snow and ice', 80: 'permanent water', 90: 'herbaceous wetland', 95: 'mangroves', 100: 'moss and lichen'}[(floor(value / 50) * 10)::INT], 'class ' || (floor(value / 50) * 10)::INT) AS ground FROM events"""
)
def class_codes(spark, sf_dir):
    """Kelvin to Celsius where the unit says so, vegetation classes and land-cover names."""
    # Land-cover classes.
    names = {10: "tree cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built-up", 60: "bare or sparse vegetation", 70: "snow and ice", 80: "permanent water", 90: "herbaceous wetland", 95: "mangroves", 100: "moss and lichen"}
    v, x = F.col("value"), F.col("value") / 500
    code = (F.floor(v / 50) * 10).cast("int")
    ground = F.coalesce(F.create_map(*[F.lit(y) for pair in names.items() for y in pair])[code], F.concat(F.lit("class "), code.cast("string")))
    cover = F.when(x > 0.5, "dense").when(x > 0.3, "moderate").when(x > 0.1, "sparse").otherwise("little or none")
    unit = F.when(F.col("event_type") == "view", F.lit("kelvin")).otherwise(F.lit("index"))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(unit.rlike("(?i)kelvin"), v - 273.15).otherwise(v), 6).alias("value"), cover.alias("cover"), ground.alias("ground"))


@jobs.query(
    """
WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL),
l AS (SELECT event_type, max(value) FILTER (i = floor(n * 0.02::DOUBLE)) AS lo, max(value) FILTER (i = floor(n * 0.98::DOUBLE)) AS hi FROM r GROUP BY event_type)
SELECT event_id, floor(power(greatest(0, least(1, (value - lo) / (hi - lo))), 0.8) * 255 + 0.5)::BIGINT AS level FROM events JOIN l USING (event_type) WHERE value IS NOT NULL"""
)
def percentile_stretch(spark, sf_dir):
    """Grey levels of values between the 2nd and 98th percentile of their band."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "event_type", "value")
    limits = grids.percentile_limits(events, ["event_type"], "value")
    return events.join(limits, "event_type").select("event_id", grids.stretch(F.col("value"), F.col("lo"), F.col("hi")).alias("level"))


@jobs.query(
    """
WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, abs(embedding[4]::DOUBLE) AS opacity FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM p),
t AS (SELECT * FROM r WHERE pos % greatest(1, n // 10) = 0 AND opacity >= 0.05),
a AS (SELECT label, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, avg(opacity) AS mean FROM t GROUP BY label)
SELECT label, points, min_x, max_x, min_y, max_y, min_z, max_z, round(mean, 6) AS mean, xs[floor(points * 0.03::DOUBLE)::INT + 1] AS x_lo, xs[floor(points * 0.97::DOUBLE)::INT + 1] AS x_hi, ys[floor(points * 0.03::DOUBLE)::INT + 1] AS y_lo, ys[floor(points * 0.97::DOUBLE)::INT + 1] AS y_hi FROM a"""
)
def point_extents(spark, sf_dir):
    """Vectors as point clouds of their labels: thinned, boxed, and cut to the 3rd and 97th percentile seen from above."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.abs(at(3)).alias("opacity"))
    thin = written(grids.thinned(points, ["label"], ["vec_id"], 10, "opacity"), "points")
    out = grids.boxes(thin, ["label"], ["x", "y", "z"], "opacity").withColumn("mean", F.round("mean", 6))
    for axis in "xy":
        ends = grids.percentile_limits(thin, ["label"], axis, 0.03, 0.97).select(F.col("label").alias("of"), F.col("lo").alias(f"{axis}_lo"), F.col("hi").alias(f"{axis}_hi"))
        out = out.join(ends, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return out


@jobs.query(
    """
SELECT event_id, floor(CASE WHEN x <= 0 THEN 68 WHEN x < 0.25 THEN 68 + (x - 0) / 0.25 * (59 - 68) WHEN x < 0.5 THEN 59 + (x - 0.25) / 0.25 * (33 - 59) WHEN x < 0.75 THEN 33 + (x - 0.5) / 0.25 * (94 - 33) WHEN x < 1 THEN 94 + (x - 0.75) / 0.25 * (253 - 94) ELSE 253 END + 0.5)::BIGINT AS red FROM (SELECT event_id, value / 500 AS x FROM events)"""
)
def colour_ramp(spark, sf_dir):
    """Red channel of a five-stop ramp."""
    # Stops of a perceptual ramp.
    stops = [(0.0, 68), (0.25, 59), (0.5, 33), (0.75, 94), (1.0, 253)]
    return table(spark, sf_dir, "events").select("event_id", geo.ramp(F.col("value") / 500, stops).alias("red"))


@jobs.query("SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def scenes_in_all_bands(spark, sf_dir):
    """Scenes that three bands have."""
    return grids.in_all_bands(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@jobs.query(
    """
WITH m AS (SELECT c_nationkey, c_custkey, EXISTS (FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS member FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, member ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey, member) AS n FROM m)
SELECT c_nationkey, member, n, count(*) AS sampled, min(c_custkey) AS first FROM r WHERE i % greatest(1, ceil(n / 6)) = 0 AND i // greatest(1, ceil(n / 6)) < 6 GROUP BY c_nationkey, member, n"""
)
def grid_members_missing(spark, sf_dir):
    """Cells of each grid (nation) with and without a fact, and an evenly stepped sample of six of each."""
    from pyspark.sql import Window

    cells, bought = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    marked = cells.join(bought, "c_custkey", "left_semi").withColumn("member", F.lit(True)).unionByName(cells.join(bought, "c_custkey", "left_anti").withColumn("member", F.lit(False)))
    w = Window.partitionBy("c_nationkey", "member")
    ranked = marked.withColumns({"i": F.row_number().over(w.orderBy("c_custkey")) - 1, "n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / 6))
    return ranked.where((F.pmod(F.col("i"), step) == 0) & (F.floor(F.col("i") / step) < 6)).groupBy("c_nationkey", "member", "n").agg(F.count("*").alias("sampled"), F.min("c_custkey").alias("first"))


_D = "(epoch(ts) / 86400.0 + 2440587.5 - 2451545.0)"


@jobs.query(
    f"""
WITH p AS (SELECT event_id, (user_id % 120 - 60)::DOUBLE AS lat, (user_id % 300 - 150)::DOUBLE AS lng, {_D} AS d FROM events),
g AS (SELECT *, radians(357.529 + 0.98560028 * d) AS g FROM p), e AS (SELECT *, radians(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.02 * sin(2 * g)) AS l, radians(23.439 - 3.6e-7 * d) AS t FROM g),
s AS (SELECT *, atan2(cos(t) * sin(l), cos(l)) AS ra, asin(sin(t) * sin(l)) AS de FROM e), h AS (SELECT *, radians(fmod(18.697374558 + 24.06570982441908 * d, 24) * 15 + lng) - ra AS ha, radians(lat) AS la FROM s)
SELECT event_id, round(degrees(asin(sin(la) * sin(de) + cos(la) * cos(de) * cos(ha))), 4) AS elevation, round(fmod(degrees(atan2(-sin(ha), tan(de) * cos(la) - sin(la) * cos(ha))) + 360, 360), 4) AS azimuth FROM h"""
)
def sun_position(spark, sf_dir):
    """Where the sun stood at each event, for a place that follows from its user."""
    lat, lng = (F.col("user_id") % 120 - 60).cast("double"), (F.col("user_id") % 300 - 150).cast("double")
    seconds = F.unix_micros(F.to_timestamp("ts")) / 1e6
    elevation, azimuth = geo.sun(lat, lng, seconds)
    return table(spark, sf_dir, "events").select("event_id", F.round(elevation, 4).alias("elevation"), F.round(azimuth, 4).alias("azimuth"))


@jobs.query(
    "SELECT c_custkey, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) AS lat, round(degrees(x / 6378137.0), 6) AS lng FROM (SELECT c_custkey, c_acctbal * 1000 AS y, (c_custkey * 7919 % 40000000 - 20000000)::DOUBLE AS x FROM customer)"
)
def mercator_to_latlng(spark, sf_dir):
    """Places from web Mercator coordinates that follow from a customer's row."""
    x, y = (F.col("c_custkey") * 7919 % 40_000_000 - 20_000_000).cast("double"), F.col("c_acctbal") * 1000
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(geo.mercator_to_lat(y), 6).alias("lat"), F.round(geo.mercator_to_lng(x), 6).alias("lng"))


@jobs.query(
    """
WITH k AS (SELECT 6378137.0::DOUBLE AS a, 0.9996::DOUBLE AS k0, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2),
q AS (SELECT c_custkey, (c_custkey * 379 % 600000 + 200000)::DOUBLE - 500000 AS x, CASE WHEN c_custkey % 2 = 0 THEN -abs(c_acctbal) * 900 ELSE abs(c_acctbal) * 900 END AS y, c_nationkey + 20 AS zone, a, k0, e2, e2 / (1 - e2) AS s2, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS n FROM customer, k),
m AS (SELECT *, y / k0 / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu FROM q),
f AS (SELECT *, mu + (3 * n / 2 - 27 * n ** 3 / 32) * sin(2 * mu) + (21 * n ** 2 / 16 - 55 * n ** 4 / 32) * sin(4 * mu) + 151 * n ** 3 / 96 * sin(6 * mu) + 1097 * n ** 4 / 512 * sin(8 * mu) AS p FROM m),
g AS (SELECT *, tan(p) ** 2 AS t2, s2 * cos(p) ** 2 AS c, a / sqrt(1 - e2 * sin(p) ** 2) AS v, a * (1 - e2) / (1 - e2 * sin(p) ** 2) ** 1.5 AS r FROM f), h AS (SELECT *, x / (v * k0) AS d FROM g)
SELECT c_custkey, round(degrees(p - v * tan(p) / r * (d ** 2 / 2 - (5 + 3 * t2 + 10 * c - 4 * c * c - 9 * s2) * d ** 4 / 24 + (61 + 90 * t2 + 298 * c + 45 * t2 * t2 - 252 * s2 - 3 * c * c) * d ** 6 / 720)), 6) AS lat,
  round((zone - 1) * 6 - 177 + degrees((d - (1 + 2 * t2 + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t2 - 3 * c * c + 8 * s2 + 24 * t2 * t2) * d ** 5 / 120) / cos(p)), 6) AS lng FROM h"""
)
def utm_to_latlng(spark, sf_dir):
    """Places from UTM coordinates that follow from a customer's row."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 379 % 600_000 + 200_000).cast("double").alias("e"), (F.abs("c_acctbal") * 900).alias("n"), (F.col("c_nationkey") + 20).alias("zone"), (F.col("c_custkey") % 2 == 0).alias("south"))
    lat, lng = geo.utm_to_latlng(F.col("e"), F.when(F.col("south"), F.lit(1e7) - F.col("n")).otherwise(F.col("n")), F.col("zone"), F.col("south"))
    return c.select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@jobs.query(
    """
WITH RECURSIVE s AS (SELECT c_custkey, z, c_custkey - (4 ** z - 1)::BIGINT // 3 AS t FROM (SELECT c_custkey, floor(ln(3 * c_custkey + 1.0000001) / ln(4))::INT AS z FROM customer)),
r AS (SELECT c_custkey, z, 0 AS k, t, 0::BIGINT AS x, 0::BIGINT AS y FROM s UNION ALL
      SELECT c_custkey, z, k + 1, t // 4,
        CASE WHEN xor(t % 2, (t // 2) % 2) = 0 THEN CASE WHEN (t // 2) % 2 = 1 THEN (1 << k) - 1 - y ELSE y END ELSE x END + (1 << k) * ((t // 2) % 2),
        CASE WHEN xor(t % 2, (t // 2) % 2) = 0 THEN CASE WHEN (t // 2) % 2 = 1 THEN (1 << k) - 1 - x ELSE x END ELSE y END + (1 << k) * xor(t % 2, (t // 2) % 2) FROM r WHERE k < z)
SELECT c_custkey, z::BIGINT AS z, x::BIGINT AS x, y::BIGINT AS y FROM r WHERE k = z"""
)
def hilbert_zxy(spark, sf_dir):
    """Tiles of the customers' keys as Hilbert tile numbers."""
    return table(spark, sf_dir, "customer").select("c_custkey", geo.tile_of_hilbert_id(F.col("c_custkey")).alias("t")).select("c_custkey", "t.z", "t.x", "t.y")


@jobs.query("SELECT o_orderkey, (o_orderkey // 35 % 9)::BIGINT AS a, (o_orderkey // 7 % 5)::BIGINT AS b, (o_orderkey % 7)::BIGINT AS c FROM orders")
def mixed_radix(spark, sf_dir):
    """Chunk coordinates of row-major indexes in a 9 x 5 x 7 grid."""
    at = geo.mixed_radix(F.col("o_orderkey"), [9, 5, 7])
    return table(spark, sf_dir, "orders").select("o_orderkey", *[at[i].alias(x) for i, x in enumerate("abc")])


@jobs.query(
    """
WITH g AS (SELECT n_nationkey, (n_nationkey * 5 - 60)::DOUBLE AS lat, (n_nationkey * 13 - 170)::DOUBLE AS lng, unnest(range(12)) AS i FROM nation), h AS (SELECT *, unnest(range(12)) AS j FROM g)
SELECT n_nationkey, i::BIGINT AS row_no, j::BIGINT AS col_no, round(lat + 0.027 - i * 0.054 / 11, 6) AS lat, round(lng + (j * 0.054 / 11 - 0.027) / cos(radians(lat)), 6) AS lng FROM h"""
)
def lattice_points(spark, sf_dir):
    """Twelve by twelve points around each nation's place."""
    lat, lng = (F.col("n_nationkey") * 5 - 60).cast("double"), (F.col("n_nationkey") * 13 - 170).cast("double")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(geo.lattice(lat, lng, 0.027, 12)).alias("p")).select("n_nationkey", F.col("p.row_no").cast("bigint").alias("row_no"), F.col("p.col_no").cast("bigint").alias("col_no"), F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))
