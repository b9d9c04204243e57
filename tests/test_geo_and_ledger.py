import math

from pyspark.sql import functions as F

from corpusmill.functions import geo
from corpusmill.operators import grids, ledger


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_utm(spark):
    lat, lng = geo.utm_to_latlng(F.lit(500000.0), F.lit(0.0), F.lit(31), F.lit(False))
    assert [round(x, 6) for x in one(spark, lat, lng)] == [0.0, 3.0]
    # Round trip against the forward scale on the central meridian: 110.576 km a degree at the equator, times 0.9996.
    lat, _ = geo.utm_to_latlng(F.lit(500000.0), F.lit(4427757.2), F.lit(31), F.lit(False))
    assert abs(one(spark, lat)[0] - 40.0) < 0.001
    south, _ = geo.utm_to_latlng(F.lit(500000.0), F.lit(1e7 - 4427757.2), F.lit(31), F.lit(True))
    assert abs(one(spark, south)[0] + 40.0) < 0.001


def test_sun(spark):
    # Solstice noon at Greenwich, 2024-06-20: declination 23.44, so 90 - 51.5 + 23.44 degrees high and due south.
    elevation, azimuth = one(spark, *geo.sun(F.lit(51.5), F.lit(0.0), F.lit(1718884920.0)))
    assert abs(elevation - 61.94) < 0.05 and abs(azimuth - 180) < 1


def test_angles(spark):
    assert one(spark, geo.angle_gap(F.lit(359.9), F.lit(0.05)))[0] < 0.16


def test_hilbert_is_a_bijection(spark):
    rows = spark.range(0, 85).select("id", geo.tile_of_hilbert_id(F.col("id")).alias("t")).select("id", "t.*").orderBy("id").collect()
    assert [tuple(r) for r in rows[:5]] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 0, 1), (3, 1, 1, 1), (4, 1, 1, 0)]
    for z in range(4):
        tiles = {(r.x, r.y) for r in rows if r.z == z}
        assert tiles == {(x, y) for x in range(2**z) for y in range(2**z)}
    for a, b in zip(rows, rows[1:]):
        assert a.z != b.z or abs(a.x - b.x) + abs(a.y - b.y) == 1


def test_lattice_is_north_first(spark):
    points = one(spark, geo.lattice(F.lit(60.0), F.lit(10.0), 0.02, 3))[0]
    assert len(points) == 9 and points[0].lat > points[8].lat and abs(points[0].lng - (10 - 0.02 / math.cos(math.radians(60)))) < 1e-9


def test_pearson_guards(spark):
    rows = [("few", float(i), float(i)) for i in range(7)] + [("flat", 1.0, float(i)) for i in range(9)] + [("line", float(i), 2.0 * i) for i in range(9)] + [("line", None, 1.0), ("line", float("nan"), 2.0), ("line", None, None)]
    got = {r.k: (r.n, r.skipped, r.r if r.r is None else round(r.r, 9)) for r in grids.pearson(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {"few": (7, 0, None), "flat": (9, 0, None), "line": (9, 2, 1.0)}


def test_latest_skips_nulls(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None)], "k int, t int, v double")
    assert [(r.k, r.value, r["at"]) for r in grids.latest(rows, ["k"], "v", "t").collect()] == [(1, 5.0, 1)]


def test_task_states(spark):
    hops = [("r1", "request", 0, 7, 1), ("r2", "request", 0, 7, 9), ("r3", "request", 0, 7, 1), ("r3", "claim", 7, 0, 2), ("r4", "request", 0, 7, 1), ("r4", "deliver", 7, 0, 2), ("r5", "request", 0, 7, 1), ("r5", "deliver", 7, 0, 2), ("r5", "verify", 7, 0, 3), ("r6", "request", 0, 7, 1), ("r6", "deliver", 7, 0, 2), ("r6", "verify", 3, 0, 3), ("r6", "verify", 4, 0, 3), ("r7", "request", 0, 7, 1), ("r7", "deliver", 5, 0, 2)]
    df = spark.createDataFrame(hops, "request string, kind string, from_key int, to_key int, at int")
    got = {r.request: r.state for r in ledger.task_states(df, F.lit(5)).collect()}
    assert got == {"r1": "expired", "r2": "requested", "r3": "claimed", "r4": "delivered", "r5": "delivered", "r6": "verified by 2 keys", "r7": "expired"}


def test_token_bucket(spark):
    writes = spark.createDataFrame([("k", i, 0.0) for i in range(50)], "k string, event_id bigint, at double")
    starts = sorted(r.start for r in ledger.token_bucket(writes, "k", "at").collect())
    assert starts[:40] == [0.0] * 40 and [round(x, 4) for x in starts[40:43]] == [round(i / 3.5, 4) for i in (1, 2, 3)]


def test_hourly_cap_rounds_seconds(spark, tmp_path):
    import datetime

    from corpusmill.jobs.ledger_jobs import hourly_cap

    # 0.4 s and 3,600.4 s round to an hour's distance, as 0.6 s and 3,600.6 s do; 0.4 s and 3,600.6 s don't.
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 1, at(0.6)), (2, 1, at(3600.6)), (3, 2, at(0.4)), (4, 2, at(3600.6)), (5, 3, at(0.6)), (6, 3, at(3601.4))]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.n for r in hourly_cap(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 2}


def test_budget_stops_at_first_breach(spark):
    steps = spark.createDataFrame([("r", i, 10.0) for i in range(5)], "k string, i int, s double")
    assert [r.ok for r in ledger.within_budget(steps, "k", "i", "s", 10, 25).orderBy("i").collect()] == [True, True, True, False, False]


def test_terrarium_elevation(spark):
    rows = spark.createDataFrame([(128, 0, 0), (0, 0, 0), (128, 10, 128), (None, 1, 1)], "r int, g int, b int")
    got = rows.select(geo.terrarium_metres(F.col("r"), F.col("g"), F.col("b")).alias("m")).collect()
    assert [x.m for x in got] == [0.0, -32768.0, 10.5, None]
