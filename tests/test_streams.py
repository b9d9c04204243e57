"""Streams over several files: frames cut anywhere, surveys that end, appends that run twice."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.jobs.stream_jobs import _in_files
from corpusmill.sources.tables import scratch_path
from corpusmill.streaming.follow import run_batches, run_to_end
from corpusmill.streaming import frames as frames_module
from corpusmill.streaming.frames import NamedLog, _before, broken_links, counted_surveys, fields_of, frames, last_of

TEXT = ": hello\n\nevent: stage\ndata: one\ndata: two\n\nevent: answer\r\ndata:first\r\n\r\ndata: plain\n\n\n\nevent: answer\nid: 7\ndata: é😀 last\n\nevent: answer\ndata: never ends"
WANT = [("message", ""), ("stage", "one\ntwo"), ("answer", "first"), ("message", "plain"), ("answer", "é😀 last")]


def as_stream(spark, batches, schema):
    path = scratch_path(spark, "test-stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_fields():
    assert fields_of("data: a\ndata:b\nevent: x\r\n: note\nretry") == ("x", "a\nb") and fields_of("") == ("message", "")


def test_frames_cut_at_every_character(spark):
    # Key i is cut at i in four files: before i, one character, the next three, the rest.
    n = len(TEXT)
    cuts = [(i, [TEXT[:i], TEXT[i : i + 1], TEXT[i + 1 : i + 4], TEXT[i + 4 :]]) for i in range(n)]
    batches = [[(i, k, parts[k]) for i, parts in cuts] for k in range(3)] + [[(i, 3, parts[3][:5]) for i, parts in cuts] + [(i, 4, None) for i, _ in cuts] + [(i, 5, parts[3][5:]) for i, parts in cuts]]
    found = run_to_end(frames(as_stream(spark, batches, "k bigint, seq bigint, text string"), "k", "seq", "text"))
    got: dict = {}
    for r in found.orderBy("k", "frame").collect():
        got.setdefault(r.k, []).append((r.event, r.data))
    assert all(got[i] == WANT for i in range(n))
    assert {tuple(r) for r in last_of(found, "k", "answer").collect()} == {(i, "é😀 last", 4) for i in range(n)}


@pytest.mark.parametrize("sizes", [(5, 5, 5, 5), (30, 1, 1), (12, 3, 0)])
def test_surveys_end(spark, sizes):
    rows, at = [], 0
    for size in sizes:
        rows.append([("a", at + i) for i in range(size)] + [("b", at + 1000)])
        at += size
    got = run_to_end(counted_surveys(as_stream(spark, rows, "k string, at bigint"), "k", "at")).collect()
    mine = sorted(r.survey for r in got if r.k == "a")
    assert mine == list(range(1, 13)) and [r.at for r in got if r.k == "a" and r.ended] == [11] and sorted(r.at for r in got if r.k == "a") == list(range(12))
    assert len([r for r in got if r.k == "b"]) == len(sizes) and not any(r.ended for r in got if r.k == "b")


def test_appends_may_run_twice(spark):
    log = NamedLog(spark)
    assert log.read().count() == 0
    schema = "chain string, at bigint, body string"
    one = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("x", 3, "a"), ("y", 1, "a"), (None, 1, "z"), ("y", 2, None)], schema)
    two = spark.createDataFrame([("x", 9, "c"), ("x", 5, "b"), ("z", 1, "")], schema)
    assert [log.append(one), log.append(one), log.append(two), log.append(one.union(two)), log.append(one.limit(0))] == [3, 0, 2, 0, 0]
    rows = {(r.chain, r.entry): (r.name, r.previous, r.body) for r in log.read().collect()}
    name = lambda c, b: hashlib.sha256(f"{c}\n{b}".encode()).hexdigest()
    chains = {"x": ["a", "b", "c"], "y": ["a"], "z": [""]}
    assert rows == {(c, i): (name(c, b), name(c, bodies[i - 1]) if i else "", b) for c, bodies in chains.items() for i, b in enumerate(bodies)}
    assert broken_links(log.read()).count() == 0
    changed = log.read().withColumn("body", F.when((F.col("chain") == "x") & (F.col("entry") == 1), "other").otherwise(F.col("body")))
    assert [(r.chain, r.entry) for r in broken_links(changed).collect()] == [("x", 1)]
    assert [(r.chain, r.entry) for r in broken_links(log.read().where("NOT (chain = 'x' AND entry = 1)")).collect()] == [("x", 2)]


def test_a_batch_written_twice_is_one(spark):
    # A job that failed after its write and runs again from the log it saw before.
    log = NamedLog(spark)
    rows = spark.createDataFrame([("x", i, str(i)) for i in range(5)], "chain string, at bigint, body string")
    before = NamedLog(spark, log.path)
    log.append(rows)
    held = log.read
    before.read = lambda: held().limit(0)
    before.append(rows)
    assert log.read().count() == 5 and broken_links(log.read()).count() == 0


def test_an_append_sorts_nothing_to_find_what_is_new(spark, monkeypatch):
    plans = {}

    def spy(df, what, **options):
        plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString())
        return held(df, what, **options)

    held = frames_module.written
    monkeypatch.setattr(frames_module, "written", spy)
    log, rows = NamedLog(spark), spark.range(2000).selectExpr("concat('c', id % 2) AS chain", "id AS at", "string(id % 500) AS body")
    assert [log.append(rows.where("at < 300")), log.append(rows), log.append(rows)] == [300, 200, 0]
    assert len(plans["log-new"]) == 3 and all("HashAggregate" in p for p in plans["log-new"])
    assert not [what for what, found in plans.items() for p in found if "SortAggregate" in p or "SortMergeJoin" in p]
    assert [(r.chain, r.n, r.last) for r in log.read().groupBy("chain").agg(F.count("*").alias("n"), F.max("entry").alias("last")).orderBy("chain").collect()] == [("c0", 250, 249), ("c1", 250, 249)]
    assert broken_links(log.read()).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 14])
def test_the_name_before_passes_between_runs(spark, bits):
    rng = random.Random(bits)
    rows = [(c, e, f"{c}{e}{k}") for c in ("x", "y", None) for e in range(40) if rng.random() < 0.9 for k in range(rng.choice([1, 1, 1, 2]))]
    at: dict = {}
    for c, e, name in rows:
        at.setdefault((c, e), []).append(name)
    log = spark.createDataFrame(rows, "chain string, entry bigint, name string").repartition(3)
    want = {(c, e, name, *((min(b), max(b)) if c and (b := at.get((c, e - 1))) else (None, None))) for c, e, name in rows}
    got = _before(log, F.col("name"), bits).select("chain", "entry", "name", "least", "most").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_an_entry_told_twice_breaks_the_next(spark):
    log = NamedLog(spark)
    log.append(spark.createDataFrame([("x", i, str(i)) for i in range(4)], "chain string, at bigint, body string"))
    copy = log.read().where("entry = 1")
    assert broken_links(log.read().union(copy)).count() == 0
    other = copy.withColumns({"body": F.lit("other"), "name": F.sha2(F.lit("x\nother"), 256)})
    names = {r.entry: r.name for r in log.read().collect()}
    assert [(r.entry, r.previous, r.expected) for r in broken_links(log.read().union(other)).collect()] == [(2, names[1], other.first().name)]
    assert [r.entry for r in broken_links(log.read().withColumn("previous", F.when(F.col("entry") != 3, F.col("previous")))).collect()] == [3]


def test_parts_are_written_by_many_tasks_and_come_in_order(spark):
    rows = spark.range(40_000).selectExpr("id % 100 AS k", "id AS at", "concat(sha2(string(id), 256), sha2(string(-id), 256)) AS t").repartition(4)
    name, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        stream = _in_files(rows, F.floor(F.col("at") / 20_000).cast("int"), 2, "k")
        seen = run_batches(stream.select("k", "at", F.input_file_name().alias("file")), lambda df: df.withColumn("n", F.lit(1)))
        files = seen.groupBy("k", F.floor(F.col("at") / 20_000).alias("part")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
        assert {(r.files, r.n) for r in files} == {(1, 200)} and len(files) == 200
        assert seen.select("file").distinct().count() > 2
    finally:
        spark.conf.set(name, before)
    got = run_to_end(counted_surveys(_in_files(rows, F.floor(F.col("at") / 20_000).cast("int"), 2, "k"), "k", "at")).collect()
    assert {(r.k, r.survey, r.at) for r in got} == {(k, i + 1, k + 100 * i) for k in range(100) for i in range(12)}
