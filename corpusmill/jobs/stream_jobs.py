"""Streaming jobs, run over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.jobs.registry import Registry
from corpusmill.operators.ledger import first_rows
from corpusmill.sources.tables import scratch_path, table, written
from corpusmill.streaming.follow import monotonic, read_stream, run_batches, run_to_end
from corpusmill.streaming.frames import NamedLog, checked, counted_surveys, frames, last_of

jobs = Registry()


def _events(spark, sf_dir):
    return read_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events"))


@jobs.query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def stream_follow(spark, sf_dir):
    """A live window followed to its end: labels seen, each kept when it leaves the window."""
    seen = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    updates = run_to_end(seen, "update")
    return updates.groupBy("user_id", "event_type").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "first", "last")])


@jobs.query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 6")
def stream_tail(spark, sf_dir):
    """The six newest of every channel, from a stream: each batch's newest are kept, and the newest of those count."""
    newest = lambda df: first_rows(df, ["event_type"], 6, F.desc("ts"), F.desc("event_id")).select("event_type", "ts", "event_id")
    kept = run_batches(_events(spark, sf_dir).select("event_type", "ts", "event_id"), newest)
    return newest(kept).select("event_type", "event_id")


@jobs.query(
    """
SELECT user_id, count(*) AS heads, count_if(size < greatest(-1, coalesce(top, -1)))::BIGINT AS shrunk FROM (SELECT user_id, size, max(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT user_id, event_id, event_id // 10 * 10 - CASE WHEN event_id % 13 = 0 THEN 500 ELSE 0 END AS size FROM events)) GROUP BY user_id"""
)
def stream_monotonic_head(spark, sf_dir):
    """Heads of growing logs from a stream; some shrink."""
    size = (F.floor(F.col("event_id") / 10) * 10 - F.when(F.col("event_id") % 13 == 0, 500).otherwise(0)).cast("bigint")
    heads = _events(spark, sf_dir).select("user_id", "event_id", size.alias("size"))
    checked = run_to_end(monotonic(heads, "user_id", "event_id", "size"))
    return checked.groupBy("user_id").agg(F.count("*").alias("heads"), F.count_if(~F.col("ok")).alias("shrunk"))


def _in_files(rows, by, files, key):
    """A stream over ``rows`` dealt to parts by ``by`` (0 to ``files`` - 1), which come one after the other: a part is written by many tasks, and a file holds a key's rows of its part whole."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "messages")
    kept = written(rows.withColumn("_part", by), "message-rows")
    for i in range(files):
        kept.where(F.col("_part") == i).drop("_part").repartition(key).write.parquet(f"{path}/{i}")
    # A stream takes files by their times, so in the order of the parts; as many at once as the largest part has.
    most = max(len(spark.read.schema(rows.schema).parquet(f"{path}/{i}").inputFiles()) for i in range(files))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, most)).option("recursiveFileLookup", "true").parquet(path)


def _messages(turns):
    """Turns as frames of two lines and more, cut into messages of 37 characters wherever that falls."""
    frame = F.concat(F.lit(": a note\nevent: "), F.when(F.col("role") == "assistant", "answer").otherwise("stage"), F.lit("\ndata: "), F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", "\ndata: "), F.lit("\n\n"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("t"))
    return whole.select("conv_id", F.length("t").alias("chars"), F.posexplode(F.regexp_extract_all("t", F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "text"))


@jobs.query(
    """
WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '\n\r?\n')),
n AS (SELECT conv_id, count(*) AS frames FROM t GROUP BY conv_id)
SELECT n.conv_id, frames, sha256(replace(arg_max(text, frame), chr(13), '')) AS answer, max(frame) AS frame FROM n JOIN t ON t.conv_id = n.conv_id AND role = 'assistant' GROUP BY n.conv_id, frames"""
)
def stream_frames(spark, sf_dir):
    """Answers from a stream of cut frames in four parts: every message's rest waits for the next, and the last answer counts."""
    turns = table(spark, sf_dir, "conversations").where(~F.coalesce("text", F.lit("")).rlike("\n\r?\n"))
    messages = _messages(turns)
    found = run_to_end(frames(_in_files(messages, F.floor(F.col("seq") * 37 * 4 / F.col("chars")).cast("int"), 4, "conv_id").select("conv_id", "seq", "text"), "conv_id", "seq", "text"))
    answers = last_of(found, "conv_id", "answer")
    return found.groupBy("conv_id").agg(F.count("*").alias("frames")).join(answers, "conv_id").select("conv_id", "frames", F.sha2(F.regexp_replace("data", "\r", ""), 256).alias("answer"), "frame")


@jobs.query(
    """
SELECT user_id, count(*) AS surveys, max(event_id) AS last, count(*) = 12 AS ended FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 12 GROUP BY user_id"""
)
def stream_surveys(spark, sf_dir):
    """Refreshes that end after twelve surveys of a user, from a stream of three parts in order."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    top = events.agg(F.max("event_id")).first()[0]
    third = F.least(F.lit(2), F.floor(F.col("event_id") * 3 / F.lit((top or 0) + 1)).cast("int"))
    found = run_to_end(counted_surveys(_in_files(events, third, 3, "user_id"), "user_id", "event_id"))
    return found.groupBy("user_id").agg(F.count("*").alias("surveys"), F.max("event_id").alias("last"), F.bool_or("ended").alias("ended"))


@jobs.query(
    """
WITH b AS (SELECT event_type AS chain, event_id AS t, 'user ' || user_id || ' value ' || floor(value)::BIGINT AS body FROM events),
f AS (SELECT chain, body, min(t) AS t FROM b GROUP BY ALL),
n AS (SELECT chain, t, body, sha256(chain || chr(10) || body) AS name FROM f)
SELECT chain, row_number() OVER w - 1 AS entry, name, coalesce(lag(name) OVER w, '') AS previous, TRUE AS linked FROM n WINDOW w AS (PARTITION BY chain ORDER BY t)"""
)
def drift_append(spark, sf_dir):
    """A log appended to in three batches, two of which run twice: the same bytes are one entry, and each entry names the one before."""
    body = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" value "), F.floor("value").cast("string"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("at"), body.alias("body"))
    top = (events.agg(F.max("at")).first()[0] or 0) + 1
    log = NamedLog(spark)
    for low, high in ((0, 1), (0, 1), (1, 2), (0, 2), (2, 3)):
        log.append(events.where((F.col("at") * 3 >= low * top) & (F.col("at") * 3 < high * top)))
    return checked(log.read()).select("chain", "entry", "name", "previous", "linked")
