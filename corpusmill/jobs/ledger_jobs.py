"""Jobs on ledgers; events stand for entries, writes and hops of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.jobs.registry import Registry
from corpusmill.operators import ledger as L
from corpusmill.sources.tables import table

jobs = Registry()


def _seconds(c: str = "ts"):
    """Seconds since 1970, rounded (halves to even) as the SQL's cast does."""
    return F.rint(F.unix_micros(F.to_timestamp(c)) / 1e6).cast("bigint")


_HOPS = "CASE event_type WHEN 'signup' THEN 'request' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'deliver' WHEN 'error' THEN 'verify' ELSE 'other' END"


@jobs.query(
    f"""
WITH e AS (SELECT user_id * 100 + event_id % 50 AS request, {_HOPS} AS kind, event_id % 4 AS f, user_id % 4 AS t, ts FROM events),
a AS (SELECT *, max(CASE WHEN kind = 'request' THEN t END) OVER (PARTITION BY request) AS asked FROM e),
s AS (SELECT request, count(DISTINCT CASE WHEN kind = 'verify' AND f <> asked THEN f END) AS verifiers, count_if(kind = 'deliver' AND f = asked) AS delivered, count_if(kind = 'claim') AS claimed, max(ts) AS last FROM a GROUP BY request)
SELECT request, verifiers, CASE WHEN verifiers > 0 AND delivered > 0 THEN 'verified by ' || verifiers || ' keys' WHEN delivered > 0 THEN 'delivered' WHEN claimed > 0 THEN 'claimed' WHEN last < TIMESTAMP '2024-01-15' THEN 'expired' ELSE 'requested' END AS state FROM s"""
)
def task_state(spark, sf_dir):
    """State of every task, derived from its hops."""
    kinds = {"signup": "request", "click": "claim", "purchase": "deliver", "error": "verify"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")], F.lit("other"))
    hops = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 50).alias("request"), kind.alias("kind"), (F.col("event_id") % 4).alias("from_key"), (F.col("user_id") % 4).alias("to_key"), F.col("ts").alias("at"))
    return L.task_states(hops, F.lit("2024-01-15").cast("timestamp_ntz"))


@jobs.query("SELECT user_id % 20 AS inbox, event_type AS author, arg_max(event_id, {'ts': ts, 'e': event_id}) AS last FROM events WHERE event_type <> 'view' GROUP BY ALL")
def witness_dedupe(spark, sf_dir):
    """One witness an author and inbox, the last counting; the inbox's own notes are excluded."""
    notes = table(spark, sf_dir, "events").where("event_type <> 'view'").select((F.col("user_id") % 20).alias("inbox"), F.col("event_type").alias("author"), "ts", "event_id")
    return L.last_of_each(notes, ["inbox", "author"], "ts", "event_id").select("inbox", "author", F.col("event_id").alias("last"))


@jobs.query(
    """
WITH e AS (SELECT user_id, event_id, 'e' || event_id AS name, CASE WHEN event_id % 17 = 0 THEN 'lost' ELSE 'e' || lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS previous FROM events),
k AS (SELECT user_id, previous IS NOT DISTINCT FROM lag(name) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM e)
SELECT user_id, count(*) AS entries, count_if(NOT ok)::BIGINT AS broken FROM k GROUP BY user_id"""
)
def drift_links(spark, sf_dir):
    """Chains of entries that name the one before; some names were lost."""
    from pyspark.sql import Window

    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", name.alias("name"))
    e = e.withColumn("previous", F.when(F.col("event_id") % 17 == 0, F.lit("lost")).otherwise(F.lag("name").over(Window.partitionBy("user_id").orderBy("event_id"))))
    return L.linked(e, "user_id", "event_id", F.col("name"), F.col("previous")).groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("broken"))


@jobs.query("SELECT event_id, n, n > 2 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events)")
def hourly_cap(spark, sf_dir):
    """Writes of a key in the hour up to each one, and whether a cap refuses it."""
    events = table(spark, sf_dir, "events").withColumn("s", _seconds())
    return events.select("event_id", L.trailing_count(events, "user_id", F.col("s"), 3600).alias("n")).withColumn("refused", F.col("n") > 2)


@jobs.query(
    """
SELECT user_id, count_if(ok)::BIGINT AS done, round(max(CASE WHEN ok THEN used END), 4) AS used FROM (SELECT user_id, coalesce(sum(value) OVER w, 0) AS used, count(*) OVER w < 30 AND coalesce(sum(value) OVER w, 0) < 1500 AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY user_id"""
)
def run_budget(spark, sf_dir):
    """Steps of a run before its count or size is used up."""
    steps = L.within_budget(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 30, 1500)
    return steps.groupBy("user_id").agg(F.count_if("ok").alias("done"), F.round(F.max(F.when(F.col("ok"), F.col("used"))), 4).alias("used"))


@jobs.query(
    """
WITH RECURSIVE w AS (SELECT user_id, event_id, epoch(ts)::BIGINT / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT / 1e6, event_id) AS r FROM events),
b AS (SELECT user_id, event_id, r, t, t AS begun, 39.0::DOUBLE AS tokens FROM w WHERE r = 1
      UNION ALL SELECT user_id, event_id, r, t, CASE WHEN have < 1 THEN base + (1 - have) / 3.5 ELSE base END, CASE WHEN have < 1 THEN 0.0 ELSE have - 1 END
      FROM (SELECT w.user_id, w.event_id, w.r, w.t, greatest(w.t, b.begun) AS base, least(40.0, b.tokens + (greatest(w.t, b.begun) - b.begun) * 3.5)::DOUBLE AS have FROM b JOIN w ON w.user_id = b.user_id AND w.r = b.r + 1))
SELECT user_id, event_id, round(t, 3) AS "at", round(begun, 3) AS "start" FROM b"""
)
def token_bucket(spark, sf_dir):
    """When each user's paced writes start; a millionth of the events' time, so that writes do wait."""
    writes = table(spark, sf_dir, "events").select("user_id", "event_id", (_seconds() / 1e6).alias("at"))
    return L.token_bucket(writes, "user_id", "at").select("user_id", "event_id", F.round("at", 3).alias("at"), F.round("start", 3).alias("start"))


@jobs.query("SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 6")
def feed_top6(spark, sf_dir):
    """The six newest notes of every channel."""
    top = L.first_rows(table(spark, sf_dir, "events"), ["event_type"], 6, F.desc("ts"), F.desc("event_id"))
    return top.select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


@jobs.query(
    """
WITH d AS (SELECT user_id, event_type || '/' || event_id % 25 AS url, max(event_id) AS last FROM events GROUP BY ALL)
SELECT user_id, url, last, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rank FROM d) WHERE rank <= 8"""
)
def recent8(spark, sf_dir):
    """The eight addresses that a user opened last, each once."""
    url = F.concat("event_type", F.lit("/"), (F.col("event_id") % 25).cast("string"))
    once = table(spark, sf_dir, "events").groupBy("user_id", url.alias("url")).agg(F.max("event_id").alias("last"))
    return L.first_rows(once, ["user_id"], 8, F.desc("last")).select("user_id", "url", "last", F.col("rank").cast("bigint").alias("rank"))


@jobs.query("SELECT event_id, '{\"event\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' AS canonical, sha256('{\"event\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}') AS name FROM events")
def canonical_json(spark, sf_dir):
    """Records as JSON with sorted keys and no blanks, and their hash names."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    record = F.to_json(F.struct(F.col("event_id").alias("event"), k.alias("k"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", record.alias("canonical")).withColumn("name", F.sha2("canonical", 256))


@jobs.query("SELECT doc_id, strlen(text) + 28 AS sealed_bytes, TRUE AS opened FROM documents")
def sealed_roundtrip(spark, sf_dir):
    """Texts sealed with AES-256-GCM and opened again; a nonce follows from the id, so that runs agree."""
    key = F.unhex(F.sha2(F.lit("corpusmill demonstration key"), 256))
    nonce = F.unhex(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(24)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", nonce.alias("iv"))
    sealed = F.aes_encrypt(F.col("text"), key, F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"))
    opened = F.aes_decrypt(F.col("sealed"), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return docs.withColumn("sealed", sealed).select("doc_id", F.octet_length("sealed").cast("bigint").alias("sealed_bytes"), (opened == F.col("text")).alias("opened"))


@jobs.query(
    """
WITH RECURSIVE l AS (SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, sha256(unhex('00' || hex(encode(p_name)))) AS h FROM part),
t AS (SELECT 0 AS lvl, k, pos, h FROM l UNION ALL
      SELECT lvl + 1, k, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || min(h) FILTER (pos % 2 = 0) || min(h) FILTER (pos % 2 = 1))) ELSE min(h) END FROM t WHERE lvl < 20 GROUP BY lvl, k, pos // 2)
SELECT t.k AS p_brand, t.h AS root, n.n AS entries, n.n AS ok FROM t JOIN (SELECT k, count(*) AS n FROM l GROUP BY k) n ON n.k = t.k WHERE lvl = 20"""
)
def log_inclusion(spark, sf_dir):
    """Each brand's parts as a log: whether every part's audit path leads to the brand's root."""
    from corpusmill.operators import manifest as M
    from corpusmill.operators.ordered import running
    from corpusmill.sources.tables import written

    entry = F.sha2(F.unhex(F.concat(F.lit("00"), F.hex(F.encode("p_name", "UTF-8")))), 256)
    leaves = written(running(table(spark, sf_dir, "part").select("p_brand", "p_partkey", entry.alias("hash")), ["p_brand"], ["p_partkey"]).select("p_brand", "pos", "hash"), "log-leaves")
    proven = M.audit_paths(written(M.log_levels(leaves, "p_brand"), "log-nodes"), "p_brand")
    checked = proven.select("p_brand", "root", (M.path_root(F.col("hash"), F.col("path")) == F.col("root")).alias("ok"))
    return checked.groupBy("p_brand", "root").agg(F.count("*").alias("entries"), F.count_if("ok").alias("ok"))


@jobs.query(
    """
WITH RECURSIVE l AS (SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, sha256(unhex('00' || hex(encode(p_name)))) AS h FROM part),
n AS (SELECT k, count(*) AS n FROM l GROUP BY k),
s AS (SELECT DISTINCT k, n, unnest([1, n // 3 + 1, n // 2 + 1, greatest(1, n - 1), n]) AS m FROM n),
x AS (SELECT s.k, s.m, s.n, list(h ORDER BY pos) AS h FROM s JOIN l ON l.k = s.k AND l.pos < s.m GROUP BY s.k, s.m, s.n
      UNION ALL SELECT k, m, n, list_transform(range(0, len(h), 2), lambda i: CASE WHEN i + 1 < len(h) THEN sha256(unhex('01' || h[i + 1] || h[i + 2])) ELSE h[i + 1] END) FROM x WHERE len(h) > 1),
r AS (SELECT k, m, n, h[1] AS root FROM x WHERE len(h) = 1)
SELECT a.k AS p_brand, a.m::BIGINT AS old_size, a.n AS new_size, a.root AS old_root, b.root AS new_root, TRUE AS ok, TRUE AS refused FROM r a JOIN r b ON b.k = a.k AND b.m = a.n"""
)
def log_consistency(spark, sf_dir):
    """Each brand's log proven to go on from earlier sizes of it; the same proofs with an altered old root, new root or node are refused."""
    from corpusmill.operators import manifest as M
    from corpusmill.operators.ordered import running
    from corpusmill.sources.tables import written

    entry = F.sha2(F.unhex(F.concat(F.lit("00"), F.hex(F.encode("p_name", "UTF-8")))), 256)
    leaves = written(running(table(spark, sf_dir, "part").select("p_brand", "p_partkey", entry.alias("hash")), ["p_brand"], ["p_partkey"]).select("p_brand", "pos", "hash"), "log-leaves")
    n = F.count("*")
    sizes = F.array(F.lit(1).cast("bigint"), F.floor(n / 3) + 1, F.floor(n / 2) + 1, F.greatest(F.lit(1).cast("bigint"), n - 1), n)
    heads = leaves.groupBy("p_brand").agg(n.alias("new"), sizes.alias("m")).select("p_brand", "new", F.explode("m").alias("old"))
    proven = M.consistency_proofs(written(M.log_levels(leaves, "p_brand"), "log-nodes"), heads, "p_brand")
    old, new, a, b, path = (F.col(c) for c in ("old", "new", "old_root", "new_root", "path"))
    other = lambda h: F.sha2(h, 256)
    altered = F.transform(path, lambda h, i: F.when(i == F.size(path) - 1, other(h)).otherwise(h))
    tampered = [M.consistent(old, new, other(a), b, path), M.consistent(old, new, a, other(b), path), (F.size(path) > 0) & M.consistent(old, new, a, b, altered)]
    return proven.select("p_brand", old.alias("old_size"), new.alias("new_size"), a, b, M.consistent(old, new, a, b, path).alias("ok"), (~(tampered[0] | tampered[1] | tampered[2])).alias("refused"))
