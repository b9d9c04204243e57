"""Jobs on chunk manifests, listings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.jobs.registry import Registry
from corpusmill.operators import manifest as M
from corpusmill.operators.ordered import running
from corpusmill.sources.tables import table

jobs = Registry()


@jobs.query(
    """
WITH r AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size, unnest(range(0, greatest(1, strlen(text)), 4096)) AS off FROM documents WHERE strlen(text) > 0)
SELECT doc_id, (off // 4096)::BIGINT AS pos, off::BIGINT AS "offset", least(4096, size - off)::BIGINT AS length, sha256(unhex(substr(h, (2 * off + 1)::BIGINT, (2 * least(4096, size - off))::BIGINT))) AS hash FROM r"""
)
def chunk_ranges(spark, sf_dir):
    """Hashed 4 KiB ranges of every document's bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    sized = docs.select("doc_id", F.octet_length("b").cast("bigint").alias("size"), "b")
    step = 4096
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step).cast("int")), lambda i: F.sha2(F.substring("b", i * step + 1, F.lit(step)), 256))
    rows = sized.where("size > 0").select("doc_id", "size", F.posexplode(cut).alias("pos", "hash"))
    offset = F.col("pos").cast("bigint") * step
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), offset.alias("offset"), F.least(F.lit(step).cast("bigint"), F.col("size") - offset).alias("length"), "hash")


@jobs.query(
    """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM n WHERE n <= 3 OR k IN (0, floor((n - 1) / 2.0 + 0.5), n - 1)"""
)
def spread_sample(spark, sf_dir):
    """Three evenly spread lines of every order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place"))
    return M.spread(rows, "l_orderkey", "place", 3).select("l_orderkey", "l_linenumber", "l_partkey")


@jobs.query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_name || '#' || p_partkey)) AS rank FROM part) WHERE rank <= 3")
def hash_order_sample(spark, sf_dir):
    """The first three parts of every brand by the hash of their label."""
    label = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return M.by_hash_order(table(spark, sf_dir, "part"), "p_brand", label, 3).select("p_brand", "p_partkey", F.col("rank").cast("bigint").alias("rank"))


_TREE = """
t AS (SELECT 0 AS lvl, k, pos, h FROM l UNION ALL
      SELECT lvl + 1, k, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min(h) FILTER (pos % 2 = 0) || min(h) FILTER (pos % 2 = 1))) ELSE min(h) END FROM t WHERE lvl < 20 GROUP BY lvl, k, pos // 2)
"""


@jobs.query(
    f"""
WITH RECURSIVE l AS (SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, sha256(p_partkey || ':' || p_name) AS h FROM part), {_TREE}
SELECT k AS p_brand, h AS root FROM t WHERE lvl = 20"""
)
def merkle_root(spark, sf_dir):
    """Root over the parts of every brand, in order of their keys."""
    return M.merkle_roots(_positions(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name"), 256)), "p_brand")


def _positions(rows, key, order, digest):
    return running(rows.select(key, order, digest.alias("hash")), [key], [order, "hash"]).select(key, "pos", "hash")


@jobs.query(
    f"""
WITH RECURSIVE l AS (SELECT source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
  sha256(unhex(hex(encode('doc/' || doc_id)) || lpad('', 16, '0') || lpad(to_hex(strlen(text)), 16, '0') || upper(sha256(doc_id || chr(10) || strlen(text) || chr(10) || sha256(text))))) AS h FROM documents), {_TREE}
SELECT k AS source, h AS root FROM t WHERE lvl = 20"""
)
def listing_root(spark, sf_dir):
    """Root over the documents of every source as listing rows: path, size and hash, hashed into leaves."""
    size = F.octet_length("text").cast("bigint")
    row = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), size.cast("string"), F.sha2("text", 256)), 256)
    leaf = M.leaf_hash(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit(0).cast("bigint"), size, row)
    return M.merkle_roots(_positions(table(spark, sf_dir, "documents"), "source", "doc_id", leaf), "source")


_EVENTS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, {v} AS v FROM events"


@jobs.query(
    f"""
WITH RECURSIVE e AS ({_EVENTS.format(v="sha256(event_id || ':' || event_type)")}),
c AS (SELECT user_id, 0::BIGINT AS r, repeat('00', 32) AS p UNION ALL SELECT c.user_id, e.r, sha256(unhex(p || v)) FROM c JOIN e ON e.user_id = c.user_id AND e.r = c.r + 1)
SELECT user_id, max(r)::BIGINT AS length, arg_max(p, r) AS head FROM c GROUP BY user_id""".replace("SELECT user_id, 0::BIGINT AS r, repeat('00', 32) AS p UNION", "SELECT DISTINCT user_id, 0::BIGINT AS r, repeat('00', 32) AS p FROM e UNION")
)
def hash_chain(spark, sf_dir):
    """Head of the hash chain over every user's events."""
    digest = F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type"), 256)
    chained = table(spark, sf_dir, "events").groupBy("user_id").agg(M.ordered(digest, F.col("event_id")).alias("h"))
    return chained.select("user_id", F.size("h").cast("bigint").alias("length"), M.chain_head(F.col("h")).alias("head"))


@jobs.query(
    f"""
WITH RECURSIVE e AS ({_EVENTS.format(v="'event/' || event_id")}),
c AS (SELECT DISTINCT user_id, 0::BIGINT AS r, substr(sha256(''), 1, 32) AS p FROM e UNION ALL SELECT c.user_id, e.r, substr(sha256(p || v), 1, 32) FROM c JOIN e ON e.user_id = c.user_id AND e.r = c.r + 1)
SELECT user_id, arg_max(p, r) AS link FROM c GROUP BY user_id"""
)
def track_chain(spark, sf_dir):
    """Last link of every user's track of references."""
    ref = F.concat(F.lit("event/"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(M.ordered(ref, F.col("event_id")).alias("r")).select("user_id", M.track_links(F.col("r")).alias("link"))


_A, _B = "SELECT p_brand, p_partkey % 40 AS slot, p_name AS v, p_partkey AS pos FROM part", "SELECT p_brand, p_partkey % 40 AS slot, CASE WHEN p_partkey % 5 = 0 THEN p_name || '*' ELSE p_name END AS v, p_partkey AS pos FROM part WHERE p_partkey % 7 <> 0"


@jobs.query(
    f"""
WITH a AS (SELECT p_brand, slot, arg_max(v, pos) AS v FROM ({_A}) GROUP BY ALL), b AS (SELECT p_brand, slot, arg_max(v, pos) AS v FROM ({_B}) GROUP BY ALL)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.slot, b.slot) AS slot, CASE WHEN b.slot IS NULL THEN 'only_a' WHEN a.slot IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.slot = b.slot"""
)
def manifest_compare(spark, sf_dir):
    """Two manifests by key, the last row of a repeated key counting."""
    part = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 40).alias("slot"), F.col("p_name").alias("v"), F.col("p_partkey").alias("pos"))
    other = part.where("pos % 7 <> 0").withColumn("v", F.when(F.col("pos") % 5 == 0, F.concat("v", F.lit("*"))).otherwise(F.col("v")))
    keys = ["p_brand", "slot"]
    return M.compare(M.last_by(part, keys, "pos"), M.last_by(other, keys, "pos"), keys, "v").select("p_brand", "slot", "status")


@jobs.query(
    """
WITH a AS (SELECT o_orderstatus AS l, o_orderkey AS p, o_totalprice AS s, o_orderpriority AS h FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderstatus AS l, o_orderkey AS p, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS s, o_orderpriority AS h FROM orders WHERE o_orderkey % 7 <> 0),
c AS (SELECT coalesce(a.l, b.l) AS listing, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN CASE WHEN coalesce(a.l, b.l) = 'O' THEN 'unseen' ELSE 'gone' END WHEN a.s = b.s AND a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.l = b.l AND a.p = b.p)
SELECT listing, status, count(*) AS n FROM c GROUP BY ALL"""
)
def folder_relist(spark, sf_dir):
    """A listing against an earlier one; the listing of open orders is cut short."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("listing"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("hash"))
    after = orders.where("path % 7 <> 0").withColumns({"size": F.when(F.col("path") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")), "truncated": F.col("listing") == "O"})
    return M.relist(orders.where("path % 11 <> 0"), after, "listing", "path", "size", "hash").groupBy("listing", "status").agg(F.count("*").alias("n"))


@jobs.query(
    """
WITH s AS (SELECT p_brand, p_partkey AS pos, p_name || '#' || p_partkey AS label, p_partkey % 9 = 0 AS had FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, had ORDER BY sha256(label)) AS r FROM s)
SELECT p_brand, pos, had AS carried, sha256(CASE WHEN had THEN 'old ' ELSE 'new ' END || label) AS hash FROM r WHERE had OR r <= 8"""
)
def extend_manifest(spark, sf_dir):
    """Every brand's pointer extended by eight parts in hash order; rows it had keep their hashes."""
    label = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    structure = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("pos"), label.alias("label"), F.sha2(F.concat(F.lit("new "), label), 256).alias("hash"))
    prior = structure.where("pos % 9 = 0").select("p_brand", "label", F.sha2(F.concat(F.lit("old "), "label"), 256).alias("hash"))
    return M.extend(structure, prior, "p_brand", "pos", "label", 8).select("p_brand", "pos", "carried", "hash")


@jobs.query(
    """
WITH n AS (SELECT p_brand, p_partkey, p_name, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part),
k AS (SELECT *, list_transform(range(6), lambda j: floor(j * (n - 1) / 5.0 + 0.5)::BIGINT) AS marks FROM n)
SELECT p_brand, count(*) AS checked, count_if(sha256(p_name) <> sha256(CASE WHEN p_partkey % 10 = 0 THEN p_name || '!' ELSE p_name END))::BIGINT AS bad FROM k WHERE n <= 6 OR list_contains(marks, i) GROUP BY p_brand"""
)
def recheck_sample(spark, sf_dir):
    """Six spread rows of every brand hashed again; some have changed."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.sha2("p_name", 256).alias("stored"), F.sha2(F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("now"))
    return M.spread(rows, "p_brand", "p_partkey", 6).groupBy("p_brand").agg(F.count("*").alias("checked"), F.count_if(F.col("stored") != F.col("now")).alias("bad"))


@jobs.query(
    """
WITH p AS (SELECT user_id, event_id FROM events WHERE event_id % 3 <> 0), l AS (SELECT user_id, event_id FROM events WHERE event_id % 4 <> 0)
SELECT user_id, count_if(expired)::BIGINT AS expired, count(*) AS total FROM (SELECT user_id, TRUE AS expired FROM p WHERE NOT EXISTS (FROM l WHERE l.user_id = p.user_id AND l.event_id = p.event_id) UNION ALL SELECT user_id, FALSE FROM l) GROUP BY user_id"""
)
def keep_expired_segments(spark, sf_dir):
    """Live windows after a new listing keep the rows that left them."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    kept = M.keep_expired(events.where("event_id % 3 <> 0"), events.where("event_id % 4 <> 0"), "user_id", "event_id")
    return kept.groupBy("user_id").agg(F.count_if("expired").alias("expired"), F.count("*").alias("total"))


@jobs.query(
    """
WITH m AS (SELECT vec_id, len(embedding)::BIGINT AS n, list_aggregate(embedding::DOUBLE[], 'avg') AS mean, list_aggregate(embedding::DOUBLE[], 'stddev_pop') AS sd, list_aggregate(embedding::DOUBLE[], 'min') AS mn, list_aggregate(embedding::DOUBLE[], 'max') AS mx FROM embeddings)
SELECT vec_id, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mn, 5) AS min, round(mx, 5) AS max FROM m"""
)
def chunk_moments(spark, sf_dir):
    """Count, mean, deviation and range of every vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    m = M.moments(F.col("v"), digits=12)
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", m["n"].alias("n"), *[F.round(m[k], 5).alias(k) for k in ("mean", "sd", "min", "max")])


@jobs.query()
def parquet_footer(spark, sf_dir):
    """Column chunks of the tables' Parquet files, from their footers."""
    from corpusmill.sources.binary import parquet_chunks

    return parquet_chunks(spark, f"{sf_dir}/lineitem.parquet").unionByName(parquet_chunks(spark, f"{sf_dir}/events.parquet"))
