"""Jobs on records of notes and manifests: rows read back from text, samples with forced ends, seals, running offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.jobs.registry import Registry
from corpusmill.operators import records as R
from corpusmill.sources.tables import table

jobs = Registry()


@jobs.query(
    """
SELECT p_brand, p_partkey, 'part ' || p_name AS label, p_partkey * 100 AS "offset", p_size::BIGINT AS length, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE left(sha256(p_name), 52) END AS hash, p_partkey % 5 = 0 AS absent FROM part"""
)
def chunk_rows(spark, sf_dir):
    """Manifest tables rendered as notes, one a brand and hundred keys, and read back row by row."""
    key = F.col("p_partkey").cast("string")
    digest = F.when(F.col("p_partkey") % 5 == 0, "not read").otherwise(F.left(F.sha2("p_name", 256), F.lit(52)))
    line = F.concat_ws(" | ", F.concat(F.lit("| part "), "p_name"), F.lit("·"), F.concat(key, F.lit("00")), F.col("p_size").cast("string"), F.concat(digest, F.lit(" |"), F.lit(" "), key, F.lit(" |")))
    notes = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    head = F.lit("| what | where | offset | length | hash | stats |\n|---|---|---|---|---|---|\n")
    read = notes.select("p_brand", F.explode(R.table_rows(F.concat(head, "rows"), "[0-9a-f]{52}")).alias("r"))
    return read.select("p_brand", F.col("r.stats").cast("bigint").alias("p_partkey"), "r.label", "r.offset", "r.length", "r.hash", "r.absent")


@jobs.query(
    """
WITH s AS (SELECT source, doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id // 6 + 1 END AS mark FROM documents),
c AS (SELECT *, coalesce(last_value(mark + 1 IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS seen FROM s)
SELECT source, doc_id, coalesce(mark, seen)::BIGINT AS page_from, coalesce(mark + 1, seen)::BIGINT AS page_to FROM c"""
)
def page_carry(spark, sf_dir):
    """First and last page of every section; a section without a page mark goes on from the one before. Every sixth document gets two marks."""
    mark = (F.floor(F.col("doc_id") / 6) + 1).cast("string")
    marked = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("[page "), mark, F.lit("]\n"), F.col("text"), F.lit("\n[page "), (F.floor(F.col("doc_id") / 6) + 2).cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return R.page_ranges(table(spark, sf_dir, "documents").select("source", "doc_id", marked.alias("text")), "source", ["doc_id"], "text")


@jobs.query(
    """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, r = 1 OR r = n ORDER BY sha256(l_orderkey || '/' || r)) AS k FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, r::BIGINT AS place, n AS total FROM m WHERE n <= 6 OR r = 1 OR r = n OR k <= 2"""
)
def section_sample(spark, sf_dir):
    """Of more than six lines of an order the first, the last and two picked by a hash, in order; else all."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("order"))
    picked = R.ends_and_some(lines, "l_orderkey", "order", 6, 2)
    return picked.select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("bigint").alias("place"), "total")


@jobs.query("SELECT user_id, event_id, r::BIGINT AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 2 OR r > n - 8")
def pinned_heads(spark, sf_dir):
    """The first two and the last eight heads that each user saw."""
    w = Window.partitionBy("user_id")
    ranked = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w.orderBy("event_id")).alias("r"), F.row_number().over(w.orderBy(F.desc("event_id"))).alias("z"))
    return ranked.where("r <= 2 OR z <= 8").select("user_id", "event_id", F.col("r").cast("bigint").alias("place"))


@jobs.query(
    """
WITH s AS (SELECT doc_id, sha256(text) AS sha FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256('changed') ELSE sha256(text) END AS want, 'copy/' || doc_id AS copy FROM documents WHERE doc_id % 13 <> 0)
SELECT m.doc_id, CASE WHEN s.sha IS NULL THEN 'missing' WHEN s.sha = want THEN 'sealed' ELSE 'differs' END AS state, CASE WHEN s.sha IS DISTINCT FROM want THEN copy END AS restore FROM m LEFT JOIN s ON s.doc_id = m.doc_id AND m.doc_id % 17 <> 0"""
)
def manifest_seal(spark, sf_dir):
    """Files against a sealed manifest: what differs or is missing, and the copy to restore it from. Some entries are changed, some files left out."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2("text", 256)
    manifest = docs.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("changed"), 256)).otherwise(digest).alias("want"), F.concat(F.lit("copy/"), F.col("doc_id").cast("string")).alias("copy"))
    files = docs.where("doc_id % 17 <> 0").select("doc_id", digest.alias("sha"))
    return R.against_seal(manifest, files, "doc_id").select("doc_id", "state", "restore")


@jobs.query(
    """
WITH p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/?([^?#]*)', 1), '/') AS parts FROM pages),
d AS (SELECT host, parts[1:len(parts) - 1] AS dirs FROM p),
m AS (SELECT host, min(dirs) AS a, max(dirs) AS b, count(*) AS pages FROM d GROUP BY host),
k AS (SELECT host, pages, a, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM m)
SELECT host, pages, CASE WHEN n > 0 THEN array_to_string(a[1:n], '/') || '/' ELSE '' END AS folder FROM k"""
)
def common_folder(spark, sf_dir):
    """The longest folder that all pages of a host share."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)).alias("host"), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+/?([^?#]*)", 1).alias("path"))
    return R.common_folders(pages, "host", "path")


@jobs.query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM lineitem""".replace(" AS at", ' AS "at"')
)
def running_offsets(spark, sf_dir):
    """Where each line starts inside its order, if lines lie one after the other."""
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.sum("l_quantity").over(before), F.lit(0.0)).alias("at"))


@jobs.query(
    """
WITH c AS (SELECT p_brand, p_partkey, p_size, p_partkey % 3 <> 0 AS got FROM part), g AS (SELECT p_brand, avg(CASE WHEN got THEN p_size END) AS mean, count(*) AS units, count_if(got) AS got FROM c GROUP BY p_brand)
SELECT p_brand, units, got::BIGINT AS got, CASE WHEN got > 0 THEN floor(mean * units + 0.5)::BIGINT END AS bytes FROM g"""
)
def estimated_size(spark, sf_dir):
    """Size of a source from the mean length of the chunks that were read."""
    got = F.col("p_partkey") % 3 != 0
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("units"), F.count_if(got).alias("got"), F.avg(F.when(got, F.col("p_size"))).alias("mean"))
    return sums.select("p_brand", "units", "got", F.when(F.col("got") > 0, T.round_half_up(F.col("mean") * F.col("units"))).alias("bytes"))


@jobs.query(
    """
SELECT p_brand, sum(p_size * (p_partkey % 7 + 1) * (p_partkey % 3 + 1))::BIGINT AS parameters, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY p_brand"""
)
def parameter_count(spark, sf_dir):
    """Values of all tensors of a model, from their shapes, and the kinds of numbers in it."""
    shape = F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 3 + 1)
    size = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(size).alias("parameters"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds"))


@jobs.query(
    """
WITH s AS (SELECT doc_id, 'chunk ' || doc_id || ' I' || n_chars || '[' || n_chars || ']' AS label, sha256(coalesce(text, '')) AS hash FROM documents),
r AS (SELECT 'chunk ' || doc_id AS label, CASE WHEN doc_id % 4 = 1 THEN sha256(source) ELSE sha256(coalesce(text, '')) END AS hash, 1 AS pos FROM documents WHERE n_chars > 500
      UNION ALL SELECT 'chunk ' || doc_id, sha256(lang), 2 FROM documents WHERE n_chars > 4000 UNION ALL SELECT 'gone ' || doc_id, sha256(lang), 3 FROM documents),
l AS (SELECT label, arg_max(hash, pos) AS hash FROM r GROUP BY label)
SELECT doc_id, s.hash = l.hash AS shown FROM s JOIN l ON l.label = 'chunk ' || doc_id"""
)
def preview_rows(spark, sf_dir):
    """Chunks of a structure for which a stored row exists by its label without type and shape, and whether they still have its hash, so that they may be shown; of rows with one label the last counts."""
    docs = table(spark, sf_dir, "documents")
    name, digest = F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)
    structure = docs.select("doc_id", F.format_string("chunk %s I%s[%s]", name, F.col("n_chars").cast("string"), F.col("n_chars").cast("string")).alias("label"), digest.alias("hash"))
    row = lambda label, hash_, pos: docs.select(F.concat(F.lit(label), name).alias("label"), hash_.alias("hash"), F.lit(pos).alias("pos"), "n_chars")
    stored = row("chunk ", F.when(F.col("doc_id") % 4 == 1, F.sha2("source", 256)).otherwise(digest), 1).where("n_chars > 500").unionByName(row("chunk ", F.sha2("lang", 256), 2).where("n_chars > 4000")).unionByName(row("gone ", F.sha2("lang", 256), 3))
    return R.previewed(structure, stored.drop("n_chars")).select("doc_id", "shown")


@jobs.query(
    """
SELECT doc_id, 'doc ' || doc_id || ' in ' || lang || ' of {owner}' AS filled, trim(regexp_replace(text, '\\[page [0-9]+\\]', '', 'g')) <> '' AS has_text FROM documents"""
)
def template_fill(spark, sf_dir):
    """A template filled with a row's fields, unknown names kept; and whether a document has any text."""
    docs = table(spark, sf_dir, "documents")
    filled = R.filled("doc {doc_id} in {lang} of {owner}", ["doc_id", "lang"])
    return docs.select("doc_id", filled.alias("filled"), (F.trim(F.regexp_replace("text", "\\[page [0-9]+\\]", "")) != "").alias("has_text"))


@jobs.query(
    """
WITH d AS (SELECT user_id, dayofyear(ts)::BIGINT AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL),
s AS (SELECT user_id, min(day) AS a, max(day) AS b, greatest(1, ceil((max(day) - min(day) + 1) / 8))::BIGINT AS step FROM d GROUP BY user_id),
y AS (SELECT user_id, unnest(range(a, b + 1, step)) AS day FROM s)
SELECT y.user_id, y.day, event_id FROM y LEFT JOIN d ON d.user_id = y.user_id AND d.day = y.day"""
)
def stepped_series(spark, sf_dir):
    """At most eight days of every user's span, evenly stepped from the first, with the day's newest capture if there is one."""
    days = table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").cast("bigint").alias("day"), "ts", "event_id")
    return R.stepped(days, "user_id", "day", 8, F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
