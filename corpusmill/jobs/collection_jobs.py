"""Jobs on whole collections: sections that run on through their documents, and their notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.jobs.registry import Registry
from corpusmill.jobs.text_jobs import MARKED_SQL, PIECES_SQL, marked, tokens_sql
from corpusmill.operators import collections as C
from corpusmill.sources.tables import table, written

jobs = Registry()

LIMIT, MOST = 3_000, 40


def _docs(spark, sf_dir):
    """Documents in the collection of their source, by id; short lines stand for headings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("key"), F.col("doc_id").alias("at"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), marked(T.tidy(F.coalesce("text", F.lit("")))).alias("md"))


@jobs.query(
    f"""
WITH RECURSIVE {PIECES_SQL.replace("{limit}", str(LIMIT)).replace("{root}", "'doc-' || doc_id")},
q AS (SELECT *, len(s) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id, r) AS i FROM g),
w AS (SELECT source, i, 0 AS sec, size AS open FROM q WHERE i = 1
      UNION ALL SELECT w.source, q.i, CASE WHEN open + q.size > {LIMIT} OR (2 * open > {LIMIT} AND (q.depth = 1 OR q.r = 1)) THEN sec + 1 ELSE sec END, CASE WHEN open + q.size > {LIMIT} OR (2 * open > {LIMIT} AND (q.depth = 1 OR q.r = 1)) THEN q.size ELSE open + q.size END
      FROM w JOIN q ON q.source = w.source AND q.i = w.i + 1),
m AS (SELECT q.*, w.sec FROM q JOIN w USING (source, i)),
d AS (SELECT source, doc_id, max(sec) + 1 AS upto, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM m GROUP BY source, doc_id),
t AS (SELECT source, n AS left_ FROM d WHERE pos = 1 UNION ALL SELECT t.source, floor(left_ * 0.95::DOUBLE)::BIGINT FROM t JOIN d ON d.source = t.source AND d.pos = t.left_ WHERE d.upto > {MOST} AND left_ > 1),
f AS (SELECT source, min(left_) AS left_ FROM t GROUP BY source)
SELECT source, sec::BIGINT AS section_no, count(*) AS pieces, min(doc_id) AS first_doc, max(doc_id) AS last_doc, sum(size)::BIGINT AS chars, count_if(pos <= left_)::BIGINT AS kept, any_value(left_)::BIGINT AS documents_left
FROM m JOIN d USING (source, doc_id) JOIN f USING (source) GROUP BY source, sec"""
)
def collection_pack(spark, sf_dir):
    """Sections of every source's documents in one run, and which of their pieces stay when a source may have 40 sections."""
    numbered = written(C.collection_sections(C.pieces_of(_docs(spark, sf_dir), LIMIT), LIMIT), "numbered")
    fit = C.fitting_documents(numbered.select("key", "at", "rid", "section_no"), MOST).select("rid", "kept", "left")
    rows = numbered.join(fit, "rid").groupBy(F.col("key").alias("source"), "section_no")
    return rows.agg(F.count("*").alias("pieces"), F.min("at").alias("first_doc"), F.max("at").alias("last_doc"), F.sum(F.length("text")).alias("chars"), F.count_if("kept").alias("kept"), F.max("left").alias("documents_left"))


@jobs.query()
def collection_notes(spark, sf_dir):
    """The index note of every source over its section notes; held against a plain version in the tests."""
    _, index = C.collection_notes(_docs(spark, sf_dir), LIMIT, MOST)
    return index.select(F.col("key").alias("source"), "sections", "tokens", "skipped", F.sha2("body", 256).alias("note"), "body")
