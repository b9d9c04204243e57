"""Merkle manifest of a dataset: trees of three by source, a tree of sources, and proofs by checkpoint and recompute.

Rows are placed by a range partition and running counts of its parts, so that neither a window nor a task holds a source. Of the levels of a tree only every
``STRIDE``-th is stored: a group of 27 consecutive nodes gives its next stored node without leaving a row of the levels between. A proof is
extracted from the top down: each aligned subtree of a stored node is read again, its missing interior nodes are made anew from the stored descendants, every
descendant gets its siblings on the way up beside those of the stored node, and the interior nodes are dropped with the row. Groups never exceed ``ARITY ** STRIDE`` nodes
whatever a source holds, and a lost executor costs tasks over written tables.

Digests are lowercase hex of sha256 over concatenated inputs. DataFrame functions only.

Defined results: null values count as ``-``; a null source is a source of its own and comes first, null ids come first in a source; rows that repeat an id are ordered by their leaf, so equal
rows are leaves of their own and the root doesn't depend on how the table is stored; a lone leaf is its source's root, a lone source's root is the root; an empty table gives an empty result; other columns
are ignored. Long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import table, written

ARITY = 3
#: Levels from one stored level to the next.
STRIDE = 3
SPAN = ARITY**STRIDE
#: Siblings of a level: what stands before and after the node that is proven.
STEP = "struct<before:string,after:string>"


def encoded(*values: Column) -> Column:
    """The values as one text: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)])


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` inside ``tree``, nulls first) and ``n``, the rows of the tree; written.

    Rows are dealt by ranges and numbered in each part; what comes before a part follows from a table of a row for each part and tree in it.
    """
    sorted_ = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in (tree, *order)]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in (tree, *order)])
    # The number of a row holds when a task runs again only once it is written.
    numbered = written(sorted_.withColumn("line", F.monotonically_increasing_id()), "merkle-rows").withColumn("part", F.shiftright("line", 33))
    runs = numbered.groupBy("part", tree).agg(F.min("line").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy(tree).orderBy("part")
    runs = runs.withColumns({"shift": F.sum("c").over(before) - F.col("c") - F.col("first"), "n": F.sum("c").over(Window.partitionBy(tree))})
    runs = written(runs.select("part", F.col(tree).alias("run_tree"), "shift", "n"), "merkle-runs")
    out = numbered.join(runs, (numbered["part"] == runs["part"]) & numbered[tree].eqNullSafe(runs["run_tree"]))
    return written(out.select(*rows.columns, (F.col("line") + F.col("shift")).alias("pos"), "n"), "merkle-placed")


def _next(nodes: Column) -> Column:
    """The level above a list of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _lists(level: DataFrame) -> DataFrame:
    """``tree, up, size, nodes``: the aligned groups of a stored level (``tree, idx, size, digest``), in order."""
    grouped = level.groupBy("tree", F.floor(F.col("idx") / SPAN).alias("up")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("held"))
    return grouped.select("tree", "up", "size", F.transform("held", lambda x: x["digest"]).alias("nodes"))


def _levels_above() -> Column:
    """How many levels a group's tree has from here to the next stored one: fewer at the top, where one node remains."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE)), F.lit(0), lambda a, i: F.when(F.col("size") > F.pow(F.lit(ARITY), i - 1), i).otherwise(a))


def checkpoints(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels of all trees of ``leaves`` (``tree, idx, size, digest``; ``size`` nodes in the level): a written table each, up to the roots.

    Interior nodes live inside one expression. A tree of which one node is left stays in that level.
    """
    out = [leaves]
    while out[-1].where("size > 1").limit(1).count():
        groups = _lists(out[-1].where("size > 1")).withColumn("levels", _levels_above())
        digest = F.aggregate(F.sequence(F.lit(1), F.col("levels")), F.col("nodes"), lambda a, i: _next(a))[0]
        out.append(written(groups.select("tree", F.col("up").alias("idx"), F.ceil(F.col("size") / F.lit(SPAN)).cast("bigint").alias("size"), digest.alias("digest")), "merkle-level"))
    return out


def _siblings(nodes: Column, at: Column) -> Column:
    """The rest of a node's run, as one text before it and one after it."""
    first = (at - at % ARITY).cast("int")
    return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("before"), F.array_join(F.slice(nodes, at + 2, first + ARITY - 1 - at), "").alias("after"))


def _subtrees(level: DataFrame) -> DataFrame:
    """``tree, up, steps``: for every node of a group, its siblings on the levels between, which are made anew from the group's nodes."""
    interior = F.aggregate(F.sequence(F.lit(1), F.col("levels")), F.array("nodes"), lambda a, i: F.concat(a, F.array(_next(F.element_at(a, -1)))))
    # Exploded, so that a group's levels are made once and not for every node.
    held = _lists(level).withColumn("levels", _levels_above()).select("tree", "up", "levels", F.explode(F.array(interior)).alias("held"))
    own = lambda k: F.transform(F.sequence(F.lit(0), F.col("levels") - 1), lambda i: _siblings(F.get(F.col("held"), i), F.floor(k / F.pow(F.lit(ARITY), i)).cast("int")))
    return held.select("tree", "up", F.transform(F.sequence(F.lit(0), F.size(F.col("held")[0]) - 1), own).alias("steps"))


def paths(levels: list[DataFrame]) -> DataFrame:
    """``tree, idx, path``: for every leaf the siblings of each level up to its tree's root."""
    roots = lambda level: level.where("size = 1").select("tree", "idx", F.array().cast(f"array<{STEP}>").alias("path"))
    known = roots(levels[-1])
    for level in reversed(levels[:-1]):
        above = _subtrees(level.where("size > 1")).join(known.select("tree", F.col("idx").alias("up"), "path"), ["tree", "up"])
        each = above.select("tree", "up", "path", F.posexplode("steps").alias("k", "own"))
        found = each.select("tree", (F.col("up") * SPAN + F.col("k")).alias("idx"), F.concat("own", "path").alias("path"))
        known = written(found.unionByName(roots(level)), "merkle-paths")
    return known


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, source, leaf`` and others) with ``subroot``, ``root`` and ``path``, the siblings of every level from the leaf to the root.

    Leaves ascend by ``key``, then by digest, inside their ``source``.
    """
    others = [c for c in rows.columns if c not in ("key", "source", "leaf")]
    leaves = placed(rows, "source", ["key", "leaf", *others])
    level = leaves.select(F.col("source").alias("tree"), F.col("pos").alias("idx"), F.col("n").alias("size"), F.col("leaf").alias("digest"))
    # A null source is a tree too: named by an encoding that no other name has.
    name = F.coalesce(F.concat(F.lit(":"), F.col("tree")), F.lit("-"))
    stored = checkpoints(level.withColumn("tree", name))
    own = paths(stored).withColumnRenamed("path", "own")

    roots = stored[0].where("size = 1").select("tree", "digest")
    for more in stored[1:]:
        roots = roots.unionByName(more.where("size = 1").select("tree", "digest"))
    tops = placed(roots.withColumns({"source": F.when(F.col("tree") != "-", F.expr("substr(tree, 2)")), "all": F.lit("")}), "all", ["source"])
    top = checkpoints(tops.select(F.col("all").alias("tree"), F.col("pos").alias("idx"), F.col("n").alias("size"), "digest"))
    root = top[-1].select(F.col("digest").alias("root"))
    above = tops.join(paths(top).select(F.col("idx").alias("pos"), F.col("path").alias("above")), "pos").select("tree", F.col("digest").alias("subroot"), "above")
    above = written(above.crossJoin(F.broadcast(root.limit(1))), "merkle-sources")

    found = leaves.withColumn("tree", F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-")))
    found = found.join(own.withColumnRenamed("idx", "pos"), ["tree", "pos"]).join(above, "tree")
    return found.select("key", "source", "leaf", *others, "subroot", "root", F.concat("own", "above").alias("path"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proven(table(spark, sf_dir, "documents"))


def proven(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: its leaf, the roots, the digest of its proof, and what the proof says of a copy that may have been tampered with.

    Where 2 divides the id's crc32, the copy lacks its line ends.
    """
    leaf = lambda text: F.sha2(encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text), 256)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.col("text")
    shown = F.when(tampered & (F.instr(text, "\n") > 0), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), "source", leaf(text).alias("leaf"), shown.alias("shown"))
    found = manifest(rows).withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("path")))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# crc32 by its polynomial, a byte and eight shifts at a time.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, x: list_reduce([xor(c, x)] || range(8), lambda y, j: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"
OP12_SQL = f"""
WITH RECURSIVE e AS (SELECT doc_id, source, text, CASE WHEN crc32_even THEN replace(text, chr(10), '') ELSE text END AS shown, head FROM (SELECT *, {_CRC} % 2 = 0 AS crc32_even, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents)),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS given FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS h FROM p GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range(0, len(h), 3), lambda i: sha256(array_to_string(h[i + 1:i + 3], ''))) FROM t WHERE len(h) > 1),
s AS (SELECT source, h[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM t WHERE len(h) = 1),
u AS (SELECT 0 AS lvl, list(subroot ORDER BY spos) AS h FROM s
  UNION ALL SELECT lvl + 1, list_transform(range(0, len(h), 3), lambda i: sha256(array_to_string(h[i + 1:i + 3], ''))) FROM u WHERE len(h) > 1),
r AS (SELECT h[1] AS root FROM u WHERE len(h) = 1),
k AS (SELECT p.doc_id, p.source, p.pos, t.lvl, t.h, (p.pos // pow(3, t.lvl)::BIGINT) AS o FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source WHERE len(t.h) > 1
  UNION ALL SELECT p.doc_id, p.source, p.pos, s.height + u.lvl, u.h, (s.spos // pow(3, u.lvl)::BIGINT) FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON len(u.h) > 1),
g AS (SELECT source, pos, lvl, array_to_string(h[o - o % 3 + 1:o], '') AS b, array_to_string(h[o + 2:o - o % 3 + 3], '') AS a FROM k),
w AS (SELECT source, pos, sha256(string_agg(b || a, '' ORDER BY lvl)) AS proof, list(b ORDER BY lvl) AS b, list(a ORDER BY lvl) AS a FROM g GROUP BY source, pos),
f AS (SELECT p.source, p.pos, 0 AS i, p.given AS x, coalesce(w.b, []) AS b, coalesce(w.a, []) AS a FROM p LEFT JOIN w ON w.source IS NOT DISTINCT FROM p.source AND w.pos = p.pos
  UNION ALL SELECT source, pos, i + 1, sha256(b[i + 1] || x || a[i + 1]), b, a FROM f WHERE i < len(b))
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(w.proof, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = r.root AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN r LEFT JOIN w ON w.source IS NOT DISTINCT FROM p.source AND w.pos = p.pos JOIN f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos AND f.i = len(f.b)
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": OP12_SQL}
