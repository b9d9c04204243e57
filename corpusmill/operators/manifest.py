"""Chunk manifests: ranges, samples, hash trees and chains, comparison, extension and re-checks. The order of rows is data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import round_half_up
from corpusmill.operators.ordered import by_key


def ranges(sources: DataFrame, source: str, size: Column, step: int) -> DataFrame:
    """Fixed ranges of every source: ``pos, offset, length``."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), size - 1).cast("bigint"), F.lit(step).cast("bigint"))
    each = sources.where(size > 0).select(source, size.alias("size"), F.posexplode(starts).alias("pos", "offset"))
    return each.select(source, F.col("pos").cast("bigint").alias("pos"), "offset", F.least(F.lit(step).cast("bigint"), F.col("size") - F.col("offset")).alias("length"))


def u64be(n: Column) -> Column:
    """Eight big-endian bytes as hex digits."""
    return F.lpad(F.hex(n), 16, "0")


def leaf_hash(url: Column, offset: Column, length: Column, digest: Column) -> Column:
    """SHA-256 over address, offset, length and the chunk's own hash (hex)."""
    return F.sha2(F.unhex(F.concat(F.hex(F.encode(url, "UTF-8")), u64be(offset), u64be(length), digest)), 256)


def merkle_roots(leaves: DataFrame, key: str) -> DataFrame:
    """Root of the hash tree over each key's ``hash`` in the order of ``pos`` (0, 1, ...): pairs are hashed, an odd last node moves up as it is.

    Every round halves all trees at once by a grouping on (key, pos / 2); their number is the logarithm of the longest tree.
    """
    longest = leaves.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    level = leaves.select(key, "pos", "hash")
    while longest > 1:
        pair = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        joined = F.when(F.size("p") == 2, F.sha2(F.unhex(F.concat(F.col("p")[0]["hash"], F.get("p", F.lit(1))["hash"])), 256)).otherwise(F.col("p")[0]["hash"])
        level = level.groupBy(key, F.floor(F.col("pos") / 2).alias("pos")).agg(pair.alias("p")).select(key, "pos", joined.alias("hash"))
        longest = -(-longest // 2)
    return level.select(key, F.col("hash").alias("root"))


def merkle_fold(hashes: Column) -> Column:
    """The same root over an array of hex digests in one row, null if it is empty."""
    n = F.size(hashes)
    pair = lambda a, k: F.when(2 * k + 1 < F.size(a), F.sha2(F.unhex(F.concat(F.get(a, 2 * k), F.get(a, 2 * k + 1))), 256)).otherwise(F.get(a, 2 * k))
    halve = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda k: pair(a, k))
    rounds = F.when(n > 1, F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.get(F.aggregate(rounds, hashes, lambda a, _: halve(a)), F.lit(0))


def log_levels(leaves: DataFrame, key: str) -> DataFrame:
    """``level, pos, hash`` of every node of each key's log tree (RFC 9162) over the leaf hashes ``pos, hash``: a round a level, as for roots; an odd last node moves up."""
    longest = leaves.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    level = leaves.select(key, F.lit(0).alias("level"), "pos", "hash")
    out, depth = level, 0
    while longest > 1:
        depth += 1
        pair = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        joined = F.when(F.size("p") == 2, F.sha2(F.unhex(F.concat(F.lit("01"), F.col("p")[0]["hash"], F.get("p", F.lit(1))["hash"])), 256)).otherwise(F.col("p")[0]["hash"])
        level = level.groupBy(key, F.floor(F.col("pos") / 2).alias("pos")).agg(pair.alias("p")).select(key, F.lit(depth).alias("level"), "pos", joined.alias("hash"))
        out = out.unionByName(level)
        longest = -(-longest // 2)
    return out


def audit_paths(nodes: DataFrame, key: str) -> DataFrame:
    """``pos, hash, path, root`` of every leaf of ``nodes`` (as of ``log_levels``, written): ``path`` has (level, left, hash) of the siblings on the way up.

    Every leaf asks for its siblings at all levels, which one join answers.
    """
    top = nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    ask = F.transform(F.sequence(F.lit(0), F.lit(max(0, top - 1))), lambda k: F.struct(k.alias("level"), F.floor(F.col("pos") / F.pow(F.lit(2.0), k)).cast("bigint").alias("own")))
    leaves = nodes.where("level = 0").select(key, "pos", "hash")
    asked = leaves.select(key, "pos", F.explode(ask).alias("a")).select(key, "pos", "a.level", (F.col("a.own") % 2 == 1).alias("left"), F.when(F.col("a.own") % 2 == 1, F.col("a.own") - 1).otherwise(F.col("a.own") + 1).alias("at"))
    told = asked.join(nodes.select(key, "level", F.col("pos").alias("at"), F.col("hash").alias("sibling")), [key, "level", "at"])
    paths = told.groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("level", "left", F.col("sibling").alias("hash")))).alias("path"))
    roots = nodes.where(F.col("level") == top).select(key, F.col("hash").alias("root"))
    return leaves.join(paths, [key, "pos"], "left").join(roots, key).withColumn("path", F.coalesce("path", F.array().cast("array<struct<level:int,left:boolean,hash:string>>")))


def path_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf hash and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.unhex(F.when(x["left"], F.concat(F.lit("01"), x["hash"], h)).otherwise(F.concat(F.lit("01"), h, x["hash"]))), 256))


_NODE = "struct<level:int,pos:bigint>"


def _bits(n: Column) -> Column:
    """Binary digits of a number, 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(F.lit(0)).cast("int")


def _node(lo: Column, size: Column) -> Column:
    """The node over ``size`` leaves from ``lo``; a tree's last node may be an incomplete one, which moved up."""
    level = _bits(size - 1)
    return F.struct(level.alias("level"), F.floor(lo / F.pow(F.lit(2.0), level)).cast("bigint").alias("pos"))


def consistency_nodes(old: Column, new: Column) -> Column:
    """The nodes that prove a log of ``new`` entries to go on from one of ``old`` (RFC 9162), in order; none for equal sizes.

    Both sizes are split from the top: at each turn the half without the old end is a node, until the rest is all old.
    """
    begin = F.struct(F.lit(0).cast("bigint").alias("lo"), new.cast("bigint").alias("size"), old.cast("bigint").alias("m"), F.lit(True).alias("whole"), F.array().cast(f"array<{_NODE}>").alias("out"))

    def halve(a: Column, _: Column) -> Column:
        k = F.pow(F.lit(2.0), _bits(a["size"] - 1) - 1).cast("bigint")
        left = a["m"] <= k
        going = F.struct(
            F.when(left, a["lo"]).otherwise(a["lo"] + k).alias("lo"),
            F.when(left, k).otherwise(a["size"] - k).alias("size"),
            F.when(left, a["m"]).otherwise(a["m"] - k).alias("m"),
            (a["whole"] & left).alias("whole"),
            F.concat(F.array(F.when(left, _node(a["lo"] + k, a["size"] - k)).otherwise(_node(a["lo"], k))), a["out"]).alias("out"),
        )
        return F.when(a["m"] < a["size"], going).otherwise(a)

    done = F.aggregate(F.sequence(F.lit(1), _bits(new)), begin, halve)
    return F.transform(F.array(done), lambda d: F.when(d["whole"], d["out"]).otherwise(F.concat(F.array(_node(d["lo"], d["size"])), d["out"])))[0]


def prefix_nodes(size: Column) -> Column:
    """The whole subtrees that the first ``size`` entries fill, the smallest first."""
    all_ = F.transform(F.sequence(F.lit(0), _bits(size) - 1), lambda b: F.struct(b.cast("int").alias("level"), (F.floor(size / F.pow(F.lit(2.0), b)).cast("bigint") - 1).alias("pos")))
    return F.filter(all_, lambda x: x["pos"] % 2 == 0)


def prefix_root(hashes: Column) -> Column:
    """The root over whole subtrees, the smallest first."""
    return F.aggregate(F.slice(hashes, 2, F.greatest(F.lit(1), F.size(hashes))), hashes[0], lambda r, h: F.sha2(F.unhex(F.concat(F.lit("01"), h, r)), 256))


def consistent(old: Column, new: Column, old_root: Column, new_root: Column, path: Column) -> Column:
    """Whether a proof leads from both sizes to both roots (RFC 9162): one fold that rebuilds the old and the new root together."""
    zeros = lambda x: F.when(x > 0, F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0")))).otherwise(F.lit(0))
    down = lambda x, by: F.floor(x / F.pow(F.lit(2.0), by)).cast("bigint")
    power = F.regexp_replace(F.bin(old), "^1", "").rlike("^0*$")
    whole = F.when(power, F.concat(F.array(old_root), path)).otherwise(path)
    ones = zeros(old)  # as many ones end old - 1
    begin = F.struct(down(old - 1, ones).alias("f"), down(new - 1, ones).alias("s"), whole[0].alias("fr"), whole[0].alias("sr"), F.lit(True).alias("ok"))
    pair = lambda a, b: F.sha2(F.unhex(F.concat(F.lit("01"), a, b)), 256)

    def step(a: Column, c: Column) -> Column:
        inner = (a["f"] % 2 == 1) | (a["f"] == a["s"])
        up = F.when(inner, zeros(a["f"])).otherwise(F.lit(0)) + 1
        return F.struct(
            down(a["f"], up).alias("f"), down(a["s"], up).alias("s"), F.when(inner, pair(c, a["fr"])).otherwise(a["fr"]).alias("fr"), F.when(inner, pair(c, a["sr"])).otherwise(pair(a["sr"], c)).alias("sr"), (a["ok"] & (a["s"] != 0)).alias("ok")
        )

    end = F.aggregate(F.slice(whole, 2, F.greatest(F.lit(1), F.size(whole))), begin, step)
    proven = F.transform(F.array(end), lambda e: e["ok"] & (e["s"] == 0) & (e["fr"] == old_root) & (e["sr"] == new_root))[0]
    return F.when(old == new, (old_root == new_root) & (F.size(path) == 0)).when((old < 1) | (old > new) | (F.size(path) == 0), F.lit(False)).otherwise(proven)


def consistency_proofs(nodes: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``old, new, old_root, new_root, path`` of every row of ``heads`` (``key, old, new``, 1 <= old <= new = the log's size): the nodes of both are picked from ``nodes`` (of ``log_levels``, written) by one join.

    A proof has at most two nodes a level, so it is gathered in its row. Rows that repeat are proven once.
    """
    heads = heads.select(key, F.col("old").cast("bigint").alias("old"), F.col("new").cast("bigint").alias("new")).distinct()
    ask = lambda kind, of: F.transform(of, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["level"].alias("level"), x["pos"].alias("pos")))
    asked = heads.select(key, "old", "new", F.explode(F.concat(ask("path", consistency_nodes(F.col("old"), F.col("new"))), ask("old", prefix_nodes(F.col("old"))), ask("new", prefix_nodes(F.col("new"))))).alias("q"))
    told = asked.select(key, "old", "new", "q.*").join(nodes.select(key, "level", "pos", "hash"), [key, "level", "pos"])
    held = told.groupBy(key, "old", "new").agg(F.array_sort(F.collect_list(F.struct("kind", "i", "hash"))).alias("h"))
    of = lambda kind: F.transform(F.filter("h", lambda x: x["kind"] == kind), lambda x: x["hash"])
    return held.select(key, "old", "new", prefix_root(of("old")).alias("old_root"), prefix_root(of("new")).alias("new_root"), of("path").alias("path"))


def chain_head(hashes: Column) -> Column:
    """Head of a hash chain over an ordered array of hex digests: p becomes H(p, h), from 32 zero bytes."""
    return F.aggregate(hashes, F.lit("00" * 32), lambda p, h: F.sha2(F.unhex(F.concat(p, h)), 256))


def track_links(refs: Column) -> Column:
    """Head of a track: the text of the last link and the reference are hashed, from the hash of nothing; links are 128-bit."""
    seed = F.left(F.sha2(F.lit(""), 256), F.lit(32))
    return F.aggregate(refs, seed, lambda p, r: F.left(F.sha2(F.concat(p, r), 256), F.lit(32)))


def ordered(value: Column, *order: Column) -> Column:
    """The values of a group as an array in a stated order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))), lambda x: x["v"])


def spread(rows: DataFrame, key: str, pos: str, k: int) -> DataFrame:
    """Of each key's n rows in order: all if n <= k, else those at round(i * (n - 1) / (k - 1)); one row for k = 1."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: round_half_up(i * (F.col("n") - 1) / F.lit(max(1, k - 1))))
    return by_key(rows, key).withColumns({"n": n, "at": at}).where((F.col("n") <= k) | F.array_contains(marks, F.col("at").cast("bigint")))


def by_hash_order(rows: DataFrame, key: str, label: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each key by the hash of their label, which is the same choice in every source."""
    h = F.sha2(label, 256)
    return rows.withColumn("h", h).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("rank") <= n)


def last_by(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pos)))).where("_r = 1").drop("_r")


def compare(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """``status`` of every key: same, changed, only_a or only_b. Keys are unique on either side."""
    both = a.select(*key, F.col(value).alias("va"), F.lit(1).alias("ia")).join(b.select(*key, F.col(value).alias("vb"), F.lit(1).alias("ib")), key, "full_outer")
    status = F.when(F.col("ib").isNull(), "only_a").when(F.col("ia").isNull(), "only_b").when(F.col("va").eqNullSafe(F.col("vb")), "same").otherwise("changed")
    return both.withColumn("status", status).drop("ia", "ib")


def relist(before: DataFrame, after: DataFrame, listing: str, path: str, size: str, digest: str) -> DataFrame:
    """``status`` of every path: same, changed, added, and gone, or unseen where the new listing was cut short (``truncated``)."""
    cut = after.groupBy(listing).agg(F.max("truncated").alias("cut"))
    a = before.select(listing, path, F.struct(size, digest).alias("va"), F.lit(1).alias("ia"))
    b = after.select(listing, path, F.struct(size, digest).alias("vb"), F.lit(1).alias("ib"))
    both = a.join(b, [listing, path], "full_outer").join(cut, listing, "left")
    missing = F.when(F.coalesce("cut", F.lit(False)), "unseen").otherwise("gone")
    status = F.when(F.col("ia").isNull(), "added").when(F.col("ib").isNull(), missing).when(F.col("va") == F.col("vb"), "same").otherwise("changed")
    return both.withColumn("status", status).select(listing, path, "status")


def extend(structure: DataFrame, prior: DataFrame, key: str, pos: str, label: str, more: int) -> DataFrame:
    """Rows of a pointer after an extension: what it had, then the next ``more`` of the rest by hash order, in the structure's order."""
    had = prior.select(key, label, F.col("hash").alias("known"))
    marked = structure.join(had, [key, label], "left")
    rank = F.row_number().over(Window.partitionBy(key, F.col("known").isNull()).orderBy(F.sha2(F.col(label), 256)))
    kept = marked.withColumn("_r", rank).where(F.col("known").isNotNull() | (F.col("_r") <= more))
    return kept.select(key, pos, label, F.coalesce("known", "hash").alias("hash"), F.col("known").isNotNull().alias("carried"))


def keep_expired(prior: DataFrame, listed: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of a live window after a new listing: those that left it first, then the listed ones."""
    gone = prior.join(listed.select(key, label), [key, label], "left_anti").withColumn("expired", F.lit(True))
    return gone.unionByName(listed.withColumn("expired", F.lit(False)))


def moments(values: Column, nodata: float | None = None, digits: int = 4) -> dict[str, Column]:
    """``n, mean, sd, min, max`` of an array (population deviation), without NaN and ``nodata``; null where nothing is left."""
    from corpusmill.functions.text import significant

    ok = F.filter(values, lambda x: ~F.isnan(x) & (F.lit(True) if nodata is None else x != nodata))
    n = F.size(ok)
    total = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / F.when(n > 0, n)
    sd = F.sqrt(F.greatest(F.lit(0.0), squares / F.when(n > 0, n) - mean * mean))
    return {"n": n.cast("bigint"), "mean": significant(mean, digits), "sd": significant(sd, digits), "min": significant(F.array_min(ok), digits), "max": significant(F.array_max(ok), digits)}
