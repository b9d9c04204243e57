"""Near-duplicate vectors by random-hyperplane signs, exact cosines and distributed components.

Equal vectors are one node from the start. Every node is hashed by the signs of its products with random hyperplanes in several tables; ``bits`` of a table grow with
the logarithm of the nodes, and the tables with them, so that a pair exactly at the threshold meets with probability ``recall`` and buckets stay small. What shares a bucket
is sifted by 256 sign bits, far above what a linked pair differs in, and then verified by its cosine in doubles.

A tight group is never compared pair by pair. Every node looks for a centre, the least node of one of its buckets, within half of the threshold's angle; two
nodes of one centre are then linked whatever lies between them, as angles add up at most. Groups of one centre are held against each other by their centres: their angle and the groups'
radii mostly tell that all pairs link, or none; only where they leave it open are the members compared, block by block, with counts as the result. A vector without a centre is a group of its own
with radius 0, so ordinary pairs are decided by their own cosine. Groups of vectors wider than that (cosines of 0.9 to 0.97 among thousands) are compared pair by pair by their sketches.

Defined results: a null vector, one without components, with a null or non-finite component or with zeros alone links with nothing; vectors of different lengths don't link; rows that
repeat an id are vectors of their own; a null id never names a component, and a component without ids has a null name and keeps all its rows; ties are decided by cosine >= ``least`` in doubles; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corpusmill.llm.components import connected_components
from corpusmill.llm.shingles import mix
from corpusmill.llm.tokens import small_batches
from corpusmill.sources.tables import table, written

#: Probability that a pair at the threshold shares a bucket.
RECALL = 0.98
#: Sign bits that travel with a node, as 64-bit integers.
SKETCH = 4
#: Nodes of a group that one block holds where two groups must be compared member by member.
BLOCK_NODES = 2_000
#: What a bound by angles must leave, far above the rounding of doubles.
MARGIN = 1e-7
_SKETCH = [f"s{i}" for i in range(SKETCH)]


def tables_for(nodes: int, least: float, recall: float) -> tuple[int, int]:
    """Bits of a table (about four nodes a bucket) and number of tables."""
    same = 1 - math.acos(least) / math.pi
    bits = max(6, math.ceil(math.log2(max(2, nodes))) - 2)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in doubles, from vectors of one dimension; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(raw: list[bytes]):
    """Places of the vectors of each length."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        at.setdefault(len(x), []).append(i)
    return at.values()


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """``rid, id, raw, h1, h2`` of every row (nulls where the vector links with nothing), written, and the numpy type of ``raw``."""
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    column = F.col(f"`{vec_col}`") if element == "float" else F.col(f"`{vec_col}`").cast("array<double>")

    def run(batches):
        for batch in batches:
            raws: list[bytes | None] = []
            for x in batch.column("v"):
                values = x.values
                ok = values is not None and len(values) > 0 and not values.null_count
                a = values.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                raws.append(a.tobytes() if ok and np.isfinite(a).all() and a.any() else None)
            names = [[None if r is None else xxh3_64_intdigest(r, seed) - (1 << 63) for r in raws] for seed in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(raws, pa.binary()), *[pa.array(x, pa.int64()) for x in names]], names=["rid", "id", "raw", "h1", "h2"])

    source = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("id"), column.alias("v"))
    return written(source.mapInArrow(run, "rid bigint, id bigint, raw binary, h1 bigint, h2 bigint"), "vectors"), kind


def _signs(nodes: DataFrame, kind: str, bits: int, tables: int) -> DataFrame:
    """``key, node`` and the sketch, a row for each node and table."""
    total = max(bits * tables, 64 * SKETCH)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, raw = batch.column("node").to_numpy(), batch.column("raw").to_pylist()
            for at in _by_length(raw):
                x = unit([raw[i] for i in at], kind).astype(np.float32)
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng(11).normal(size=(d, total)).astype(np.float32)
                signs = x @ planes[d] > 0
                sketch = np.packbits(signs[:, : 64 * SKETCH], axis=1).view(np.int64)
                powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                place = (signs[:, : bits * tables].reshape(len(at), tables, bits) * powers).sum(2, dtype=np.uint64)
                keys = mix(place + mix(np.arange(tables, dtype=np.uint64) + np.uint64(d << 20))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(ids[at], tables)), *[pa.array(np.repeat(sketch[:, j], tables)) for j in range(SKETCH)]], names=["key", "node", *_SKETCH]
                )

    return nodes.select("node", "raw").mapInArrow(run, "key bigint, node bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH))


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{a}.{_SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{_SKETCH[0]}"))))


def _most(angle: Column) -> Column:
    """Bits in which sketches at most ``angle`` apart differ, with six standard deviations to spare."""
    p = F.least(F.lit(0.5), angle / math.pi)
    return 64 * SKETCH * p + 6 * F.sqrt(64 * SKETCH * p * (1 - p))


def _angles(pairs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``pairs`` (``a, b`` and others) with ``cosine`` in doubles."""
    raw = lambda x: nodes.select(F.col("node").alias(x), F.col("raw").alias(f"raw_{x}"))
    joined, columns = pairs.join(raw("a"), "a").join(raw("b"), "b"), pairs.columns

    def run(batches):
        for batch in batches:
            a, b = batch.column("raw_a").to_pylist(), batch.column("raw_b").to_pylist()
            out = np.full(len(a), -2.0)
            for at in _by_length(a):
                at = [i for i in at if len(b[i]) == len(a[i])]
                if at:
                    out[at] = (unit([a[i] for i in at], kind) * unit([b[i] for i in at], kind)).sum(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out)], names=[*columns, "cosine"])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    return joined.select(*columns, "raw_a", "raw_b").mapInArrow(run, f"{kinds}, cosine double")


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _centres(signs: DataFrame, nodes: DataFrame, kind: str, half: float) -> DataFrame:
    """``node, home, angle`` of the nodes that found a centre, another node within the angle ``half``."""
    lead = F.min(F.struct("node", *_SKETCH)).alias("lead")
    # A row a bucket, made by partial sums and written: the join with it can be split where a bucket is hot.
    buckets = written(signs.groupBy("key").agg(lead, F.max("node").alias("last")).where("lead.node < last").select("key", "lead"), "vector-buckets")
    met = signs.select("key", "node", F.struct(*_SKETCH).alias("own")).join(buckets, "key").where(F.col("node") != F.col("lead.node")).where(_differ("own", "lead") <= _most(F.lit(half)))
    pairs = written(met.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct(), "vector-leads")

    def nearest(found: DataFrame) -> DataFrame:
        """The least of the centres that are near enough."""
        near = _angles(found, nodes, kind).withColumn("angle", _angle(F.col("cosine"))).where(F.col("angle") <= half - MARGIN)
        return near.groupBy("a").agg(F.min(F.struct("b", "angle")).alias("c")).select(F.col("a").alias("node"), F.col("c.b").alias("home"), F.col("c.angle").alias("angle"))

    first = written(nearest(pairs), "vector-homes")
    # A centre that has a centre itself: one step further, where that is near enough too.
    further = first.join(first.select(F.col("node").alias("home"), F.col("home").alias("next")), "home").select(F.col("node").alias("a"), F.col("next").alias("b"))
    second = nearest(further).select("node", F.col("home").alias("home2"), F.col("angle").alias("angle2"))
    return written(first.join(second, "node", "left").select("node", F.coalesce("home2", "home").alias("home"), F.coalesce("angle2", "angle").alias("angle")), "vector-homes")


def _members_apart(open_pairs: DataFrame, homes: DataFrame, nodes: DataFrame, sizes: DataFrame, kind: str, least: float) -> DataFrame:
    """``a, b, node, more`` of groups whose members must be compared: how many rows of the other group a node links with.

    Groups are cut into blocks; two blocks meet in a group of their own and give counts, never pairs.
    """
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(F.col(x) / BLOCK_NODES)).cast("int")
    many = sizes.select("home", "nodes")
    sized = open_pairs
    for x in "ab":
        sized = sized.join(many.select(F.col("home").alias(x), blocks("nodes").alias(f"blocks_{x}")), x)
    sized = written(sized, "vector-open")
    whole = homes.join(nodes.select("node", "raw", "m"), "node")

    def side(x: str, other: str) -> DataFrame:
        mine = sized.join(whole.withColumnRenamed("home", x), x)
        own = F.pmod(F.xxhash64("node"), F.col(f"blocks_{x}")).cast("int")
        return mine.withColumn(x + "_block", own).withColumn(other + "_block", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1))).select("a", "b", "a_block", "b_block", F.lit(x == "a").alias("first"), "node", "m", "raw")

    def meet(pdf):
        import pandas as pd

        left, right = pdf[pdf["first"]], pdf[~pdf["first"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "node": [], "more": []}).astype("int64")
        linked = unit(left["raw"].tolist(), kind) @ unit(right["raw"].tolist(), kind).T >= least
        more = np.concatenate([linked @ right["m"].to_numpy(), linked.T @ left["m"].to_numpy()]).astype(np.int64)
        out = pd.DataFrame({"a": pdf["a"].iat[0], "b": pdf["b"].iat[0], "node": np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()]), "more": more})
        return out[out["more"] > 0]

    return side("a", "b").unionByName(side("b", "a")).groupBy("a", "b", "a_block", "b_block").applyInPandas(meet, "a bigint, b bigint, node bigint, more bigint")


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    small_batches(vectors.sparkSession)
    rows, kind = _rows(vectors, id_col, vec_col)
    node = F.min("rid").alias("node")
    nodes = written(rows.where("raw IS NOT NULL").groupBy("h1", "h2").agg(node, F.count("*").alias("m"), F.first("raw").alias("raw")), "vector-nodes")
    bits, tables = tables_for(nodes.count(), least, recall)
    wide = math.acos(least)
    signs = written(_signs(nodes, kind, bits, tables), "vector-signs")
    found = _centres(signs, nodes, kind, wide / 2)

    # Every node's group: the one of its centre, or its own.
    homes = nodes.select("node", "m").join(found, "node", "left").select("node", "m", F.coalesce("home", "node").alias("home"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    homes = written(homes, "vector-groups")
    sizes = written(homes.groupBy("home").agg(F.sum("m").alias("w"), F.count("*").alias("nodes"), F.max("angle").alias("radius"), F.min("node").alias("rep")), "vector-sizes")

    # Groups that meet in a bucket, each once for a bucket; centres stand for their groups.
    centre = signs.select(F.col("node").alias("home"), *[F.col(s).alias(f"c_{s}") for s in _SKETCH]).join(found.select("home").distinct(), "home", "left_semi").distinct()
    told = found.select("node", "home").join(centre, "home").join(sizes.select("home", "radius"), "home")
    own = sizes.where("radius > 0").select(F.col("home").alias("node"), F.col("radius").alias("own_radius"))
    placed = signs.join(written(told, "vector-told"), "node", "left").join(own, "node", "left")
    at_centre = placed.select("key", F.coalesce("home", "node").alias("home"), F.coalesce("radius", F.when(F.col("home").isNull(), F.col("own_radius")), F.lit(0.0)).alias("radius"), *[F.coalesce(f"c_{s}", s).alias(s) for s in _SKETCH])
    met = at_centre.groupBy("key", "home").agg(F.first(F.struct("radius", *_SKETCH)).alias("c"))
    met = written(met, "vector-met")
    a, b = [met.select("key", F.col("home").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
    near = (F.col("a") < F.col("b")) & (_differ("ca", "cb") <= _most(F.col("ca.radius") + F.col("cb.radius") + wide))
    pairs = written(a.join(b, "key").where(near).select("a", "b").distinct(), "vector-pairs")
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("home").alias(x), F.col("w").alias(f"w_{x}"), F.col("radius").alias(f"r_{x}"), F.col("rep").alias(f"rep_{x}")), x)
    gap, reach = _angle(F.col("cosine")), F.col("r_a") + F.col("r_b")
    verdict = F.when(reach == 0, F.when(F.col("cosine") >= least, "all").otherwise("none")).when(gap + reach <= wide - MARGIN, "all").when(gap - reach > wide + MARGIN, "none").otherwise("open")
    judged = written(_angles(pairs, nodes, kind).withColumn("verdict", verdict).where("verdict <> 'none'"), "vector-judged")
    apart = written(_members_apart(judged.where("verdict = 'open'").select("a", "b"), homes.select("node", "home"), nodes, sizes, kind, least), "vector-apart")

    # Links of a node: the rest of its group, the groups that are linked as a whole, and what the blocks have counted.
    whole = judged.where("verdict = 'all'").select(F.explode(F.array(F.struct(F.col("a").alias("home"), F.col("w_b").alias("w")), F.struct(F.col("b").alias("home"), F.col("w_a").alias("w")))).alias("x"))
    by_home = sizes.join(whole.groupBy("x.home").agg(F.sum("x.w").alias("others")), "home", "left").select("home", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("base"))
    by_node = apart.groupBy("node").agg(F.sum("more").alias("more"))
    counted = homes.join(by_home, "home").join(by_node, "node", "left").select("node", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_links"))
    open_links = judged.join(apart.select("a", "b").distinct(), ["a", "b"], "left_semi").where("verdict = 'open'")
    edges = found.select(F.col("node").alias("a"), F.col("home").alias("b")).unionByName(judged.where("verdict = 'all'").unionByName(open_links).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    component = written(connected_components(edges), "vector-components")

    of_row = rows.select("rid", "id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left")
    of_row = of_row.join(counted, "node", "left").join(component.select(F.col("id").alias("node"), "component"), "node", "left")
    # A row that links with nothing is a component of its own, by a number that no node has.
    of_row = written(of_row.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node", -1 - F.col("rid")).alias("component")), "vector-rows")
    names = written(of_row.groupBy("component").agg(F.min("id").alias("component_id")), "vector-names")
    return of_row.join(names, "component").select(F.col("id").alias("vec_id"), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.id WHERE r.root < l.v)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(r.root) AS component_id, e.vec_id = min(r.root) AS kept FROM embeddings e LEFT JOIN n ON n.u = e.vec_id JOIN r ON r.id = e.vec_id GROUP BY e.vec_id, n.n
"""

QUERIES = {"op11_embedding_dedup": op11_embedding_dedup}
ORACLE = {"op11_embedding_dedup": OP11_SQL}
