"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sizes are cut into bands of ratio 5:4, so a link joins neighbouring bands at most. In the instance of a band, tokens are hashed into ``m`` segments;
two sets that link differ in at most ``(|A| + |B|) / 9`` tokens, so with more filled segments than that some segment is equal in
both. Allocation goes by cost: a set whose filled segments suffice indexes them only; another adds the one-deletion neighbourhoods of its segments (two
units each); a set for which even that is too little adds every token. Copies of a set are one node from the start.

Segments held by up to ``HOT_RUN`` nodes give pairs, and a pair must share as many of them as the pigeonhole demands. Segments held by more are
left out of that count; nodes for which the rest no longer suffices are compared to one pivot per such segment, and then across
the components that remain. Every candidate is verified on whole texts. Only linked components are the result, so that pairs inside a component need no check.

Defined results: a text without words has ``n_shingles`` 0 and links with nothing; null texts likewise; repeated rows share a component; a null
``doc_id`` never names a component; an empty table gives an empty result; other input columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corpusmill.llm.components import connected_components
from corpusmill.llm.shingles import mix, shingle_set
from corpusmill.llm.tokens import released, small_batches
from corpusmill.sources.tables import table, written

HOT_RUN = 16
#: Ids up to this count are broadcast to pick texts (8 bytes each); more are joined.
BROADCAST_IDS = 4_000_000
NO_ID = -(1 << 63)
_LEVEL = 1 << 8
#: Nodes of a long run that one group compares.
BLOCK_NODES = 1_000
#: Keys that a task gathers before it looks for long runs among them (24 bytes each).
KEYS_HELD = 150_000


def band_starts(top: int = 1 << 31) -> np.ndarray:
    """The least size of each band."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, np.int64)


STARTS = band_starts()


def segments_of(band: int) -> int:
    """Segments of a band's instance: a few more than the differences that its largest pair can have."""
    return int(1.04 * (STARTS[band + 1] / 4)) + 2


def _places(tokens: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and segment of every token."""
    h = mix(tokens + np.uint64(seed * 2 + 1))
    return h, ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def _instances(n: int):
    """Of a set of ``n`` tokens: the instances it takes part in (0: its own band's, 1: the lower's), and the filled segments each demands."""
    band = int(np.searchsorted(STARTS, n, "right")) - 1
    for which, instance in enumerate((band, band - 1)):
        if instance >= 0:
            partner = n * 5 // 4 if which == 0 else int(STARTS[band]) - 1
            if partner * 5 >= n * 4:
                yield which, instance, (n + partner) // 9 + 1


def filled_segments(tokens: np.ndarray) -> list[int]:
    """How many segments of a set hold a token, in its own and in the lower band's instance."""
    out = [0, 0]
    for which, instance, _ in _instances(len(tokens)):
        m = segments_of(instance)
        out[which] = int(np.count_nonzero(np.bincount(_places(tokens, m, instance)[1].astype(np.int64), minlength=m)))
    return out


def _segment_sums(tokens: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filled segments, their hash sums and sizes, and the tokens ordered by segment."""
    h, seg = _places(tokens, m, seed)
    order = np.argsort(seg, kind="stable")
    seg, h = seg[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg[first], np.add.reduceat(h, first), np.diff(np.append(first, len(h))), h


def _keys(values: np.ndarray, segs: np.ndarray, instance: int, level: int) -> np.ndarray:
    """Keys of segment contents; the low bits name instance and level."""
    h = mix(values + mix(segs * np.uint64(0x9E3779B97F4A7C15) + np.uint64(instance * 4 + level)))
    return (h & ~np.uint64(0x3FF)) | np.uint64(level * _LEVEL + instance)


def signatures(tokens: np.ndarray) -> np.ndarray:
    """All keys of a set."""
    keys = []
    for _, instance, need in _instances(len(tokens)):
        seg, sums, sizes, h = _segment_sums(tokens, segments_of(instance), instance)
        keys.append(_keys(sums, seg, instance, 0))
        if len(seg) >= need:
            continue
        # One-deletion neighbourhoods: segments of two and more tokens count twice.
        more = np.repeat(sizes > 1, sizes)
        keys += [_keys(sums, seg, instance, 1), _keys((np.repeat(sums, sizes) - h)[more], np.repeat(seg, sizes)[more], instance, 1)]
        if int(np.minimum(sizes, 2).sum()) < need:
            keys.append(_keys(tokens, np.zeros_like(tokens), instance, 2))
    return np.unique(np.concatenate(keys))


def _digest(tokens: np.ndarray, seed: int) -> int:
    return xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def _node(tokens: np.ndarray, clashes: dict[int, int]) -> int:
    """A set's name: its 64-bit hash; a hash that two sets share is replaced by another, as often as ``clashes`` says."""
    name = _digest(tokens, 0)
    while name in clashes:
        name = _digest(tokens, clashes[name])
    return name


def _named(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` in which two sets never share a name, and the seeds of the names that were replaced.

    Sets are told apart by 128 bits, name and ``check``. Few names clash (about n * n / 2^65 of n sets), so they go to every task.
    """
    clashes: dict[int, int] = {}
    while True:
        twice = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("c1"), F.max("check").alias("c2")).where("c1 <> c2")
        found = [r["node"] for r in twice.select("node").toLocalIterator()]
        if not found:
            return rows, clashes
        clashes |= {name: 2 + len(clashes) + i for i, name in enumerate(found)}
        rows = written(_nodes(docs, clashes), "jaccard-rows")


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hashes by place, in a power of two of bits not below four times their number.

    Two sets' sketches differ in at most as many bits as the sets differ in tokens. Halves combine by exclusive or to a sketch of half the bits.
    """
    bits = max(256, 1 << int(4 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _nodes(docs: DataFrame, clashes: dict[int, int]) -> DataFrame:
    """``doc_id, n, node, check, own, lower, sketch`` of every row."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                t = shingle_set(text)
                own = lower = 0
                if len(t):
                    own, lower = filled_segments(t)
                for to, x in zip(out, (len(t), _node(t, clashes) if len(t) else None, _digest(t, 1) if len(t) else None, own, lower, sketch(t) if len(t) else None)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:5]], pa.array(out[5], pa.binary())], names=["doc_id", "n", "node", "check", "own", "lower", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, n bigint, node bigint, check bigint, own bigint, lower bigint, sketch binary")


def _keys_of(docs: DataFrame, clashes: dict[int, int], hot_run: int) -> DataFrame:
    """``sig, node, pivot`` of every key of every row; copies that a task meets within ``KEYS_HELD`` keys count once.

    A key that more than ``hot_run`` of those nodes hold is a long run whatever the others say: its first node goes on with itself as pivot, the
    rest with that pivot. Only the first one need travel by key, so that a key that a third of all texts hold is no task of its own.
    """

    def run(batches):
        sigs, nodes, seen, held = [], [], set(), 0

        def out():
            s, v = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
            order = np.lexsort((v, s))
            s, v = s[order], v[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            count = np.diff(np.append(first, len(s)))
            long = np.repeat(count > hot_run, count)
            pivot = pa.array(np.repeat(v[first], count), mask=~long)
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(v), pivot], names=["sig", "node", "pivot"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                t = shingle_set(text)
                if len(t) and (node := _node(t, clashes)) not in seen:
                    seen.add(node)
                    s = signatures(t)
                    sigs.append(s)
                    nodes.append(np.full(len(s), node, np.int64))
                    held += len(s)
                    if held > KEYS_HELD:
                        yield out()
                        sigs, nodes, seen, held = [], [], set(), 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(released(run), "sig bigint, node bigint, pivot bigint")


def _runs(keys: DataFrame, hot_run: int) -> DataFrame:
    """``sig, a, b, long``: pairs of the nodes of a short run; of a long run each node ``a`` with a pivot ``b``. Streams over sorted rows."""

    def run(batches):
        sig, held, long, pivot = None, [], False, None
        out: list[tuple] = []

        def close():
            if not long:
                out.extend((sig, x, y, False) for i, x in enumerate(held) for y in held[i + 1 :])

        for batch in batches:
            p = batch.column("pivot")
            known = p.is_valid().to_numpy(zero_copy_only=False)
            s, v, p = batch.column("sig").to_numpy(), batch.column("node").to_numpy(), p.fill_null(0).to_numpy()
            # Nodes whose task knew the run to be long go on as they are; its pivot stands for them here.
            told = known & (p != v)
            if told.any():
                yield pa.RecordBatch.from_arrays([*map(pa.array, (s[told], v[told], p[told])), pa.array(np.ones(int(told.sum()), bool))], names=["sig", "a", "b", "long"])
            s, v, p = s[~told], v[~told], known[~told]
            if not len(s):
                continue
            # Keys that one node holds are the rule: only runs, and the ends of a batch, are looked at one by one.
            same = s[1:] == s[:-1]
            look = np.append(same, True) | np.append(True, same) | p
            for x, node, marked in zip(s[look].tolist(), v[look].tolist(), p[look].tolist()):
                if x != sig:
                    close()
                    sig, held, long, pivot = x, [node], False, node
                elif node != held[-1]:
                    held.append(node)
                if long:
                    if len(held) > 1:
                        out.append((sig, node, pivot, True))
                        held = [node]
                elif marked or len(held) > hot_run:
                    long = True
                    out.extend((sig, y, pivot, True) for y in held)
                    held = [node]
            if out:
                yield _pairs_batch(out)
                out.clear()
        close()
        if out:
            yield _pairs_batch(out)

    route = F.when(F.col("pivot") != F.col("node"), F.xxhash64("sig", "node")).otherwise(F.col("sig"))
    return keys.repartition(route).sortWithinPartitions("sig", "node").mapInArrow(released(run), "sig bigint, a bigint, b bigint, long boolean")


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    *ids, long = zip(*rows)
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in ids], pa.array(long, pa.bool_())], names=["sig", "a", "b", "long"])


def _candidates(runs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, c`` (pairs with what they share) and ``sig, node, pivot`` (long runs of the nodes that need them)."""
    instance, level = F.col("sig").bitwiseAND(F.lit(0xFF)), F.shiftright(F.col("sig"), 8).bitwiseAND(F.lit(3))
    marked = runs.withColumns({"instance": instance, "level": level})
    # A copy in another task may name a node of a run again.
    hot = marked.where("long").groupBy("sig", F.col("a").alias("node"), "instance", "level").agg(F.min("b").alias("pivot"))
    # Long runs by node and instance: what the count of shared segments must do without.
    lost = hot.where("level = 0").groupBy("node", "instance").agg(F.count("*").alias("lost"))
    starts = F.array(*[F.lit(int(x)) for x in STARTS])
    band = F.size(F.filter(starts, lambda x: x <= F.col("n"))) - 1
    sized = reps.select("node", "n", "own", "lower", band.alias("band"))
    hot_nodes = lost.join(sized, "node").withColumns({"filled": F.when(F.col("instance") == F.col("band"), F.col("own")).otherwise(F.col("lower")), "need": F.when(F.col("instance") == F.col("band"), F.floor((F.col("n") + F.floor(F.col("n") * 5 / 4)) / 9) + 1).otherwise(F.floor((F.col("n") * 2) / 9) + 1)})
    weak = hot_nodes.where("filled - lost < need").select("node", "instance")
    needed = hot.join(weak, ["node", "instance"], "left_semi").unionByName(hot.where("level > 0").select("node", "instance", "sig", "level", "pivot")).select("sig", "node", "pivot")
    pairs = marked.where("NOT long").groupBy("a", "b", "instance").agg(F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("c"), F.max("level").alias("level"))
    side = lambda x: sized.select(F.col("node").alias(x), *[F.col(y).alias(f"{x}_{y}") for y in ("n", "own", "lower", "band")])
    less = lambda x: lost.select(F.col("node").alias(x), "instance", F.col("lost").alias(f"{x}_lost"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("instance") == F.least("a_band", "b_band")).where("4 * greatest(a_n, b_n) <= 5 * least(a_n, b_n)")
    both = both.join(less("a"), ["a", "instance"], "left").join(less("b"), ["b", "instance"], "left")
    differ = F.floor((F.col("a_n") + F.col("b_n")) / 9)
    least = [F.when(F.col("instance") == F.col(f"{x}_band"), F.col(f"{x}_own")).otherwise(F.col(f"{x}_lower")) - F.coalesce(f"{x}_lost", F.lit(0)) - differ for x in "ab"]
    kept = both.where((F.col("level") > 0) | (F.col("c") >= F.greatest(*least))).select("a", "b", F.col("c").cast("bigint").alias("c"))
    return kept, needed


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, repeated: bool, clashes: dict[int, int]) -> DataFrame:
    """Those of ``pairs`` (``a, b`` nodes, written) whose whole texts link; ``repeated``: an id may stand for several texts.

    Pivots are the ``a`` of their pairs: texts of ``b`` are joined first, so that a pivot's text is read beside many others but isn't moved with each.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    need = written(reps.join(ends, "node", "left_semi").select("node", "key"), "jaccard-need")
    n = need.count()
    small = F.broadcast(need) if n <= BROADCAST_IDS else need
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    texts = keyed.join(small, "key").select("node", "text")

    def right(batches):
        for batch in batches:
            keep = [_node(shingle_set(t), clashes) == node for node, t in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    def link(batches):
        for batch in batches:
            cache: dict[int, np.ndarray] = {}
            keep = []
            for a, b, s, t in zip(*[batch.column(x).to_pylist() for x in ("a", "b", "s", "t")]):
                x = cache[a] if a in cache else cache.setdefault(a, shingle_set(s))
                y = cache[b] if b in cache else cache.setdefault(b, shingle_set(t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if repeated:
        texts = texts.mapInArrow(released(right), "node bigint, text string").dropDuplicates(["node"])
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    return written(joined.select("a", "b", "s", "t").mapInArrow(released(link), "a bigint, b bigint"), "jaccard-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_run: int = HOT_RUN) -> DataFrame:
    """``doc_id, n_shingles, node, component_id`` of every row; equal ``node`` means equal sets."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows, clashes = _named(written(_nodes(docs, {}), "jaccard-rows"), docs)
    total = rows.agg(F.count("*"), F.countDistinct(F.coalesce("doc_id", F.lit(NO_ID)))).first()
    reps = written(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("key"), F.max("n").alias("n"), F.max("own").alias("own"), F.max("lower").alias("lower"), F.min("sketch").alias("sketch")),
        "jaccard-nodes",
    )
    repeated = total[0] != total[1]
    runs = written(_runs(_keys_of(docs, clashes, hot_run), hot_run), "jaccard-runs")
    kept, hot = _candidates(runs, reps)
    hot = written(hot, "jaccard-hot")
    stars = hot.where("pivot <> node").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("c"))
    pairs = written(kept.unionByName(stars).groupBy("a", "b").agg(F.sum("c").alias("c")), "jaccard-candidates")
    # First every node with the one it shares most with; then only what still lies in different components.
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    best = each.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    best = written(best.distinct(), "jaccard-pairs")
    links = _verified(best, docs, reps, repeated, clashes)
    component = written(connected_components(links), "jaccard-components")

    def grown(more: DataFrame) -> None:
        """Verifies further pairs, if there are any, and joins components by them."""
        nonlocal links, component
        more = written(more.select("a", "b").distinct(), "jaccard-pairs")
        if more.limit(1).count():
            links = links.unionByName(_verified(more, docs, reps, repeated, clashes))
            component = written(connected_components(links), "jaccard-components")

    grown(_apart(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(best, ["a", "b"], "left_anti"), component))
    if hot.limit(1).count():
        of = component.select(F.col("id").alias("node"), F.col("component").alias("comp"))
        told = hot.join(of, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp"))
        # A row a run, made by partial sums and written: the join with it can then be split where a run is long.
        mixed = written(told.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("sig", "size"), "jaccard-mixed")
        grown(_across(told.join(mixed, "sig"), reps).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    # Names: the smallest document id of a component.
    named = reps.join(component.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    real = F.when(F.col("key") != NO_ID, F.col("key"))
    names = named.groupBy("component").agg(F.min(real).alias("component_id"))
    classes = named.join(names, "component").select("node", "component_id")
    return rows.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_run: int = HOT_RUN) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, nulls last; of rows that repeat it, one.

    Rows without words stay. The input is written with a number for each row, which holds when a task runs again; decisions are about rows, not ids.
    """
    row, columns = "jaccard_row", [F.col(f"`{c}`") for c in docs.columns]
    stored = written(docs.select(F.struct(*columns).alias("kept"), F.monotonically_increasing_id().alias(row)), "jaccard-input")
    numbered = stored.select("kept", F.col(f"kept.`{id_col}`").cast("bigint").alias("own_id"), F.col(f"kept.`{text_col}`").alias("text"), row)
    found = jaccard_components(numbered, row, "text", hot_run).where("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    ids = found.join(numbered.select(row, "own_id"), row)
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("own_id").isNull().alias("z"), "own_id", row)).alias("first"), F.count("*").alias("size")).where("size > 1")
    # Rows of a large group are split by the join with this written table, of a row a group.
    first = written(first.select("group", F.col(f"first.{row}").alias("first")), "jaccard-kept")
    gone = written(found.join(first, "group").where(F.col(row) != F.col("first")).select(row), "jaccard-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return numbered.join(gone, row, "left_anti").select("kept.*")


def _across(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of one long run (``sig, size, node, comp``) in different components whose sketches allow a link.

    Runs are cut into blocks of about ``BLOCK_NODES`` nodes, and every two blocks of a run meet in a group of their own.
    """
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    dealt = placed.withColumn("g", F.explode(meets)).select("sig", "g.lo", "g.hi", "block", "node", "comp").join(reps.select("node", "n", "sketch"), "node")

    def meet(pdf):
        import pandas as pd

        n, comp, node = pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["node"].to_numpy()
        least = min(map(len, pdf["sketch"]))
        bits = np.zeros((len(pdf), least // 8), np.uint64)
        for i, x in enumerate(pdf["sketch"]):
            bits[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0)
        side = pdf["block"].to_numpy()
        a, b = [], []
        for i in range(len(pdf)):
            # Two different blocks: only pairs between them; one block: each pair once.
            ok = (comp != comp[i]) & (node > node[i]) & (4 * np.maximum(n, n[i]) <= 5 * np.minimum(n, n[i]))
            if pdf["lo"].iat[0] != pdf["hi"].iat[0]:
                ok &= side != side[i]
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(1) <= (n[at] + n[i]) // 9]
            a.append(np.full(len(at), node[i]))
            b.append(node[at])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("sig", "lo", "hi").applyInPandas(meet, "a bigint, b bigint").distinct()


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    ends = [component.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    told = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return told.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE = {"op6_ngram_jaccard_join": OP6_SQL}
