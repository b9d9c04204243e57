from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import proofs
from corpusmill.operators import manifest as M
from corpusmill.operators import ordered, records


def plain_root(hashes):
    level = [bytes.fromhex(h) for h in hashes]
    while len(level) > 1:
        level = [sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex() if level else None


def test_merkle_roots(spark):
    rows = [(k, i, sha256(f"{k}/{i}".encode()).hexdigest()) for k in (1, 2, 3, 5, 8, 13) for i in range(k)]
    got = {r.k: r.root for r in M.merkle_roots(spark.createDataFrame(rows, "k bigint, pos bigint, hash string"), "k").collect()}
    assert got == {k: plain_root([h for kk, _, h in rows if kk == k]) for k in (1, 2, 3, 5, 8, 13)}
    changed = [(k, i, sha256(b"x").hexdigest() if (k, i) == (5, 4) else h) for k, i, h in rows]
    other = {r.k: r.root for r in M.merkle_roots(spark.createDataFrame(changed, "k bigint, pos bigint, hash string"), "k").collect()}
    assert [k for k in got if got[k] != other[k]] == [5]


def test_chain_depends_on_order(spark):
    a, b = sha256(b"a").hexdigest(), sha256(b"b").hexdigest()
    df = spark.createDataFrame([([a, b],), ([b, a],), ([],)], "h array<string>")
    heads = [r[0] for r in df.select(M.chain_head(F.col("h"))).collect()]
    want = sha256(sha256(bytes(32) + bytes.fromhex(a)).digest() + bytes.fromhex(b)).hexdigest()
    assert heads[0] == want and heads[1] != want and heads[2] == "00" * 32


def test_spread(spark):
    rows = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(3)], "k bigint, p bigint")
    got = sorted((r.k, r.p) for r in M.spread(rows, "k", "p", 4).collect())
    assert got == [(1, 0), (1, 3), (1, 6), (1, 9), (2, 0), (2, 1), (2, 2)]
    assert [(r.k, r.p) for r in M.spread(rows, "k", "p", 1).orderBy("k").collect()] == [(1, 0), (2, 0)]


def test_tasks_of_samples_dont_grow_with_the_table(spark, monkeypatch):
    # A task's share is given by the rows, not by the number of shuffle partitions.
    monkeypatch.setattr(ordered, "TASK_ROWS", 50, raising=False)
    rows = spark.createDataFrame([(k, i) for k in range(100) for i in range(10)], "k bigint, p bigint")
    for got, each in ((M.spread(rows, "k", "p", 4), 4), (records.ends_and_some(rows, "k", "p", 6, 2), 4)):
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 12 and sum(r["count"] for r in sizes) == 100 * each
    assert M.spread(rows.limit(0), "k", "p", 4).count() == 0


def test_compare(spark):
    a = spark.createDataFrame([("s", "1", 0), ("c", "1", 0), ("a", "1", 0), ("d", "1", 0), ("d", "2", 1)], "k string, v string, pos int")
    b = spark.createDataFrame([("s", "1", 0), ("c", "2", 0), ("b", "1", 0), ("d", "2", 0)], "k string, v string, pos int")
    got = {r.k: r.status for r in M.compare(M.last_by(a, ["k"], "pos"), M.last_by(b, ["k"], "pos"), ["k"], "v").collect()}
    assert got == {"s": "same", "c": "changed", "a": "only_a", "b": "only_b", "d": "same"}


@pytest.mark.parametrize(("cut", "missing"), [(False, "gone"), (True, "unseen")])
def test_relist(spark, cut, missing):
    schema = "l int, p string, s int, h string"
    before = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 1, "x"), (1, "c", 1, "x")], schema)
    after = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "x"), (1, "d", 1, "x")], schema).withColumn("truncated", F.lit(cut))
    got = {r.p: r.status for r in M.relist(before, after, "l", "p", "s", "h").collect()}
    assert got == {"a": "same", "b": "changed", "c": missing, "d": "added"}


def test_extend_twice_goes_on(spark):
    all_ = spark.createDataFrame([(1, i, f"t{i}", f"h{i}") for i in range(10)], "k int, pos int, label string, hash string")
    first = M.extend(all_, all_.where("pos < 3").select("k", "label", "hash"), "k", "pos", "label", 2)
    second = M.extend(all_, first.select("k", "label", "hash"), "k", "pos", "label", 2)
    order = sorted((f"t{i}" for i in range(3, 10)), key=lambda x: sha256(x.encode()).hexdigest())
    assert {r.label for r in second.where("NOT carried").collect()} == set(order[2:4]) and second.count() == 7


def test_expired_rows_stay(spark):
    a, b = (spark.createDataFrame([(1, x) for x in xs], "k int, label string") for xs in ("abc", "bcd"))
    assert sorted((r.label, r.expired) for r in M.keep_expired(a, b, "k", "label").collect()) == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_moments(spark):
    df = spark.createDataFrame([([1.0, 2.0, float("nan"), -9999.0, 3.0],), ([],), ([float("nan")],)], "v array<double>")
    m = M.moments(F.col("v"), nodata=-9999.0)
    rows = df.select(*[c.alias(k) for k, c in m.items()]).collect()
    assert tuple(rows[0]) == (3, 2.0, 0.8165, 1.0, 3.0) and rows[1].n == 0 and rows[1].mean is None and rows[2].n == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 64), st.data())
def test_log_proofs(n, data):
    leaves = [proofs.leaf(bytes([i])) for i in range(n)]
    root, i, m = proofs.tree_root(leaves), data.draw(st.integers(0, n - 1)), data.draw(st.integers(1, n))
    path = proofs.inclusion_path(leaves, i)
    assert proofs.included(leaves[i], i, n, path, root)
    old, link = proofs.tree_root(leaves[:m]), proofs.consistency_path(leaves, m)
    assert proofs.consistent(m, n, old, root, link)
    flip = lambda b: bytes([b[0] ^ 1]) + b[1:]
    assert not proofs.included(flip(leaves[i]), i, n, path, root)
    for k in range(len(path)):
        assert not proofs.included(leaves[i], i, n, [*path[:k], flip(path[k]), *path[k + 1 :]], root)
    for k in range(len(link)):
        assert not proofs.consistent(m, n, old, root, [*link[:k], flip(link[k]), *link[k + 1 :]])
    assert not proofs.consistent(m, n, flip(old), root, link)


def test_audit_paths_are_the_published_ones(spark):
    from corpusmill.functions import proofs

    names = [("a", i, f"entry {i}") for i in range(11)] + [("b", 0, "only")]
    leaves = spark.createDataFrame([(k, i, proofs.leaf(x.encode()).hex()) for k, i, x in names], "k string, pos bigint, hash string")
    proven = {(r.k, r.pos): r for r in M.audit_paths(M.log_levels(leaves, "k"), "k").withColumn("led", M.path_root(F.col("hash"), F.col("path"))).collect()}
    for key in ("a", "b"):
        own = [proofs.leaf(x.encode()) for k, _, x in names if k == key]
        for i in range(len(own)):
            r = proven[key, i]
            assert r.root == proofs.tree_root(own).hex() == r.led
            assert [x["hash"] for x in r.path] == [x.hex() for x in proofs.inclusion_path(own, i)]


def test_a_root_in_one_row_is_the_root_by_rounds(spark):
    import hashlib

    rows = [(n, [hashlib.sha256(f"{n} {i}".encode()).hexdigest() for i in range(n)]) for n in range(0, 20)]
    df = spark.createDataFrame(rows, "k int, h array<string>")
    folded = {r.k: r.root for r in df.select("k", M.merkle_fold(F.col("h")).alias("root")).collect()}
    rounds = {r.k: r.root for r in M.merkle_roots(df.select("k", F.posexplode("h").alias("pos", "hash")), "k").collect()}
    assert folded.pop(0) is None and folded == rounds
