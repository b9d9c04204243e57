"""Rules, consistency proofs and byte ranges."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import checks
from corpusmill.operators import manifest as M
from corpusmill.sources import ranges
from corpusmill.sources.tables import scratch_path, written

# ---- rules

RULES = [checks.Rule("big", "v above 1", "v > 1"), checks.Rule("named", "has a name", "name IS NOT NULL"), checks.Rule("unknown", "nothing is known", "CAST(NULL AS BOOLEAN)")]


def test_rules_in_one_pass(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 0, None), (3, None, "b"), (3, 1, "b")], "id int, v int, name string")
    rows = {r.rule: (r.rows, r.broken, r.open, r.verdict) for r in checks.report(df, RULES).collect()}
    assert rows == {"big": (4, 2, 1, "breaks"), "named": (4, 1, 0, "breaks"), "unknown": (4, 0, 4, "open")}
    assert sorted((r.id, r.broken) for r in checks.violations(df, RULES, ["id"]).collect()) == [(2, ["big", "named"]), (3, ["big"])]
    path = scratch_path(spark, "checked")
    seen = checks.written_checked(df, RULES, path)
    assert seen == {"rows": 4, "broken_big": 2, "open_big": 1, "broken_named": 1, "open_named": 0, "broken_unknown": 0, "open_unknown": 4} and spark.read.parquet(path).count() == 4
    assert {r.verdict for r in checks.report(df.limit(0), RULES).collect()} == {"open"} and checks.violations(df.limit(0), RULES, ["id"]).count() == 0
    with pytest.raises(ValueError):
        checks.report(df, [RULES[0], RULES[0]])


# ---- consistency


def node(a, b):
    return hashlib.sha256(b"\x01" + a + b).digest()


def plain_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return node(plain_root(leaves[:k]), plain_root(leaves[k:]))


def plain_proof(m, leaves, whole=True):
    n = len(leaves)
    if m == n:
        return [] if whole else [plain_root(leaves)]
    k = 1 << (n - 1).bit_length() - 1
    return plain_proof(m, leaves[:k], whole) + [plain_root(leaves[k:])] if m <= k else plain_proof(m - k, leaves[k:], False) + [plain_root(leaves[:k])]


def test_consistency_of_all_sizes(spark):
    sizes = [1, 2, 3, 7, 8, 13, 21, 33]
    leaf = lambda k, i: hashlib.sha256(f"{k}/{i}".encode()).digest()
    leaves = spark.createDataFrame([(n, i, leaf(n, i).hex()) for n in sizes for i in range(n)], "k int, pos bigint, hash string")
    heads = spark.createDataFrame([(n, m, n) for n in sizes for m in range(1, n + 1)] * 2, "k int, old int, new int")
    proofs = written(M.consistency_proofs(written(M.log_levels(leaves, "k"), "nodes"), heads, "k"), "proofs")
    rows = proofs.collect()
    assert len(rows) == sum(sizes)
    for r in rows:
        mine = [leaf(r.k, i) for i in range(r.k)]
        assert r.old_root == plain_root(mine[: r.old]).hex() and r.new_root == plain_root(mine).hex() and r.path == [x.hex() for x in plain_proof(r.old, mine)]
    old, new, a, b, path = (F.col(c) for c in ("old", "new", "old_root", "new_root", "path"))
    other, n = lambda h: F.sha2(h, 256), F.size("path")
    at = F.pmod(old, n)
    tries = {
        "try_right": M.consistent(old, new, a, b, path),
        "try_old_root": M.consistent(old, new, other(a), b, path),
        "try_new_root": M.consistent(old, new, a, other(b), path),
        "try_node": (n > 0) & M.consistent(old, new, a, b, F.transform(path, lambda h, i: F.when(i == at, other(h)).otherwise(h))),
        "try_less": (n > 0) & M.consistent(old, new, a, b, F.slice(path, F.lit(1), n - 1)),
        "try_more": M.consistent(old, new, a, b, F.concat(path, F.array(other(a)))),
        "try_size": (old < new) & M.consistent(old + 1, new, a, b, path),
    }
    got = proofs.select("old", "new", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in tries.items()]).collect()
    assert all(r.try_right for r in got) and not [(k, r.old, r.new) for r in got for k in tries if k != "try_right" and r[k]]
    assert M.consistency_proofs(written(M.log_levels(leaves, "k"), "nodes"), heads.limit(0), "k").count() == 0


# ---- byte ranges


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("ranges")
    rng = random.Random(3)
    for name, size in (("a.bin", 10_000), ("b.bin", 1), ("empty.bin", 0), ("large.bin", 300_000), ("_skipped", 50)):
        (top / name).write_bytes(rng.randbytes(size))
    return top


def test_ranges_are_the_whole_file_in_parts(spark, files):
    got = ranges.ranges_of(spark, str(files), step=4096, whole=100_000, spread=7).collect()
    assert {os.path.basename(r.path) for r in got} == {"a.bin", "b.bin", "large.bin"}
    for name in ("a.bin", "b.bin", "large.bin"):
        content, mine = (files / name).read_bytes(), sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.pos)
        assert [r.pos for r in mine] == (list(range(-(-len(content) // 4096))) if name != "large.bin" else ranges.places(300_000, 4096, 100_000, 7))
        for r in mine:
            part = content[r.offset : r.offset + r.length]
            x = np.frombuffer(part, np.uint8).astype(float)
            assert r.offset == r.pos * 4096 and r.length == min(4096, len(content) - r.offset) and r.hash == hashlib.sha256(part).hexdigest()
            assert np.allclose([r.mean, r.sd, r.least, r.greatest], [x.mean(), x.std(), x.min(), x.max()])
    # By Spark's own reader: the same rows.
    name = lambda r: (os.path.basename(r.path), *r[1:])
    assert sorted(map(name, ranges._from_whole_files(spark, str(files), 4096, 100_000, 7).collect())) == sorted(map(name, got))


def test_only_the_ranges_asked_for_are_read(spark, files, tmp_path):
    # A file with a hole of a terabyte: only its samples are read.
    sparse = tmp_path / "sparse.bin"
    with open(sparse, "wb") as f:
        f.truncate(1 << 40)
    got = ranges.ranges_of(spark, f"file://{sparse}", spread=5).collect()
    assert [r.pos for r in sorted(got)] == [0, 65536, 131072, 196607, 262143] and {r.greatest for r in got} == {0}


def test_stored_ranges_are_read_again(spark, files, tmp_path):
    copy = tmp_path / "c.bin"
    copy.write_bytes((files / "a.bin").read_bytes())
    stored = written(ranges.ranges_of(spark, str(copy), step=4096), "stored")
    assert {r.state for r in ranges.rechecked(stored).collect()} == {"same"}
    content = bytearray(copy.read_bytes())
    content[5000] ^= 1
    copy.write_bytes(content[:-1])
    more = spark.createDataFrame([("/nowhere/x", 0, 0, 5, "h"), (None, 1, 0, 5, "h"), (str(copy), 9, 0, 4096, None)], "path string, pos bigint, offset bigint, length bigint, hash string")
    rows = stored.select(*more.columns).unionByName(more)
    assert sorted((r.pos, r.state) for r in ranges.rechecked(rows).collect()) == [(0, "gone"), (0, "same"), (1, "changed"), (1, "gone"), (2, "short"), (9, "changed")]
    assert ranges.rechecked(more.limit(0)).count() == 0
