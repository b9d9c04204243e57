"""Near vectors, Merkle manifest and lexical search on edge rows and an empty table, and against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import embedding_dedup, lexical_search, merkle_manifest

# ---- 11: near vectors


def plain_links(rows, least=0.9):
    """Partners of every row by all pairs of numpy cosines, and components."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    links = {i: {j for j in ok if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= least} for i in ok}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in links:
        for j in links[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    names: dict = {}
    for i, (name, _) in enumerate(rows):
        names.setdefault(find(i), []).append(name)
    least_id = {r: min((x for x in found if x is not None), default=None) for r, found in names.items()}
    return [len(links.get(i, ())) for i in range(len(rows))], [least_id[find(i)] for i in range(len(rows))]


def around(rng, centre, angle, n):
    """Unit vectors at about ``angle`` from a centre."""
    d = rng.normal(size=(n, len(centre)))
    d -= (d @ centre)[:, None] * centre
    d /= np.linalg.norm(d, axis=1)[:, None]
    return math.cos(angle) * centre + math.sin(angle) * d


def vector_rows(rng, size=32):
    centre = lambda: (lambda c: c / np.linalg.norm(c))(rng.normal(size=size))
    groups = [around(rng, centre(), math.radians(4), 400), around(rng, centre(), math.radians(9), 60), around(rng, centre(), math.radians(13), 40)]
    c = centre()
    groups.append(np.vstack([around(rng, c, math.radians(a), 12) for a in (2, 8, 16, 24, 30)]))
    a = rng.normal(size=(300, size))
    groups += [a, np.vstack([around(rng, x / np.linalg.norm(x), math.radians(t), 1) * 7 for x, t in zip(a[:80], np.linspace(20, 30, 80))])]
    groups.append(np.repeat(around(rng, centre(), 0.3, 1), 50, axis=0))
    x = np.vstack(groups).astype(np.float32)
    order = rng.permutation(len(x))
    return [(int(i), x[j].tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK_NODES, 7])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_NODES", block)
    rows = vector_rows(np.random.default_rng(2))
    n_links, component = plain_links(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    found = [got[i].n_links for i, _ in rows]
    # No pair below the threshold is a link; of all links at most 2 in 100 are missed, near the threshold only.
    assert all(x <= y for x, y in zip(found, n_links)) and sum(found) >= 0.98 * sum(n_links)
    assert all(got[i].kept == (got[i].component_id == i) for i, _ in rows)
    same = [got[i].component_id == c for (i, _), c in zip(rows, component)]
    assert sum(same) >= 0.95 * len(rows)


def test_near_vectors_edges(spark, monkeypatch):
    e = [1.0] + [0.0] * 7
    near = [1.0, 0.3] + [0.0] * 6
    nan, inf = float("nan"), float("inf")
    rows = [(5, e), (3, e), (3, near), (None, near), (9, [2 * x for x in e]), (10, None), (11, []), (12, [0.0] * 8), (13, [nan] * 8), (14, [inf] + e[1:]), (15, [None] + e[1:]), (16, e[:4]), (17, e[:4]), (None, [0.0, 0.0, 0.0, 1.0] * 2), (18, [1e-30, *e[1:]]), (19, [3e38] * 8)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id int, embedding array<float>, node string, raw string")).collect()
    n_links, component = plain_links(rows)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key) == sorted([(r[0], n, c) for r, n, c in zip(rows, n_links, component)], key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    doubles = embedding_dedup.near_vectors(spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e200, 1.1e200])], "vec_id bigint, embedding array<double>")).collect()
    assert [r.n_links for r in doubles] == [1, 1]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).collect()[0].kept


def test_tables_grow_with_the_nodes():
    small, large = embedding_dedup.tables_for(10_000, 0.9, 0.98), embedding_dedup.tables_for(10**9, 0.9, 0.98)
    same = 1 - math.acos(0.9) / math.pi
    assert all(1 - (1 - same**bits) ** tables >= 0.98 and n / 2**bits <= 4 for n, (bits, tables) in ((10_000, small), (10**9, large)))


# ---- 12: Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) with what the contract asks for."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(part, (r[0], r[3], r[2], r[4], t))))
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    trees = {s: plain_tree([leaf(r, r[1]) for r in kept[s]]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(kept[s]):
            steps = []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    first = at - at % 3
                    steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
                    at //= 3
            gone = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            x = leaf(r, r[1].replace("\n", "") if gone else r[1])
            for a, b in steps:
                x = sha(a + x + b)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 27, 28), (82, 81, 80, 9, 1, 4, 2), (800,)])
def test_manifest_against_a_plain_tree(spark, sizes):
    rows = [(i * 7 + k, f"line {i}\nof {k}", None if i % 5 else "en", None if k == 1 else f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    got = merkle_manifest.proven(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))
    assert {r.verified for r in got} == {zlib.crc32(str(r[0]).encode()) % 2 == 1 for r in rows}


def test_manifest_edges(edges, edge_rows, empty):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, merkle_manifest.proven(edges).collect()), key=key) == sorted(plain_manifest([r[:5] for r in edge_rows]), key=key)
    assert merkle_manifest.proven(empty).count() == 0


def test_only_every_third_level_is_stored(spark):
    leaves = spark.range(1000).selectExpr("'t' AS tree", "id AS idx", "1000L AS size", "sha2(string(id), 256) AS digest")
    stored = merkle_manifest.checkpoints(leaves)
    assert [x.count() for x in stored] == [1000, 38, 2, 1]
    assert stored[-1].first()["digest"] == plain_tree([sha(str(i)) for i in range(1000)])[-1][0]


# ---- 13: lexical search


def plain_search(docs, items, best=50):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        ranked = []
        for d, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                ranked.append((-score, d is None, d or 0, d))
        out += [(item_id, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(ranked)[:best])]
    return out


WORDS = ["a", "B", "ab", "b-a", "Être", "être", "x1", "日本", "İ", "the", "the", "the", " ", "naïve_", "Z", "9"]


@pytest.mark.parametrize("block_bytes", [lexical_search.BLOCK_BYTES, 40])
def test_search_against_a_plain_version(spark, block_bytes):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", "\n", ".", "  ", "\x00", "/"])) for _ in range(n))
    docs = [(int(i % 180), text(int(rng.integers(0, 60)))) for i in range(200)] + [(None, text(20)), (None, None), (500, ""), (501, " ./ "), (502, text(30000))]
    items = [(int(i), text(int(rng.integers(1, 9)))) for i in range(12)] + [(3, "the ab"), (None, "ab"), (90, None), (91, "--"), (92, "absent")]
    frames = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id bigint, text string, item string, score string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical_search.ranked_documents(*frames, block_bytes=block_bytes).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items), key=key)


def test_search_keeps_the_best_of_many(spark, monkeypatch):
    docs = [(i, "common " + "pad " * (i % 97)) for i in range(3000)]
    got = lexical_search.ranked_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame([(1, "pad common")], "item_id bigint, text string"), best=5)
    assert sorted(map(tuple, got.collect())) == sorted(plain_search(docs, [(1, "pad common")], 5))
    top = lexical_search.Best(2, 3)
    scores = np.random.default_rng(0).integers(0, 5, (100, 2))
    for i in range(0, 100, 10):
        top.add(scores[i : i + 10], np.arange(i, i + 10), np.zeros(10, bool))
        top.cut()
    item, score, doc, _ = top.cut()
    assert [(d, s) for k, s, d in zip(item, score, doc) if k == 1] == sorted(((d, s) for d, s in enumerate(scores[:, 1].tolist()) if s), key=lambda x: (-x[1], x[0]))[:3]


def test_search_of_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.ranked_documents(empty, one).count() == 0 and lexical_search.ranked_documents(empty, none).count() == 0
    assert lexical_search.ranked_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), none).count() == 0


# ---- 2 and 9: plain versions of what the models compute


def test_scores_are_a_plain_convolution(spark):
    from pyspark.sql import functions as F

    from corpusmill.llm import toxicity

    rng = np.random.default_rng(31)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9)))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 30, 80)] + ["", None, "one", "Two words", "...", "a-b c_d É é"]
    ids = [r.ids for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", toxicity.word_ids(F.col("t")).alias("ids")).orderBy("i").collect()]
    rows = [np.array(x, np.int64) for x in ids]
    assert [len(x) // 5 for x in rows[-4:]] == [1, 2, 0, 6]
    model = toxicity.TextCnn().fit(rows[:60], np.array([i % 3 == 0 for i in range(60)], np.int64))
    got = model.score(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
    for x, score in zip(rows, got):
        vectors = [[sum(float(model.embed[i][d]) for i in word) for d in range(toxicity.DIM)] for word in x.reshape(-1, 5)]
        total = float(model.bias)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                responses = [sum(vectors[at + j][d] * float(model.filters[k][j][d][f]) for j in range(width) for d in range(toxicity.DIM)) for at in range(len(vectors) - width + 1)]
                if responses:
                    total += max(0.0, max(responses)) * float(model.out[k * toxicity.FILTERS + f])
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-4


def test_suffix_tree_of_null_ids_alone(spark):
    from corpusmill.llm import suffix_tree

    docs = spark.createDataFrame([(None, "a b c a b c"), (None, None), (None, "")], "doc_id bigint, text string")
    rows = suffix_tree.score_texts(docs).collect()
    # Nothing is learned from rows without an id: every token has the share of an unknown one.
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in rows) == [(1, 0, 0, False), (1, 0, 0, False), (7, 0, 0, False)]
    assert all(r.doc_id is None and math.isfinite(r.score) and abs(r.base_score - r.n_tokens * math.log10(0.1 / 0.1)) < 1e-9 for r in rows)
