"""Rules along ordered keys, and what is built on them, against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import collections as C
from corpusmill.operators.ordered import Sequence, joined, packed, running, through
from corpusmill.operators.quantiles import exact_quantiles
from corpusmill.operators.sections import STOP_WORDS


def plain_pack(sizes, opens, limit, content=0):
    out, section = [], 0
    for size, opened in zip(sizes, opens):
        if content and (content + size > limit or (2 * content > limit and opened)):
            content, section = 0, section + 1
        content += size
        out.append(section)
    return out, content, section


def test_states_of_blocks_put_together():
    rng = random.Random(1)
    for _ in range(600):
        limit, n = rng.choice([5, 10, 11, 50]), rng.randrange(1, 40)
        sizes = [rng.randrange(0, min(limit, rng.choice([3, limit])) + 1) for _ in range(n)]
        opens = [rng.random() < 0.3 for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(0, 6)))) if n > 1 else []
        blocks = [Sequence(np.array(sizes[a:b]), np.array(opens[a:b]), limit) for a, b in zip([0, *cuts], [*cuts, n])]
        found = [b.summary() for b in blocks]
        content = before = 0
        got = []
        for b, s in zip(blocks, found):
            got += b.sections(content, before).tolist()
            content, more = through(content, *s)
            before += more
        want, end, last = plain_pack(sizes, opens, limit)
        assert got == want and (content, before) == (end, last)
        whole = found[0]
        for s in found[1:]:
            whole = joined(whole, s)
        for content in range(limit + 1):
            assert through(content, *whole) == plain_pack(sizes, opens, limit, content)[1:]


@pytest.mark.parametrize(("bits", "fan"), [(17, 64), (3, 2), (0, 3)])
def test_packing_runs_through_a_key(spark, bits, fan):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(1, 30), rng.choice([True, False, False, None])) for i in range(300)] + [("one", 1, 100, True)]
    df = spark.createDataFrame(rows, "source string, at int, size int, opens boolean").repartition(5)
    got = {(r.source, r.at): r.section_no for r in packed(df, "source", ["at"], "size", "opens", 100, bits, fan).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        want, _, _ = plain_pack([r[2] for r in mine], [bool(r[3]) for r in mine], 100)
        assert [got[key, r[1]] for r in mine] == want
    assert packed(df.where("false"), "source", ["at"], "size", "opens", 100).count() == 0


@pytest.mark.parametrize("bits", [17, 2])
def test_running_numbers(spark, bits):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(40), i, rng.choice([None, 1, 2, 3]), "text") for i in range(200)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v int, n string").withColumnRenamed("n", "other").repartition(4)
    got = {r.id: r for r in running(df, ["key"], ["at", "id"], {"so_far": F.col("v")}, {"seen": F.col("v")}, bits).collect()}
    assert len(got) == 200
    for key in {r[0] for r in rows}:
        mine, total, last = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 0, None
        for pos, r in enumerate(mine):
            x = got[r[2]]
            assert (x.pos, x.n, x.so_far, x.seen, x.other) == (pos, len(mine), total, last, "text")
            total, last = total + (r[3] or 0), r[3] if r[3] is not None else last
    assert running(df.where("false"), ["key"], ["at"]).count() == 0


# ---- collections


def tokens(text):
    n = lambda p: len(re.findall(p, text))
    return max(1, math.floor(1.098 * n("[A-Za-z]+") + 2.207 * n("[0-9]+") + 0.569 * n(r"[^A-Za-z0-9_\s]") + 0.325 * n("\n") + 0.5))


def plain_notes(docs, limit, most, total):
    """Section and index notes of one collection: (name, blocks) in order, blocks as (title, depth, text) of at most ``limit`` characters."""
    many, all_docs = len(docs) > 1, docs
    while True:
        sections, before = [], None
        for name, blocks in docs:
            for title, depth, text in blocks:
                size = sum(len(b[2]) for b in sections[-1]) if sections else 0
                if not sections or size + len(text) > limit or (size > limit / 2 and (depth == 1 or name != before)):
                    sections.append([])
                sections[-1].append((name, title, text))
                before = name
        if len(sections) <= most or len(docs) == 1:
            break
        docs = docs[: math.floor(len(docs) * 0.95)]
    if len(sections) > most:
        return None
    bags = [Counter(w for w in re.findall("[a-z][a-z0-9_]{3,}", "".join(b[2] for b in s).lower()) if w not in STOP_WORDS) for s in sections]
    df = Counter(w for b in bags for w in b)
    rows = []
    for s, bag in zip(sections, bags):
        names = list(dict.fromkeys(b[0] for b in s))
        label = [("" if not many or (i and s[i - 1][0] == b[0]) or b[1].startswith(b[0]) else b[0] + " · ") + b[1] for i, b in enumerate(s)]
        if many and len(names) > 1:
            folder = names[0].split("/")[:-1]
            while folder and not all(n.split("/")[:-1][: len(folder)] == folder for n in names):
                folder.pop()
            title = f"{'/'.join(folder)}/ · {len(names)} files" if folder else f"{names[0]} + {len(names) - 1} more file{'s' if len(names) > 2 else ''}"
            covers = label
        else:
            title, covers = label[0], label[1:]
        plain = " ".join(re.sub(r"(?m)^#+\s[^\n]*$", "", s[0][2]).split())[:110]
        begins = f'begins "{plain}{"…" if len(plain) >= 110 else ""}"' if not covers and plain else ""
        score = sorted(((-round(c / sum(bag.values()) * math.log(len(sections) / df[w]), 12), i, w) for i, (w, c) in enumerate(bag.items()) if c >= 2 and df[w] < len(sections)), key=lambda x: x[:2])
        best = [w for *_, w in score[:6] if w not in " ".join(covers + [begins]).lower()][:5] if len(sections) >= 3 else []
        rows.append([title, covers, begins, best, "".join(b[2] for b in s)])
    length = [len("; ".join(r[1])) for r in rows]
    notes, lines = [], []
    for i, (title, covers, begins, best, text) in enumerate(rows):
        shown = ""
        if covers:
            budget, n = max(300, math.floor(length[i] * total / sum(length))) if sum(length) > total else math.inf, 0
            for c in covers:
                if shown and len(shown) + len(c) + 2 > budget:
                    break
                shown, n = shown + ("; " if shown else "") + c, n + 1
            shown += f"; +{len(covers) - n} more" if n < len(covers) else ""
        body = f"---\nsource: key\nsection: {i + 1} of {len(rows)}: {title}\n---\n\n{text.strip()}\n"
        notes.append(body)
        extra = "".join(f" · {x}" for x in (shown or begins, "terms: " + ", ".join(best) if best else "") if x)
        lines.append(f"- [{re.sub(r'[\[\]]', '', title)}]({hashlib.sha256(body.encode()).hexdigest()}): ~{tokens(text)} tokens{extra}")
    n = sum(tokens(r[4]) for r in rows)
    shown = f"{n}" if n < 1000 else f"{math.floor(n / 100 + 0.5) // 10}.{math.floor(n / 100 + 0.5) % 10}k" if n < 10_000 else f"{math.floor(n / 1000 + 0.5)}k"
    gone = f"\n## Not included\n\n- {len(all_docs) - len(docs)} lower-ranked files\n" if len(docs) < len(all_docs) else ""
    return notes, f"# key\n\n> {len(docs)} files. ~{shown} tokens in {len(rows)} sections.\n\n## Sections\n\n" + "\n".join(lines) + "\n" + gone


@pytest.mark.parametrize(("n", "limit", "most", "total", "folder"), [(1, 300, 50, 10_000, ""), (30, 300, 40, 900, "docs/"), (30, 400, 12, 400, ""), (6, 200, 200, 2_000, "a/b/")])
def test_notes_of_a_collection(spark, n, limit, most, total, folder):
    rng = random.Random(n + limit)
    words = ["alpha", "beta", "gamma", "delta", "the", "with", "omega1", "x", "sigma", "kappa", "lambda", "theta"]
    docs = []
    for d in range(n):
        blocks = []
        for k in range(rng.randrange(1, 6)):
            depth = rng.randrange(1, 4)
            title = " ".join(rng.choice(words) for _ in range(2))
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(4, 25)))
            blocks.append((title, depth, f"{'#' * depth} {title}\n{text}\n"))
        docs.append((f"{folder}doc{d}", blocks))
    rows = [("key", d, name, "".join(b[2] for b in blocks)[:-1]) for d, (name, blocks) in enumerate(docs)]
    sections, index = C.collection_notes(spark.createDataFrame(rows, "key string, at int, name string, md string"), limit, most, total)
    want = plain_notes(docs, limit, most, total)
    assert [r.body for r in sections.orderBy("section_no").collect()] == want[0]
    assert [r.body for r in index.collect()] == [want[1]]


def test_collections_at_the_edges(spark):
    schema = "key string, at int, name string, md string"
    rows = [(None, 1, "a", "one\n"), (None, 1, "a", "one\n"), ("k", None, "b", None), ("k", 2, "c", " \n"), ("k", 3, "d", "x" * 95 + "\n\n" + "y" * 400)]
    numbered = C.collection_sections(C.pieces_of(spark.createDataFrame(rows, schema), 100), 100)
    got = sorted((r.key or "", r.section_no, len(r.text)) for r in numbered.collect())
    assert [x for x in got if not x[0]] == [("", 0, 5), ("", 0, 5)] and sum(x[2] for x in got if x[0]) == 95 + 2 + 401
    assert all(sum(x[2] for x in got if x[:2] == s) <= 100 for s in {x[:2] for x in got})
    # One document that is still too much has no notes.
    sections, index = C.collection_notes(spark.createDataFrame(rows, schema), 100, 2)
    assert [r.key for r in index.collect()] == [None] and sections.count() == 1
    assert [x.count() for x in C.collection_notes(spark.createDataFrame([], schema))] == [0, 0]


# ---- order statistics


@pytest.mark.parametrize(("bins", "gathered"), [(4096, 4096), (64, 5)])
def test_exact_quantiles(spark, bins, gathered):
    rng = random.Random(6)
    inf = float("inf")
    values = {
        "even": [rng.random() for _ in range(500)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(300)],
        "one": [7.0],
        "same": [5.0] * 100,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(200)] + [1.7e308, -1.7e308],
        "close": [1e9 + i * 1e-6 for i in range(200)] + [0.0],
        None: [-0.0, 0.0, float("nan"), inf, -inf, None, 4.0],
        "none": [None, float("nan")],
    }
    rows = [(k, v) for k, found in values.items() for v in found]
    got = {r.key: r for r in exact_quantiles(spark.createDataFrame(rows, "key string, v double").repartition(4), ["key"], "v", {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.98, "e": 1.0}, bins, gathered).collect()}
    assert set(got) == set(values) - {"none"}
    for k, found in values.items():
        s = sorted(v for v in found if v is not None and math.isfinite(v))
        if s:
            assert [got[k][x] for x in "abcde"] == [s[min(len(s) - 1, math.floor(len(s) * q))] for q in (0.0, 0.02, 0.5, 0.98, 1.0)] and got[k].n == len(s)
    assert exact_quantiles(spark.createDataFrame([], "key string, v double"), ["key"], "v", {"a": 0.5}).count() == 0
