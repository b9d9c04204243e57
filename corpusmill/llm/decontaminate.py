"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, a table. Passages are weighted by TF-IDF, with document frequencies over all documents, and a randomised singular value
decomposition finds their latent space: each step is a pass over the table, whose tasks multiply their sparse rows with the current basis; sums are made by blocks of
terms, and the driver only orthogonalises a matrix of terms by rank.

A document's windows are searched for in that space by cosine. Only windows near enough of an item's words, in any order, are projected; others can't be confirmed. An item's cosine must reach a limit that is
calibrated on its own text: the least cosine of ``VARIANTS`` windows in which all but ``LCS_WITH_ANSWER`` of its words were replaced by the benchmark's ordinary words, so that nine of ten windows at the edge of a match pass and
fuller ones nearly always. An item of which the space keeps less than ``KEPT`` (a space of ``RANK`` directions can't keep thousands) goes without that limit: its windows are all verified, which is the exact way.

Verification takes words in the item's order or its clauses in any order: the longest common subsequence, and the share of the item's words that lie in runs of ``TILE`` words which the window holds too. Each decides alone, or from
``LCS_WITH_ANSWER`` on with an answer check (the item's answer, or its last quarter); runs in another order also need a limit that the space has set, so they are found by the cosine search alone.

What is broadcast is bounded by bytes: passages go in blocks of about ``BLOCK_WORDS`` words, and ``BLOCKS_AT_ONCE`` of them (20,000 items of 50 words) are one scan of the
documents for their frequencies, of ``TERMS_HELD`` terms at once, and one for the matches. A larger benchmark takes more scans, with the documents and their matches written in between.

Defined results: items and documents without words match nothing; of equal items each is reported; an item that several passages find is reported once, with its best
passage; ties of passages don't change a result, as the greatest shares count; repeated rows are checked each;
null ids stay null; an empty table on either side gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import released, small_batches
from corpusmill.sources.tables import table, written

#: Words of passages in a block (about 150 bytes each in a task, with their place in the latent space), and terms counted in one scan.
BLOCK_WORDS = 250_000
#: Blocks that one scan of the documents holds against every text.
BLOCKS_AT_ONCE = 4
TERMS_HELD = 300_000
#: Words of passages that one task multiplies.
PART_WORDS = 10_000
RANK = 128
OVERSAMPLE = 16
POWER_STEPS = 2
#: Items of more words are cut into passages of this many, half overlapping.
PASSAGE_WORDS = 96
#: Shares of an item's words found in order: enough alone, or enough with the answer.
LCS_ALONE = 0.8
LCS_WITH_ANSWER = 0.6
ANSWER_PART = 0.5
TERM_BLOCK = 512
#: Share of an item's squared TF-IDF weights that the space must keep for its cosine to decide, and windows on which its limit is set.
KEPT = 0.15
VARIANTS = 10
#: Words of a run that counts as a clause in whatever order.
TILE = 4

_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def tiled_part(passage: list, words: list) -> float:
    """Share of a passage's words that lie in runs of ``TILE`` words which ``words`` hold too, wherever they stand."""
    runs = lambda w: list(zip(*[w[i:] for i in range(TILE)]))
    there, covered = set(runs(words)), set()
    for i, run in enumerate(runs(passage)):
        if run in there:
            covered.update(range(i, i + TILE))
    return len(covered) / len(passage)


def passages_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, place, words, answer`` of every passage (lists of words), written; ``block`` deals them out by running sums of words."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item_id, text, told in zip(*[batch.column(c).to_pylist() for c in ("item_id", "text", "answer")]):
                w = words_of(text)
                for s in range(0, len(w), PASSAGE_WORDS // 2) if len(w) > PASSAGE_WORDS else [0]:
                    passage = w[s : s + PASSAGE_WORDS]
                    if passage and (s == 0 or len(passage) >= PASSAGE_WORDS // 2):
                        given = words_of(told) if told is not None else []
                        for to, x in zip(out, (item_id, s, passage, given or passage[-(-3 * len(passage) // 4) :] or passage)):
                            to.append(x)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["item_id", "place", "words", "answer"])

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text", answer.alias("answer"))
    rows = written(items.mapInArrow(cut, "item_id bigint, place int, words array<string>, answer array<string>"), "passages")
    words = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("words", "item_id", "place"), F.lit(blocks)).cast("int"))
    return written(dealt.repartition(max(1, -(-words // PART_WORDS))), "passage-blocks")


class Block:
    """Passages of a block: words, answers and term ids."""

    def __init__(self, items: list, words: list[list[str]], answers: list[list[str]]):
        self.items, self.words, self.answers = items, words, answers
        self.terms = {t: i for i, t in enumerate(sorted({x for w in self.words for x in w}))}


def sparse_rows(terms: dict[str, int], idf: np.ndarray, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows: limits of the rows, term ids and weights."""
    counts = [Counter(terms[x] for x in w) for w in words]
    ids = np.fromiter((t for c in counts for t in c), np.int64)
    times = np.fromiter((n for c in counts for n in c.values()), np.float32)
    return np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64), ids, times * idf[ids].astype(np.float32)


def times_basis(limits: np.ndarray, ids: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix; no row is empty."""
    return np.add.reduceat(weights[:, None] * basis[ids], limits[:-1], axis=0) if len(limits) > 1 else np.zeros((0, basis.shape[1]), np.float32)


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many rows each of ``terms`` occurs, and the number of rows; at most a row for each term and task is shuffled."""
    small_batches(docs.sparkSession)
    out: dict[str, int] = {}
    for start in range(0, max(1, len(terms)), TERMS_HELD):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms[start : start + TERMS_HELD]))

        def run(batches):
            known, counts, n = shared.value, Counter(), 0  # noqa: B023
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    n += 1
                    counts.update(known.intersection(words_of(text)))
            counts[""] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        found = docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out.update(zip(found["term"].to_pylist(), found["n"].to_pylist()))
        shared.destroy()
    return out, out.pop("", 0)


def randomised_svd(passages: DataFrame, terms: dict[str, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of ``passages`` (a table with ``words``), by subspace iteration from a random start."""
    sc = passages.sparkSession.sparkContext
    rank = min(rank, len(terms))
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(len(terms), min(len(terms), rank + OVERSAMPLE))))[0].astype(np.float32)
    shared = sc.broadcast((terms, idf))

    def product(basis):
        """A'A times basis: each task from its rows, summed by blocks of terms."""
        given = sc.broadcast(basis)

        def run(batches):
            at, w = shared.value
            total = np.zeros_like(given.value)
            for batch in batches:
                limits, ids, weights = sparse_rows(at, w, batch.column("words").to_pylist())
                y = times_basis(limits, ids, weights, given.value)
                np.add.at(total, ids, weights[:, None] * np.repeat(y, np.diff(limits), axis=0))
            starts = range(0, len(total), TERM_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), pa.array([total[s : s + TERM_BLOCK].astype("<f4").tobytes() for s in starts], pa.binary())], names=["at", "part"])

        def add(pdf):
            import pandas as pd

            out = sum(np.frombuffer(x, "<f4") for x in pdf["part"])
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "part": [out.tobytes()]})

        sums = passages.select("words").mapInArrow(run, "at int, part binary").groupBy("at").applyInPandas(add, "at int, part binary")
        rows = sums.orderBy("at").collect()
        given.destroy()
        return np.frombuffer(b"".join(bytes(r["part"]) for r in rows), "<f4").reshape(basis.shape)

    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    # Rayleigh-Ritz: the best directions inside the subspace.
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    shared.destroy()
    return (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


class Gate:
    """Which passages can be found at all, from the words alone.

    A match holds at least ``LCS_WITH_ANSWER`` of a passage's words, ``need`` of ``n``. So of its ``n - need + k`` rarest words at least ``k`` are
    there: ``terms`` lists those words with their passages, ``least`` the ``k``. Nothing that the LCS would confirm is left out.
    """

    def __init__(self, block: Block, df: np.ndarray):
        self.need, self.least, self.counts = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64), []
        rows = []
        for item, words in enumerate(block.words):
            ids = [block.terms[x] for x in words]
            need = next(m for m in range(len(ids) + 1) if m / len(ids) >= LCS_WITH_ANSWER)
            self.need[item], self.least[item] = need, -(-need // 2)
            rare = sorted(ids, key=lambda t: (df[t], t))[: len(ids) - need + self.least[item]]
            rows += [(t, item, n) for t, n in Counter(rare).items()]
            self.counts.append(tuple(np.array(x, np.int64) for x in zip(*sorted(Counter(ids).items()))))
        rows = np.array(sorted(rows), np.int64)
        self.start, self.items, self.times = np.searchsorted(rows[:, 0], np.arange(len(block.terms) + 1)), rows[:, 1], rows[:, 2]

    def passages(self, terms: np.ndarray) -> np.ndarray:
        """Passages that a text with these distinct terms may hold."""
        first, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(self.items[at], self.times[at], len(self.least)) >= self.least)

    def places(self, item: int, order: np.ndarray, ranked: np.ndarray, length: int) -> np.ndarray:
        """Multiples of ``length`` around which (one before, three from there) enough of a passage's words occur; ``ranked = ids[order]``."""
        terms, times = self.counts[item]
        first = np.searchsorted(ranked, terms)
        n = np.searchsorted(ranked, terms, "right") - first
        at = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        cells = -(-len(ranked) // length)
        there = np.zeros((len(terms), cells + 3), bool)
        there[np.repeat(np.arange(len(terms)), n), at // length + 1] = True
        return np.flatnonzero(times @ (there[:, :-3] | there[:, 1:-2] | there[:, 2:-1] | there[:, 3:]) >= self.need[item])


def calibrated(block: Block, df: np.ndarray, weighted: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """For every passage the least cosine, in the latent space, of windows that hold ``LCS_WITH_ANSWER`` of its words among ordinary ones."""
    rng = np.random.default_rng(7)
    ordinary = np.cumsum(df + 1.0)
    out = np.empty(len(block.words))
    for item, words in enumerate(block.words):
        ids = np.array([block.terms[x] for x in words])
        n = len(ids)
        mine = np.argsort(rng.random((VARIANTS, n)), axis=1) < -(-n * LCS_WITH_ANSWER // 1)
        other = np.searchsorted(ordinary, rng.random((VARIANTS, n)) * ordinary[-1], "right")
        v = weighted[np.where(mine, ids, other)].sum(1)
        out[item] = (v @ latent[item] / np.maximum(np.linalg.norm(v, axis=1), 1e-9)).min()
    return out


def _matcher(spark, block: Block, df: np.ndarray, idf: np.ndarray, space: np.ndarray):
    """A column function: the verified matches of a text with the block's items."""
    parts = [sparse_rows(block.terms, idf, block.words[i : i + 256]) for i in range(0, len(block.words), 256)]
    latent = np.vstack([times_basis(*p, space) for p in parts])
    kept = (latent**2).sum(1) / np.maximum(np.concatenate([np.add.reduceat(w**2, p[:-1]) for p, _, w in parts]), 1e-9) >= KEPT
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
    weighted = space * idf[:, None].astype(np.float32)
    limits = np.where(kept, calibrated(block, df, weighted, latent), -np.inf)
    # A window length for each class of item lengths, half as long again from one to the next.
    lengths = np.array([max(1, int(round(1.5 ** round(np.log(len(w)) / np.log(1.5))))) for w in block.words])
    shared = spark.sparkContext.broadcast((block, Gate(block, df), weighted, latent.astype(np.float32), lengths, limits))

    def matches(text, state):
        b, gate, weighted, q, sizes, least = state
        words = words_of(text)
        n = len(words)
        if not n:
            return
        ids = np.fromiter(map(lambda x, get=b.terms.get: get(x, -1), words), np.int64, n)
        held = gate.passages(np.unique(ids[ids >= 0]))
        if not len(held):
            return
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        projected: dict[tuple[int, int], np.ndarray] = {}

        def cosine(item: int, cell: int, length: int) -> float:
            """The best cosine in the latent space of the windows that start in a cell."""
            if (length, cell) not in projected:
                start = np.arange(cell * length, min((cell + 1) * length, n), max(1, length // 4))
                stop = np.minimum(start + length, n)
                d = np.stack([weighted[x[x >= 0]].sum(0) for x in (ids[i:j] for i, j in zip(start, stop))])
                projected[length, cell] = d / np.maximum(np.linalg.norm(d, axis=1), 1e-9)[:, None]
            return float((projected[length, cell] @ q[item]).max())

        by_item: dict = {}
        for item in held.tolist():
            passage, length = b.words[item], int(sizes[item])
            # Best cosine first: after a whole copy no other place can do better.
            for near, cell in sorted(((cosine(item, c, length), c) for c in gate.places(item, order, ranked, length).tolist()), reverse=True):
                if near < least[item]:
                    break
                around = words[max(0, (cell - 1) * length) : (cell + 2) * length + length // 2]
                found = lcs_length(passage, around) / len(passage)
                clauses = tiled_part(passage, around) if found < LCS_ALONE and least[item] > -np.inf else 0.0
                if max(found, clauses) < LCS_WITH_ANSWER:
                    continue
                told = lcs_length(b.answers[item], around) / len(b.answers[item])
                if max(found, clauses) >= LCS_ALONE or told >= ANSWER_PART:
                    row = (found, told, near, clauses)
                    by_item[b.items[item]] = max(by_item.get(b.items[item], row), row)
                if found == told == 1:
                    break
        for item_id, row in by_item.items():
            yield item_id, *row

    def run(batches):
        state = shared.value
        for texts in batches:
            yield pa.array([[dict(zip(_FIELDS, m)) for m in matches(text, state)] for text in texts.to_pylist()], _MATCHES)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(released(run), MATCHES)


MATCHES = "array<struct<item_id:bigint,lcs_part:double,answer_part:double,cosine:double,clause_part:double>>"
_FIELDS = ("item_id", "lcs_part", "answer_part", "cosine", "clause_part")
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), *[(x, pa.float64()) for x in _FIELDS[1:]]]))


def _matchers(docs: DataFrame, passages: DataFrame, blocks: list[int], rank: int) -> list:
    """A column function for each of ``blocks``; ``docs`` (``text``) gives the document frequencies."""
    mine = passages.where(F.col("block").isin(blocks))
    terms = mine.select(F.explode("words").alias("t")).distinct().orderBy("t").toArrow()["t"].to_pylist()
    counts, n = document_frequencies(docs, terms)
    out = []
    for i in blocks:
        mine = passages.where(F.col("block") == i)
        held = mine.orderBy("item_id", "place", "words").select("item_id", "words", "answer").toArrow()
        block = Block(*[held[c].to_pylist() for c in ("item_id", "words", "answer")])
        df = np.array([counts.get(t, 0) for t in block.terms], np.float64)
        idf = np.log((n + 1) / (df + 1)) + 0.1
        out.append(_matcher(docs.sparkSession, block, df, idf, randomised_svd(mine, block.terms, idf, rank)))
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, text_col: str = "text") -> DataFrame:
    """``docs`` with ``matches``, the items that a row's text holds. Rows stay where they are: only texts go to Python."""
    small_batches(docs.sparkSession)
    passages = passages_of(benchmark)
    blocks = sorted(r["block"] for r in passages.select("block").distinct().collect())
    out = docs.withColumn("matches", F.array().cast(MATCHES))
    for at in range(0, len(blocks), BLOCKS_AT_ONCE):
        if at:
            out = written(out, "matches")
        found = _matchers(docs.select(F.col(text_col).alias("text")), passages, blocks[at : at + BLOCKS_AT_ONCE], rank)
        for match in found:
            out = out.withColumn("matches", F.concat("matches", F.coalesce(match(F.col(text_col)), F.array().cast(MATCHES))))
    # Passages of an item may lie in several blocks: the greatest of an item's rows counts.
    ranked = lambda m: F.filter(m, lambda x, k: ~F.coalesce(F.get(m, k + 1)["item_id"].eqNullSafe(x["item_id"]) & (k + 1 < F.size(m)), F.lit(False)))
    return out.withColumn("matches", F.array_sort("matches")).withColumn("matches", ranked(F.col("matches")))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, lcs_part, answer_part, cosine, clause_part`` of every document that holds a benchmark item.

    ``benchmark`` has ``item_id``, ``text`` and, if known, ``answer``.
    """
    rows = with_matches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, rank)
    return rows.select("doc_id", F.explode("matches").alias("m")).select("doc_id", *[f"m.{x}" for x in _FIELDS])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE: dict[str, str] = {}
