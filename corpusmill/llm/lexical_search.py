"""Ranked lexical search by one automaton over the texts.

The distinct terms of a block of items go, with a blank on either side, into an Aho-Corasick automaton, which every task holds. A text is brought to its terms with single
blanks between, so a guarded pattern matches whole terms only, and neighbours share a blank. The automaton's outputs are counted straight into term frequencies; nothing
is stored of a document. One scan of the texts gives the corpus' counts, a second scores: a term's output maps to the items that hold it, so a document is scored for just the items
it shares a term with. A task keeps the best of each item, and those meet in two steps, so that no task sees all tasks' rows of an item.

What is broadcast is bounded: items go in blocks of at most ``BLOCK_BYTES`` of terms (a single larger item is a block of its own), and each block is two scans.

Defined results: null texts and items have no terms; an item without terms has no rows; rows that repeat an item's or a document's id are rows of their own; null document ids come
after others of the same score; only scores above 0 are ranked; an empty table on either side gives an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import small_batches
from corpusmill.sources.tables import table, written

BEST = 50
#: Bytes of the terms of a block, each item's counted by itself; a term takes about ten times that in an automaton.
BLOCK_BYTES = 8_000_000
#: Groups in which the tasks' rows of an item meet first.
FIRST_STEP = 64
#: Bytes that stand between terms become blanks, A-Z small letters.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of ASCII letters, digits and characters from U+0080, A-Z lower-cased, in order."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()]


def _spaced(text: str) -> tuple[str, int]:
    """The terms of a text with single blanks between and around, and how many there are."""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    return b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass"), len(words)


class Terms:
    """A block's terms, and for each the items that hold it: ``items[start[t] : start[t + 1]]``."""

    def __init__(self, items: list[list[str]]):
        self.names = sorted({t for terms in items for t in terms})
        at = {t: i for i, t in enumerate(self.names)}
        held = np.array(sorted((at[t], k) for k, terms in enumerate(items) for t in terms), np.int64).reshape(-1, 2)
        self.n_items, self.items = len(items), held[:, 1]
        self.start = np.searchsorted(held[:, 0], np.arange(len(self.names) + 1))

    @cached_property
    def automaton(self):
        """Made once in a worker, for as long as it holds the broadcast block."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, t in enumerate(self.names):
            out.add_word(f" {t} ", i)
        out.make_automaton()
        return out

    def counts(self, spaced: str) -> Counter:
        """How often each term occurs."""
        return Counter(map(itemgetter(1), self.automaton.iter(spaced)))


class Best:
    """The best ``k`` documents of each item that a task has seen so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, bool)]
        self.new: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        """``scores`` of documents (rows) for all items (columns)."""
        row, item = np.nonzero(scores >= self.least)
        self.new.append((item, scores[row, item], docs[row], nameless[row]))
        self.held += len(row)
        if self.held > 200_000:
            self.cut()

    def cut(self) -> tuple:
        if self.new:
            item, score, doc, nameless = (np.concatenate([x, *y]) for x, y in zip(self.rows, zip(*self.new)))
            order = np.lexsort((doc, nameless, -score, item))
            item = item[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
            self.rows = [item, score[order], doc[order], nameless[order]]
            last = rank == self.k - 1
            self.least[item[last]] = self.rows[1][last]
            self.new, self.held = [], 0
        return tuple(self.rows)


def _blocks(items: DataFrame, block_bytes: int):
    """Items (numbers) with their distinct terms, streamed in blocks of at most ``block_bytes``, a single larger item apart."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.string()))], names=["item", "terms"])

    block, held = [], 0
    for row in items.select("item", "text").mapInArrow(run, "item bigint, terms array<string>").where(F.size("terms") > 0).toLocalIterator():
        n = sum(len(t.encode("utf-8", "surrogatepass")) + 1 for t in row["terms"])
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["item"], row["terms"]))
        held += n
    if block:
        yield block


def _corpus_counts(docs: DataFrame, shared, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each term of the block occurs; at most a row for each term and task is shuffled."""

    def run(batches):
        terms, df, n, total = shared.value, np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    spaced, length = _spaced(text)
                    if length:
                        n, total = n + 1, total + length
                        df[list(terms.counts(spaced))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms + 2, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(out[-1]), int(out[-2]), out[:-2]


def _block_best(docs: DataFrame, block: list, best: int) -> DataFrame:
    """``item, doc_id, score, rank`` of the items of a block."""
    terms = Terms([t for _, t in block])
    sc, numbers = docs.sparkSession.sparkContext, np.array([k for k, _ in block], np.int64)
    shared = sc.broadcast(terms)
    n_docs, total, df = _corpus_counts(docs, shared, len(terms.names))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights = sc.broadcast((weight, numbers))
    at_once = max(1, 2_000_000 // terms.n_items)

    def run(batches):
        t, (w, number) = shared.value, weights.value
        top, task = Best(t.n_items, best), pa.scalar(_task_number() % FIRST_STEP, pa.int32())
        fan = np.diff(t.start)
        waiting: list[tuple] = []

        def score():
            if not waiting:
                return
            ids, tf = (np.concatenate([x[i] for x in waiting]) for i in (0, 1))
            doc = np.repeat(np.arange(len(waiting)), [len(x[0]) for x in waiting])
            m = np.array([x[2] for x in waiting], np.int64)[doc]
            part = w[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            n = fan[ids]
            at = np.repeat(t.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
            scores = np.zeros(len(waiting) * t.n_items, np.int64)
            np.add.at(scores, np.repeat(doc * t.n_items, n) + t.items[at], np.repeat(part, n))
            named = [x[3] is not None for x in waiting]
            top.add(scores.reshape(-1, t.n_items), np.array([x[3] or 0 for x in waiting], np.int64), ~np.array(named))
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spaced, length = _spaced(text or "")
                counts = t.counts(spaced) if length else None
                if counts:
                    ids = np.fromiter(counts, np.int64, len(counts))
                    waiting.append((ids, np.fromiter(counts.values(), np.int64, len(counts)), 100 - 50 + (50 * length * n_docs) // total, doc_id))
                    if len(waiting) >= at_once:
                        score()
            score()
        item, score_, doc, nameless = top.cut()
        yield pa.RecordBatch.from_arrays([pa.array(number[item]), pa.array(doc, mask=nameless), pa.array(score_), pa.array(np.full(len(item), task.as_py(), np.int32))], names=["item", "doc_id", "score", "step"])

    found = docs.select("doc_id", "text").mapInArrow(run, "item bigint, doc_id bigint, score bigint, step int")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "step").orderBy(*order))).where(F.col("rank") <= best)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best).select("item", "doc_id", "score", "rank")


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def ranked_documents(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``best`` documents (``doc_id, text``) of each row of ``items`` (``item_id, text``)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Written, so that an item's number holds.
    numbered = written(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text", F.monotonically_increasing_id().alias("item")), "search-items")
    out = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    for block in _blocks(numbered, block_bytes):
        out = out.unionByName(written(_block_best(docs, block, best), "search-best"))
    return out.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
o AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM o, s GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + (50 * len(t) * n_docs) // total AS m FROM d, s WHERE len(t) > 0),
c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN o USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50
"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE = {"op13_lexical_search": OP13_SQL}
