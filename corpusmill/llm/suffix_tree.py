"""Language-model scoring by a probabilistic suffix tree over words.

Frequent words are symbols, all others share one symbol whose words are told apart by their counts. A context (up to ``DEPTH`` symbols) is looked
at if it occurs often enough, and kept if its next-symbol distribution diverges from that of the shorter suffix by a
likelihood-ratio test. Kept distributions are smoothed towards the shorter suffix; a text is scored from its longest kept suffixes.

"Often enough" is a count that grows more slowly than the corpus, as ``LEAST * (tokens / 1e6) ** GROWTH``: estimates get better and the tree gets larger with every further text.
With Zipf's law the number of symbols, contexts and entries grows as ``tokens ** (1 - GROWTH)``; certain bounds are ``tokens / least`` a depth. That part is broadcast.

Counts come from all training texts by partial sums in tasks and a shuffle. All symbols and at least ``LOCAL_WORDS`` words are held with their counts by every task; rarer words get theirs by a join.
Contexts are named by 64-bit hashes.

Defined results: a null text is empty and consists of the end token; repeated rows are scored each; a null ``doc_id`` is neither held out nor
learned from; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import mix
from corpusmill.llm.tokens import small_batches
from corpusmill.sources.tables import table, written

DEPTH = 3
LEAST = 20
GROWTH = 0.75
#: Counts of symbols and of entries that are kept, as parts of a context's.
SYMBOL_PART = 0.5
ENTRY_PART = 0.1
LOCAL_WORDS = 1 << 18
PRIOR = 0.1
SMOOTH = 20.0
OTHER, END, FIRST = 0, 1, 2
_BITS = 24
_FLUSH = 400_000


def least_count(total: int) -> float:
    """How often a context must occur among ``total`` tokens."""
    return max(LEAST, LEAST * (total / 1e6) ** GROWTH)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than blank and U+0009..U+000D, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of ``text``; the empty word stands for the end token."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > _FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the most frequent words, the first of which are symbols."""

    def __init__(self, words: list[bytes], counts: np.ndarray, symbols: int, total: int, distinct: int):
        self.words, self.counts, self.symbols, self.total, self.distinct = words, counts, symbols, total, distinct
        self._ids: dict[bytes, int] | None = None

    def ids(self) -> dict[bytes, int]:
        """Word to rank; made once in each worker."""
        if self._ids is None:
            self._ids = {w: i for i, w in enumerate(self.words)}
        return self._ids

    def __getstate__(self):
        return self.__dict__ | {"_ids": None}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of ``counts`` that workers hold. Its least count follows from a histogram of counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    symbol_least = max(2, SYMBOL_PART * least_count(total))
    # Distinct counts are few: their number grows as the square root of the tokens at most.
    least, held = 1, 0
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if held + n > LOCAL_WORDS and c < symbol_least:
            least = c + 1
            break
        held += n
    found = counts.where((F.col("c") >= least) & (F.col("word") != "")).toArrow()
    order = np.lexsort((found["word"].to_numpy(zero_copy_only=False).astype(str), -found["c"].to_numpy())) if len(found) else np.empty(0, np.int64)
    c = found["c"].to_numpy()[order] if len(found) else np.empty(0, np.int64)
    symbols = int((c >= symbol_least).sum())
    words = [w.encode() for w in found["word"].take(pa.array(order)).to_pylist()] if len(found) else []
    return Vocabulary(words, c, symbols, total, distinct)


def _symbols(ranks: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols of ranks (-1: not held)."""
    return np.where((ranks >= 0) & (ranks < symbols), ranks + FIRST, OTHER)


def longer(keys: np.ndarray, syms: np.ndarray) -> np.ndarray:
    """Keys of contexts with one more, newest symbol; the empty context's key is 0."""
    return mix(keys.astype(np.uint64) + mix(syms.astype(np.uint64) + np.uint64(1))).astype(np.int64)


def _contexts(syms: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``depth`` symbols before each token, and where they are: not where the text starts later or one of them is no symbol."""
    key, ok = np.zeros(len(syms), np.int64), place >= depth
    for back in range(depth, 0, -1):
        prev = np.full_like(syms, OTHER)
        prev[back:] = syms[:-back]
        ok &= prev >= FIRST
        key = longer(key, prev)
    return key, ok


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _sequence(texts: list, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ranks of the tokens of all texts in a row (-2: the end), their places in their texts, and the words."""
    words = [words_of(t) for t in texts]
    n = sum(map(len, words)) + len(words)
    ranks, place, at = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for w in words:
        ranks[at : at + len(w)] = np.fromiter((ids.get(x, -1) for x in w), np.int64, len(w))
        ranks[at + len(w)] = -2
        place[at : at + len(w) + 1] = np.arange(len(w) + 1)
        at += len(w) + 1
    return ranks, place, words


def count_contexts(texts: DataFrame, vocab, contexts: np.ndarray, depth: int) -> DataFrame:
    """``key, n``: context (a place in ``contexts``) and next symbol, packed, with their count."""
    shared = texts.sparkSession.sparkContext.broadcast(contexts)

    def run(batches):
        v, known = vocab.value, shared.value
        parts, held = [], 0

        def out():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            ranks, place, _ = _sequence(batch.column("text").to_pylist(), v.ids())
            syms = np.where(ranks == -2, END, _symbols(ranks, v.symbols))
            keys, ok = _contexts(syms, place, depth)
            at = _find(known, keys)
            has = ok & (at >= 0)
            parts.append((at[has] << _BITS) | syms[has])
            held += len(parts[-1])
            if held > 4_000_000:
                yield out()
                parts, held = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Root distribution over symbols, and by depth the kept contexts with their entries and back-off factors (log10)."""

    def __init__(self, vocab: Vocabulary, ends: int):
        k = vocab.symbols
        mass = np.zeros(k + FIRST)
        mass[END], mass[FIRST:] = ends, vocab.counts[:k]
        mass[OTHER] = max(0, vocab.total - mass.sum())
        self.root = np.log10((mass + PRIOR) / (vocab.total + PRIOR * len(mass)))
        self.levels: list[tuple] = []

    def log_p(self, syms: np.ndarray, contexts: list[tuple]) -> np.ndarray:
        """log10 P of symbols; ``contexts[d]`` has the keys of the last ``d + 1`` symbols, and where there are so many. Longer kept suffixes override shorter ones."""
        p = self.root[syms]
        for (keys, ok), (kept, back, entries, values) in zip(contexts, self.levels):
            at = np.where(ok, _find(kept, keys), -1)
            entry = _find(entries, (at << _BITS) | syms)
            p = np.where(at < 0, p, np.where(entry >= 0, values[np.maximum(entry, 0)] if len(values) else p, p + (back[np.maximum(at, 0)] if len(back) else 0)))
        return p

    def add_level(self, contexts: np.ndarray, suffixes: list[np.ndarray], totals: np.ndarray, at: np.ndarray, syms: np.ndarray, n: np.ndarray) -> None:
        """Keeps those ``contexts`` (ascending) whose entries (by context and symbol) diverge from the shorter suffix; ``suffixes`` has the keys of theirs, the shortest first."""
        parent = 10 ** self.log_p(syms, [(x[at], True) for x in suffixes])
        size = len(contexts)
        seen, below, count = (np.bincount(at, x, size) for x in (n, parent, np.ones(len(at))))
        gain = np.bincount(at, n * np.log(n / totals[at] / parent), size)
        rest, left = totals - seen, np.maximum(1e-12, 1 - below)
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / totals / left), 0)
        # Twice the gain is chi-squared with a degree for each entry if the context tells nothing.
        kept = (2 * gain > count + 4 * np.sqrt(2 * count) + 10) & (gain > 0.005 * totals)
        p = (n + SMOOTH * parent) / (totals[at] + SMOOTH)
        given = np.bincount(at, p, size)
        back = np.log10(np.maximum(1e-12, 1 - given) / left)
        place = np.cumsum(kept) - 1
        use = kept[at]
        self.levels.append((contexts[kept], back[kept], (place[at[use]] << _BITS) | syms[use], np.log10(p[use])))


def learn(texts: DataFrame, counts: DataFrame, vocab: Vocabulary):
    """The suffix tree of ``texts``; a pass for each depth."""
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tree = SuffixTree(vocab, ends)
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    least = least_count(vocab.total)
    k = int((vocab.counts[: vocab.symbols] >= least).sum())
    contexts, suffixes = longer(np.zeros(k, np.int64), np.arange(FIRST, FIRST + k)), []
    contexts = np.sort(contexts)
    for depth in range(1, DEPTH + 1):
        if not len(contexts):
            break
        grams = written(count_contexts(texts, shared, contexts, depth), "contexts")
        totals = grams.groupBy(F.shiftright("key", _BITS).alias("at")).agg(F.sum("n").alias("n")).toArrow()
        all_ = np.zeros(len(contexts))
        all_[totals["at"].to_numpy()] = totals["n"].to_numpy()
        found = grams.where(F.col("n") >= max(2, ENTRY_PART * least)).orderBy("key").toArrow()
        key, n = found["key"].to_numpy(), found["n"].to_numpy().astype(float)
        at, syms = key >> _BITS, key & ((1 << _BITS) - 1)
        tree.add_level(contexts, suffixes, np.maximum(all_, 1), at, syms, n)
        on = (syms >= FIRST) & (n >= least)
        # A context's suffixes grow with it; the shortest is the newest symbol alone.
        suffixes = [longer(np.zeros(int(on.sum()), np.int64), syms[on]), *[longer(x[at[on]], syms[on]) for x in suffixes]]
        contexts = longer(contexts[at[on]], syms[on])
        order = np.argsort(contexts)
        contexts, suffixes = contexts[order], [x[order] for x in suffixes]
    shared.destroy()
    return tree


def _local_scores(docs: DataFrame, vocab: Vocabulary, tree: SuffixTree) -> DataFrame:
    """What the broadcast counts tell of each row, and its words that they don't hold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, tree))

    def run(batches):
        v, t = shared.value
        logs = np.log10(np.append(v.counts, [0, 0]) + PRIOR)
        end_log = np.log10(10 ** t.root[END] * (v.total + PRIOR * len(t.root)))
        for batch in batches:
            ranks, place, words = _sequence(batch.column("text").to_pylist(), v.ids())
            ends = ranks == -2
            syms = np.where(ends, END, _symbols(ranks, v.symbols))
            p = t.log_p(syms, [_contexts(syms, place, d + 1) for d in range(len(t.levels))])
            own = np.where(ends, end_log, np.where(ranks >= 0, logs[ranks], 0))
            first = np.flatnonzero(place == 0)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)  # noqa: B023, E731
            rare = []
            stops = np.append(first[1:], len(ranks))
            for w, a, b in zip(words, first, stops):
                rare.append([{"word": x.decode("utf-8", "replace"), "n": n} for x, n in Counter(w[i] for i in np.flatnonzero(ranks[a : b - 1] == -1)).items()])
            sums = [add(x).astype(np.int64) for x in (np.ones(len(ranks)), (ranks >= 0) | (ends & (v.total > 0)), syms == OTHER)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), *map(pa.array, sums), pa.array(add(own)), pa.array(add(p + np.where((syms == OTHER) & (ranks >= 0), own, 0))), pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))],
                names=["rid", "doc_id", "n_tokens", "n_known", "n_other", "own", "p", "rare"],
            )

    schema = "rid bigint, doc_id bigint, n_tokens bigint, n_known bigint, n_other bigint, own double, p double, rare array<struct<word:string,n:bigint>>"
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 10 == 0


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout=held_out) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    training = docs.where(~holdout(F.col("doc_id")))
    counts = written(count_words(training), "word-counts")
    vocab = vocabulary(counts)
    tree = learn(training, counts, vocab)
    local = written(_local_scores(docs, vocab, tree), "local-scores")
    rare = local.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(counts, "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(PRIOR))
    sums = rare.groupBy("rid").agg(F.sum(F.col("n") * log_c).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    whole = float(np.log10(vocab.total + PRIOR * (vocab.distinct + 1)))
    others, kinds = vocab.total - int(vocab.counts[: vocab.symbols].sum()), vocab.distinct - vocab.symbols
    part = float(np.log10(max(0, others) + PRIOR * (max(0, kinds) + 1)))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return local.drop("rare").join(sums, "rid", "left").select(
        "doc_id",
        F.coalesce(holdout(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("own") + rare_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("p") + rare_log - F.col("n_other") * part).alias("score"),
    )


def op9_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_tree_scores": op9_suffix_tree_scores}
ORACLE: dict[str, str] = {}
