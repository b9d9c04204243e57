"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained over all labelled rows by Spark.

A word's embedding is the sum of hashed rows for the word itself and for its beginnings of ``PREFIXES`` characters, so words that share a
beginning share evidence. A filter of width ``w`` is a linear map of ``w`` neighbouring embeddings; the greatest response over the whole
text enters a logistic unit. Hashing happens in Spark; workers get integer ids only.

Every labelled row is learned, whole, whatever its length. Rows are written as chunks of word codes. A pass over the chunks gives exact document counts of all ids by label,
from which the embeddings start; each further pass gives the gradient over all rows, summed by id in Spark, and one Adagrad step. What comes to the driver is a model's size, not the rows'.
Gradients are summed as whole numbers of ``UNIT``, so a model doesn't depend on how chunks are dealt to tasks. Thresholds are calibrated, for all languages together and for each, on scores of
all labelled rows by a model that has not seen them: rows are cut into ``FOLDS`` parts, and a model without a part, trained in the same passes, scores that part. A score depends on the text alone;
the language only picks the threshold behind ``lang_predicted``.

Defined results: a null or empty text has no words and gets the score of a text in which no filter responds; without labels of both
kinds every score is 0; an id with two labels counts as the lower one's and the higher one's row; repeated rows are learned and scored each; a language without a threshold
(null included) takes the common one; an empty table gives an empty result; ``scored`` keeps the input's columns and replaces those of its own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import give_back, released, small_batches
from corpusmill.sources.tables import table, written

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
FILTERS = 4
DIM = 8
FOLDS = 2
#: With so many toxic rows a language's threshold lies halfway between the common one and its own.
OWN_THRESHOLD = 20
#: Steps, each of which is a pass over all labelled rows.
PASSES = 5
#: Up to so many labels (an id and a label each) are broadcast.
BROADCAST_LABELS = 5_000_000
#: A chunk is some MB, so a page is looked at after every row: codecs keep buffers outside the heap as large as the largest page.
ONE_ROW_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Gradients are summed in these units.
UNIT = 2.0**-36
#: Thresholds lie between scores that differ by this much in log odds.
BIN = 1 / 512
#: Fixed value: the score from which a text counts as toxic.
PREDICT_AT = 0.7


def word_ids(text: Column) -> Column:
    """Hashed ids of a text, one group of ``1 + len(PREFIXES)`` per word: the lower-cased run of letters, and its beginnings."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), lambda w: w != "")
    bucket = lambda tag, x: F.pmod(F.xxhash64(F.lit(tag), x), F.lit(BUCKETS)).cast("int")
    return F.flatten(F.transform(words, lambda w: F.array(bucket(0, w), *[bucket(k, F.substring(w, 1, k)) for k in PREFIXES])))


class Chunk:
    """Labelled rows as codes of the chunk's own words: ``words`` has the ids of each code, ``limits`` where each row's codes begin and end."""

    def __init__(self, ids: np.ndarray, limits: np.ndarray, labels: np.ndarray):
        """From the ids of rows that lie one after the other; ``limits`` are in words."""
        words = ids.reshape(-1, 1 + len(PREFIXES)).astype(np.int64)
        # Words are told apart by a 64-bit mix of their ids.
        mix = np.zeros(len(words), np.uint64)
        for c in range(words.shape[1]):
            mix = (mix ^ words[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
        _, first, codes = np.unique(mix, return_index=True, return_inverse=True)
        self.words, self.codes, self.limits, self.labels = words[first], codes, np.asarray(limits, np.int64), np.asarray(labels, np.int64)

    @classmethod
    def of(cls, words, codes, limits, labels) -> "Chunk":
        out = cls.__new__(cls)
        out.words, out.codes, out.limits, out.labels = words.reshape(-1, 1 + len(PREFIXES)), codes.astype(np.int64), limits.astype(np.int64), labels.astype(np.int64)
        return out

    def document_counts(self) -> np.ndarray:
        """Rows of each label that hold an id: 2 x BUCKETS, with the number of rows in a last column."""
        out, held = np.zeros((2, BUCKETS + 1), np.int64), np.zeros(BUCKETS, bool)
        for y, start, end in zip(self.labels, self.limits, self.limits[1:]):
            held[self.words.take(self.codes[start:end], 0)] = True
            ids = np.flatnonzero(held)
            out[y, ids] += 1
            out[y, BUCKETS] += 1
            held[ids] = False
        return out


class TextCnn:
    """Weights, and what is done with them. ``tables[j]`` has a row of all filters' responses per id: embeddings times filters."""

    #: Where an id's embedding is, if not at the id.
    place: np.ndarray | None = None

    def __init__(self, seed: int = 11):
        """Untrained weights."""
        rng = np.random.default_rng(seed)
        self.per_word = 1 + len(PREFIXES)
        self.embed = np.zeros((BUCKETS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0.0)
        self.rng = rng

    def _words(self, ids: np.ndarray) -> np.ndarray:
        return ids.reshape(-1, self.per_word)

    def start(self, df: np.ndarray, n: np.ndarray) -> "TextCnn":
        """Starts the first dimension at a cautious log odds of each id, and leaves ids that few texts hold at 0 for good. ``df`` and ``n`` are rows with an id, and all rows, by label."""
        odds = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
        least = np.maximum(0, odds - 2 * np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5)))
        self.learns = df.max(0) >= 3
        self.embed = (self.rng.normal(0, 0.01, self.embed.shape) * self.learns[:, None]).astype(np.float32)
        self.embed[:, 0] += (least * self.learns).astype(np.float32)
        for w, f in zip(WIDTHS, self.filters):
            f *= 0.1
            f[:, 0, 0] = 1 / w
        self.out = np.abs(self.out)
        self.bias = np.float32(-2)
        self.n = int(n.sum())
        self.weight = np.sqrt(self.n / (2 * np.maximum(1, n)))
        # An id that a single row teaches moves as far as the others, over some steps.
        self.e_sq, self.dense_sq = np.full(BUCKETS, (0.3 / max(1, self.n)) ** 2), np.full(len(self._dense()), 1e-5)
        return self

    def _dense(self) -> np.ndarray:
        """Filters, output weights and bias, one after the other."""
        return np.concatenate([*[f.ravel() for f in self.filters], self.out, [self.bias]]).astype(np.float64)

    def _forward(self, chunk: Chunk, winners: bool = False):
        """Evidence of each row before the logistic function; with ``winners`` also the greatest responses and where they are."""
        e = self.embed[chunk.words if self.place is None else self.place[chunk.words]].sum(1) if len(chunk.words) else np.zeros((0, DIM), np.float32)
        n = np.diff(chunk.limits)
        row = np.repeat(np.arange(len(n)), n) if winners else None
        x, at = np.zeros((len(n), len(self.out)), np.float32), np.zeros((len(n), len(self.out)), np.int64)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            has = np.flatnonzero(n >= w)
            if not len(has):
                continue
            windows = len(chunk.codes) - w + 1
            total = np.zeros((windows, FILTERS), np.float32)
            for j in range(w):
                total += (e @ f[j]).take(chunk.codes[j : windows + j], 0)
            # Windows that would reach into the next row don't count.
            for j in range(1, w):
                ends = chunk.limits[1:] - j
                total[ends[(ends >= 0) & (ends < windows)]] = -np.inf
            begins = chunk.limits[has]
            best = np.maximum.reduceat(total, begins, axis=0)
            x[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
            if winners:
                # Responses that aren't positive pass no gradient.
                top = np.full((len(n), FILTERS), np.inf, np.float32)
                top[has] = np.where(best > 0, best, np.inf)
                where, c = np.divmod(np.flatnonzero((total == top.take(row[:windows], 0)).ravel()), FILTERS)
                held, first = np.unique(row[where] * FILTERS + c, return_index=True)
                at[held // FILTERS, k * FILTERS + held % FILTERS] = where[first]
        z = x @ self.out + self.bias
        return (z, x, at, e) if winners else z

    def gradient(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their gradients, and that of the dense weights, of the class-weighted logistic loss over a chunk, in ``UNIT``; only the winning window of each filter passes one. Rows without words pass none."""
        z, x, at, e = self._forward(chunk, True)
        y = chunk.labels
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64))) - y) * self.weight[y] * (np.diff(chunk.limits) > 0)
        gx = g[:, None] * self.out * (x > 0)
        ge, gf = np.zeros((len(chunk.words), DIM)), [np.zeros(f.shape) for f in self.filters]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            for c in range(FILTERS):
                rows = np.flatnonzero(gx[:, k * FILTERS + c])
                for j in range(w):
                    codes, each = chunk.codes[at[rows, k * FILTERS + c] + j], gx[rows, k * FILTERS + c]
                    gf[k][j, :, c] += each @ e[codes]
                    ge += np.bincount(codes, each, minlength=len(chunk.words))[:, None] * f[j, :, c]
        held = np.flatnonzero(np.abs(ge).sum(1))
        ids, where = np.unique(chunk.words[held], return_inverse=True)
        by_id = np.zeros((len(ids), DIM), np.int64)
        np.add.at(by_id, where.ravel(), np.repeat(np.rint(ge[held] / UNIT).astype(np.int64), self.per_word, 0))
        dense = np.concatenate([*[a.ravel() for a in gf], g @ x, [g.sum()]])
        held = self.learns[ids] if self.place is None else self.place[ids] > 0
        return ids[held], by_id[held], np.rint(dense / UNIT).astype(np.int64)

    def step(self, number: int, ids: np.ndarray, by_id: np.ndarray, dense: np.ndarray) -> None:
        """One Adagrad step by the sums of all rows' gradients (in ``UNIT``)."""
        rate = 0.1 / (0.75 + number / 4)
        d = by_id * (UNIT / self.n)
        self.e_sq[ids] += (d * d).mean(1)
        self.embed[ids] -= (rate * d / np.sqrt(self.e_sq[ids])[:, None]).astype(np.float32)
        d = dense * (UNIT / self.n)
        self.dense_sq += d * d
        held = self._dense() - rate * d / np.sqrt(self.dense_sq)
        cuts = np.cumsum([f.size for f in self.filters])
        self.filters = [x.reshape(f.shape).astype(np.float32) for x, f in zip(np.split(held, cuts), self.filters)]
        self.out, self.bias = held[cuts[-1] : -1].astype(np.float32), np.float32(held[-1])

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> "TextCnn":
        """The same counts, gradients and steps for rows at hand."""
        chunk = Chunk(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) // self.per_word for x in rows])]), labels)
        counts = chunk.document_counts()
        self.start(counts[:, :BUCKETS], counts[:, BUCKETS])
        for number in range(PASSES):
            self.step(number, *self.gradient(chunk))
        return self.finished()

    def sent(self) -> "TextCnn":
        """What tasks need for a pass: of the embeddings only those that are learned."""
        out = TextCnn.__new__(TextCnn)
        for name in ("per_word", "filters", "out", "bias", "weight"):
            setattr(out, name, getattr(self, name))
        out.ids = np.flatnonzero(self.learns).astype(np.int32)
        out.rows = self.embed[out.ids]
        return out

    def received(self) -> "TextCnn":
        """Ready for a pass: ``place`` leads from an id to its row of the embeddings; those that aren't learned share a first row of 0."""
        if self.place is None:
            self.place = np.zeros(BUCKETS, np.int32)
            self.place[self.ids] = np.arange(1, len(self.ids) + 1)
            self.embed = np.concatenate([np.zeros((1, DIM), np.float32), self.rows])
            del self.rows
        return self

    def finished(self) -> "TextCnn":
        self._tables()
        return self

    def _tables(self) -> None:
        self.tables = [[(self.embed @ f[j]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def score(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of texts whose ids lie one after the other; ``ends`` has the limits of each in ids."""
        limits = np.asarray(ends, np.int64) // self.per_word
        words, n = self._words(ids), np.diff(limits)
        out = np.full(len(n), float(self.bias), np.float64)
        columns = np.ascontiguousarray(words.T).astype(np.int64)
        for k, w in enumerate(WIDTHS):
            weight = self.out[k * FILTERS : (k + 1) * FILTERS]
            has = np.flatnonzero(n >= w)
            if not len(has):
                continue
            total = np.zeros((len(words) - w + 1, FILTERS), np.float32)
            for j in range(w):
                t = self.tables[k][j]
                part = t.take(columns[0, j : len(words) - w + 1 + j], 0)
                for c in range(1, self.per_word):
                    part += t.take(columns[c, j : len(words) - w + 1 + j], 0)
                total += part
            # Windows that would reach into the next text don't count.
            cuts = np.empty(2 * len(has), np.int64)
            cuts[::2], cuts[1::2] = limits[has], limits[has] + n[has] - w + 1
            padded = np.vstack([total, np.zeros((1, FILTERS), np.float32)])
            best = np.maximum.reduceat(padded, np.minimum(cuts, len(total)), axis=0)[::2]
            out[has] += np.maximum(best, 0) @ weight
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


_GRADIENT = ", ".join(f"g{d} bigint" for d in range(DIM))


def labelled_chunks(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """All rows with a label as chunks of one fold, written: ``fold, words, codes, limits, labels, langs``. Texts stay where they are up to ``BROADCAST_LABELS`` labels."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    # A plan's choice only: with more labels the join shuffles texts.
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rows = docs.select("doc_id", "lang", "text").join(known, "doc_id").select(fold.alias("fold"), "y", "lang", word_ids(F.col("text")).alias("ids"))

    def run(batches):
        kinds = [pa.int32(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.string())]
        for whole in batches:
            for k in range(FOLDS):
                part = whole.filter(pa.array(whole.column("fold").to_numpy(zero_copy_only=False) == k))
                if not part.num_rows:
                    continue
                lists = part.column("ids")
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                c = Chunk(flat, (offsets - offsets[0]) // (1 + len(PREFIXES)), part.column("y").to_numpy(zero_copy_only=False))
                values = [k, c.words.ravel(), c.codes, c.limits, c.labels, part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["fold", "words", "codes", "limits", "labels", "langs"])

    ints = ", ".join(f"{c} array<int>" for c in ("words", "codes", "limits", "labels"))
    return written(rows.mapInArrow(released(run), f"fold int, {ints}, langs array<string>"), "toxicity-labelled", **ONE_ROW_PAGES)


def _chunks(batches):
    """Fold, chunk and languages of every row of ``labelled_chunks``."""
    for batch in batches:
        lists = [batch.column(c) for c in ("words", "codes", "limits", "labels")]
        for i, k in enumerate(batch.column("fold").to_pylist()):
            yield k, Chunk.of(*[x[i].values.to_numpy(zero_copy_only=False) for x in lists]), batch.column("langs")[i]


def _counts(batches):
    counts = np.zeros((2 * FOLDS, BUCKETS + 1), np.int64)
    for k, chunk, _ in _chunks(batches):
        counts[2 * k : 2 * k + 2] += chunk.document_counts()
    ids = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(x[ids]) for x in counts]], names=["id", *[f"c{i}" for i in range(2 * FOLDS)]])


def _summed(found: DataFrame, keys: list[str]) -> pa.Table:
    return found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in found.columns if c not in keys]).toArrow()


def _stepped(models: dict[int, TextCnn], number: int, found: pa.Table) -> None:
    """A step of every model by its sums, a model's rows at a time."""
    of, ids = found["model"].to_numpy(), found["id"].to_numpy()
    columns = [found[f"g{d}"] for d in range(DIM)]
    for m, model in models.items():
        mine = np.flatnonzero(of == m)
        mine = mine[np.argsort(ids[mine])]
        rows = np.empty((len(mine), DIM), np.int64)
        for d, c in enumerate(columns):
            rows[:, d] = c.to_numpy()[mine]
        sparse = int(np.searchsorted(ids[mine], BUCKETS))
        model.step(number, ids[mine[:sparse]], rows[:sparse], rows[sparse:].ravel()[: len(model._dense())])


def _gradients(shared):
    """Gradients of every model over the chunks of a task that it learns from; dense weights follow the ids, in rows of ``DIM``."""

    def run(batches):
        models, sums, dense = shared.value, {}, {}
        for k, chunk, _ in _chunks(batches):
            for m, model in models.items():
                if m == k:
                    continue
                ids, by_id, rest = model.received().gradient(chunk)
                # Only ids that are learned have a gradient.
                if m not in sums:
                    sums[m], dense[m] = np.zeros((len(model.ids), DIM), np.int64), np.zeros(len(rest), np.int64)
                sums[m][model.place[ids] - 1] += by_id
                dense[m] += rest
        for m in list(sums):
            found = sums.pop(m)
            held = np.flatnonzero(found.any(1))
            rest = np.pad(dense[m], (0, -len(dense[m]) % DIM)).reshape(-1, DIM)
            rows = np.concatenate([found[held], rest])
            at = np.concatenate([models[m].ids[held], BUCKETS + np.arange(len(rest))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m), pa.int32()), pa.array(at, pa.int32()), *[pa.array(np.ascontiguousarray(rows[:, d])) for d in range(DIM)]], names=["model", "id", *[f"g{d}" for d in range(DIM)]])

    return run


def _bins(shared, whole: int):
    """Language, bin of the log odds and label of every row, by the model that has not seen its fold (else by the whole one), counted."""

    def run(batches):
        models = shared.value
        for k, chunk, langs in _chunks(batches):
            z = np.clip(models.get(k, models[whole]).received()._forward(chunk), -13.8, 13.8)
            bins = np.floor(z / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([langs.values.cast(pa.string()), pa.array(bins), pa.array(chunk.labels.astype(np.int32))], names=["lang", "bin", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", passes: int = PASSES) -> tuple[TextCnn | None, dict[str, float]]:
    """The model and its thresholds by language. ``labels`` has only rows that may be learned from."""
    spark = docs.sparkSession
    chunks = labelled_chunks(docs, labels, label_col)
    table_ = _summed(chunks.mapInArrow(released(_counts), "id int, " + ", ".join(f"c{i} bigint" for i in range(2 * FOLDS))), ["id"])
    counts = np.zeros((FOLDS, 2, BUCKETS + 1), np.int64)
    for i in range(2 * FOLDS):
        counts[i // 2, i % 2, table_["id"].to_numpy()] = table_[f"c{i}"].to_numpy()
    # Model k hasn't seen fold k; the last one sees all.
    models: dict[int, TextCnn] = {}
    for m in range(FOLDS + 1):
        of = counts.sum(0) - (counts[m] if m < FOLDS else 0)
        if of[0, BUCKETS] and of[1, BUCKETS]:
            models[m] = TextCnn().start(of[:, :BUCKETS], of[:, BUCKETS])
    if FOLDS not in models:
        return None, {}
    # What a pass brought to the driver is handed back before the next one.
    del table_, counts, of
    give_back()
    for number in range(passes):
        shared = spark.sparkContext.broadcast({m: model.sent() for m, model in models.items()})
        _stepped(models, number, _summed(chunks.mapInArrow(released(_gradients(shared)), f"model int, id int, {_GRADIENT}"), ["model", "id"]))
        shared.destroy()
        give_back()
    shared = spark.sparkContext.broadcast({m: model.sent() for m, model in models.items()})
    bins = chunks.mapInArrow(released(_bins(shared, FOLDS)), "lang string, bin int, y int").groupBy("lang", "bin").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")).toArrow()
    shared.destroy()
    model = models[FOLDS]
    models.clear()
    langs, at = np.array(bins["lang"].to_pylist(), object), bins["bin"].to_numpy()
    clean, toxic = bins["clean"].to_numpy(), bins["toxic"].to_numpy()
    # The best threshold over all languages becomes PREDICT_AT, by a shift of the bias. A language with few labels stays close to it.
    logit = lambda p: np.log(p / (1 - p))
    common = logit(calibrate(at, clean, toxic))
    model.bias += np.float32(logit(PREDICT_AT) - common)
    thresholds = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = langs == lang
        n = toxic[mine].sum()
        own = calibrate(at[mine], clean[mine], toxic[mine])
        if own is not None:
            thresholds[lang] = float(1 / (1 + np.exp(-(logit(PREDICT_AT) + n / (n + OWN_THRESHOLD) * (logit(own) - common)))))
    model.finished()
    del bins, langs, at, clean, toxic
    give_back()
    return model, thresholds


def calibrate(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float | None:
    """The threshold with the best F1 on counts of labels by bin of the score's log odds; the middle between its last bin and the next held one, none where one label is missing."""
    if not clean.sum() or not toxic.sum():
        return None
    at = np.unique(bins)[::-1]
    where = len(at) - 1 - np.searchsorted(at[::-1], bins)
    n, hits = np.bincount(where, clean + toxic, len(at)).cumsum(), np.bincount(where, toxic, len(at)).cumsum()
    best = int((2 * hits / (n + toxic.sum())).argmax())
    p = 1 / (1 + np.exp(-(at + 0.5) * BIN))
    return float(np.clip((p[best] + p[min(best + 1, len(p) - 1)]) / 2, 1e-6, 1 - 1e-6))


def scored(docs: DataFrame, model: TextCnn | None, thresholds: dict[str, float], predict_at: float = PREDICT_AT, default: float = PREDICT_AT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score, predicted, lang_threshold, lang_predicted``. Rows stay where they are: only a text's word ids go to Python."""
    spark = docs.sparkSession
    small_batches(spark)
    score = F.lit(0.0)
    if model is not None:
        shared = spark.sparkContext.broadcast((model.tables, model.out, model.bias))

        def run(batches):
            cnn = TextCnn.__new__(TextCnn)
            cnn.per_word = 1 + len(PREFIXES)
            cnn.tables, cnn.out, cnn.bias = shared.value
            for lists in batches:
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                yield pa.array(cnn.score(flat, offsets - offsets[0]))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        score = F.arrow_udf(released(run), "double")(word_ids(F.col(text_col)))
    by_lang = F.lit(default)
    for lang, limit in sorted(thresholds.items()):
        by_lang = F.when(F.col(lang_col) == lang, F.lit(limit)).otherwise(by_lang)
    out = docs.withColumn("score", score)
    return out.withColumns({"predicted": (F.col("score") >= predict_at).cast("int"), "lang_threshold": by_lang, "lang_predicted": (F.col("score") >= by_lang).cast("int")})


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT) -> DataFrame:
    """Trains on the labelled rows outside the held-out third and scores every row: ``doc_id, score, predicted, lang_threshold, lang_predicted``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model, thresholds = train(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    return scored(docs, model, thresholds, predict_at).select("doc_id", "score", "predicted", "lang_threshold", "lang_predicted")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted", "lang_threshold", "lang_predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
