"""Encodes texts with a public tokenizer file inside tasks, a distinct chunk at a time.

A text is cut only where the tokenizer itself must cut (before a single blank, around line ends, after a run of Latin
letters that ends in a blank, a line end, a full stop or a comma). The library encodes each distinct chunk once per worker;
the ids of the text are the ids of its chunks. A text in which such cuts are not certain is encoded whole.
"""

from __future__ import annotations

import ctypes
import functools
import re
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pyarrow as pa

#: Fixed value: the id that ends a document.
END_ID = 1
#: Bytes of distinct chunks that a worker remembers; beyond it the memory starts anew, so results never depend on it.
CACHE_BYTES = 96 << 20
#: What a remembered chunk takes besides its characters and ids: the string's head, its place in the table, its first id and count.
_CHUNK_BYTES = 180
_BLOCK_UNITS = 50_000
_BLOCK_CHARS = 250_000

_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^ \n.,])"
#: Byte-level vocabularies keep blanks: a single blank starts a chunk, other blanks are chunks of their own.
_KEEPS_BLANKS = re.compile(f" ?{_LATIN}| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Word vocabularies drop blanks.
_DROPS_BLANKS = re.compile(f"{_LATIN}|[^ \n]+")
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: White space other than blank and line end, and the start of a special token's name.
_UNSURE = [chr(i) for i in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SPECIAL = ["<|"]

def _shown(runs: list[str], keeps_blanks: bool) -> list[str]:
    """Runs in the letters that stand for bytes, all in one pass: a line end, which no run holds, keeps them apart. Of ASCII only the blank has another letter."""
    if not runs:
        return []
    text = "\n".join(runs if keeps_blanks else [x.lower() for x in runs])
    text = text.replace(" ", _BYTE_LETTERS[32]) if text.isascii() else text.encode().decode("latin-1").translate(_RUN_LETTERS)
    return text.split("\n")


#: Texts that try every rule by which a text is cut.
PROBES = [
    "Plain words, in a row. And more: 3.14, 15% of x-ray (really)!",
    "don't we're 's I'LL  two  blanks   three\n\n new\nline \n end ",
    "Être où l'été naïve straße Größe ÀÉÎ ñandú İstanbul ŉ é.è,ê",
    "snake_case camelCase HTTPServer2 a1b2 ...  ,, -- $5 #tag @me https://x.y/z?q=1&r=2",
    "日本語 текст العربية 😀 é\u0301",
]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies: itself if printable, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()
_RUN_LETTERS = {b: x for b, x in _BYTE_LETTERS.items() if b != 10}


class Encoder:
    """Ids of texts by a tokenizer file; ``keeps_blanks`` tells which of the two families it belongs to."""

    def __init__(self, path: str, keeps_blanks: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.pattern = _KEEPS_BLANKS if keeps_blanks else _DROPS_BLANKS
        self.keeps_blanks = keeps_blanks
        self.unsure = _SPECIAL + _UNSURE if keeps_blanks else _SPECIAL
        self.cache_bytes = CACHE_BYTES
        self._forget()

    def verify(self) -> None:
        """Raises if the chunk rules don't give the library's ids on texts that try them."""
        want = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        if [x.tolist() for x in self.encode(PROBES)] != want:
            raise ValueError(f"{self.path}: its tokenizer doesn't cut texts by the rules of this module")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encodes chunks that aren't known yet, each once."""
        # A run of Latin letters is one word to the tokenizer: its model takes it straight.
        runs, rest = [], []
        for x in new:
            (runs if _LETTERS(x) else rest).append(x)
        new, merge = [x for x in runs if x.isascii()] + [x for x in runs if not x.isascii()] + rest, self.tokenizer.model.tokenize
        shown = _shown([x for x in runs if x.isascii()], self.keeps_blanks) + _shown([x for x in runs if not x.isascii()], self.keeps_blanks)
        found = [[k.id for k in merge(x)] for x in shown]
        found += [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total, n = int(counts.sum()), len(self.known)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        if n + len(new) > len(self.first):
            self.first, self.count = (np.resize(x, 2 * (n + len(new))) for x in (self.first, self.count))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.first[n : n + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(new)] = counts
        self.used += total
        self.held += 4 * total + _CHUNK_BYTES * len(new) + sum(map(len, new))
        self.known.update(zip(new, range(n, n + len(new))))

    def _of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and how many each has."""
        if self.held > self.cache_bytes:
            self._forget()
        at = list(map(self.known.get, units))
        if missing := [i for i, k in enumerate(at) if k is None]:
            self._learn(list({units[i] for i in missing}))
            known = self.known
            for i in missing:
                at[i] = known[units[i]]
        at = np.array(at, np.int64)
        counts = self.count[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.first[at] - ends + counts, counts) + np.arange(total)], counts

    def _long(self, text: str) -> np.ndarray:
        found, parts = self.pattern.finditer(text), []
        while units := [m.group() for m in islice(found, _BLOCK_UNITS)]:
            parts.append(self._of_units(units)[0])
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode(self, texts: list[str | None]):
        """Yields the ids of each text, with the end id; null counts as empty."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= _BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]):
        special, units, counts = {}, [], []
        for i, text in enumerate(texts):
            if any(map(text.__contains__, self.unsure)):
                special[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                found = []
            elif len(text) > _BLOCK_CHARS:
                special[i], found = self._long(text), []
            else:
                found = self.pattern.findall(text)
            units += found
            counts.append(len(found))
        ids, each = self._of_units(units)
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        for i in range(len(texts)):
            body = special[i] if i in special else ids[ends[i] : ends[i + 1]]
            yield np.append(body, np.int32(END_ID)).astype(np.int32)


_encoders: dict[tuple[str, bool], Encoder] = {}


@contextmanager
def encoder(path: str, keeps_blanks: bool, cache_bytes: int = CACHE_BYTES, keep: bool = True):
    """This worker's encoder for the length of a task; the tokenizer stays, and with ``keep`` what was remembered, for the worker's next task.

    The first use in a worker holds the chunk rules against the library's own ids and fails if a file doesn't follow them.
    """
    if (path, keeps_blanks) not in _encoders:
        made = Encoder(path, keeps_blanks)
        made.verify()
        _encoders[path, keeps_blanks] = made
    mine = _encoders[path, keeps_blanks]
    mine.cache_bytes = cache_bytes
    try:
        yield mine
    finally:
        if not keep:
            mine._forget()
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Hands memory that is free in this process back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(run):
    """``run`` over a task's batches; what it held is handed back at the task's end, not kept by the worker through the stages that follow."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        give_back()

    return task


def small_batches(spark, size: str = "4m", rows: int = 512) -> None:
    """Arrow batches of few bytes and rows, so that long texts don't add up in a worker.

    Sets only what the session has left at Spark's default.
    """
    for key, value, default in (("maxRecordsPerBatch", str(rows), "10000"), ("maxBytesPerBatch", size, "67108864b")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)
