"""First-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids are cut into full sequences and one rest. Pieces, not whole documents, are dealt at random into groups of bounded expected size; each
group packs its pieces alone: longest first, each into the first sequence with room, found by a tree of the greatest room.
Ids never leave the task that encodes them; only lengths and checksums are shuffled.

Defined results: a null text is empty and has the end id alone; repeated ``doc_id`` rows are separate documents; equal lengths go
by id, then start; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import CACHE_BYTES, encoder, released, small_batches
from corpusmill.sources.tables import table, written

SEQUENCE = 2048
GROUP_PIECES = 8192
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, in the given order; leaves of the tree are bins, inner nodes the greatest room below."""
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, keeps_blanks: bool = True, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES, keep: bool = True) -> DataFrame:
    """A row per full sequence and per rest of every document. ``cache_bytes`` and ``keep`` (see ``encoder``) bound what workers remember; results don't depend on them."""
    small_batches(docs.sparkSession)

    def cut(batches):
        with encoder(tokenizer, keeps_blanks, cache_bytes, keep) as enc:
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                    ids = ids.astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        for to, x in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut if keep else released(cut), PIECES)


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``pieces`` has been written, so that a row keeps its group when a task runs again."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = pdf["group"] * (1 << 32) + bins, offsets
        return pdf.drop(columns="group")

    return dealt.groupBy("group").applyInPandas(pack_group, PIECES + ", sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str, keeps_blanks: bool = True, capacity: int = SEQUENCE, **memory) -> DataFrame:
    """Cuts and packs; the pieces are written in between. ``memory``: ``cache_bytes`` and ``keep`` of the cutting tasks."""
    return pack(written(cut_pieces(docs, tokenizer, keeps_blanks, capacity, **memory), "pieces"), capacity)


def op10_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_pack_sequences": op10_pack_sequences}
ORACLE: dict[str, str] = {}
