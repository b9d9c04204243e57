"""Hash names: BLAKE3, base32 text and CRC-32C, for Arrow UDFs. SHA-256 is Spark's own and the default elsewhere."""

from __future__ import annotations

import base64
import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The initial vector of SHA-256 and the message permutation.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF
# Columns, then diagonals.
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, block, counter, size, flags):
    v = [*cv, *_IV[:4], counter & _M, counter >> 32, size, flags]
    m = list(block)
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_QUARTERS):
            for x, r, s in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & _M
                y = v[d] ^ v[a]
                v[d] = (y >> r | y << 32 - r) & _M
                v[c] = (v[c] + v[d]) & _M
                y = v[b] ^ v[c]
                v[b] = (y >> s | y << 32 - s) & _M
        m = [m[p] for p in _PERMUTE]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _last_block(chunk: bytes, counter: int):
    """The inputs of the compression that ends a chunk."""
    cv, blocks = _IV, [chunk[i : i + 64] for i in range(0, len(chunk), 64)] or [b""]
    for i, block in enumerate(blocks):
        flags = (_START if i == 0 else 0) | (_END if i == len(blocks) - 1 else 0)
        args = cv, struct.unpack("<16I", block.ljust(64, b"\0")), counter, len(block), flags
        if i == len(blocks) - 1:
            return args
        cv = _compress(*args)


def _tree(data: bytes, counter: int):
    """The inputs of the compression that ends a subtree: its left part is the largest power of two of chunks that leaves a rest."""
    chunks = max(1, -(-len(data) // 1024))
    if chunks == 1:
        return _last_block(data, counter)
    left = 1 << (chunks - 1).bit_length() - 1
    a, b = _compress(*_tree(data[: left * 1024], counter)), _compress(*_tree(data[left * 1024 :], counter + left))
    return _IV, (*a, *b), 0, 64, _PARENT


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash."""
    cv, block, counter, size, flags = _tree(data, 0)
    return struct.pack("<8I", *_compress(cv, block, counter if not flags & _PARENT else 0, size, flags | _ROOT))


def base32_text(data: bytes) -> str:
    """RFC 4648 base32, lower case, without padding."""
    return base64.b32encode(data).decode().rstrip("=").lower()


def base32_bytes(text: str) -> bytes:
    return base64.b32decode(text.upper() + "=" * (-len(text) % 8))


def note_name(data: bytes) -> str:
    """26 characters that name a note: the first 128 bits of its hash."""
    return base32_text(blake3(data)[:16])


def crc32c(data: bytes) -> int:
    """Castagnoli's CRC-32."""
    crc = _M
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ _M


def _bytes_udf(f, kind: str):
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v.encode() if isinstance(v, str) else bytes(v)) for v in x], dtype="object")

    return F.pandas_udf(run, kind)


def blake3_column(c: Column) -> Column:
    return _bytes_udf(lambda b: blake3(b).hex(), "string")(c)


def note_name_column(c: Column) -> Column:
    return _bytes_udf(note_name, "string")(c)


def crc32c_column(c: Column) -> Column:
    return _bytes_udf(crc32c, "bigint")(c)


def nfkc_column(c: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(run, "string")(c)


def name_holds(name: Column, body: Column) -> Column:
    """Whether a note's bytes hash to its name; null for names of another form, which make no claim."""
    return F.when(name.rlike("^[a-z2-7]{26}$"), note_name_column(body) == name)
