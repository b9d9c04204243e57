"""Proofs over append-only logs (RFC 9162): what one row's proof says, with SHA-256. Small helpers for Arrow UDFs."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(entry: bytes) -> bytes:
    return sha256(b"\x00" + entry).digest()


def node(left: bytes, right: bytes) -> bytes:
    return sha256(b"\x01" + left + right).digest()


def tree_root(leaves: list[bytes]) -> bytes:
    """Root of the RFC's tree: the left part is the largest power of two below the size."""
    if not leaves:
        return sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return node(tree_root(leaves[:k]), tree_root(leaves[k:]))


def inclusion_path(leaves: list[bytes], i: int) -> list[bytes]:
    if len(leaves) <= 1:
        return []
    k = 1 << (len(leaves) - 1).bit_length() - 1
    if i < k:
        return [*inclusion_path(leaves[:k], i), tree_root(leaves[k:])]
    return [*inclusion_path(leaves[k:], i - k), tree_root(leaves[:k])]


def consistency_path(leaves: list[bytes], m: int, whole: bool = True) -> list[bytes]:
    n = len(leaves)
    if m == n:
        return [] if whole else [tree_root(leaves)]
    k = 1 << (n - 1).bit_length() - 1
    if m <= k:
        return [*consistency_path(leaves[:k], m, whole), tree_root(leaves[k:])]
    return [*consistency_path(leaves[k:], m - k, False), tree_root(leaves[:k])]


def included(entry_leaf: bytes, i: int, size: int, path: list[bytes], root: bytes) -> bool:
    if not 0 <= i < size:
        return False
    at, last, h = i, size - 1, entry_leaf
    for p in path:
        if last == 0:
            return False
        if at & 1 or at == last:
            h = node(p, h)
            while at and not at & 1:
                at, last = at >> 1, last >> 1
        else:
            h = node(h, p)
        at, last = at >> 1, last >> 1
    return last == 0 and h == root


def consistent(first: int, second: int, first_root: bytes, second_root: bytes, path: list[bytes]) -> bool:
    if first == second:
        return not path and first_root == second_root
    if not 1 <= first < second or not path:
        return False
    path = [first_root, *path] if first & (first - 1) == 0 else list(path)
    at, last = first - 1, second - 1
    while at & 1:
        at, last = at >> 1, last >> 1
    old = new = path[0]
    for p in path[1:]:
        if last == 0:
            return False
        if at & 1 or at == last:
            old, new = node(p, old), node(p, new)
            while at and not at & 1:
                at, last = at >> 1, last >> 1
        else:
            new = node(new, p)
        at, last = at >> 1, last >> 1
    return last == 0 and old == first_root and new == second_root


def included_column(entry: Column, i: Column, size: Column, path: Column, root: Column) -> Column:
    """``included`` of rows; null where a part of the proof is missing: not checkable is not failed."""

    def check(entry: pd.Series, i: pd.Series, size: pd.Series, path: pd.Series, root: pd.Series) -> pd.Series:
        rows = zip(entry, i, size, path, root)
        return pd.Series([None if any(x is None for x in r) else included(leaf(bytes(r[0])), int(r[1]), int(r[2]), [bytes(p) for p in r[3]], bytes(r[4])) for r in rows], dtype="object")

    return F.pandas_udf(check, "boolean")(entry, i, size, path, root)
