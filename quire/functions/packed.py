"""Vectors as bytes, for tables that hold many of them.

A vector of whole numbers over its length (as hashed words give) takes one or two bytes a place, another keeps
its floats; either comes back bit by bit. The first byte says which: the bytes of a number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

KINDS = {1: np.int8, 2: np.int16, 4: np.float32, 8: np.float64}


def _scaled(whole: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(whole, axis=1, keepdims=True)
    return whole / np.where(norm == 0, 1, norm)


def _whole(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that give the rows back, and the rows for which there are such."""
    least = np.where(v == 0, np.inf, np.abs(v)).min(axis=1, keepdims=True, initial=np.inf)
    out, good = np.zeros(v.shape, np.float32), np.zeros(len(v), bool)
    for smallest in (1, 2, 3):
        left = np.flatnonzero(~good)
        if len(left):
            with np.errstate(all="ignore"):
                n = np.rint(v[left] / least[left] * np.float32(smallest))
                fits = (np.abs(n) <= 32767).all(axis=1)
                fits[fits] = (_scaled(n[fits]) == v[left][fits]).all(axis=1)
            out[left[fits]], good[left[fits]] = n[fits], True
    return out, good


def pack(v: np.ndarray) -> pa.Array:
    """Rows of float32 or float64 as binary."""
    kinds = np.full(len(v), v.dtype.itemsize)
    if v.dtype == np.float32:
        whole, good = _whole(v)
        kinds[good] = np.where(np.abs(whole[good]).max(axis=1, initial=0) <= 127, 1, 2)
    parts = {}
    for kind in np.unique(kinds):
        rows = (v if kind >= 4 else whole)[kinds == kind].astype(KINDS[int(kind)])
        parts[kind] = np.concatenate([np.full((len(rows), 1), kind, np.uint8), np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)], axis=1)
    if len(parts) == 1:
        (rows,) = parts.values()
        ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
    each = {kind: iter(rows) for kind, rows in parts.items()}
    return pa.array([next(each[kind]).tobytes() for kind in kinds], pa.binary())


def unpack(column: pa.Array) -> np.ndarray:
    """Rows of double from packed vectors, or from a column of arrays. All rows have one length."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    if not len(column):
        return np.zeros((0, 0))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    kinds, sizes = data[ends[:-1]], np.diff(ends)
    out = np.zeros((len(column), int((sizes[0] - 1) // kinds[0])))
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        if len(at) == len(column):
            part = data[ends[0] : ends[-1]].reshape(len(at), -1)[:, 1:]
        else:
            part = data[ends[at][:, None] + np.arange(1, sizes[at[0]])]
        v = np.ascontiguousarray(part).view(KINDS[int(kind)])
        out[at] = _scaled(v.astype(np.float32)) if kind <= 2 else v
    return out


def units(column: pa.Array) -> np.ndarray:
    """Like unpack(); packed vectors are divided by their length, arrays of an index have length 1 already."""
    v = unpack(column)
    return _scaled(v) if pa.types.is_binary(column.type) else v
