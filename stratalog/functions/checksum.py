"""CRC-32C (Castagnoli), which Spark lacks; its crc32 is the IEEE one.

The checksum is linear, so that many pieces can go through the table side by side: the rows of a column, or the lanes that a
long buffer is cut into, whose checksums are put together afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78
#: Lanes of a long buffer, and the least bytes that are worth so many.
LANES = 4096
LONG = 1 << 17


def _table() -> np.ndarray:
    """Effect of each byte, made from the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


_TABLE = _table()
_LIST = _TABLE.tolist()


def _times(a: int, b: int) -> int:
    """The product of two polynomials, bits reversed, modulo the checksum's."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def _zeros(n: int) -> int:
    """What a checksum is multiplied by to go over n zero bytes."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def _shift(factor: int) -> list[list[int]]:
    """Multiplication by factor as four tables, a byte each."""
    bits = [_times(1 << i, factor) for i in range(32)]
    tables = []
    for k in range(4):
        t = [0] * 256
        for x in range(1, 256):
            low = x & -x
            t[x] = t[x ^ low] ^ bits[8 * k + low.bit_length() - 1]
        tables.append(t)
    return tables


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (state >> np.uint32(8)) ^ _TABLE[(state ^ byte) & np.uint32(255)]


def crc32c(data: bytes, crc: int = 0) -> int:
    """The checksum of data, going on from crc."""
    c = crc ^ 0xFFFFFFFF
    if len(data) >= LONG:
        length = len(data) // LANES
        lanes = np.frombuffer(data, np.uint8, LANES * length).reshape(LANES, length).T.astype(np.uint32, order="C")
        state = np.zeros(LANES, np.uint32)
        state[0] = c
        for row in lanes:
            state = _step(state, row)
        t0, t1, t2, t3 = _shift(_zeros(length))
        c = 0
        for x in state.tolist():
            c = t0[c & 255] ^ t1[c >> 8 & 255] ^ t2[c >> 16 & 255] ^ t3[c >> 24] ^ x
        data = data[LANES * length :]
    for x in data:
        c = c >> 8 ^ _LIST[(c ^ x) & 255]
    return c ^ 0xFFFFFFFF


def crc32c_rows(values: list[bytes]) -> np.ndarray:
    """The checksums of many byte strings, a byte of all of them at a time; very long ones by themselves."""
    out = np.zeros(len(values), np.int64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    for i in np.flatnonzero(lengths >= LONG):
        out[i] = crc32c(values[i])
    order = np.flatnonzero(lengths < LONG)
    order = order[np.argsort(-lengths[order], kind="stable")]
    if not len(order):
        return out
    data = np.frombuffer(b"".join(values[i] for i in order) + b"\0", np.uint8)
    starts = np.r_[0, np.cumsum(lengths[order])[:-1]]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    left = -lengths[order]  # ascending
    for k in range(int(-left[0])):
        n = np.searchsorted(left, -k, "left")  # so many are longer than k
        state[:n] = _step(state[:n], data[starts[:n] + k].astype(np.uint32))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _crc_series(values: pd.Series) -> pd.Series:
    there = values.notna().to_numpy()
    out = pd.Series(pd.NA, index=values.index, dtype="Int64")
    out[there] = crc32c_rows([bytes(x) for x in values[there]])
    return out


def crc32c_column(value: Column) -> Column:
    """CRC-32C of a binary column; null stays null."""
    return F.pandas_udf(_crc_series, "long")(value)
