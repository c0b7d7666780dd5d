"""CRC-32C (Castagnoli) of many byte strings at once, with numpy, and the mask of record files."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected Castagnoli polynomial and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 64


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return t


@lru_cache(maxsize=1)
def _pair_table() -> np.ndarray:
    """The state after two bytes, by the 16 bits that the state and the bytes give together."""
    t, v = _byte_table(), np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        v = t[v & 255] ^ (v >> 8)
    return v


@lru_cache(maxsize=64)
def _shift(level: int) -> np.ndarray:
    """Tables (4, 256) of what BLOCK * 2**level zero bytes do to a state; a linear map, so by bytes of the state."""
    if level == 0:
        v = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        t = _byte_table()
        for _ in range(BLOCK):
            v = t[v & 255] ^ (v >> 8)
        return v.reshape(4, 256)
    return _apply(_shift(level - 1), _shift(level - 1).ravel()).reshape(4, 256)


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][(v >> 8) & 255] ^ tables[2][(v >> 16) & 255] ^ tables[3][v >> 24]


def _one(data: bytes) -> int:
    t, s = _byte_table(), 0xFFFFFFFF
    for b in data:
        s = int(t[(s ^ b) & 255]) ^ (s >> 8)
    return s ^ 0xFFFFFFFF


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksum of each string. Leading zero bytes don't change a zero state, so strings are padded in front to
    whole blocks, all blocks are run through side by side, and a string's blocks are joined pairwise."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros(len(parts), np.uint32)
    for i in np.flatnonzero(sizes < 4):
        out[i] = _one(parts[i])
    long = np.flatnonzero(sizes >= 4)
    if not len(long):
        return out
    count = -(-sizes[long] // BLOCK)
    ends = np.cumsum(count) * BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    for i, end in zip(long, ends.tolist()):
        data[end - sizes[i] : end] = np.frombuffer(parts[i], np.uint8)
    first = (ends - sizes[long])[:, None] + np.arange(4)
    data[first] ^= 255
    words = np.ascontiguousarray(data.view("<u2").reshape(-1, BLOCK // 2).T)
    pairs, state = _pair_table(), np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = pairs[(state ^ w) & 0xFFFF] ^ (state >> 16)
    level = 0
    while count.max() > 1:
        odd = count & 1
        if odd.any():
            at = np.arange(len(state)) + np.repeat(np.cumsum(odd), count)
            grown = np.zeros(len(state) + int(odd.sum()), np.uint32)
            grown[at] = state
            state, count = grown, count + odd
        # a string of one block was padded to two as well; a zero block in front changes nothing
        state = _apply(_shift(level), state[0::2]) ^ state[1::2]
        count, level = count // 2, level + 1
    out[long] = ~state
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
