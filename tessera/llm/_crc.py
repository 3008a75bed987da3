"""CRC-32 of words and of runs of words, for all words of a block at once.

The checksum of a joined run follows from those of its parts: the checksum of A followed by
B is that of A carried over the bytes of B, plus (xor) that of B. Carrying is linear, so it
is done by tables, a pass for each power of two in B's length.
"""

from __future__ import annotations

import zlib

import numpy as np

POLYNOMIAL = 0xEDB88320
SHORT = 64  # longer words go to zlib one by one


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _carry_tables() -> list[np.ndarray]:
    """For each power of two: where each byte of a checksum goes when so many bytes follow."""
    value = np.arange(256, dtype=np.uint32)
    one = np.stack([BYTE[value] if j == 0 else value << np.uint32(8 * (j - 1)) for j in range(4)])
    out = [one]
    for _ in range(31):
        out.append(np.stack([_carry(out[-1], _carry(out[-1], value << np.uint32(8 * j))) for j in range(4)]))
    return out


BYTE = _byte_table()
CARRY = _carry_tables()
SPACE = np.uint32(zlib.crc32(b" "))


def carried(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums carried over so many bytes each."""
    crc = crc.copy()
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        at = np.flatnonzero((lengths >> k) & 1)
        crc[at] = _carry(CARRY[k], crc[at])
    return crc


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte span."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    first, size = starts[order], size[order]
    long = int((size > SHORT).sum())
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[long:].max()) if long < len(size) else 0):
        some = slice(long, long + int(np.searchsorted(-size[long:], -j)))
        state = crc[some]
        crc[some] = BYTE[(state ^ data[first[some] + j]) & 255] ^ (state >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int):
    """Yield (k, checksums) for k = 1 to ``most``: of each k neighbouring words joined by one space.

    Entry i is of the run that starts at word i; runs that cross a row's bounds are in too.
    """
    size = ends - starts
    words = span_crcs(data, starts, ends)
    after = carried(np.full(len(words), SPACE, np.uint32), size) ^ words  # of a space and the word
    runs = words
    for k in range(1, most + 1):
        if k > 1:
            n = max(len(words) - k + 1, 0)
            runs = carried(runs[:n], size[k - 1 : k - 1 + n] + 1) ^ after[k - 1 : k - 1 + n]
        yield k, runs
