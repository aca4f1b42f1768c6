"""Words of many texts at once, as places in one byte array and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from packetgrain.llm import hashing

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTES = np.arange(256)
# Letters, digits and everything beyond ASCII, after lower-casing A-Z.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
# Everything but ASCII white space.
VISIBLE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))


@dataclass
class Words:
    low: np.ndarray  # bytes with A-Z lower-cased
    starts: np.ndarray  # first byte of every word
    ends: np.ndarray  # byte after it
    first: np.ndarray  # first word of every text, and the number of words
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space between them, and every word's place in that."""
        size = self.ends - self.starts
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at[:-1], size) + step] = self.low[np.repeat(self.starts, size) + step]
        return out.tobytes(), at[:-1], at[:-1] + size


def find(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> Words:
    """Maximal runs of bytes of ``kind``; no word crosses the end of a text."""
    low = LOWER[data]
    inside = np.concatenate([[False], kind[low], [False]])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[edges] = inside[1:-1][edges]
    edges = edges[edges > 0]
    end[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = hashing.spans(hashing.prefix(low), starts, ends)
    return Words(low, starts, ends, np.searchsorted(starts, offsets), hashes)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = op(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of every value in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)
