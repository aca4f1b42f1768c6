"""Raw frames of one Arrow batch as a flat array, read at an offset per frame."""

from __future__ import annotations

import numpy as np


class Batch:
    def __init__(self, buffers: list[bytes]):
        self.buffers = buffers
        self.n = np.fromiter((len(b) for b in buffers), np.int64, len(buffers))
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(buffers) + b"\0", np.uint8).copy()

    def u8(self, off: np.ndarray) -> np.ndarray:
        """The byte at each frame's offset; 0 outside the frame."""
        inside = (off >= 0) & (off < self.n)
        return np.where(inside, self.flat[np.where(inside, self.start + off, 0)], 0).astype(np.int64)

    def u16(self, off: np.ndarray) -> np.ndarray:
        return self.u8(off) * 256 + self.u8(off + 1)
