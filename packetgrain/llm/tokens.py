"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

Both supplied vocabularies split a text into pre-tokens before any merge, and no pre-token crosses the places where
the classes below cut. The ids of a text are therefore the ids of its pieces in order. A batch is cut and hashed
as one byte array; the ids of distinct pieces are kept in a table of bounded size from task to task.
"""

from __future__ import annotations

import os
import re
import sys
from functools import lru_cache

import numpy as np
import pandas as pd

from packetgrain.llm import hashing

# Distinct pieces a worker remembers; beyond it the table starts anew.
REMEMBERED = 3_000_000
# 1: ASCII letter or digit, 2: other visible ASCII but the apostrophe.
_KIND = np.array([(1 if chr(c).isalnum() else 2 * (33 <= c < 127 and c != 39)) if c < 128 else 0 for c in range(256)])
_KIND = _KIND.astype(np.uint8)


class Whole:
    """Any tokenizer file: every text is encoded as it is."""

    def __init__(self, path: str):
        assert sys.byteorder == "little"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the place where each text's ids start and end."""
        raw = data.tobytes()
        rows = self.ids([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return _flat(rows)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return np.array([i for r in rows for i in r], np.uint32), ends


class _Table(Whole):
    """Pieces looked up by hash: sorted hashes, and for each the range of its ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self.lean = Tokenizer.from_file(path)
        self.lean.encode_special_tokens = True
        self.lean.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._simplify(self.lean)
        self._forget()

    def _simplify(self, tokenizer) -> None:
        """Drop what does nothing to a single word of letters."""

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = self._irregular(data, offsets)
        gap = (data == 0x20) | (data == 0x0A)
        mark = gap.copy()
        # A mark after an ASCII letter or digit starts a pre-token; an apostrophe may belong to a contraction.
        kind = _KIND[data]
        mark[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        full = offsets[1:] > offsets[:-1]
        mark[offsets[:-1][full]] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(data))
        begin, text = self._pieces(data, starts, gap[starts])
        codes, keys = pd.factorize(hashing.spans(hashing.prefix(text), begin, ends), sort=True)
        first = np.zeros(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        slot = self._slots(keys, text, begin[first], ends[first])
        size = self.size[slot][codes]
        out = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=out[1:])
        ids = self.pool[np.repeat(self.at[slot][codes] - out[:-1], size) + np.arange(out[-1])]
        places = out[np.searchsorted(starts, offsets)]
        return (ids, places) if not whole.any() else self._mend(data, offsets, whole, ids, places)

    def _mend(self, data, offsets, whole, ids, places):
        """Put texts that cannot be cut at every gap in place of what was found for them."""
        raw = data.tobytes()
        own = iter(self._slow([raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(whole)]))
        rows = [
            np.array(next(own), np.uint32) if odd else ids[places[i] : places[i + 1]] for i, odd in enumerate(whole)
        ]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=ends[1:])
        return np.concatenate(rows), ends

    def _slots(self, keys: np.ndarray, text: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table places of the distinct pieces, in order of hash; the unknown ones are encoded first."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            order = np.flatnonzero(new)
            raw = text.tobytes()
            rows = self._learn([raw[a:b].decode() for a, b in zip(begin[order], ends[order], strict=True)])
            ids, places = _flat(rows)
            into = np.searchsorted(self.keys, keys[order])
            self.keys = np.insert(self.keys, into, keys[order])
            self.at = np.insert(self.at, into, places[:-1] + len(self.pool))
            self.size = np.insert(self.size, into, np.diff(places))
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.keys, keys)
        return at

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; one word of letters alone needs no cutting by the tokenizer."""
        plain = [p[p[:1] == " " :].isalpha() and "\u0130" not in p for p in pieces]
        words = iter(self.lean.encode_batch_fast([p for p, w in zip(pieces, plain, strict=True) if w], add_special_tokens=False))
        rest = iter(self.ids([p for p, w in zip(pieces, plain, strict=True) if not w]))
        return [next(words).ids if w else next(rest) for w in plain]

    def _irregular(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.zeros(len(offsets) - 1, bool)

    def _pieces(self, data, starts, led):
        return starts, data

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return self.ids(texts)


class ByteLevel(_Table):
    """Byte-level pre-tokens: a word takes the one space before it.

    A text whose white space is single characters between words is cut before every space and newline. Any other
    text is cut only before spaces next to a character that is no white space.
    """

    _CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
    _ODD = re.compile(r"\s\s|\A\s|\s\Z")
    # First bytes of white space beyond ASCII; texts that have them are looked at one by one.
    _WIDE = (0xC2, 0xE1, 0xE2, 0xE3)

    def _irregular(self, data, offsets):
        gap = (data == 0x20) | (data == 0x0A)
        other = ((data >= 0x09) & (data <= 0x0D) & ~gap) | ((data >= 0x1C) & (data <= 0x1F))
        odd = other.copy()
        if len(data):
            odd[1:] |= gap[1:] & gap[:-1]
            # A pair across two texts is no pair, but the ends of texts count.
            edges = np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], offsets[1:][offsets[1:] > offsets[:-1]] - 1])
            odd[edges] |= gap[edges]
        out = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0
        wide = np.diff(np.concatenate([[0], np.cumsum(np.isin(data, self._WIDE))])[offsets]) > 0
        for i in np.flatnonzero(wide & ~out):
            out[i] = bool(self._ODD.search(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        return out

    def _slow(self, texts):
        cut = [[p for p in self._CUT.split(t) if p] for t in texts]
        ids = iter(self.ids([p for pieces in cut for p in pieces]))
        return [[i for _ in pieces for i in next(ids)] for pieces in cut]


class WordEnd(_Table):
    """Lower-cased words with white space dropped: cut at every space and newline."""

    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[0x41:0x5B] += 0x20

    def _pieces(self, data, starts, led):
        return starts + led, self._LOWER[data]

    def _simplify(self, tokenizer):
        from tokenizers import normalizers

        tokenizer.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


KINDS = {"byte_level": ByteLevel, "word_end": WordEnd, "whole": Whole}


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Whole:
    """The encoder a Python worker keeps for all its tasks."""
    return KINDS[kind](path)
