"""Vectorised words of Arrow text batches: byte masks and prefix hashes in numpy, no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def letter_table() -> np.ndarray:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased: the byte itself, 0 for what separates words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = True
    keep[128:] = True
    return np.where(keep, table, 0).astype(np.uint8)


def space_table() -> np.ndarray:
    """Words [^\\x20\\x09-\\x0D]+: NUL is a letter too, so bytes are moved up by one where they would be 0."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 32  # any value that no other letter has: the space itself separates
    table[[32, 9, 10, 11, 12, 13]] = 0
    return table


LETTERS, SPACED = letter_table(), space_table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Piece:
    """Some whole texts: raw bytes, where each begins, and their words."""

    first: int  # row of the batch
    data: np.ndarray
    starts: np.ndarray  # of texts, one more at the end
    word_at: np.ndarray
    word_end: np.ndarray
    word_doc: np.ndarray
    hashes: np.ndarray
    folded: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.starts) - 1

    def n_words(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.docs)

    def first_words(self) -> np.ndarray:
        return np.searchsorted(self.word_doc, np.arange(self.docs + 1))

    def word(self, i: int) -> str:
        return self.folded[self.word_at[i] : self.word_end[i]].tobytes().decode()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row within a text, and the place of their first words."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.word_doc[:n] == self.word_doc[k - 1 :])
        return shingle_hash([self.hashes[j : n + j] for j in range(k)])[at], at


def shingle_hash(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = out * np.uint64(_Q) + w
    return mix(out)


def tokenize(data: np.ndarray, starts: np.ndarray, table: np.ndarray, first: int, up: np.ndarray, down: np.ndarray) -> Piece:
    n = len(data)
    folded = table[data]
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = folded != 0
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    here, before = letter[1:], letter[:-1]
    word_at = np.flatnonzero(here & (~before | cut))
    word_end = np.flatnonzero(before & (~here | cut))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * up[:n], out=total[1:])
    hashes = mix((total[word_end] - total[word_at]) * down[word_at] + (word_end - word_at).astype(np.uint64))
    word_doc = np.searchsorted(starts, word_at, side="right") - 1
    return Piece(first, data, starts, word_at, word_end, word_doc, hashes, folded)


def pieces(texts: pa.Array, table: np.ndarray = LETTERS) -> Iterator[Piece]:
    """Cuts a batch's texts (null: empty) into pieces of whole texts and finds their words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, longest = 0, int(np.diff(offsets).max(initial=0))
    up, down = powers(max(min(PIECE_BYTES, int(offsets[-1] - offsets[0])), longest) + 1)
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1)
        yield tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, i, up, down)
        i = j


def words_of(text: str, table: np.ndarray = LETTERS) -> tuple[list[str], np.ndarray]:
    piece = next(pieces(pa.array([text]), table))
    return [piece.word(i) for i in range(len(piece.hashes))], piece.hashes
