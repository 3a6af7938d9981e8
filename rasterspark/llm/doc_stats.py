"""Statistics of whole texts, vectorised over the words of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import SPACED, Piece, mix, pieces

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_distinct", "n_upper", "n_digits", "n_punct", "n_wide", "n_stops", "longest_line")
SYMBOLS, STOPS = b"#*$%&|<>", b".!?"


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


_SYMBOL, _STOP = _members(SYMBOLS), _members(STOPS)
_UPPER, _DIGIT = _members(bytes(range(65, 91))), _members(bytes(range(48, 58)))
_PUNCT = _members(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def lines_of(piece: Piece) -> tuple[list[int], list[int], list[int]]:
    """Of each text: \\n-split lines with a word, those equal to an earlier line, bytes of the longest line."""
    filled, again, longest = [], [], []
    raw = piece.data.tobytes()
    for a, b in zip(piece.starts[:-1].tolist(), piece.starts[1:].tolist(), strict=True):
        seen: set[bytes] = set()
        n = twice = most = 0
        for line in raw[a:b].split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                n += 1
                most = max(most, len(line))
                twice += line in seen
                seen.add(line)
        filled.append(n)
        again.append(twice)
        longest.append(most)
    return filled, again, longest


def repeated_words(piece: Piece) -> np.ndarray:
    """Words of each text inside windows of eight words that the text has twice or more."""
    hashes, at = piece.shingles(WINDOW)
    edge = np.zeros(len(piece.hashes) + 1, np.int64)
    if len(hashes):
        _, which, count = np.unique(mix(hashes ^ mix(piece.word_doc[at].astype(np.uint64) + np.uint64(7))), return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(piece.word_doc[inside], minlength=piece.docs)


def stats(piece: Piece) -> dict[str, np.ndarray]:
    data, starts = piece.data, piece.starts
    first = (data & 0xC0) != 0x80  # a byte for each code point
    filled, again, longest = lines_of(piece)
    pairs = np.unique(mix(piece.hashes ^ mix(piece.word_doc.astype(np.uint64) + np.uint64(3))), return_index=True)[1]
    return {
        "n_words": piece.n_words(), "word_chars": per_text(first & (piece.folded != 0), starts), "n_symbols": per_text(_SYMBOL[data], starts),
        "n_dup_lines": np.array(again, np.int64), "n_repeat_words": repeated_words(piece), "n_lines": np.array(filled, np.int64),
        "n_chars": per_text(first, starts), "n_distinct": np.bincount(piece.word_doc[pairs], minlength=piece.docs), "n_upper": per_text(_UPPER[data], starts),
        "n_digits": per_text(_DIGIT[data], starts), "n_punct": per_text(_PUNCT[data], starts), "n_wide": per_text(first & (data >= 0x80), starts),
        "n_stops": per_text(_STOP[data], starts), "longest_line": np.array(longest, np.int64),
    }


STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def counted(batches):
    """Replaces the last column, a text, by its statistics; the other columns pass through."""
    for batch in batches:
        found = [stats(p) for p in pieces(batch.column(batch.num_columns - 1), SPACED)]
        cols = [pa.array(np.concatenate([np.zeros(0, np.int64), *[f[c] for f in found]]).astype(np.int64)) for c in COUNTS]
        yield pa.record_batch([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], *COUNTS])
