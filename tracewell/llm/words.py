"""Words of a text as numbers of a small vocabulary, for operators that look for known passages."""

from __future__ import annotations

from itertools import repeat

import numpy as np

#: A-Z lowered, ASCII punctuation and controls turned into spaces.
PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of ``plain_words``, in order."""
    return edges(np.frombuffer(text.translate(PLAIN), dtype=np.uint8))


def edges(plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each run of plain bytes other than spaces."""
    inside = np.zeros(len(plain) + 2, dtype=bool)
    np.not_equal(plain, 32, out=inside[1:-1])
    turn = (inside[1:] != inside[:-1]).nonzero()[0]
    return turn[::2], turn[1::2]


def char_offset(text: bytes, at: int) -> int:
    """Code points before byte ``at``."""
    return len(text[:at].decode("utf-8", "ignore"))


def number(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words, 0 for those outside the vocabulary."""
    return np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words))
