"""Counts over a whole text, in Python and numpy; used on Arrow batches."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    keys = ids[:n]
    for i in range(1, width):  # dense numbers of the longer windows keep the keys within 64 bits
        _, keys = np.unique(keys * len(number) + ids[i : i + n], return_inverse=True)
    twice = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the number of lines with a word."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows just the six blanks
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)
