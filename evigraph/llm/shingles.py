"""Word and window hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit affects every output bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``bytes.split`` knows just those six blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes. Most words of a text are rare ones, so hashing all of them costs less than to remember those seen."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes of one array."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = mix(np.array([seed], dtype=np.uint64))[0] | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * base + hashes[i : i + n]
    return mix(out)


def blocks(texts: Iterator[str | None], most: int = 400_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first text, words of each text): runs of texts of about ``most`` words together."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if held and size + len(words) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield start, held
