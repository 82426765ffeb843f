"""Character n-grams of a batch of texts as flat numpy arrays of hashed feature numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Whole texts in one array; a batch of texts is worked on in groups of about this many characters.
GROUP_CHARS = 500_000


def groups(texts: list[str | None], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """``texts`` (null: empty) in runs of about ``chars`` characters."""
    held, out = 0, []
    for t in texts:
        out.append(t or "")
        held += len(out[-1])
        if held >= chars:
            yield out
            held, out = 0, []
    if out:
        yield out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, a line feed before, between and after them; the place of each line feed."""
    flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return flat, np.r_[0, ends]


def grams(symbols: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The hashed number of the n-gram that begins at each place (the last ``order - 1`` wrap)."""
    h = symbols.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(order)
    for k in range(1, order):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h += np.roll(symbols, -k).astype(np.uint32) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def squeeze(symbols: np.ndarray, marks: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` without the places in ``drop``; ``marks`` are never dropped and are moved along."""
    stay = ~drop
    stay[marks] = True
    place = np.cumsum(stay) - 1
    return symbols[stay], place[marks]
