"""Character n-grams of texts as hashed numbers, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20  # characters worked on at once
_LETTERS: list[np.ndarray] = []  # filled in each Python worker


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_pieces(text: str | None, overlap: int) -> Iterator[np.ndarray]:
    """Code points of the lower-cased letters, each run of others as one space; the whole text, piece by piece.

    Neighbouring pieces share `overlap` code points, so that n-grams of overlap + 1 appear once each.
    """
    text = text or ""
    tail = np.full(1, 32, np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        codes = np.concatenate((tail, codes))
        space = codes == 32
        codes = codes[~(space & np.concatenate(([False], space[:-1])))]
        yield codes
        tail = codes[-overlap:] if overlap else codes[:0]


def gram_numbers(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A number below 2**bits for the `size` code points that begin at each place."""
    if len(codes) < size:
        return np.empty(0, np.uint32)
    count = len(codes) - size + 1
    total = np.full(count, 0x9E3779B1 * size & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        total = (total ^ codes[k : k + count]) * np.uint32(0x85EBCA6B)
        total ^= total >> np.uint32(15)
    return (total * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
