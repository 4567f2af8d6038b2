"""Hashes of words and character n-grams of many texts at once, over one array of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Texts are worked on in blocks of about so many bytes, each text whole.
BLOCK_BYTES = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def blocks(texts: list[str], most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in order, in lists of about ``most`` bytes; a longer text makes a list of its own."""
    block, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield block


class Bytes:
    """The bytes of a block with a space before and after each text; ``starts`` has each text's first place and the end."""

    def __init__(self, texts: Iterable[bytes]):
        texts = list(texts)
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of bytes of the class ``inside`` start and end."""
        edges = np.diff(inside[self.data].astype(np.int8))
        return np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """The code points of the block, and each text's first place among them and the end."""
        points = np.frombuffer(self.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) == len(self.data):
            return points, self.starts
        before = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return points, before[self.starts]

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """Where each text's places begin among sorted places, one more at the end."""
        return np.searchsorted(places, self.starts)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The text of each place."""
        return np.searchsorted(self.starts, places, "right") - 1


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n + 1, P, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits of their input in every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``most`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts if most is None else np.minimum(ends - starts, most)
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(values * powers(int(lengths.max()))[within], before)
    return mixed(sums + np.uint64(salt))


def ngram_hashes(points: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, 32-bit hashes of the n-grams of characters without white space inside, and their places.

    White space may stand at either end, where it marks the word's start or end.
    """
    space = (points == 32) | ((points >= 9) & (points <= 13))
    plain = np.where(space, np.uint32(32), points)
    h = plain
    inner = None
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint32(0x01000193) + plain[n - 1 :]
        if n > 2:
            nth = space[n - 2 : len(points) - 1]
            inner = nth if inner is None else inner[:-1] | nth
        if n in sizes and inner is not None:
            places = np.flatnonzero(~inner)
            found = h[places] + np.uint32(n)
            found = (found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield found ^ (found >> np.uint32(13)), places
