"""Vectorised word hashing over batches of UTF-8 texts.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's hash
absorbs its length and then eight bytes at a time, with a keyed finaliser after
each, so short words (nearly all) take one or two numpy passes over the words
of a whole slice and no Python object. Words above ``LONG`` bytes are rare and
take a keyed BLAKE2b each. Under a key that the texts' author does not know no
collision can be constructed; two keys give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

LONG = 64
#: The key of hashes that only propose candidates, which are confirmed on the words themselves.
KEY = 0x5851F42D4C957F2D
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = bytes(int(b == 32 or 9 <= b <= 13) for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Texts are hashed in slices of about so many bytes, which bounds the memory of a task.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that together have about SLICE_BYTES."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def hashed(texts: list[bytes], keys: tuple[int, ...] = (KEY,), fold: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """For each key, hashes of all words of ``texts`` in order; and len(texts) + 1 offsets into them.

    ``fold`` lower-cases A-Z.
    """
    raw = b" ".join(texts) + b" "
    if fold:
        raw = raw.translate(_FOLD)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    space = np.frombuffer(raw.translate(_IS_SPACE), dtype=np.int8)
    change = np.diff(space, prepend=np.int8(1))
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    if not texts or not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in keys], np.zeros(len(texts) + 1, dtype=np.int64)
    eight = np.ndarray((len(raw),), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    size = ends - starts
    states = [np.uint64(k) ^ (size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) for k in keys]
    live, at, left = None, starts, size
    while True:
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        for h, k in zip(states, keys, strict=True):
            if live is None:
                h[:] = mix(h ^ chunk)
            else:
                h[live] = mix((h[live] + np.uint64(k)) ^ chunk)
        more = np.flatnonzero((left > 8) & (size <= LONG) if live is None else left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for w in np.flatnonzero(size > LONG).tolist():
        word = raw[starts[w] : ends[w]]
        for h, k in zip(states, keys, strict=True):
            h[w] = int.from_bytes(blake2b(word, digest_size=8, key=k.to_bytes(8, "little")).digest(), "little")
    return states, np.searchsorted(starts, bounds)


def folded(text: bytes) -> list[bytes]:
    """The words themselves, A-Z as a-z."""
    return text.translate(_FOLD).split()


def grams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, seed, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)
