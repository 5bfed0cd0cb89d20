"""Hashed five-word shingle sets and SuperMinHash signatures, vectorised over documents."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS = 5
#: Words that one task remembers before it starts anew.
MEMO_WORDS = 300_000

_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Turns texts into sorted arrays of distinct 64-bit shingle hashes.

    A-Z are lower-cased and words end at a space or at the characters 9 to 13; a text
    with fewer than five words is one shingle, one without words has none.
    """

    def __init__(self) -> None:
        self.memo = _Words()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = [len(w) for w in words]
        get = self.memo.__getitem__
        flat = np.fromiter((h for w in words for h in map(get, w)), np.uint64, sum(sizes))
        rolled = np.zeros(0, np.uint64)
        if len(flat) >= WORDS:
            rolled = flat[: len(flat) - WORDS + 1].copy()
            for i in range(1, WORDS):
                rolled = rolled * _B + flat[i : len(flat) - WORDS + 1 + i]
            rolled = mix(rolled)
        out, at = [], 0
        for n in sizes:
            if n >= WORDS:
                s = np.sort(rolled[at : at + n - WORDS + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in flat[at : at + n]:
                        h = h * _B + x
                out.append(mix(np.array([h]) + np.uint64(1)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def super_minhash(sets: list[np.ndarray], m: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), one row of ``m`` 64-bit values for each set.

    Each element has a random permutation of the ``m`` places and random fractions; at
    the place that its permutation ranks ``j``-th it offers ``j`` plus a fraction, and
    each place keeps the least offer.  All elements take step ``j`` at once; a set is
    finished, and takes no further step, when its largest value is below ``j``: later
    offers can't be smaller.  Values are ``j << 56 | fraction``.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return sig
    flat = sig.reshape(-1)
    x = mix(np.concatenate(sets) ^ np.uint64(seed))
    owner = np.repeat(np.arange(len(sets)), sizes)
    perm: np.ndarray | None = None
    for j in range(m):
        state = mix(x + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((state >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
                rows = np.arange(len(x))
                perm[rows, k0] = 0  # the swap of step 0
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        value = np.uint64(j) << np.uint64(56) | mix(state ^ _M1) >> np.uint64(8)
        np.minimum.at(flat, owner * m + place, value)
        worst = sig.max(axis=1)
        going = worst >= np.uint64(j + 1) << np.uint64(56)
        keep = going[owner]
        if not keep.any():
            break
        if j == 0:
            x, owner, k0 = x[keep], owner[keep], k[keep]
        elif not keep.all():
            x, owner, perm = x[keep], owner[keep], perm[keep]
            rows = np.arange(len(x))
    return sig


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(size of the intersection, size of the union) of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return both, len(a) + len(b) - both
