"""Numbers of a bootstrap: how often each resample draws a row, by a hash that any engine has."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Shares of a Poisson law of mean one: a row is drawn once, twice, ... where its number is at or over them.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)
#: Hashes made at once, the longest text of one block of md5.
CHUNK, LONGEST = 8192, 55
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_LEAST = np.array([math.ceil(x * (1 << 32)) for x in POISSON], np.uint32)


def md5_heads(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first eight digits, as numbers, of the md5 of n texts of one block, given as its 16 words: arrays, or numbers that all share.
    The digest's first word is made in step 61 of 64."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for s in range(61):
        if s < 16:
            at = s
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif s < 32:
            at = (5 * s + 1) % 16
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif s < 48:
            at = (3 * s + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            at = 7 * s % 16
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        word, shared = words[at], _SINES[s]
        if isinstance(word, np.ndarray):
            t += word
        else:
            shared += word
        t += np.uint32(shared & 0xFFFFFFFF)
        shift = _SHIFTS[s // 16][s % 4]
        np.left_shift(t, np.uint32(shift), out=u)
        t >>= np.uint32(32 - shift)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def times(numbers: np.ndarray) -> np.ndarray:
    """How often a row with such a number (of 32 bits) is drawn."""
    out = np.zeros(numbers.shape, np.uint8)
    for least in _LEAST:
        out += numbers >= least
    return out


def drawn(seed: str, keys: list[str | None], iterations: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place of a key, first iteration from 0, how often each iteration from there draws it) over all keys and iterations from 1 on, by the
    md5 of seed|iteration|key. Texts of one length are hashed together: those of keys and of iterations of as many digits."""
    by_length: dict[int, list[int]] = {}
    tails = [b"" if k is None else b"|" + k.encode() for k in keys]
    for at, tail in enumerate(tails):
        by_length.setdefault(len(tail), []).append(at)
    head = seed.encode() + b"|"
    for length, places in by_length.items():
        for lo in (10**e for e in range(len(str(iterations)))):
            hi = min(10 * lo, iterations + 1)
            digits, size = len(str(lo)), len(head) + len(str(lo)) + length
            if size > LONGEST:
                for at in places:
                    made = [int(hashlib.md5(head + str(i).encode() + tails[at]).hexdigest()[:8], 16) for i in range(lo, hi)]
                    yield at, lo - 1, times(np.array(made, np.uint32))
                continue
            for start in range(lo, hi, CHUNK):
                some = np.arange(start, min(start + CHUNK, hi))
                own = np.zeros((len(some), 64), np.uint8)
                for k in range(digits):
                    own[:, len(head) + k] = 48 + some // 10 ** (digits - 1 - k) % 10
                own_words = own.view("<u4")
                fixed = np.zeros(64, np.uint8)
                fixed[: len(head)] = np.frombuffer(head, np.uint8)
                fixed[size] = 128
                fixed[56:60] = np.array([8 * size], "<u4").view(np.uint8)
                shared = fixed.view("<u4")
                rows = max(1, CHUNK // len(some))
                for first in range(0, len(places), rows):
                    block = places[first : first + rows]
                    theirs = np.zeros((len(block), 64), np.uint8)
                    if length:
                        theirs[:, size - length : size] = np.frombuffer(b"".join(tails[at] for at in block), np.uint8).reshape(len(block), length)
                    key_words, words = theirs.view("<u4"), []
                    for w in range(16):
                        lies = 4 * w < len(head) + digits and 4 * w + 4 > len(head), 4 * w < size and 4 * w + 4 > size - length
                        if any(lies):
                            words.append((key_words[:, w, None] + own_words[None, :, w] + shared[w]).ravel())
                        else:
                            words.append(int(shared[w]))
                    counts = times(md5_heads(words, len(block) * len(some))).reshape(len(block), len(some))
                    for at, row in zip(block, counts, strict=True):
                        yield at, start - 1, row
