"""Hash-ordered randomness: the draw depends on the key and the seed only, so it is the
same for every partitioning and survives the recomputation of a lost executor."""

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def hash_key(*cols, seed) -> Column:
    """Hex digest of the key columns and the seed; order by it to shuffle."""
    return F.md5(F.concat_ws(":", *[_c(c).cast("string") for c in cols], F.lit(str(seed))))


def uniform(*cols, seed) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the digest."""
    h = F.substring(hash_key(*cols, seed=seed), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def gaussian(*cols, seed) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    u1 = F.greatest(uniform(*cols, seed=f"{seed}a"), F.lit(1e-12))
    u2 = uniform(*cols, seed=f"{seed}b")
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def fold(*cols, seed, k) -> Column:
    """Random fold number 0..k-1."""
    h = F.substring(hash_key(*cols, seed=seed), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") % k


_MD5 = [(i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16,
         np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)), ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]) for i in range(64)]


def _heads(prefix, lo, hi, suffix):
    """As ``heads``, for numbers of equally many digits: a round of MD5 is a few array operations over all of them."""
    digits = len(str(lo))
    size = len(prefix) + digits + len(suffix)
    text = np.zeros(-(-(size + 9) // 64) * 64, np.uint8)
    text[:size + 1] = np.frombuffer(prefix + b"\0" * digits + suffix + b"\x80", np.uint8)
    text[-8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words = [x[None] for x in text.view("<u4")]  # one number where all texts agree
    n = np.arange(lo, hi)
    for k in range(digits):
        at = len(prefix) + digits - 1 - k
        words[at // 4] = words[at // 4] | ((n // 10 ** k % 10 + 48).astype(np.uint32) << (at % 4 * 8))
    state = [np.full(len(n), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, t = np.empty_like(state[0]), np.empty_like(state[0])
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i, (g, add, turn) in enumerate(_MD5):
            if i < 32:
                x, y, z = (b, c, d) if i < 16 else (d, b, c)
                np.bitwise_xor(y, z, out=f)
                np.bitwise_and(f, x, out=f)
                np.bitwise_xor(f, z, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            np.add(f, words[block + g] + add, out=f)
            np.left_shift(f, turn, out=t)
            np.right_shift(f, 32 - turn, out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap()


def heads(prefix: bytes, lo: int, hi: int, suffix: bytes):
    """First 32 bits of the digests of ``prefix``, a number, ``suffix`` for the numbers from ``lo`` to below ``hi``, as ``uniform`` reads them."""
    out = [np.zeros(0, np.uint32)]
    while lo < hi:
        end = min(hi, lo + 16384, 10 ** len(str(lo)))
        if end - lo < 256:
            out.append(np.array([int.from_bytes(hashlib.md5(b"%b%d%b" % (prefix, j, suffix), usedforsecurity=False).digest()[:4], "big") for j in range(lo, end)], np.uint32))
        else:
            out.append(_heads(prefix, lo, end, suffix))
        lo = end
    return np.concatenate(out)
