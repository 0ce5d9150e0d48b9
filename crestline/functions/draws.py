"""Random numbers as hashes of what they are drawn for: the same in any run, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a number: as many as a double holds exactly.
BITS = 52


def number(seed: int, *keys: Column | str) -> Column:
    """A whole number from 0 to 2^52 - 1 for each value of the keys (null: empty)."""
    words = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *words).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def numbers(words: Iterable[str]) -> np.ndarray:
    """number() in tasks: of the seed and the keys, joined by colons."""
    digests = b"".join([md5(w.encode()).digest()[:8] for w in words])
    return (np.frombuffer(digests, ">u8") >> np.uint64(64 - BITS)).astype(np.int64)


#: MD5 (RFC 1321): the sines' constants, and the turns of each of the four rounds.
SINES = [int(abs(np.sin(k + 1)) * (1 << 32)) & 0xFFFFFFFF for k in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SMALL = [np.uint32(k) for k in range(33)]
#: Bytes of a text that MD5 takes in one block.
ONE_BLOCK = 55


def _digest_numbers(words: list, n: int) -> np.ndarray:
    """numbers() of n texts of one block each, given as MD5's 16 words: arrays, or the same whole number for all."""
    seeds = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in seeds)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        part, g = k // 16, (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], int):
            np.add(f, np.uint32((SINES[k] + words[g]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(SINES[k]), out=f)
            f += words[g]
        turn = TURNS[part][k % 4]
        np.left_shift(f, SMALL[turn], out=t)
        np.right_shift(f, SMALL[32 - turn], out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = (x + np.uint32(s) for x, s in ((a, seeds[0]), (b, seeds[1])))
    return ((a.byteswap().astype(np.uint64) << np.uint64(BITS - 32)) | (b.byteswap() >> np.uint32(64 - BITS))).astype(np.int64)


class Texts:
    """Whole numbers of 0 or more as texts, to be ends of longer ones."""

    def __init__(self, at: np.ndarray):
        self.at, self.parts = at, []
        top = int(at.max()) if len(at) else 0
        sizes = 1 + sum((at >= 10**k).astype(np.int8) for k in range(1, len(str(top)))) if top > 9 else np.ones(len(at), np.int8)
        for size in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == size)
            rest, digits = at[here], []
            for _ in range(size):
                next_ = rest // 10
                digits.append((rest - 10 * next_ + 48).astype(np.uint32))
                rest = next_
            self.parts.append((here, digits[::-1]))

    def numbers(self, begin: str) -> np.ndarray:
        """numbers() of begin + text, all at once."""
        head, out = begin.encode(), np.empty(len(self.at), np.int64)
        for here, digits in self.parts:
            size = len(head) + len(digits)
            if size > ONE_BLOCK:
                out[here] = numbers(f"{begin}{x}" for x in self.at[here].tolist())
                continue
            text = bytearray(64)
            text[: len(head)] = head
            text[size] = 0x80
            text[56:] = (8 * size).to_bytes(8, "little")
            words: list = np.frombuffer(bytes(text), "<u4").tolist()
            for place, digit in enumerate(digits, len(head)):
                words[place // 4] = (digit << np.uint32(8 * (place % 4))) | (np.uint32(words[place // 4]) if isinstance(words[place // 4], int) else words[place // 4])
            out[here] = _digest_numbers(words, len(here))
        return out


def share(seed: int, *keys: Column | str) -> Column:
    """A number from 0 (included) to 1."""
    return number(seed, *keys) / F.lit(float(1 << BITS))


def number_sql(seed: int, *keys: str) -> str:
    """number() in DuckDB's SQL."""
    return f"('0x' || md5(concat_ws(':', '{seed}', {', '.join(f"coalesce(({k})::VARCHAR, '')" for k in keys)}))[1:{BITS // 4}])::BIGINT"


def share_sql(seed: int, *keys: str) -> str:
    return f"({number_sql(seed, *keys)} / {float(1 << BITS)}::DOUBLE)"
