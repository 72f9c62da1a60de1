"""Randomness keyed to row ids.

Every draw is a function of a salt and the row key, so a result does not depend on partitioning,
task retries or the order of rows, and the same draw can be recomputed elsewhere. A published salt
voids the privacy guarantee: production callers pass a secret one.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**52)


def salt(seed: str, column: str, draw: int = 0) -> str:
    """Salt of one draw for one column; distinct columns and draws are independent."""
    return f"{seed}|{column}|{draw}"


def digest(salt_text: str, *keys: Column | str) -> Column:
    """MD5 of salt and keys in hex: two independent draws of 52 bits, its digits 1-13 and 14-26."""
    text = F.lit(salt_text)
    for k in keys:
        value = (F.col(k) if isinstance(k, str) else k).cast("string")
        text = F.concat(text, F.lit("|"), F.coalesce(value, F.lit("")))
    return F.md5(text)


def uniform(salt_text: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from 52 bits of an MD5 digest; never exactly 0 or 1."""
    bits = F.conv(F.substring(digest(salt_text, *keys), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(_SPAN)


def least_not_below(p: float) -> int:
    """The least draw of 52 bits whose uniform is not less than p."""
    return ceil(Fraction(p) * 2**52 - Fraction(1, 2))


def below(digits: Column, p: float) -> Column:
    """Whether the uniform of a draw's 13 hex digits (further ones do no harm) is less than p, without making a number of them."""
    first = least_not_below(p)
    if first <= 0 or first >= 2**52:
        return F.lit(first > 0)
    return digits < F.lit(f"{first:013x}")


def md5_words():
    """(laid_out, digests): the four 32-bit words of the MD5 digests of many texts, which share a head and differ in their tails.

    Each step is taken for all texts at once by numpy, which costs a fraction of one digest after another. The functions are made
    here since tasks are sent nested functions by value and need no package of ours.
    """
    u4 = np.uint32
    sines = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
    turns = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
    places = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
    shifts = [(u4(t), u4(32 - t)) for t in turns]

    def laid_out(size, tails, sizes):
        """Words of the padded texts, with zeros for a head of `size` bytes: arrays, or numbers where all texts have the same.

        `tails` holds a row of bytes for each text, of which `sizes` count, with zeros behind them.
        """
        n, total = len(sizes), sizes + size
        # the end mark and eight bytes of length follow a text; its length is in the last block of its own, so all must have as many
        data = np.zeros((n, 64 * ((int(total.max()) + 72) // 64)), np.uint8)
        data[:, size : size + tails.shape[1]] = tails
        data[np.arange(n), total] = 128
        words = np.ascontiguousarray(data.view("<u4").T)
        words[-2] = (total * 8).astype(u4)
        return [int(w[0]) if (w == w[0]).all() else w for w in words]

    def digests(head, words, n):
        start = np.frombuffer(head + bytes(-len(head) % 4), "<u4").tolist()
        words = [start[i] | w if i < len(start) and isinstance(w, int) else w | u4(start[i]) if i < len(start) else w for i, w in enumerate(words)]
        state = [np.full(n, x, u4) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        t = np.empty(n, u4)
        for block in (words[i : i + 16] for i in range(0, len(words), 16)):
            a, b, c, d = (x.copy() for x in state)
            for i in range(64):
                if i < 16:
                    np.bitwise_xor(c, d, t), np.bitwise_and(t, b, t), np.bitwise_xor(t, d, t)
                elif i < 32:
                    np.bitwise_xor(b, c, t), np.bitwise_and(t, d, t), np.bitwise_xor(t, c, t)
                elif i < 48:
                    np.bitwise_xor(b, c, t), np.bitwise_xor(t, d, t)
                else:
                    np.invert(d, t), np.bitwise_or(t, b, t), np.bitwise_xor(t, c, t)
                word, constant = block[places[i]], sines[i]
                if isinstance(word, int):
                    constant = constant + word & 0xFFFFFFFF
                else:
                    np.add(a, word, a)
                np.add(a, t, a), np.add(a, u4(constant), a)
                left, right = shifts[i]
                np.left_shift(a, left, t), np.right_shift(a, right, a), np.bitwise_or(a, t, a), np.add(a, b, a)
                a, b, c, d = d, a, b, c
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        return state

    return laid_out, digests


def laplace_noise(u: Column, scale: Column | float) -> Column:
    """Laplace draw with mean 0 by inverse CDF of a uniform."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
