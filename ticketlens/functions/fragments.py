"""Sets of hashes cut into fragments that similar sets share, and parity bitmaps that bound their difference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most bits of the parity bitmap of a set, and how many members for each bit still make it useful.
MOST_BITS, MEMBERS_PER_BIT = 4096, 2.5


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bands(largest: int, percent: int) -> list[int]:
    """Least sizes of the bands of sizes; similar sets lie in the same band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts + [starts[-1] * 100 // percent + 1]


def cells(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the cells of a set: two similar sets have a key in common.

    Band k cuts the order of members into m fragments of equal width, more
    than the most members d in which two similar sets of at most its sizes
    differ. So at least m - d fragments are alike. A set gives the key of each
    fragment that holds something, for its own band and the next one, where
    larger partners are. With m - d or more empty fragments it gives
    those as well, as only they may be alike.
    """
    if not len(tokens):
        return np.empty(0, np.uint64)
    starts = _bands(len(tokens), percent)
    own = int(np.searchsorted(starts, len(tokens), side="right")) - 1
    found, parts = [], mixed(tokens)
    for band in (own, own + 1):
        most = 2 * (starts[band + 1] - 1) * (100 - percent) // (100 + percent)
        count = most + 1 + (2 + -(-most * 15 // 100) if most else 0)
        number = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        with np.errstate(over="ignore"):
            name = mixed(np.arange(count, dtype=np.uint64) + np.uint64(band << 32))
            found.append(mixed(np.add.reduceat(parts, first) + name[number[first].astype(np.int64)]))
            if count - len(first) >= count - most:
                found.append(mixed(np.delete(name, number[first].astype(np.int64)) + np.uint64(1)))
    return np.concatenate(found)


def parity_bitmap(tokens: np.ndarray, spread: int = 1) -> np.ndarray | None:
    """Parity bits of a set: bit h is set if an odd number of members are h modulo the width; none for sets too large for it.

    There are ``spread`` (a power of two) to twice as many bits for each
    member, MOST_BITS at most; the more, the closer the bound.

    Two bitmaps differ in at most as many bits as their sets differ in
    members. The width is a power of two, so that halves of a bitmap, put
    together by exclusive or, are the bitmap of half the width.
    """
    width = min(MOST_BITS, max(64, spread << (len(tokens) - 1).bit_length())) if len(tokens) else 64
    if len(tokens) > MEMBERS_PER_BIT * width:
        return None
    odd = np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def different_bits(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ, the wider one folded once; 0 where nothing is known."""
    def folded(bits: Column) -> Column:
        half = F.shiftright(F.size(bits), 1)
        return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    wide, thin = F.size(x), F.size(y)
    one = F.when(wide == thin * 2, folded(x)).otherwise(x)
    two = F.when(thin == wide * 2, folded(y)).otherwise(y)
    bits = F.aggregate(F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, b: total + b)
    return F.when(F.size(one) == F.size(two), F.coalesce(bits, F.lit(0))).otherwise(F.lit(0))
