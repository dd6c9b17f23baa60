"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.fragments import mixed  # noqa: F401
from ticketlens.operators.scaling import perhaps_in  # noqa: F401

LANES = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a whole text as UTF-8; ``lower`` folds A-Z alone."""
    body = (text or "").encode("utf-8", "replace")
    return (body.lower() if lower else body).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int, base: np.uint64 = _MIX) -> np.ndarray:
    """Polynomial hash of every run of ``size`` consecutive values, modulo 2 ** 64; none if there are fewer.

    Runs of 1, 2, 4, ... values are doubled and put together by the binary
    digits of ``size``.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, covered = np.zeros(n, np.uint64), 0
        run, length, power = hashes, 1, base
        while covered < size:
            if size & length:
                out = out * power + run[covered:covered + n]
                covered += length
            run = run[:-length] * power + run[length:] if len(run) > length else run
            power = power * power
            length *= 2
    return out


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: Column, lanes: int = LANES) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row per key), however many rows share a key.

    Rows are spread over lanes by ``spread``; a fact is sent once to each lane
    that has rows of its key. ``facts`` must not have a column named _lane.
    """
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(spread), F.lit(lanes)))
    sent = laned.select(key, "_lane").distinct().join(facts, key)
    return laned.join(sent, [key, "_lane"], "left").drop("_lane")
