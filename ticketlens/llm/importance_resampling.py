"""Target-distribution importance resampling: hashed n-gram weights, Gumbel scores, and a distributed quickselect of the k best."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.session import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
#: Pivot keys of one round of the selection: its rounds grow with the logarithm of the rows to this base.
PIVOTS = 24
#: Characters of text whose words a task holds at a time.
PORTION = 1 << 21
#: Bytes of a word stay, A-Z become a-z, all others end a word.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


@lru_cache(maxsize=256)
def _zeros_after(size: int) -> np.ndarray:
    """Four tables of 256: what each byte of a checksum register becomes once ``size`` zero bytes are read."""
    if size == 0:
        return np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if size > 1:
        half, rest = _zeros_after(size // 2), _zeros_after(size - size // 2)
        return _advance(half, rest)
    # One byte: the checksum of a byte, less what the register's inversion adds.
    low = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    shifted = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]) >> np.uint32(8)
    shifted[0] = low
    return shifted


def _advance(registers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][registers & np.uint32(255)]
    for place in (1, 2, 3):
        out = out ^ tables[place][(registers >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each whole text, and all features: the bucket of each and the text it belongs to.

    Features are the words and every two consecutive words joined by a space.
    The checksum of "a b" is that of "a " carried over as many zero bytes as
    "b" has, combined with that of "b": checksums are taken once per
    distinct word, and those of pairs follow in whole arrays.
    """
    words: list[bytes] = []
    sizes = []
    for text in texts:
        found = text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []
        words += found
        sizes.append(len(found))
    n_words = np.array(sizes, np.int64)
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(sizes)), n_words)
    crc = zlib.crc32
    single = np.array([crc(w) for w in distinct], np.uint32)
    spaced = np.array([crc(b" ", c) for c in single.tolist()], np.uint32)
    lengths = np.array([len(w) for w in distinct], np.int64)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    first, second = ids[pairs], ids[pairs + 1]
    order = np.argsort(lengths[second].astype(np.uint16 if not len(lengths) or lengths.max() < 1 << 16 else np.int64), kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[second[order]], prepend=-1))
    double = np.empty(len(pairs), np.uint32)
    for start, end in zip(bounds, [*bounds[1:], len(order)]):
        at = order[start:end]
        double[at] = _advance(spaced[first[at]], _zeros_after(int(lengths[second[at[0]]]))) ^ single[second[at]]
    buckets = np.concatenate([single[ids], double]) % np.uint32(BUCKETS)
    return n_words, buckets, np.concatenate([owner, owner[pairs]])


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``PORTION`` characters; a longer text is a portion of its own."""
    start = total = 0
    for place, text in enumerate(texts):
        total += len(text or "")
        if total >= PORTION:
            yield start, place + 1
            start, total = place + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in _portions(texts):
            totals += np.bincount(features(texts[start:end])[1], minlength=BUCKETS)
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts; every task adds up its own first."""
    return texts.select(F.col(text)).mapInArrow(_count_rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> list[int]:
    """Gain of each bucket: 1000 times the log ratio of its smoothed shares in the target and in the documents, floored.

    One row per bucket, at most ``BUCKETS`` whatever the data, reaches the
    driver and is sent to the tasks as an array.
    """
    both = bucket_counts(docs, text).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        bucket_counts(target, target_text).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    found = {r["bucket"]: (r["s"], r["t"]) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = (sum(pair[i] for pair in found.values()) for i in (0, 1))
    counts = np.array([found.get(b, (0, 0)) for b in range(BUCKETS)], np.float64)
    ratio = ((counts[:, 1] + 1) * (all_s + BUCKETS)) / ((counts[:, 0] + 1) * (all_t + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def _weigh(batches: Iterator[pa.RecordBatch], table: np.ndarray, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, end in _portions(texts):
            n_words, buckets, owner = features(texts[start:end])
            sizes = np.bincount(owner, minlength=end - start)
            sums = np.zeros(end - start, np.int64)
            np.add.at(sums, owner, table[buckets])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), pa.array(n_words), pa.array(sizes),
                                              pa.array(np.where(sizes > 0, sums // np.maximum(sizes, 1), 0))], schema=fields)


def gumbel(identifier: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of ``seed:id``; a null id counts as the text null."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighed(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    table = np.array(gains(docs, target, text), np.int64)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    fields = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _weigh(batches, table, fields), schema).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def _ordering(values: Sequence[Column]) -> Column:
    """A struct that compares field by field, ascending, nulls last."""
    return F.struct(*[part for value in values for part in (value.isNull(), value)])


def _literals(pivot: Sequence, schema: T.StructType, names: Sequence[str]) -> Column:
    return _ordering([F.lit(value).cast(schema[name].dataType) for name, value in zip(names, pivot)])


def quickselect(rows: DataFrame, key: Sequence[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The ``k``-th key of ``rows`` in ascending order, nulls last; None if ``k`` is below one or there are fewer rows.

    Each round draws at random ``pivots`` keys of the rows that are left and
    counts exactly, in one aggregation, the rows below, at and between them.
    The ranks of the pivots then say in which part the ``k``-th key lies; the
    next round reads that part alone. A pivot that is the ``k``-th key ends
    the search. Only pivots and counts reach the driver, a number of rows
    bounded by ``pivots``; a key may be shared by any number of rows.
    """
    left, rank, depth = rows.select(*key), k, 0
    if k < 1:
        return None
    while True:
        drawn = left.orderBy(F.xxhash64(*key, F.lit(depth)), *key).limit(pivots).collect()
        unique = list(dict.fromkeys(tuple(row) for row in drawn))
        if not unique:
            return None
        ordered = sorted(unique, key=lambda row: tuple((value is None, value if value is not None else 0) for value in row))
        literals = [_literals(row, left.schema, key) for row in ordered]
        here = _ordering([F.col(c) for c in key])
        # 0: before the first pivot, 1: at it, 2: between it and the second, and so on
        part = F.size(F.filter(F.array(*literals), lambda p: p < here)) + F.size(F.filter(F.array(*literals), lambda p: p <= here))
        counts = {r["part"]: r["n"] for r in left.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if sum(counts.values()) < rank:
            return None
        found = 0
        while counts.get(found, 0) < rank:
            rank -= counts.get(found, 0)
            found += 1
        if found % 2:
            return ordered[found // 2]
        if found // 2 < len(ordered):
            left = left.filter(here < literals[found // 2])
        if found:
            left = left.filter(here > literals[found // 2 - 1])
        depth += 1


def _ranked(winners: DataFrame, key: Sequence[str]) -> DataFrame:
    """``winners`` with their rank: range-sorted by key, numbered inside each range, with the sizes of the ranges before added."""
    ranged = materialize(winners.repartitionByRange(*[F.asc_nulls_last(c) for c in key]).withColumn("range", F.spark_partition_id()), "winners")
    # One row per range.
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*[F.asc_nulls_last(c) for c in key]))
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + F.col("inside"))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score`` and ``rank``, null where it is not drawn.

    The weight of a document is the floored mean of its features' gains, its
    score adds Gumbel noise, and of the N rows with at least ``least_words``
    words the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller id. The quickselect finds the last key that is drawn; the winners
    alone are sorted and ranked.

    Null and empty texts have no features, weight 0 and are never drawn. A
    null id comes after all others among equal scores. Rows with one id are
    separate documents; among equal scores and ids the one with fewer features
    comes first, and rows equal in all of that are interchangeable. Without
    target texts all shares of the target are equal. An empty table gives no
    rows.
    """
    scored = materialize(weighed(docs, target, id_column, text, seed).withColumn("order", -F.col("score")).withColumn(
        "row", F.monotonically_increasing_id()), "importance")
    able = scored.filter(F.col("n_words") >= least_words)
    key = ["order", "id", "n_features", "row"]
    last = quickselect(able, key, able.count() * percent // 100)
    drawn = F.lit(False) if last is None else (F.col("n_words") >= least_words) & (_ordering([F.col(c) for c in key]) <= _literals(last, scored.schema, key))
    columns = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    ranked = _ranked(scored.filter(drawn), key).select(*columns, F.col("rank").cast("bigint").alias("rank"))
    return ranked.unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))
