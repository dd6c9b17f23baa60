"""Line dedup: range-partitioned line hashes are streamed in order of document and position; the result is a keep bitmap per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.session import materialize

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
_SPACES = b" \t\n\x0b\x0c\r"
#: What a streamed row says: the line goes; its key continues in another range; the key's largest documents in a range.
_GOES, _OPEN, _HOLDER = 0, 1, 2


def line_keys(text: str | None, least_chars: int = LEAST_CHARS) -> tuple[int, list[tuple[int, bytes]]]:
    """Number of lines of a whole text, and (position, key) of the lines whose key has enough code points.

    Lines end at \\n; a null or empty text is one empty line. The key is the
    line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
    """
    lines = (text or "").encode("utf-8", "replace").lower().split(b"\n")
    keys = []
    for at, line in enumerate(lines):
        if len(line) >= least_chars:
            key = line.strip(_SPACES)
            if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8")) >= least_chars):
                keys.append((at, key))
    return len(lines), keys


def _hashed(batches: Iterator[pa.RecordBatch], least_chars: int, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, places, sizes, codes = [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            n, keys = line_keys(text, least_chars)
            owners += [row] * len(keys)
            sizes += [n] * len(keys)
            places += [at for at, _ in keys]
            codes += [xxhash.xxh3_128_digest(key) for _, key in keys]
        halves = np.frombuffer(b"".join(codes), ">i8").astype(np.int64).reshape(-1, 2)
        rows = pa.array(owners, pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column("id").take(rows), batch.column("digest").take(rows),
            pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], schema=fields)


def _keyed_lines(docs: DataFrame, id_column: str, text: str, least_chars: int) -> DataFrame:
    """One row per line with a key: 128 bits of the key, the document, the position and the number of lines."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), rows.schema["id"], rows.schema["digest"],
                           T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
    fields = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _hashed(batches, least_chars, fields), schema)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; two nulls are equal."""
    before, after = column[:-1], column[1:]
    differs = pc.fill_null(pc.not_equal(after, before), True)
    return pc.and_(differs, pc.invert(pc.and_(pc.is_null(after), pc.is_null(before)))).to_numpy(zero_copy_only=False)


def _stream(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Lines of one range, sorted by key, descending document and position: those that go.

    A key that starts here has its largest document here, so the lines of all
    later documents go once ``least`` documents have been seen. The first key
    of a range may have started in the range before and the last one may
    continue in the next: their undecided lines and their ``least`` largest
    documents are handed on. Only the lines of fewer than ``least`` documents
    of one key are held back.
    """
    key, last_id, seen, first_key = None, None, 0, False
    pending: list[pa.Table] = []
    holders: list[pa.Table] = []

    def said(table: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            yield from table.append_column("kind", pa.array(np.full(table.num_rows, kind, np.int32))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids = table.column("id").combine_chunks()
        keys = np.stack([table.column(name).combine_chunks().to_numpy() for name in ("h1", "h2")], axis=1)
        continues = key == tuple(keys[0])
        inner = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.concatenate([[0], np.flatnonzero(inner) + 1])
        sizes = np.diff(starts, append=len(keys))
        new_id = np.concatenate([[not continues or last_id != ids[0].as_py()], inner | _changes(ids)])
        if not continues:
            pending, holders, seen, first_key = [], [], 0, key is None
        # Number of the document within its key; a key carried over goes on counting.
        total = np.cumsum(new_id)
        number = total - np.repeat(np.concatenate([[-seen], total[starts[1:]] - 1]), sizes)
        counts = number[starts + sizes - 1]

        edge = np.zeros(len(keys), bool)
        edge[:sizes[0]] = first_key
        goes = ~edge & (number >= 2) & np.repeat(counts >= least, sizes)
        holds = new_id & (number <= least)
        if counts[0] >= least:
            for held in pending:
                yield from said(held, _GOES)
            pending = []
        yield from said(table.filter(pa.array(goes)), _GOES)
        yield from said(table.filter(pa.array(edge)), _OPEN)
        yield from said(table.filter(pa.array(holds & edge)), _HOLDER)

        if len(starts) > 1:
            pending, holders, first_key = [], [], False
        if not first_key:
            tail, at = table.slice(starts[-1]), slice(starts[-1], None)
            if counts[-1] < least:
                pending.append(tail.filter(pa.array(number[at] >= 2)))
            holders.append(tail.filter(pa.array(holds[at])))
        key, last_id, seen = tuple(keys[-1]), ids[-1].as_py(), int(number[-1])
    if not first_key:
        for held in pending:
            yield from said(held, _OPEN)
        for held in holders:
            yield from said(held, _HOLDER)


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                  least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, digest, at, n): every line that goes, by its document, the hash of its text, its position and the number of lines."""
    keyed = _keyed_lines(docs, id_column, text, least_chars)
    order = ["h1", "h2", F.desc_nulls_last("id"), "digest", "at"]
    schema = T.StructType([*keyed.schema.fields, T.StructField("kind", T.IntegerType())])
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    told = materialize(ranged.mapInArrow(lambda batches: _stream(batches, least_documents), schema), "line_ranges")
    # At most two keys per range, and at most least_documents rows for each of them.
    keeper = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id"))["id"]
    decided = told.filter(F.col("kind") == _HOLDER).groupBy("h1", "h2").agg(
        keeper.alias("keeper"), (F.count_distinct(F.struct("id")) >= least_documents).alias("common"))
    crossing = told.filter(F.col("kind") == _OPEN).join(F.broadcast(decided.filter("common")), ["h1", "h2"]).filter(
        ~F.col("id").eqNullSafe(F.col("keeper")))
    return told.filter(F.col("kind") == _GOES).select("id", "digest", "at", "n").unionByName(crossing.select("id", "digest", "at", "n"))


@F.arrow_udf(T.BinaryType())
def _packed(positions: pa.Array, n: pa.Array) -> pa.Array:
    """Keep bitmap of a document: one bit per line, 1 for a line that stays, deflated."""
    def pack(gone: pa.Scalar, total: pa.Scalar) -> bytes:
        keep = np.ones(total.as_py(), np.uint8)
        keep[gone.values.to_numpy()] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pa.array([pack(gone, total) for gone, total in zip(positions, n)], pa.binary())


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _unpacked(bitmap: pa.Array, n: pa.Array) -> pa.Array:
    bits = [np.unpackbits(np.frombuffer(zlib.decompress(data.as_py()), np.uint8), count=total.as_py()).astype(bool)
            for data, total in zip(bitmap, n)]
    return pa.array([b.tolist() for b in bits], pa.list_(pa.bool_()))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                 least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, digest, n_lines, n_dropped, keep) of every document that loses lines; ``keep`` is a deflated bitmap, a bit per line.

    Keys of at least ``least_chars`` code points that at least
    ``least_documents`` documents have lose all their lines, except in the
    largest document that has them; there all their lines stay. Line hashes
    are range-partitioned by (key, descending id, position), so a very common
    line spreads over as many ranges as its rows fill, and every range is
    streamed once. No text is shuffled.

    A document is named by its id and the hash of its text: rows that repeat
    both share one bitmap. Rows with one id and different texts are one
    document in the counts, and each has its own bitmap. Null ids are one
    document, smaller than all others. Lines of null or empty texts have no
    key. An empty table gives no rows. Keys are compared by 128 bits.
    """
    gone = dropped_lines(docs, id_column, text, least_chars, least_documents)
    grouped = gone.groupBy("id", "digest").agg(F.collect_set("at").alias("positions"), F.max("n").alias("n"))
    return grouped.select("id", "digest", F.col("n").cast("bigint").alias("n_lines"), F.size("positions").cast("bigint").alias("n_dropped"),
                          _packed("positions", "n").alias("keep"))


def without_common_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                         least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per input row: id, ``n_lines`` (before), ``n_dropped``, ``keep`` (null if all lines stay) and ``kept_text``.

    :func:`keep_bitmaps` applied to the texts; the cases are defined there.
    """
    bitmaps = materialize(keep_bitmaps(docs, id_column, text, least_chars, least_documents), "line_bitmaps")
    flags = bitmaps.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n_dropped", "keep", _unpacked("keep", "n_lines").alias("flags"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), body.alias("text"), F.xxhash64(body).alias("digest"))
    # The same plan at every size: a bitmap table that happens to be small is not sent to all.
    met = rows.join(flags.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("flags").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda line, i: F.get(F.col("flags"), i)), "\n"))
    return met.select(F.col("id").alias(id_column), F.size(lines).cast("bigint").alias("n_lines"),
                      F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep", kept.alias("kept_text"))
