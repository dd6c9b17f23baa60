"""Substring dedup: words covered by a window that also starts earlier are removed; a count-min sketch picks the windows to group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import ascii_words, mixed, window_hashes, word_hashes

WINDOW = 20
#: Text held by one task at a time, in bytes.
CHUNK_BYTES = 12_000_000
#: Counters of a sketch row for each byte of text; about 32 for each window of ordinary prose.
COUNTERS_PER_BYTE = 5
SKETCH_ROWS = 2
#: Counters of one shard of a sketch row, one byte each while the shard is merged.
SHARD_COUNTERS = 1 << 24
#: Text whose repeated windows are grouped by one task, in bytes.
GROUP_BYTES = 32_000_000
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class _Sizes:
    """Numbers that follow from the amount of text: chunks of documents, sketch shards, groups of window keys."""

    chunks: int
    shards: int
    groups: int
    window: int
    rows: int


def _gaps(values: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps; a gap that does not fit is 65535 followed by four bytes at the end."""
    gaps = np.diff(values, prepend=0)
    wide = gaps >= 65_535
    return np.int32(len(gaps)).tobytes() + np.where(wide, 65_535, gaps).astype(np.uint16).tobytes() + gaps[wide].astype(np.uint32).tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    count = int(np.frombuffer(data, np.int32, 1)[0])
    gaps = np.frombuffer(data, np.uint16, count, 4).astype(np.int64)
    gaps[gaps == 65_535] = np.frombuffer(data, np.uint32, offset=4 + 2 * count)
    return np.cumsum(gaps)


class _Chunk:
    """The windows of some documents, in the order of (id, text); null ids come last."""

    def __init__(self, table: pa.Table, sizes: _Sizes):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.n_words, first, second = [], [], []
        for text in self.texts:
            words = ascii_words(text)
            hashes = word_hashes(words)
            self.n_words.append(len(words))
            first.append(window_hashes(hashes, sizes.window, _BASES[0]))
            second.append(window_hashes(hashes, sizes.window, _BASES[1]))
        self.counts = np.array([len(x) for x in first], np.int64)
        self.first = mixed(np.concatenate(first)) if first else np.empty(0, np.uint64)
        self.second = mixed(np.concatenate(second)) if second else np.empty(0, np.uint64)

    def buckets(self, row: int, sizes: _Sizes) -> np.ndarray:
        """Counter of each window in one sketch row."""
        keys = self.first if row == 0 else mixed(self.second + np.uint64(row))
        return (keys % np.uint64(sizes.shards * SHARD_COUNTERS)).astype(np.int64)

    def repeated(self, answers: list[dict], sizes: _Sizes) -> np.ndarray:
        """Windows whose smallest counter over all rows is two or more."""
        maybe = np.ones(len(self.first), bool)
        for row in range(sizes.rows):
            buckets = self.buckets(row, sizes)
            known, inverse = np.unique(buckets, return_inverse=True)
            flags = np.zeros(len(known), bool)
            shard = known // SHARD_COUNTERS
            for answer in answers:
                if answer["kind"] == row:
                    start, end = np.searchsorted(shard, [answer["shard"], answer["shard"] + 1])
                    flags[start:end] = np.unpackbits(np.frombuffer(answer["data"], np.uint8), count=end - start).astype(bool)
            maybe &= flags[inverse]
        return np.flatnonzero(maybe)

    def keys(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places sorted by key and then by order, and which of them is the first of its key here."""
        ordered = places[np.lexsort((places, self.second[places], self.first[places]))]
        a, b = self.first[ordered], self.second[ordered]
        return ordered, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(ordered) else np.empty(0, bool)


def _sketch(table: pa.Table, sizes: _Sizes) -> pa.Table:
    """The sketch of one chunk: for each row and shard the counters in use, and which of them count two or more."""
    chunk = _Chunk(table, sizes)
    number = table.column("chunk")[0].as_py()
    out: dict[str, list] = {"kind": [], "shard": [], "chunk": [], "data": [], "twice": []}
    for row in range(sizes.rows):
        used, counts = np.unique(chunk.buckets(row, sizes), return_counts=True)
        bounds = np.flatnonzero(np.diff(used // SHARD_COUNTERS, prepend=-1))
        for start, end in zip(bounds, [*bounds[1:], len(used)]):
            shard = int(used[start]) // SHARD_COUNTERS
            out["kind"].append(row)
            out["shard"].append(shard)
            out["chunk"].append(number)
            out["data"].append(_gaps(used[start:end] - shard * SHARD_COUNTERS))
            out["twice"].append(np.packbits(counts[start:end] > 1).tobytes())
    return pa.table(out, schema=_SKETCH)


_SKETCH = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("twice", pa.binary())])
_ANSWER = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
_KEYS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])
_GROUPED = -1


def _merge(table: pa.Table) -> pa.Table:
    """Merged counters of one shard; each chunk learns which of its counters are two or more."""
    counters = np.zeros(SHARD_COUNTERS, np.uint8)
    parts = [(chunk, _from_gaps(data.as_buffer()), twice) for chunk, data, twice in zip(
        table.column("chunk").to_pylist(), table.column("data"), table.column("twice").to_pylist())]
    for _, used, twice in parts:
        counters[used] = np.minimum(counters[used] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(used)), 2)
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    return pa.table({"kind": [kind] * len(parts), "shard": [shard] * len(parts), "chunk": [p[0] for p in parts],
                     "data": [np.packbits(counters[used] > 1).tobytes() for _, used, _ in parts]}, schema=_ANSWER)


def _candidates(table: pa.Table, answers: pa.Table, sizes: _Sizes) -> pa.Table:
    """Keys of the windows of one chunk that are estimated repeated, once each, with the smallest id that has them here."""
    chunk = _Chunk(table, sizes)
    ordered, leads = chunk.keys(chunk.repeated(answers.to_pylist(), sizes))
    places = ordered[leads]
    owners = np.repeat(np.array([_LAST if i is None else i for i in chunk.ids], np.int64), chunk.counts)[places]
    keys = np.stack([chunk.first[places], chunk.second[places]], axis=1)
    group = _group_of(keys[:, 0], sizes)
    bounds = np.flatnonzero(np.diff(group, prepend=-1))
    number = table.column("chunk")[0].as_py() if table.num_rows else 0
    rows = list(zip(bounds, [*bounds[1:], len(group)]))
    return pa.table({"shard": [int(group[s]) for s, _ in rows], "chunk": [number] * len(rows), "keys": [keys[s:e].tobytes() for s, e in rows],
                     "ids": [_narrow(owners[s:e]) for s, e in rows]}, schema=_KEYS)


def _group_of(first: np.ndarray, sizes: _Sizes) -> np.ndarray:
    """Ascending with the key, so that keys sorted as a whole are sorted within each group."""
    return ((first >> np.uint64(32)) * np.uint64(sizes.groups) >> np.uint64(32)).astype(np.int64)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as differences from the smallest, in four bytes where they fit."""
    low = ids.min()
    apart = (ids - low).view(np.uint64)
    width = 4 if apart.max() < 1 << 32 else 8
    return np.array([low, width], np.int64).tobytes() + apart.astype(f"u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    low, width = np.frombuffer(data, np.int64, 2)
    return np.frombuffer(data, f"u{width}", offset=16).astype(np.int64) + low


def _first_owners(table: pa.Table) -> pa.Table:
    """Exact grouping of one group of keys; each chunk learns which of its keys start earlier in another chunk."""
    keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    whole = np.concatenate(keys)
    ids = np.concatenate([_wide(i) for i in table.column("ids").to_pylist()])
    order = np.lexsort((ids, whole[:, 1], whole[:, 0]))
    lead = np.concatenate([[True], (whole[order[1:]] != whole[order[:-1]]).any(axis=1)])
    lowest = ids[order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]]
    later = np.empty(len(order), bool)
    later[order] = ids[order] > lowest
    ends = np.cumsum(sizes)
    shard = table.column("shard")[0].as_py()
    return pa.table({"kind": [_GROUPED] * len(keys), "shard": [shard] * len(keys), "chunk": table.column("chunk").to_pylist(),
                     "data": [np.packbits(later[e - n:e]).tobytes() for e, n in zip(ends, sizes)]}, schema=_ANSWER)


def _rewrite(table: pa.Table, answers: pa.Table, sizes: _Sizes, result: pa.Schema) -> pa.Table:
    """Each document without the words that a repeated window covers."""
    chunk = _Chunk(table, sizes)
    told = answers.to_pylist()
    ordered, leads = chunk.keys(chunk.repeated(told, sizes))
    group = _group_of(chunk.first[ordered[leads]], sizes)
    later = np.zeros(len(group), bool)
    for answer in told:
        if answer["kind"] == _GROUPED:
            start, end = np.searchsorted(group, [answer["shard"], answer["shard"] + 1])
            later[start:end] = np.unpackbits(np.frombuffer(answer["data"], np.uint8), count=end - start).astype(bool)
    drop = np.zeros(len(chunk.first), bool)
    if len(ordered):
        drop[ordered] = ~leads | later[np.cumsum(leads) - 1]
    texts, removed, start = [], [], 0
    for text, n, windows in zip(chunk.texts, chunk.n_words, chunk.counts):
        at = np.flatnonzero(drop[start:start + windows])
        start += windows
        words = ascii_words(text)
        if len(at):
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + sizes.window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            words = [w for w, k in zip(words, keep.tolist()) if k]
        texts.append(b" ".join(words).decode("utf-8"))
        removed.append(n - len(words))
    return pa.table([pa.array(chunk.ids, result.field(0).type), pa.array(chunk.n_words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.string())], schema=result)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
                   rows: int = SKETCH_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: id (an integer), ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one space.

    A word goes if a window of ``window`` consecutive words covers it whose
    words also start earlier: in a document with a smaller id, or earlier in
    the same one. Windows are judged on the input.

    1. Documents are dealt into chunks by their id. Every chunk sends a sketch
       of its windows: the counters in use, in ``rows`` rows, by shard.
    2. Shards are merged. As counters only overestimate, a window with a
       counter below two in any row occurs once; no repeated window is lost.
    3. Chunks send the 128-bit keys of the windows left, once each, with their
       smallest id. Keys are grouped exactly, and every chunk learns which of
       its windows start earlier elsewhere.

    All answers are bit masks over what the chunk has sent in sorted order, so
    texts are shuffled once, and no task holds more than a chunk, a shard or a
    group of keys; their numbers grow with the text.

    Null and empty texts have no words. Null ids count as the largest; rows
    repeated under one id are ordered by text, and of equal rows the first in
    that order is the earlier one. Texts shorter than a window keep all words.
    """
    body = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = body.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sizes = _Sizes(max(1, -(-total // chunk_bytes)), max(1, -(-total * COUNTERS_PER_BYTE // SHARD_COUNTERS)), max(1, -(-total // GROUP_BYTES)),
                   window, rows)
    dealt = body.select(F.pmod(F.xxhash64("id"), F.lit(sizes.chunks)).alias("chunk"), "id", "text")
    result = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    fields = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    answer = "kind int, shard long, chunk long, data binary"

    sketches = dealt.groupBy("chunk").applyInArrow(lambda t: _sketch(t, sizes), "kind int, shard long, chunk long, data binary, twice binary")
    counted = sketches.groupBy("kind", "shard").applyInArrow(_merge, answer)
    keys = dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        lambda t, a: _candidates(t, a, sizes), "shard long, chunk long, keys binary, ids binary")
    grouped = keys.groupBy("shard").applyInArrow(_first_owners, answer)
    told = counted.unionByName(grouped)
    cleaned = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda t, a: _rewrite(t, a, sizes, fields), result)
    return cleaned.withColumnRenamed("id", id_column)
