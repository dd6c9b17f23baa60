"""N-gram Jaccard join by vertical partitioning, and the classes of documents that its links connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.fragments import MOST_BITS, cells
from ticketlens.functions.fragments import different_bits as _different_bits
from ticketlens.functions.fragments import parity_bitmap as _bitmap
from ticketlens.llm.common import LANES, ascii_words, attach, mixed, perhaps_in, window_hashes, word_hashes
from ticketlens.operators.neighbours import connected_components
from ticketlens.session import discard, materialize

SIZE = 4
PERCENT = 85
FRAGMENTS = 8
#: Cells of a set in which the first round looks for partners; the rounds after it look at all.
FIRST_PLACES = 8
HOME_PAIRS = 256
#: Sets of one shingle that a block holds; a longer list is cut into parts, and each two parts meet in a block of their own.
PART = 8_192
#: Bits for each shingle in the bitmap of a set, so that the bound of a pair is close to its similarity.
SPREAD = 8
#: Pairs that a task compares at a time.
RUN_PAIRS = 1 << 15
#: Shingles that a task hands on at a time.
BATCH_SHINGLES = 1_000_000


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct hashes of the ``size``-word shingles of a whole text, ascending; a shorter text is one shingle, none without words."""
    words = ascii_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(mixed(window_hashes(word_hashes(words), min(size, len(words))) + np.uint64(min(size, len(words)))))


def _signatures(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """set_key, n and cells of each text."""
    kind = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("n", T.IntegerType()),
                         T.StructField("cells", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, places = [], [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py(), size)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sizes.append(len(tokens))
                places.append(cells(tokens, percent).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                                   pa.array(places, pa.list_(pa.int64()))], names=["id", "text_hash", "set_key", "n", "cells"])

    return texts.mapInArrow(sign, T.StructType([texts.schema["id"], texts.schema["text_hash"], *kind.fields]))


def _texts_of(where: DataFrame, texts: DataFrame) -> DataFrame:
    """``where`` (id, text_hash, ...) with the texts that it names; a text repeated under one id comes as often."""
    digest = F.xxhash64("id", "text_hash")
    near = perhaps_in(texts, digest, where, digest)
    return near.join(where, near["id"].eqNullSafe(where["id"]) & (near["text_hash"] == where["text_hash"])).drop("id", "text_hash")


def _bitmaps(sets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(uid, bits) of each set, from the text that stands for it."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_bitmap(shingles(text.as_py(), size), SPREAD) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["uid", "bits"])

    where = materialize(sets.select("uid", F.col("lead.id").alias("id"), F.col("lead.text_hash").alias("text_hash")), "ngram_wanted")
    signed = _texts_of(where, texts).select("uid", "text").mapInArrow(sign, "uid long, bits array<long>")
    return signed.groupBy("uid").agg(F.first("bits").alias("bits"))


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)


def _similar(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in whole numbers."""
    return overlap * (100 + percent) >= (n_a + n_b) * percent


def _partners(rows: DataFrame, percent: int, keep: int) -> DataFrame:
    """(token, uid, other, n, n_other, bound): for every row its ``keep`` most promising partners of components before its own.

    ``rows`` (token, block, part, uid, n, component, bits, tried) meet inside
    each (token, block). A pair has to pass the length filter and the bound of
    the bitmaps, and must not have been tried. Pairs stay inside the task; a row hands on ``keep`` of them. Each pair belongs to
    the row of the later component, so that the members of a large group do not all hand on the same few outsiders.
    """
    def first_of(row: np.ndarray, other: np.ndarray, score: np.ndarray, most: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((uid[other], -score, row))
        row, other, score, most = row[order], other[order], score[order], most[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        return tuple(values[rank < keep] for values in (row, other, score, most))

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Values and the bounds of each row; null lists are empty."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]

    def compare(table: pa.Table) -> pa.RecordBatch:
        columns = {name: table.column(name).combine_chunks() for name in table.column_names}
        token, block, part, uid, size, component = (
            columns[c].to_numpy(zero_copy_only=False) for c in ("token", "block", "part", "uid", "n", "component"))
        words, at = flat(columns["bits"])
        words, width = words.view(np.uint64) if len(words) else np.empty(0, np.uint64), np.diff(at)
        known, dense = np.unique(uid, return_inverse=True)
        tried, tried_at = flat(columns["tried"])
        slot = np.minimum(np.searchsorted(known, tried), len(known) - 1)
        owner, met = np.repeat(dense, np.diff(tried_at)), known[slot] == tried
        done = np.unique((np.minimum(owner, slot) << 32 | np.maximum(owner, slot))[met])

        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
        ends = np.repeat(np.r_[starts[1:], len(token)], np.diff(np.r_[starts, len(token)]))
        later = ends - np.arange(len(token)) - 1
        total = np.cumsum(later)

        def enough(most: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return most * (100 + percent) >= (size[i] + size[j]) * percent

        def run(low: int, high: int) -> tuple[np.ndarray, ...]:
            count = later[low:high]
            i = np.repeat(np.arange(low, high), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            fits = ((component[i] != component[j]) & ((block[i] < 0) | (part[i] != part[j]))
                    & (size[i] * 100 >= size[j] * percent) & (size[j] * 100 >= size[i] * percent))
            i, j = i[fits], j[fits]
            most = np.minimum(size[i], size[j])
            kinds = width[i] * (MOST_BITS + 1) + width[j]
            for kind in np.unique(kinds):
                pairs = np.flatnonzero(kinds == kind)
                thin = min(divmod(int(kind), MOST_BITS + 1))
                if thin == 0:
                    continue
                sides = []
                for row in (i[pairs], j[pairs]):
                    bits = words[at[row][:, None] + np.arange(width[row[0]])]
                    while bits.shape[1] > thin:
                        half = bits.shape[1] // 2
                        bits = bits[:, :half] ^ bits[:, half:]
                    sides.append(bits)
                apart = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
                most[pairs] = np.minimum(most[pairs], (size[i[pairs]] + size[j[pairs]] - apart) // 2)
            fits = enough(most, i, j)
            if len(done):
                fits &= ~np.isin(np.minimum(dense[i], dense[j]) << 32 | np.maximum(dense[i], dense[j]), done)
            i, j, most = i[fits], j[fits], most[fits]
            later_one = component[i] > component[j]
            return first_of(np.where(later_one, i, j), np.where(later_one, j, i), most / (size[i] + size[j] - most), most, uid)

        found, low = [], 0
        while low < len(token):
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + RUN_PAIRS, side="right")))
            found.append(run(low, high))
            low = high
        row, other, score, _ = first_of(*[np.concatenate(values) for values in zip(*found)], uid)
        return pa.record_batch([pa.array(v) for v in (token[row], uid[row], uid[other], size[row], size[other], score)],
                               names=["token", "uid", "other", "n", "n_other", "bound"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            token, block = (held.column(c).to_numpy() for c in ("token", "block"))
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]))
            if len(cuts):
                yield compare(held.slice(0, int(cuts[-1]) + 1))
                held = held.slice(int(cuts[-1]) + 1)
        if held is not None and held.num_rows:
            yield compare(held)

    return rows.select("token", "block", "part", "uid", "n", "component", "bits", "tried").mapInArrow(
        seek, "token long, uid long, other long, n long, n_other long, bound double")


def _fragments(texts: DataFrame, size: int, fragments: int) -> DataFrame:
    """(home, lane, uid, fragment, tokens): the set of each text (uid, home, lane, text), cut along the global order."""
    def packed(rows: list, parts: list) -> pa.RecordBatch:
        return pa.record_batch([*[pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], pa.array(parts, pa.list_(pa.int64()))],
                               names=["home", "lane", "uid", "fragment", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, held = [], [], 0
            for uid, home, lane, text in zip(*[batch.column(c).to_pylist() for c in range(3)], batch.column(3)):
                ordered = shingles(text.as_py(), size)
                bounds = [*np.searchsorted(ordered, np.array([(i << 64) // fragments for i in range(fragments)], np.uint64)), len(ordered)]
                for number, (start, end) in enumerate(zip(bounds, bounds[1:])):
                    if start < end:
                        rows.append((home, lane, uid, number))
                        parts.append(ordered[start:end].view(np.int64))
                held += len(ordered)
                if held >= BATCH_SHINGLES:
                    yield packed(rows, parts)
                    rows, parts, held = [], [], 0
            yield packed(rows, parts)

    return texts.mapInArrow(cut, "home long, lane long, uid long, fragment long, tokens array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int, fragments: int) -> DataFrame:
    """Pairs (a, b) of those (a, b, n_a, n_b) that are similar: overlaps are counted per fragment of the order and summed per pair.

    The second set of a pair travels to its first one, fragment by fragment.
    A first set with many pairs is repeated once for every HOME_PAIRS of them.
    """
    degrees = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOME_PAIRS).alias("lanes"))
    laned = attach(pairs, degrees, "a", F.col("b")).withColumn("lane", F.pmod(F.xxhash64("b", F.lit(1)), F.col("lanes")))
    roles = laned.select(F.col("b").alias("uid"), F.col("a").alias("home"), "lane").unionByName(
        laned.select(F.col("a").alias("uid"), F.col("a").alias("home"), "lane").distinct())
    where = materialize(roles.join(sets.select("uid", "lead"), "uid").select(
        "uid", "home", "lane", F.col("lead.id").alias("id"), F.col("lead.text_hash").alias("text_hash")), "ngram_roles")
    chosen = _texts_of(where, texts).select("uid", "home", "lane", "text")
    place = Window.partitionBy("home", "lane", "fragment").orderBy(F.col("uid") != F.col("home"))
    first = F.first(F.struct("uid", "tokens")).over(place)
    met = _fragments(chosen, size, fragments).select("home", "uid", "fragment", "tokens", first.alias("own"))
    partial = met.filter((F.col("uid") != F.col("home")) & (F.col("own.uid") == F.col("home"))).select(
        "home", "uid", "fragment", F.size(F.array_intersect("tokens", "own.tokens")).alias("shared"))
    # A text repeated under one id is cut more than once; each fragment counts once.
    summed = partial.groupBy("home", "uid", "fragment").agg(F.max("shared").alias("shared")).groupBy("home", "uid").agg(F.sum("shared").alias("shared"))
    return summed.join(pairs.select(F.col("a").alias("home"), F.col("b").alias("uid"), "n_a", "n_b"), ["home", "uid"]).filter(
        _similar(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select(F.col("home").alias("a"), F.col("uid").alias("b"))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
                    fragments: int = FRAGMENTS) -> DataFrame:
    """One row per input row: id, ``text_hash``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``percent`` / 100; ``component_id`` is the smallest id
    that links reach. The result is exact:

    1. Texts with equal sets become one set, however many they are.
    2. The order of shingles is cut into more fragments than similar sets can
       differ in, so that they agree in a whole one (``cells``). Sets with a
       fragment in common are candidates.
    3. First every set is compared with the better of the first and the
       previous set that share one of its FIRST_PLACES first fragments. This
       ties large groups together in one pair for each member.
    4. Then, in rounds, the sets of each fragment that different groups share
       meet inside a task, which hands on the most promising partners of each
       in other groups: one at first, four times as many in each round, until no
       untried pair of different groups is left that could be similar. Bounds
       are those of length and of bitmaps, both exact. Pairs inside
       a group cannot change it.
    5. A comparison adds up overlaps per fragment of the global order.

    A text without words (null, empty or blank) has no shingles and is its own
    class, named by its own id. Null ids are ignored in the choice of the
    smallest id. Rows repeated under one id are separate texts; ``kept`` marks
    one row of each class, the one with the smallest id (all of several rows
    that agree in id and text).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = texts.select("id", F.xxhash64("text").alias("text_hash"), "text")
    signed = materialize(_signatures(hashed, size, percent), "ngram_signatures")
    members = materialize(signed.select("id", "text_hash", "set_key", "n"), "ngram_members")

    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash")))
    grouped = signed.filter("n > 0").groupBy("set_key").agg(
        first.alias("lead"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    cut = materialize(grouped.select("set_key", "lead", "n", "cells", F.monotonically_increasing_id().alias("uid")), "ngram_cells")
    discard(signed)
    sets = materialize(cut.select("uid", "set_key", "lead"), "ngram_sets")

    places = cut.select("uid", F.col("n").cast("bigint").alias("n"), F.posexplode("cells").alias("place", "token"))
    often = materialize(places.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"), F.count(F.lit(1)).alias("sets")).filter(
        "sets > 1").drop("sets"), "ngram_often")
    shared = materialize(perhaps_in(places, F.col("token"), often, F.col("token")).join(often, "token"), "ngram_shared")
    discard(cut)

    bitmaps = materialize(_bitmaps(sets.join(shared.select("uid").distinct(), "uid", "left_semi"), hashed, size), "ngram_bitmaps")

    item = F.struct("uid", "n")
    early = shared.filter(F.col("place") < FIRST_PLACES).withColumn("lane", F.pmod(F.xxhash64("uid"), F.col("parts")))
    together = Window.partitionBy("token", "lane").orderBy("uid")
    early = early.withColumns({"before": F.lag(item).over(together), "lead": F.first(item).over(together)})
    heads = early.filter("before is null and parts > 1")
    over = heads.groupBy("token").agg(F.min(item).alias("other"))
    links = early.filter("before is not null").select("uid", "n", F.explode(F.array("before", "lead")).alias("other")).unionByName(
        heads.join(over, "token").select("uid", "n", "other"))
    met = links.filter((F.col("uid") != F.col("other.uid")) & _fits(F.col("n"), F.col("other.n"), percent)).select(
        "uid", F.col("other.uid").alias("other"), "n", F.col("other.n").alias("n_other")).distinct()
    signed_pairs = met.join(bitmaps, "uid").join(bitmaps.select(F.col("uid").alias("other"), F.col("bits").alias("bits_other")), "other")
    most = F.floor((F.col("n") + F.col("n_other") - _different_bits(F.col("bits"), F.col("bits_other"))) / 2)
    likely = signed_pairs.select("uid", "other", "n", "n_other", most.alias("most")).filter(
        _similar(F.col("most"), F.col("n"), F.col("n_other"), percent))
    best = likely.groupBy("uid").agg(F.max(F.struct((F.col("most") / (F.col("n") + F.col("n_other") - F.col("most"))).alias("bound"),
                                                    "other", "n", "n_other")).alias("best"))

    def verified(asked: DataFrame) -> DataFrame:
        """Links among the pairs (uid, other) that are asked for, each compared once."""
        ahead = F.col("uid") < F.col("other")
        pairs = asked.select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b"),
                             F.when(ahead, F.col("n")).otherwise(F.col("n_other")).alias("n_a"),
                             F.when(ahead, F.col("n_other")).otherwise(F.col("n")).alias("n_b")).distinct()
        return _verified(materialize(pairs, "ngram_pairs"), sets, hashed, size, percent, fragments)

    asked = materialize(best.select("uid", "best.other", "best.n", "best.n_other"), "ngram_asked")
    tied = materialize(connected_components(materialize(verified(asked), "ngram_edges"), "a", "b"), "ngram_tied")

    def grouped_by(rows: DataFrame) -> DataFrame:
        return rows.join(tied.withColumnRenamed("vertex", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))

    now = grouped_by(shared.drop("place"))
    spans = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    left = materialize(now.drop("component").join(spans.select("token"), "token", "left_semi"), "ngram_open")
    keep = 1
    while True:
        tried = asked.groupBy("uid").agg(F.collect_list("other").alias("tried"))
        rows = grouped_by(left).join(bitmaps, "uid").join(tried, "uid", "left").withColumn(
            "part", F.pmod(F.xxhash64("uid"), F.col("parts")))
        # Blocks of a whole list or of one part are negative: all of their rows meet; in other blocks the rows of two parts do.
        with_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        low, high = F.least("part", "with"), F.greatest("part", "with")
        blocks = rows.withColumn("with", with_part).withColumn("block", F.when(low == high, -1 - low).otherwise(low * F.col("parts") + high))
        found = materialize(_partners(blocks.repartition("token", "block").sortWithinPartitions("token", "block"), percent, keep), "ngram_found")
        if found.isEmpty():
            break
        once = found.groupBy("uid", "other").agg(*[F.first(c).alias(c) for c in ("n", "n_other")], F.min("bound").alias("bound"))
        place = Window.partitionBy("uid").orderBy(F.desc("bound"), "other")
        new = materialize(once.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= keep).select(*asked.columns), "ngram_new")
        bridges = tied.select(F.col("component").alias("a"), F.col("vertex").alias("b")).unionByName(verified(new))
        tied = materialize(connected_components(bridges, "a", "b"), "ngram_tied")
        asked = materialize(asked.unionByName(new), "ngram_asked")
        left = materialize(left.join(found.select("token").distinct(), "token", "left_semi"), "ngram_open")
        keep *= 4

    placed = sets.select("uid", "set_key", "lead").join(tied.withColumnRenamed("vertex", "uid"), "uid", "left").select(
        "set_key", "lead", F.coalesce("component", "uid").alias("component"))
    named = placed.groupBy("component").agg(F.min("lead").alias("best"))
    facts = attach(placed.select("set_key", "component"), named, "component", F.col("set_key")).select("set_key", "best")
    joined = attach(members, facts, "set_key", F.struct("id", "text_hash"))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    return joined.select(F.col("id").alias(id_column), "text_hash", F.col("n").cast("bigint").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
                         ((F.col("n") == 0) | (F.col("best") == own)).alias("kept"))


def one_of_each_class(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, all of those without words."""
    stays = jaccard_classes(docs, id_column, text, **options).filter("kept").select(
        F.col(id_column).alias("_stays_id"), F.col("text_hash").alias("_stays_hash")).distinct()
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(stays, F.col(id_column).eqNullSafe(F.col("_stays_id")) & (body == F.col("_stays_hash")), "left_semi")
