"""Document fingerprints by Order MinHash, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import materialize

#: A text is read as pieces: words, cut into parts of at most so many code points.
PIECE = 12
K = 2
#: Ranges of the hash, as a power of two; each selects the two smallest of its k-mers.
BIN_BITS = 6


def _add_pieces(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Array column of the k-mer hashes of ``text``; a text of fewer pieces than K is one k-mer, one without pieces none."""
    cut = rows.withColumn("_pieces", F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)))
    hashed = cut.withColumn("_hashes", F.transform("_pieces", lambda piece, i: F.xxhash64(piece, *[
        F.get(F.col("_pieces"), i + j) for j in range(1, K)])))
    return hashed.withColumn(name, F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (K - 1), F.least(F.size("_hashes"), F.lit(1))))).drop(
        "_pieces", "_hashes")


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of ``text``: an array of up to 2 ** BIN_BITS codes, two hex digits of bin and four of hash.

    The occurrences of a k-mer are numbered, so that repeated k-mers count as
    often as they occur. The hash of (k-mer, number) falls into one of the
    bins; of each bin the two smallest are selected, put back into text order,
    and hashed as a pair. A bin without k-mers has no code.
    """
    kmers = _add_pieces(rows, text, "_kmers")
    placed = kmers.withColumn("_placed", F.sort_array(F.transform("_kmers", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    starts = placed.withColumn("_starts", F.when(
        F.size(F.array_distinct("_kmers")) < F.size("_kmers"),
        F.filter(F.sequence(F.lit(0), F.size("_kmers") - 1), lambda i: (i == 0) | (
            F.get(F.col("_placed"), i - 1)["h"] != F.get(F.col("_placed"), i)["h"])))).drop("_kmers")
    # Without a repeated k-mer all numbers are 0; else every run of equal k-mers is numbered from its start.
    plain = F.transform("_placed", lambda e: F.struct(F.xxhash64(e["h"], F.lit(0)).alias("v"), e["at"].alias("at")))
    runs = F.flatten(F.transform("_starts", lambda start, j: F.transform(
        F.sequence(start, F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_placed")) - 1),
        lambda i: F.struct(F.xxhash64(F.get(F.col("_placed"), i)["h"], i - start).alias("v"), F.get(F.col("_placed"), i)["at"].alias("at")))))
    numbered = starts.withColumn("_numbered", F.sort_array(F.when(F.col("_starts").isNull(), plain).otherwise(runs))).drop("_placed", "_starts")

    def bin_of(element: Column) -> Column:
        return F.shiftrightunsigned(element["v"], 64 - BIN_BITS)

    least = numbered.withColumn("_least", F.filter("_numbered", lambda e, i: (i < 2) | (
        bin_of(F.get(F.col("_numbered"), i - 2)) != bin_of(e)))).drop("_numbered")

    def code(e: Column, i: Column) -> Column:
        after = F.get(F.col("_least"), i + 1)
        pair = F.when(after.isNull() | (bin_of(after) != bin_of(e)), F.xxhash64(e["v"])).when(
            e["at"] < after["at"], F.xxhash64(e["v"], after["v"])).otherwise(F.xxhash64(after["v"], e["v"]))
        return F.struct(((i == 0) | (bin_of(F.get(F.col("_least"), i - 1)) != bin_of(e))).alias("leads"),
                        F.concat(F.lpad(F.hex(bin_of(e)), 2, "0"), F.lpad(F.hex(F.shiftrightunsigned(pair, 48)), 4, "0")).alias("code"))

    codes = F.transform(F.filter(F.transform("_least", code), lambda c: c["leads"]), lambda c: c["code"])
    return least.withColumn(name, codes).drop("_least")


def likeness(a: str, b: str) -> Column:
    """Share of the bins used by either fingerprint that hold the same code in both; two empty fingerprints are alike."""
    bins = F.size(F.array_union(F.transform(a, lambda c: F.substring(c, 1, 2)), F.transform(b, lambda c: F.substring(c, 1, 2))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _key(id_column: Column, digest: Column) -> Column:
    return F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(":"), digest.cast("string"))


def _ring(documents: DataFrame) -> DataFrame:
    """key, n_chars, copies and next_key of each document in descending order of the id; the last is followed by the first.

    Ids are range-partitioned and ordered inside each range; the last of a
    range is followed by the first of the next, taken from a table with one
    row per range.
    """
    facts = documents.groupBy("key").agg(F.max("id").alias("id"), F.max("digest").alias("digest"), F.max(F.char_length("text")).alias("n_chars"),
                                         F.count(F.lit(1)).alias("copies"))
    order = [F.desc_nulls_last("id"), F.col("digest")]
    ranged = materialize(facts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ring_order")
    inside = Window.partitionBy("part").orderBy(*order)
    led = ranged.select("key", "id", "n_chars", "copies", "part", F.lead("key").over(inside).alias("following"),
                        F.row_number().over(inside).alias("place"))
    parts = led.filter("place = 1").select("part", F.col("key").alias("head"))
    around = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = parts.select("part", F.coalesce(F.lead("head").over(around), F.first("head").over(around)).alias("next_head"))
    return materialize(led.join(heads, "part").select(
        "key", "id", "n_chars", "copies", F.coalesce("following", "next_head").alias("next_key")), "ring")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the fingerprints of a text and of its edited text, and their likeness.

    In the edited text the last floor(n / 2) code points are replaced by the
    first as many (or all) of the next document in descending order of the id;
    after the last document comes the first. ``near_edited`` compares the two
    fingerprints, ``near_next`` compares the document with the next one.

    Null texts count as empty: their fingerprint is the empty string. Null ids
    come last. Rows with one id and different texts are neighbours, ordered by
    a hash of the text; rows that agree in both are one document whose result
    is repeated. A single document is its own next document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    documents = docs.select(F.col(id_column).alias("id"), body.alias("text"), F.xxhash64(body).alias("digest")).withColumn(
        "key", _key(F.col("id"), F.col("digest")))
    ring = _ring(documents)
    # Used on both sides below with the same partitioning, so that texts are shuffled once.
    texts = documents.select("key", "text").groupBy("key").agg(F.first("text").alias("text"))
    wanted = ring.select(F.col("next_key").alias("key"), F.col("key").alias("owner"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    donors = texts.join(wanted, "key").select(F.col("owner").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("graft"))
    size = F.char_length("text")
    edited = texts.join(donors, "key").select("key", "text", F.concat(
        F.substring(F.col("text"), F.lit(1), size - F.floor(size / 2).cast("int")), F.col("graft")).alias("edited"))
    printed = with_fingerprint(edited.withColumn("edited_sha256", F.sha2("edited", 256)), "text", "codes")
    both = materialize(with_fingerprint(printed.select("key", "edited_sha256", "codes", "edited"), "edited", "edited_codes").select(
        "key", "edited_sha256", "codes", "edited_codes").join(ring, "key"), "fingerprints")
    following = both.select(F.col("key").alias("next_key"), F.col("codes").alias("next_codes"))
    met = both.join(following, "next_key").select(
        F.col("id").alias(id_column), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256",
        F.array_join("codes", " ").alias("fingerprint"), F.array_join("edited_codes", " ").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"),
        F.sequence(F.lit(1).cast("bigint"), F.col("copies")).alias("_rows"))
    return met.withColumn("_row", F.explode("_rows")).drop("_rows", "_row")
