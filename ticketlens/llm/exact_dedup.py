"""Exact dedup by content sort: equal texts are made neighbours by a distributed sort and compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import materialize

PREFIX = 24
LANES = 64


def content_sort(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: bool = False,
                 lanes: int = LANES) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (and ``row``, if carried).

    Sampled splitters range-partition the rows by the first characters of the
    text, a hash of all of it, and a lane taken from the id; the prefix keeps
    the splitters short, the lane cuts a text that a large share of all rows
    has into ``lanes`` ranges. Inside a range the external sort of the window
    puts equal texts side by side, and every row is compared in full with the
    one before it. The lanes of a text are then joined through its digest.

    Null texts count as empty, so that null and empty texts are one group. Of
    equal texts the row with the largest id stays; null ids come last, and of
    rows repeated with the same id one stays. An empty table gives no rows.
    ``carry`` returns each whole input row as the struct ``row``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(id_column).alias("id"), body.alias("text"), F.substring(body, 1, PREFIX).alias("head"),
        F.xxhash64(body).alias("hash"), F.pmod(F.xxhash64(F.col(id_column)), F.lit(lanes)).alias("lane"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    ranged = keyed.repartitionByRange("head", "hash", "lane")
    rest = ["row"] if carry else []

    near = Window.partitionBy("head", "hash", "lane").orderBy("text", F.desc_nulls_last("id"))
    before = F.lag("text").over(near)
    compared = ranged.select("head", "hash", "lane", "id", *rest, F.sha2("text", 256).alias("digest"), "text",
                             (before.isNull() | (before != F.col("text"))).cast("int").alias("starts"))
    runs = compared.select("head", "hash", "lane", "id", *rest, "digest", F.sum("starts").over(
        near.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run"))
    group = Window.partitionBy("head", "hash", "lane", "run")
    ordered = group.orderBy(F.desc_nulls_last("id"))
    local = materialize(runs.select(
        "id", *rest, "digest", "lane", F.row_number().over(ordered).alias("place"), F.first("id").over(ordered).alias("lane_keep"),
        F.count(F.lit(1)).over(group).alias("lane_size")), "content_runs")

    heads = local.filter("place = 1").select("digest", "lane", "lane_keep", "lane_size")
    groups = heads.groupBy("digest").agg(F.max("lane_keep").alias("keep_id"), F.sum("lane_size").alias("group_size"))
    by_lane = heads.select("digest", "lane").join(groups, "digest")
    return local.join(by_lane, ["digest", "lane"]).select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"), *rest)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return content_sort(docs, id_column, text, carry=True).filter("kept").select("row.*")
