"""Exact building blocks that stay spread out when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import materialize

LANES = 64
_SLOTS = 1 << 18


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, spread_by: Sequence[str] | None = None, lanes: int = LANES) -> DataFrame:
    """Left join ``rows`` to ``facts`` (one row per ``key``) without a hot partition.

    Every row belongs to one of ``lanes`` lanes by a hash of ``spread_by``. A
    fact goes once to each lane in which its key has rows, at most ``lanes``
    times, and rows meet it on key and lane. All keys are treated alike.
    """
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(*(spread_by or rows.columns)), F.lit(lanes)))
    sent = laned.filter(F.col(key).isNotNull()).select(key, "_lane").distinct().join(facts, key)
    return laned.join(sent, [key, "_lane"], "left").select(*rows.columns, *[c for c in facts.columns if c != key])


def perhaps_in(rows: DataFrame, digest: Column, wanted: DataFrame, wanted_digest: Column) -> DataFrame:
    """``rows`` without most of those whose digest no row of ``wanted`` has; none that has a partner is left out.

    A one-hash Bloom filter of 2 ** 18 slots of 64 bits. It is broadcast: its
    size of at most 2 ** 18 rows of two numbers does not grow with the data.
    A filter that fills up lets more rows pass and changes nothing else.
    """
    def slot(value: Column) -> Column:
        return F.pmod(F.shiftright(value, 6), F.lit(_SLOTS))

    bits = wanted.select(slot(wanted_digest).alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(wanted_digest, F.lit(64)).cast("int")).alias("_bit")
                         ).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_slot", slot(digest)).join(F.broadcast(bits), "_slot").filter(
        F.getbit("_bits", F.pmod(digest, F.lit(64)).cast("int")) == 1).drop("_slot", "_bits")


def ranked(rows: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column],
           rank: str = "rank", total: str | None = None) -> DataFrame:
    """Exact 1-based rank of every row inside its group, for groups of any size.

    ``bucket`` must not decrease along ``order``. Rows are sorted inside
    (group, bucket) only; a running count over the bucket sizes supplies the rest.
    """
    keyed = rows.withColumn("_bucket", bucket)
    group = list(group)
    sizes = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    condition = F.col("_bucket").eqNullSafe(F.col("_at"))
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    numbered = keyed.withColumn("_inside", F.row_number().over(inside)).join(offsets, condition)
    extra = [F.col("_total").alias(total)] if total else []
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(rank), *extra)


def hash_bucket(digest: Column | str, digits: int = 3) -> Column:
    """Leading hex digits of a digest: evenly filled buckets that follow its order."""
    return F.substring(digest, 1, digits)


def magnitude_bucket(value: Column, unit: float = 3600.0, steps: int = 256) -> Column:
    """Bucket that never decreases with ``value``; about 0.4 % wide at any magnitude."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) * unit) * steps)).cast("bigint")


def sums_with_median(rows: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column],
                     median: str) -> DataFrame:
    """Per-key sums and the exact interpolated median of ``value``.

    First pass: all sums per (key, magnitude bucket) in one aggregation with
    map-side combine; a running count finds the bucket of the middle ranks.
    Second pass: only the values of those buckets, counted per distinct value.
    No task ever holds the values of a whole group.
    """
    keys = list(keys)
    keyed = rows.withColumn("_bucket", magnitude_bucket(F.col(value)))
    parts = keyed.groupBy(*keys, "_bucket").agg(
        F.count(value).alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        parts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_low", F.expr("(_all + 1) div 2")).withColumn("_high", F.expr("(_all + 2) div 2"))
        .withColumn("_prior", F.col("_upto") - F.col("_n"))
    )

    def at(name: str, wanted: Column) -> Column:
        here = (F.col(f"_{name}") > F.col("_prior")) & (F.col(f"_{name}") <= F.col("_upto"))
        return F.max(F.when(here, wanted))

    summary = materialize(placed.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums],
        at("low", F.col("_bucket")).alias("_low_bucket"), at("high", F.col("_bucket")).alias("_high_bucket"),
        at("low", F.col("_low") - F.col("_prior")).alias("_low_rank"),
        at("high", F.col("_high") - F.col("_prior")).alias("_high_rank"),
    ), "sums")

    # One row per bucket that is wanted, so that the join is on the bucket too: no other row travels, and a large group is spread out.
    wanted = summary.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_low_bucket", "_high_bucket", "_low_rank", "_high_rank",
                            F.explode(F.array_distinct(F.array("_low_bucket", "_high_bucket"))).alias("_wanted"))
    match = F.col("_bucket") == F.col("_wanted")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    near = (
        keyed.select(*keys, "_bucket", value).filter(F.col(value).isNotNull()).join(wanted, match)
        .groupBy(*keys, "_bucket", "_low_bucket", "_high_bucket", "_low_rank", "_high_rank", value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.sum("_n").over(inside))

    def pick(name: str) -> Column:
        rank = F.col(f"_{name}_rank")
        here = (F.col("_bucket") == F.col(f"_{name}_bucket")) & (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    middles = near.groupBy(*[F.col(k).alias(f"_m_{k}") for k in keys]).agg(((pick("low") + pick("high")) / 2).alias(median))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return summary.join(middles, same, "left").select(*keys, *sums, median)
