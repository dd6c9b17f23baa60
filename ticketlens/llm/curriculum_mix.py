"""Mixing sources to target weights along a curriculum of time-varying weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Shape of each weight class over training time: weights at equally spaced times, linear in between.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKET_DIGITS = 3


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, class, target) of a table (source, source_size) with one row per source.

    The sources in code point order, null last, take the weights in turn. All
    words are shared by weight; a source stops at ``most`` times its size and
    the excess is shared again. This is the water level L with
    sum(min(most * size, weight * L)) = all words: in ascending order of
    most * size / weight, a source is full while the level over the sources
    before it exceeds its own ratio. The table of sources is ordered in one
    task; it has one row per source, however many documents there are.
    """
    ranked = sizes.select("source", "source_size", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))).alias("rank"))
    kinds = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    weighed = ranked.select("source", "source_size", kinds.alias("class"), F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), kinds.cast("int") + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("ceiling")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy("ratio", F.asc_nulls_last("source"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    left = total - F.coalesce(F.sum("ceiling").over(earlier), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    levelled = weighed.withColumn("level", left / share)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole).getField("level")
    return levelled.withColumn("final", level).select(
        "source", "source_size", "class", F.least("ceiling", F.col("weight") * F.coalesce("final", F.lit(float("inf")))).alias("target"))


def _inverse(share: Column, kind: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """Time at which the integral of the class's weight schedule has reached ``share`` of its total."""
    times = F.lit(None).cast("double")
    for index, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        area = [step * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        done, demand, time = 0.0, share * F.lit(sum(area)), F.lit(1.0)
        pieces = []
        for place, (a, b) in enumerate(zip(knots, knots[1:])):
            inside = F.greatest(demand - F.lit(done), F.lit(0.0))
            slope = (b - a) / step
            # a * x + slope * x^2 / 2 = inside, in the form that also holds for a level piece
            root = F.lit(2.0) * inside / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * inside, F.lit(0.0))))
            pieces.append((done + area[place], F.lit(place * step) + F.coalesce(root, F.lit(0.0))))
            done += area[place]
        for upper, at in reversed(pieces):
            time = F.when(demand <= F.lit(upper), at).otherwise(time)
        times = F.when(kind == index, time).otherwise(times)
    return F.least(times, F.lit(1.0))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False,
        weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS,
        schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies and the training positions of its copies.

    A source is read in an order given by the MD5 of the id: as many whole
    passes as fit in its target, and one more over the documents up to the
    place where the rest of the target ends (a document is in if its middle
    lies before that place), so a source misses its target by at most half a
    document. Copy j of a document covers words j * source_size + (words
    before it) of its source; the inverse of the source's integrated weight
    schedule turns that share into a position between 0 and 1.

    Running sums are taken inside buckets of the order, with the sums of the
    buckets before added, so that a source of any size is spread out.

    Null texts have size 0 and are never taken; a null source is a source of
    its own; null ids come first in the order; rows repeated with one id are
    separate documents, shorter first. ``carry`` returns each input row as
    the struct ``row``.
    """
    rest = ["row"] if carry else []
    rows = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), words(text).alias("size"),
                       F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("key"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    plan = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    placed = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(
        starts["source"], "bucket", "start", "source_size", "class", "target")

    inside = Window.partitionBy("source", "bucket").orderBy("key", F.asc_nulls_first("id"), "size")
    summed = rows.withColumn("before", F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = summed.join(placed, summed["source"].eqNullSafe(placed["source"]) & (summed["bucket"] == placed["bucket"])).select(
        "id", "size", "source_size", "target", "class", *rest, (F.col("start") + F.col("before")).alias("before"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("passes") * F.col("source_size")
    counted = met.withColumn("passes", passes).withColumn("copies", F.when(F.col("size") > 0, F.least(
        F.col("passes") + more.cast("bigint"), F.lit(most))).otherwise(F.lit(0)).cast("int"))
    middle = F.col("before") + F.col("size") / 2
    positions = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(
        F.array().cast("array<int>")), lambda j: _inverse(
            F.least((j * F.col("source_size") + middle) / F.col("target"), F.lit(1.0)), F.col("class"), schedules))
    return counted.select(F.col("id").alias(id_column), "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).alias("taken"), "copies", positions.alias("positions"), *rest)


def by_first_position(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of :func:`mix`, range-sorted by the training position of their first copy and then by id; documents without one come first."""
    first = F.get("positions", F.lit(0))
    return mixed.repartitionByRange(first, F.col(id_column)).sortWithinPartitions(first, F.col(id_column))


def in_training_order(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every taken copy as a row of ``docs``, range-sorted by training position."""
    copies = mix(docs, id_column, text, source, carry=True).filter("copies > 0").select(
        F.explode("positions").alias("position"), "row")
    return copies.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
