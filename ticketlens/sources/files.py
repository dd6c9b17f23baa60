"""CSV scan, header checks and sinks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import materialize

# Column names reserved for row metadata.
RESERVED = ("_record_id", "_sheet", "_source_row")
SPLITS = ("train", "validation", "test")
#: Buckets of rows in the digest of a table.
DIGEST_BUCKETS = 4096


def check_headers(names: Sequence[str | None], blank: str = "name", required: Sequence[str] = (),
                  reserved: Sequence[str] = RESERVED) -> list[str]:
    """Trimmed header names.

    ``blank`` says what becomes of an empty header: ``name`` calls it
    ``Unnamed: i``, ``reject`` raises, ``drop`` leaves it out.
    """
    cleaned = []
    for index, name in enumerate(names):
        text = "" if name is None else str(name).lstrip("﻿").strip()
        if text == "" and blank == "reject":
            raise ValueError("headers must not be blank")
        if text == "" and blank == "drop":
            continue
        cleaned.append(text or f"Unnamed: {index}")
    if not cleaned:
        raise ValueError("the table has no headers")
    repeated = sorted(n for n, count in Counter(cleaned).items() if count > 1)
    if repeated:
        raise ValueError(f"repeated headers: {', '.join(repeated)}")
    taken = sorted(set(cleaned) & set(reserved))
    if taken:
        raise ValueError(f"reserved headers: {', '.join(taken)}")
    missing = sorted(set(required) - set(cleaned))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return cleaned


def with_checked_headers(rows: DataFrame, **checks) -> DataFrame:
    """The same rows under checked names; only the schema is looked at."""
    return rows.toDF(*check_headers(rows.columns, **checks))


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark accepts code pages such as Windows-1251 only when all JVM charsets are allowed."""
    if not encoding.lower().startswith("utf-"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_ticket_csv(spark: SparkSession, path: str, encoding: str = "cp1251", required: Sequence[str] = (),
                    multiline: bool = True) -> DataFrame:
    """All-string CSV scan that fails on ragged rows.

    ``multiline`` accepts line breaks inside quoted cells, at the price of one
    task per file; turn it off for large files without such breaks.
    """
    options = {"encoding": "UTF-8" if encoding.lower() in ("utf-8", "utf-8-sig") else encoding,
               "quote": '"', "escape": '"', "multiLine": multiline, "mode": "FAILFAST"}
    _allow_charset(spark, options["encoding"])
    first = spark.read.options(**options).csv(path).first()
    names = check_headers(list(first) if first else [], required=required, reserved=())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    scan = spark.read.schema(schema).options(**options, header=True, enforceSchema=True, columnPruning=False,
                                             nullValue="\u0000", emptyValue="").csv(path)
    return scan.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def with_file_position(scan: DataFrame, name: str = "_source_row", first: int = 2) -> DataFrame:
    """Row position in file order for a file scan, counting on from file to file.

    Rows are numbered inside each file split; a running count over the splits,
    one row per split, turns that into one sequence.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_serial"))
    splits = placed.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_size"), F.min("_serial").alias("_from"))
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    joined = placed.join(offsets, ["_path", "_block"])
    return joined.select(*scan.columns, (F.col("_before") + F.col("_serial") - F.col("_from") + first).alias(name))


def write_splits(prepared: DataFrame, path: str, fmt: str = "parquet", column: str = "split") -> None:
    """One folder per split; a reader of one split never opens the others."""
    prepared.write.mode("overwrite").partitionBy(column).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def write_csv(rows: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV sink that round-trips through :func:`read_ticket_csv`."""
    _allow_charset(rows.sparkSession, encoding)
    rows.write.mode("overwrite").options(header=True, encoding=encoding, quote='"', escape='"', quoteAll=True,
                                         emptyValue="").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(prepared: DataFrame, split: str = "split", line: str = "line", flags: str | None = None) -> DataFrame:
    """Row, split, line, split-by-line and flag counts as (section, item, detail, n)."""
    counted = prepared.groupBy(split, line).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("")
    parts = [
        counted.agg(F.sum("n").alias("n")).select(F.lit("rows").alias("section"), none.alias("item"), none.alias("detail"), "n"),
        counted.groupBy(split).agg(F.sum("n").alias("n")).select(F.lit("split"), F.col(split), none, "n"),
        counted.groupBy(line).agg(F.sum("n").alias("n")).select(F.lit("line"), F.col(line), none, "n"),
        counted.select(F.lit("coverage"), F.col(split), F.col(line), "n"),
    ]
    if flags:
        parts.append(flag_histogram(prepared, flags).select(F.lit("flag"), F.col("flag"), none, "n"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def flag_histogram(rows: DataFrame, flags: str = "quality_flags") -> DataFrame:
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def multiset_digest(rows: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(bucket, n, d0 to d3): number and sums of the row digests of each bucket; equal multisets of rows have equal ones.

    Sums do not depend on the order of rows and count copies. The two 64-bit
    digests of a row are added in halves, which cannot overflow. A null is
    marked, so that it cannot change places with its neighbour unseen.
    """
    cells = [F.col(f"`{c}`") for c in rows.columns]
    cells += [cell.isNull() for cell in cells]
    hashed = rows.select(*[F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (1, 2)])
    halves = [half for seed in (1, 2) for half in (F.col(f"_h{seed}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_h{seed}", 32))]
    return hashed.groupBy(F.pmod("_h1", F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(half).alias(f"d{i}") for i, half in enumerate(halves)])


def import_checks(source: DataFrame, stored: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Row counts and rows whose source columns differ between a table and its stored form.

    Each table is read once for its digest, a few numbers per bucket. Only rows
    of buckets that differ are compared in full; equal tables need no shuffle of
    rows at all. The driver holds at most ``buckets`` numbers.
    """
    kept = stored.select(*[F.col(f"`{c}`") for c in source.columns])
    digests = [materialize(multiset_digest(rows, buckets), "digest") for rows in (source, kept)]
    facts = ["n", "d0", "d1", "d2", "d3"]
    before, after = (d.select("bucket", F.struct(*facts).alias(name)) for d, name in zip(digests, ("before", "after")))
    differing = [r.bucket for r in before.join(after, "bucket", "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select("bucket").collect()]

    def only_in(one: DataFrame, other: DataFrame) -> Column:
        if not differing:
            return F.lit(0).cast("bigint")
        cells = [F.col(f"`{c}`") for c in one.columns]
        bucket = F.pmod(F.xxhash64(F.lit(1), *cells, *[cell.isNull() for cell in cells]), F.lit(buckets))
        return one.filter(bucket.isin(differing)).exceptAll(other.filter(bucket.isin(differing))).agg(F.count(F.lit(1)).alias("n")).scalar()

    counts = [d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) for d in digests]
    return counts[0].select(F.col("n").alias("rows_in"), counts[1].scalar().alias("rows_out"),
                            only_in(source, kept).alias("rows_lost"), only_in(kept, source).alias("rows_gained"))
