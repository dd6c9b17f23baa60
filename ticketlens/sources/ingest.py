"""Table ingest: canonical cells, positions, record ids, size budget and the dataset registry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import blank_to_null
from ticketlens.functions.values import canonical
from ticketlens.operators.scaling import attach_by_key, ranked

# Size limits of one imported sheet and of one imported book.
MAX_ROWS_PER_SHEET = 50_000
MAX_COLUMNS_PER_SHEET = 200
MAX_CELLS_PER_SHEET = 1_000_000
MAX_ROWS_PER_BOOK = 100_000
MAX_CELLS_PER_BOOK = 2_000_000
MAX_SPARSE_RATIO = 100


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def canonical_cells(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every cell in its import form; columns in ``keep`` pass through."""
    return rows.select(*[
        _name(f.name) if f.name in keep else canonical(_name(f.name), f.dataType).alias(f.name) for f in rows.schema])


def number_rows(rows: DataFrame, order: str, group: Sequence[str] = (), width: int = 1_000_000,
                name: str = "_source_row", first: int = 2) -> DataFrame:
    """Position of each row along an integer key; the header is row 1, data starts at 2."""
    bucket = F.floor(_name(order) / width)
    numbered = ranked(rows, group, bucket, [_name(order)], rank=name)
    return numbered.withColumn(name, _name(name) + (first - 1))


def record_id(dataset: Column, sheet: Column, position: Column, cells: Sequence[Column]) -> Column:
    """First twenty hex digits of a digest over identity and content.

    Each part is written as ``length:text`` (null as ``-``), so no two different
    rows share a fingerprint text.
    """
    def written(part: Column) -> Column:
        text = part.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    parts = [written(p) for p in (dataset, sheet, position, *cells)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def ingest(rows: DataFrame, dataset: str | Column, sheet: str | Column, order: str, width: int = 1_000_000) -> DataFrame:
    """Canonical rows with ``_source_row``, ``_sheet``, ``dataset_id`` and ``_record_id``."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    sheet = F.lit(sheet) if isinstance(sheet, str) else sheet
    cells = sorted(c for c in rows.columns if c != order)
    numbered = number_rows(canonical_cells(rows, keep=(order,)), order, width=width)
    numbered = numbered.withColumns({"dataset_id": dataset, "_sheet": sheet})
    return numbered.withColumn("_record_id", record_id(
        F.col("dataset_id"), F.col("_sheet"), F.col("_source_row"), [_name(c) for c in cells]))


def filled_cells(columns: Sequence[str]) -> Column:
    return reduce(add, [blank_to_null(_name(c)).isNotNull().cast("int") for c in columns], F.lit(0))


def drop_trailing_blank_rows(rows: DataFrame, position: str, columns: Sequence[str]) -> DataFrame:
    """Blank rows between data rows stay, those after the last data row go."""
    last = rows.filter(filled_cells(columns) > 0).agg(F.max(position).alias("last"))
    return rows.filter(F.col(position) <= last.scalar())


def drop_blank_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.filter(filled_cells(columns) > 0)


def shape_budget(rows: DataFrame, sheet: str, columns: Sequence[str], max_rows: int | None = None,
                 max_columns: int | None = None, max_cells: int | None = None,
                 sparse_ratio: int | None = MAX_SPARSE_RATIO, book_rows: int | None = None,
                 book_cells: int | None = None) -> DataFrame:
    """Size of each sheet and the budget it breaks, if any; a limit of None is off."""
    width = len(columns)
    sizes = rows.groupBy(sheet).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(filled_cells(columns)).cast("bigint").alias("filled"))
    sizes = sizes.withColumn("cells", F.col("rows") * width)
    book = sizes.agg(F.sum("rows").alias("rows"), F.sum("cells").alias("cells"))
    broken = F.lit(None).cast("string")
    checks = [
        (book_cells, book.select("cells").scalar(), "book-cells"), (book_rows, book.select("rows").scalar(), "book-rows"),
        (max_cells, F.col("cells"), "cells"), (max_rows, F.col("rows"), "rows"), (max_columns, F.lit(width), "columns"),
    ]
    if sparse_ratio is not None:
        broken = F.when(F.col("cells") > F.col("filled") * sparse_ratio, "sparse")
    for limit, size, reason in checks:
        if limit is not None:
            broken = F.when(size > limit, reason).otherwise(broken)
    return sizes.withColumn("reason", broken).withColumn("passed", F.col("reason").isNull())


def active_sheet(sheets: DataFrame) -> DataFrame:
    """Largest non-empty sheet per dataset, the first one on a tie."""
    best = F.max_by(F.struct("sheet", "row_count"), F.struct("row_count", -F.col("sheet_pos")))
    return (sheets.filter(F.col("row_count") > 0).groupBy("dataset_id").agg(best.alias("_best"))
            .select("dataset_id", F.col("_best.sheet").alias("active_sheet"), F.col("_best.row_count").alias("row_count")))


def plan_imports(uploads: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New datasets and activations for a set of uploads.

    ``uploads`` has ``upload_id``, ``content_hash`` and ``uploaded_at``;
    ``registry`` has ``dataset_id`` and ``content_hash``. Content that was seen
    before, in the registry or earlier in the same set, is not imported again:
    the upload re-activates the first dataset with that content.
    """
    first = uploads.groupBy("content_hash").agg(F.min_by("upload_id", F.struct("uploaded_at", "upload_id")).alias("first_upload"),
                                                F.min("uploaded_at").alias("created_at"))
    fresh = first.join(registry, "content_hash", "left_anti").select(
        F.col("first_upload").alias("dataset_id"), "content_hash", "created_at")
    known = registry.select("dataset_id", "content_hash").unionByName(fresh.select("dataset_id", "content_hash"))
    met = attach_by_key(uploads, known, "content_hash", ["upload_id"]).filter(F.col("dataset_id").isNotNull())
    activations = met.select("upload_id", "dataset_id", F.col("uploaded_at").alias("activated_at"))
    return fresh, activations


def current_dataset(registry: DataFrame, activations: DataFrame) -> DataFrame:
    """The dataset activated last; without activations the newest one."""
    active = activations.agg(F.max_by("dataset_id", F.struct("activated_at", "upload_id")).alias("d")).scalar()
    newest = registry.agg(F.max_by("dataset_id", F.struct("created_at", "dataset_id")).alias("d")).scalar()
    return registry.filter(F.col("dataset_id") == F.coalesce(active, newest))
