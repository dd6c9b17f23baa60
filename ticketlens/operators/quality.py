"""Table audit: profiles, duplicate groups, label conflicts, invalid values, version differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import values as v
from ticketlens.functions.text import blank_to_null, is_blank, normalize_casefold, normalize_text
from ticketlens.operators import enrich as en
from ticketlens.operators.scaling import attach_by_key
from ticketlens.session import materialize


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def column_profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, distinct, type, formula-like cells and date range of each column.

    Cells are unpivoted once; counting per (column, value) first keeps the
    distinct count spread out over the values. Counts alone are kept in hash tables; least and largest dates, which
    are texts and would have all cells sorted, come from an aggregate of their own over the date columns.
    """
    chosen = [f for f in rows.schema if columns is None or f.name in columns]

    def cell(field: T.StructField) -> Column:
        value = _name(field.name)
        text = value.cast("string")
        is_text = isinstance(field.dataType, T.StringType)
        return F.struct(
            F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"),
            (blank_to_null(value) if is_text else text).alias("present"), text.alias("value"),
            F.lit(is_text).alias("is_text"))

    def span(field: T.StructField) -> Column:
        is_date = isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        date = F.date_format(_name(field.name), "yyyy-MM-dd HH:mm:ss") if is_date else F.lit(None).cast("string")
        return F.struct(F.lit(field.name).alias("column"), F.min(date).alias("date_min"), F.max(date).alias("date_max"))

    spans = rows.agg(F.array(*[span(f) for f in chosen]).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")
    cells = rows.select(F.explode(F.array(*[cell(f) for f in chosen])).alias("_c")).select("_c.*")
    by_value = cells.groupBy("column", "type", "value", "is_text").agg(
        F.count(F.lit(1)).alias("n"), F.count("present").alias("present"))
    here = F.col("present") > 0
    counts = by_value.groupBy("column", "type").agg(
        F.sum(F.col("n") - F.col("present")).alias("missing"), F.sum(here.cast("bigint")).alias("distinct"),
        F.sum("present").alias("present"),
        F.coalesce(F.sum(F.when(F.col("is_text") & here & F.col("value").startswith("="), F.col("n"))), F.lit(0)).alias("formula_cells"))
    return counts.join(F.broadcast(spans), "column").select(*counts.columns, "date_min", "date_max")


def categories_outside(rows: DataFrame, column: str, limit: int = en.TOP_CATEGORIES) -> DataFrame:
    """Number of categories and of rows beyond the ``limit`` most frequent ones."""
    counts = rows.groupBy(blank_to_null(column).alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("category IS NOT NULL")
    top = counts.orderBy(F.desc("n"), F.asc("category")).limit(limit).agg(F.sum("n").alias("top"))
    return counts.agg(F.count(F.lit(1)).alias("categories"), F.sum("n").alias("labelled")).select(
        "categories", (F.col("labelled") - top.scalar()).alias("outside_top"))


def _digest(parts: Sequence[Column]) -> Column:
    """Digest of a row; each part is length-prefixed so that no two rows run together."""
    texts = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def _groups(rows: DataFrame, position: str, key: Column) -> DataFrame:
    """Members of every group of two or more: (group_row, group_size, position).

    A group is named by its first member. It comes out as rows, not as an
    array, so its size is not limited by one task.
    """
    # The filter stays behind the written digests, else it would be pushed below and digest everything again.
    keyed = materialize(rows.select(_name(position).alias(position), key.alias("_digest")), "digests").filter(F.col("_digest").isNotNull())
    sizes = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(position).alias("group_row")).filter("group_size > 1")
    return attach_by_key(keyed, sizes, "_digest", [position]).filter("group_size IS NOT NULL").select(
        "group_row", "group_size", position)


def exact_duplicates(rows: DataFrame, position: str, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = columns or [c for c in rows.columns if c != position]
    return _groups(rows, position, _digest([_name(c) for c in chosen]))


def text_duplicates(rows: DataFrame, position: str, columns: Sequence[str]) -> DataFrame:
    """Groups of equal normalised text; rows without any text take no part."""
    names = [f"_text_{i}" for i in range(len(columns))]
    normal = rows.select(_name(position).alias(position), *[
        F.coalesce(normalize_casefold(_name(c).cast("string")), F.lit("")).alias(n) for c, n in zip(columns, names)])
    # Texts are normalised once, in their own step, and only digests go on.
    anything = reduce(lambda a, b: a | b, [F.col(n) != "" for n in names])
    return _groups(normal, position, F.when(anything, _digest([F.col(n) for n in names])))


def conflicting_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one distinct label, with their size."""
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.min(label).alias("_low"), F.max(label).alias("_high")
    ).filter(F.col("_low") != F.col("_high")).select(group, "rows")


def class_coverage(prepared: DataFrame, category: str = "category", group: str = "duplicate_group", split: str = "split",
                   splits: Sequence[str] = ("train", "validation", "test", "review")) -> DataFrame:
    """Rows, independent groups and rows per split of each category, most frequent first."""
    by_group = prepared.groupBy(category, group, split).agg(F.count(F.lit(1)).alias("n"))
    merged = by_group.groupBy(category, group).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(split) == s, F.col("n")).otherwise(0)).alias(s) for s in splits])
    return merged.groupBy(category).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("independent_groups"), *[F.sum(s).alias(s) for s in splits]
    ).orderBy(F.desc("total"), F.asc(category))


_AUDIT_DATES = {en.REGISTERED: v.AUDIT_LONG, en.PLANNED: v.AUDIT_SHORT, en.DEADLINE: v.AUDIT_SHORT,
                en.FINISHED: v.AUDIT_SHORT, en.STATUS_ENTERED: v.AUDIT_SHORT, en.MODIFIED: v.AUDIT_SHORT}
AUDIT_REQUIRED = (en.TICKET, en.DESCRIPTION, en.CATEGORY, en.SOLVED_BY, en.REGISTERED, en.FINISHED, en.OVERDUE,
                  en.NORM_SLA, en.FACT_SLA)


def audited(raw: DataFrame, position: str, *more: Column) -> DataFrame:
    """Strictly parsed dates and durations next to the position and flag of each row, and to the columns ``more``."""
    missing = sorted(set(AUDIT_REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    dates = {c: layout for c, layout in _AUDIT_DATES.items() if c in raw.columns}
    invalid = [F.when(~is_blank(_name(c)) & v.audit_datetime(_name(c), layout).isNull(), c)
               for c, layout in dates.items()]
    invalid += [F.when(v.strict_duration_invalid(_name(c)), c) for c in (en.NORM_SLA, en.FACT_SLA)]
    return raw.select(
        F.col(position), v.audit_datetime(_name(en.REGISTERED), v.AUDIT_LONG).alias("start"),
        v.audit_datetime(_name(en.FINISHED), v.AUDIT_SHORT).alias("finish"),
        v.strict_duration_seconds(_name(en.NORM_SLA)).alias("norm_s"), v.strict_duration_seconds(_name(en.FACT_SLA)).alias("actual_s"),
        _name(en.OVERDUE).alias("flag"), F.array_compact(F.array(*invalid)).alias("invalid"), *more)


def invalid_values(raw: DataFrame, position: str) -> DataFrame:
    return audited(raw, position).select(position, F.explode("invalid").alias("field"))


def negative_intervals(raw: DataFrame, position: str) -> DataFrame:
    return audited(raw, position).filter("finish < start").select(
        position, F.expr("timestampdiff(SECOND, start, finish)").alias("seconds"))


def sla_disagreements(raw: DataFrame, position: str) -> DataFrame:
    """Rows whose flag contradicts actual against normative duration."""
    late = F.col("flag") == v.OVERDUE_LABEL
    return audited(raw, position).filter(
        F.col("norm_s").isNotNull() & F.col("actual_s").isNotNull() & F.col("flag").isin(v.OVERDUE_LABEL, v.NOT_OVERDUE_LABEL)
        & ((F.col("actual_s") > F.col("norm_s")) != late)).select(position)


def table_audit(raw: DataFrame, position: str) -> DataFrame:
    """All audit numbers as (section, item, amount): counts, histograms, gaps, ranges and contradictions.

    One pass counts everything per solving line, flag and category; the
    sections are totals of these few rows. Only distinct ids need another pass.
    """
    columns = [c for c in raw.columns if c != position]
    dates = [*[c for c in _AUDIT_DATES if c in raw.columns], en.NORM_SLA, en.FACT_SLA]
    late = F.col("flag") == v.OVERDUE_LABEL
    checked = (F.col("norm_s").isNotNull() & F.col("actual_s").isNotNull()
               & F.col("flag").isin(v.OVERDUE_LABEL, v.NOT_OVERDUE_LABEL))
    counted = {"rows": F.lit(True), "negative_intervals": F.col("finish") < F.col("start"),
               "sla_disagreements": checked & ((F.col("actual_s") > F.col("norm_s")) != late)}
    counted |= {f"invalid {c}": F.array_contains("invalid", c) for c in dates}
    counted |= {f"missing {i}": F.col(f"_blank{i}") for i in range(len(columns))}
    read = audited(raw, position, _name(en.SOLVED_BY).alias("line"), _name(en.CATEGORY).alias("category"),
                   *[is_blank(_name(c)).alias(f"_blank{i}") for i, c in enumerate(columns)])
    cells = materialize(read.groupBy("line", "flag", "category").agg(
        *[F.count_if(test).alias(str(i)) for i, test in enumerate(counted.values())]), "audited").withColumnsRenamed(
            {str(i): name for i, name in enumerate(counted)})

    def section(name: str, item: Column, amount: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), item.alias("item"), amount.alias("amount"))

    def one(name: str, rows: DataFrame) -> DataFrame:
        return section(name, F.lit(""), F.col("amount"), rows)

    def total(name: str) -> DataFrame:
        return one(name, cells.agg(F.coalesce(F.sum(name), F.lit(0)).alias("amount")))

    def number(rows: DataFrame) -> DataFrame:
        return rows.distinct().agg(F.count(F.lit(1)).alias("amount"))

    def tally(name: str, column: str) -> DataFrame:
        return section(name, F.col(column), F.col("amount"), cells.groupBy(column).agg(F.sum("rows").alias("amount")))

    def listed(name: str, items: dict[str, str]) -> DataFrame:
        """Totals of many counts, one row each."""
        sums = cells.agg(*[F.sum(_name(c)).alias(str(i)) for i, c in enumerate(items.values())])
        rows = sums.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(str(i)).alias("amount")) for i, c in enumerate(items)])).alias("_m")).select("_m.*")
        return section(name, F.col("item"), F.col("amount"), rows)

    parts = [
        total("rows"), one("unique_ids", number(raw.select(_name(en.TICKET)))), one("categories", number(cells.select("category"))),
        tally("solving_line", "line"), tally("sla_flag", "flag"),
        listed("missing", {c: f"missing {i}" for i, c in enumerate(columns)}),
        listed("invalid", {c: f"invalid {c}" for c in dates}).filter("amount > 0"),
        total("negative_intervals"), total("sla_disagreements"),
    ]
    return reduce(DataFrame.unionByName, parts)


def date_ranges(raw: DataFrame) -> DataFrame:
    """First and last valid date of each audited date column."""
    dates = {c: layout for c, layout in _AUDIT_DATES.items() if c in raw.columns}
    cells = F.array(*[F.struct(F.lit(c).alias("field"), v.audit_datetime(_name(c), layout).alias("at")) for c, layout in dates.items()])
    return raw.select(F.explode(cells).alias("_d")).select("_d.*").groupBy("field").agg(
        F.min("at").alias("first"), F.max("at").alias("last"))


def batch_quality_check(rows: DataFrame) -> DataFrame:
    """The final checks of the batch table as (metric, amount).

    Rows are counted per whole-row digest and ids per id first, so neither
    distinct count gathers the table in one task.
    """
    gaps = [_name(c).isNull().cast("bigint") for c in rows.columns]
    closed = F.lower("status") == "закрыт"
    whole = rows.select(_digest([_name(c) for c in rows.columns]).alias("_row"), "*").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(reduce(lambda a, b: a + b, gaps)).alias("total_missing_cells"),
        reduce(lambda a, b: a + b, [F.max((g > 0).cast("bigint")) for g in gaps]).alias("columns_with_missing"),
        F.sum("has_datetime_anomaly").alias("datetime_anomalies"),
        F.sum((closed & (F.col("fact_sla_h") == 0)).cast("bigint")).alias("closed_zero_fact_sla"),
        F.sum(F.col("fact_sla_h").isNull().cast("bigint")).alias("missing_fact_sla"),
        F.sum("is_multiline").alias("multiline_tickets"), F.sum("lines_count_changed").alias("changed_lines_count"))
    ids = rows.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count("ticket_id").alias("unique_ticket_ids"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_ticket_ids"))
    copies = rows.groupBy(_digest([_name(c) for c in rows.columns]).alias("_row")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") - 1).alias("duplicate_rows"))
    wide = [whole, ids, copies]
    parts = [part.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("amount")) for c in part.columns])).alias("_m")).select("_m.*")
        for part in wide]
    return reduce(DataFrame.unionByName, parts)


def missing_cells(rows: DataFrame) -> DataFrame:
    """Null cells per column, columns without any left out."""
    counts = rows.agg(*[F.sum(_name(c).isNull().cast("bigint")).alias(c) for c in rows.columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), _name(c).alias("missing")) for c in rows.columns])).alias("_m")).select("_m.*").filter(
        "missing > 0").orderBy(F.desc("missing"), F.asc("field"))


def version_difference(new: DataFrame, old: DataFrame, key: str, fields: Sequence[str], text: str) -> DataFrame:
    """Rows, shared ids and differing fields between two versions; an id missing before counts as different."""
    before = old.select(F.col(key).alias("_old_key"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    joined = new.join(before, F.col(key) == F.col("_old_key"), "left")
    absent = F.col("_old_key").isNull()
    measures = [F.sum((absent | ~F.col(f).eqNullSafe(F.col(f"_old_{f}"))).cast("bigint")).alias(f"different_{f}") for f in fields]
    normal = absent | ~normalize_text(F.col(text)).eqNullSafe(normalize_text(F.col(f"_old_{text}")))
    old_rows = old.agg(F.count(F.lit(1)).alias("n")).scalar()
    return joined.agg(
        F.count(F.lit(1)).alias("new_rows"), F.count("_old_key").alias("shared_ids"), *measures,
        F.sum(normal.cast("bigint")).alias("normalized_text_differences")).withColumn("old_rows", old_rows)


def shared_ids(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.select(key).intersect(old.select(key))


def attach_prepared(rows: DataFrame, prepared: DataFrame, key: str) -> DataFrame:
    """Join split and group to the source rows by id, with the problems of each id made visible.

    ``matches`` is 1 for a sound row; 0 (no prepared row) and more than 1
    (repeated id) are for the caller to reject.
    """
    facts = prepared.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.min("split").alias("split"),
                                      F.min("duplicate_group").alias("duplicate_group"))
    return rows.join(facts, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
