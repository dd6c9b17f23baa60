"""SLA analytics: KPIs, distributions, breakdowns, historical risk and the whole overview."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import values as v
from ticketlens.operators.filters import Bound, filter_tickets
from ticketlens.operators.scaling import sums_with_median
from ticketlens.session import materialize

DIMENSIONS = {
    "services": "service", "categories": "category_original", "category_groups": "category_grouped",
    "priorities": "priority", "lines": "resolved_line",
}
RISK_DIMENSIONS = ("categories", "lines")
MEASURES = ("fact_sla_h", "is_overdue", "is_multiline", "is_high_clarifications", "total_work_h", "total_react_h")
ANALYTIC_COLUMNS = frozenset((*DIMENSIONS.values(), "reg_dt", *MEASURES))
OVERALL = "overall"
RISK_MIN_GROUP = 20


def missing_columns(columns: Sequence[str]) -> list[str]:
    return sorted(ANALYTIC_COLUMNS - set(columns))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Value, count and share, most frequent first."""
    counts = rows.groupBy(v.label(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.withColumn("share", F.col("count") / total.scalar()).orderBy(F.desc("count"), F.asc("value"))


def _guarded(rows: DataFrame, column: str) -> Column:
    """The column under its value guard; a column the table lacks is all null."""
    if column not in rows.columns:
        return F.lit(None).cast("int" if column.startswith("is_") else "double").alias(column)
    guard = v.binary_flag if column.startswith("is_") else v.finite_number
    return guard(column, rows.schema[column].dataType).alias(column)


def by_dimension(rows: DataFrame, dimensions: dict[str, str], missing: str | None = v.MISSING_LABEL,
                 overall: bool = False) -> DataFrame:
    """One row per (ticket, dimension) with guarded measures: a single scan feeds every breakdown."""
    entries = [
        F.struct(F.lit(name).alias("dimension"), v.label(column, missing).alias("value"))
        for name, column in dimensions.items() if column in rows.columns
    ]
    if overall:
        entries.append(F.struct(F.lit(OVERALL).alias("dimension"), F.lit("").alias("value")))
    slim = rows.select(*[_guarded(rows, m) for m in MEASURES], F.explode(F.array(*entries)).alias("_entry"))
    return slim.select("_entry.dimension", "_entry.value", *MEASURES)


def dimension_metrics(rows: DataFrame, dimensions: dict[str, str] | None = None, overall: bool = False) -> DataFrame:
    """The thirteen measures per value of every dimension; counts of flags are null without observations."""
    long = by_dimension(rows, DIMENSIONS if dimensions is None else dimensions, overall=overall)

    def seen(column: str) -> Column:
        return F.col(column).isNotNull().cast("int")

    sums = sums_with_median(long, ("dimension", "value"), "fact_sla_h", {
        "total_appeals": F.lit(1), "sla_sample_size": seen("fact_sla_h"), "overdue_sample_size": seen("is_overdue"),
        "overdue_count": F.col("is_overdue"), "_sla": F.col("fact_sla_h"),
        "multiline_sample_size": seen("is_multiline"), "multiline_count": F.col("is_multiline"),
        "clarification_sample_size": seen("is_high_clarifications"),
        "high_clarifications_count": F.col("is_high_clarifications"),
        "_work": F.col("total_work_h"), "_work_n": seen("total_work_h"),
        "_react": F.col("total_react_h"), "_react_n": seen("total_react_h"),
    }, "median_sla_h")

    def mean(total: str, count: str) -> Column:
        return F.try_divide(F.col(total), F.nullif(F.col(count), F.lit(0)))

    return sums.select(
        "dimension", "value", F.col("total_appeals").alias("count"), "total_appeals", "sla_sample_size",
        "overdue_sample_size", "overdue_count", mean("overdue_count", "overdue_sample_size").alias("overdue_share"),
        mean("_sla", "sla_sample_size").alias("mean_sla_h"), "median_sla_h", "multiline_count",
        mean("multiline_count", "multiline_sample_size").alias("multiline_share"), "high_clarifications_count",
        mean("_work", "_work_n").alias("mean_total_work_h"), mean("_react", "_react_n").alias("mean_total_react_h"),
        "multiline_sample_size", "clarification_sample_size",
    )


METRIC_COLUMNS = (
    "value", "count", "total_appeals", "sla_sample_size", "overdue_sample_size", "overdue_count", "overdue_share",
    "mean_sla_h", "median_sla_h", "multiline_count", "multiline_share", "high_clarifications_count",
    "mean_total_work_h", "mean_total_react_h",
)
KPI_COLUMNS = ("total_appeals", "overdue_count", "overdue_share", "mean_sla_h", "median_sla_h", "multiline_count",
               "high_clarifications_count")


def group_metrics(rows: DataFrame, column: str) -> DataFrame:
    return (dimension_metrics(rows, {column: column}).select(*METRIC_COLUMNS)
            .orderBy(F.desc("total_appeals"), F.asc("value")))


def kpis(rows: DataFrame) -> DataFrame:
    return dimension_metrics(rows, {}, overall=True).select(*KPI_COLUMNS)


def historical_risk(metrics: DataFrame, minimum: int = RISK_MIN_GROUP, dimensions: Sequence[str] = RISK_DIMENSIONS) -> DataFrame:
    """Overdue share of each group against the overall share; ``metrics`` must include the overall row."""
    overall = metrics.filter(F.col("dimension") == OVERALL).select("overdue_share").scalar()
    rows = metrics.filter(F.col("dimension").isin(*dimensions)).select(
        "dimension", "value", "total_appeals", "overdue_sample_size", "overdue_count", "overdue_share",
        overall.alias("overall_overdue_share"))
    share, base = F.col("overdue_share"), F.col("overall_overdue_share")
    rows = rows.withColumns({
        "overdue_share_delta": share - base,
        "overdue_risk_ratio": F.try_divide(share, F.nullif(base, F.lit(0.0))),
        "minimum_group_size": F.lit(minimum),
        "is_reliable": F.col("overdue_sample_size") >= minimum,
    })
    elevated = F.col("is_reliable") & F.coalesce(F.col("overdue_share_delta") > 0, F.lit(False))
    rows = rows.withColumns({
        "is_elevated_historical_risk": elevated,
        "status": F.when(~F.col("is_reliable"), "insufficient-sample").when(elevated, "elevated").otherwise("not-elevated"),
    })
    place = F.when(F.col("status") == "elevated", 0).when(F.col("status") == "not-elevated", 1).otherwise(2)
    return rows.orderBy("dimension", place, F.desc(F.coalesce("overdue_share_delta", F.lit(0.0))),
                        F.desc("total_appeals"), F.asc("value"))


@dataclass(frozen=True)
class Overview:
    """Tidy parts of one analytics answer; every part derives from one small metrics table."""

    status: DataFrame
    kpis: DataFrame
    distributions: DataFrame
    breakdowns: DataFrame
    risk: DataFrame
    sample_sizes: DataFrame
    missing: list[str]
    applied_filters: dict[str, str | None]


def _status(total: Column, missing: Sequence[str]) -> Column:
    return F.when(total == 0, "no-data").otherwise("partial-data" if missing else "ready").alias("status")


def overview_status(chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Status of an overview of filtered rows, from their number; ``columns`` are those of the whole table."""
    return chosen.agg(F.count(F.lit(1)).alias("total")).select(_status(F.col("total"), missing_columns(columns)))


def overview(rows: DataFrame, date_from: Bound = None, date_to: Bound = None, service: str | None = None,
             category: str | None = None, priority: str | None = None, line: str | None = None,
             risk_min_group: int = RISK_MIN_GROUP, clean_labels: bool = False) -> Overview:
    """Filtered analytics; two scans of the filtered columns serve every section."""
    missing = missing_columns(rows.columns)
    chosen = filter_tickets(rows, date_from, date_to, service, category, priority, line, clean_labels) \
        if "reg_dt" in rows.columns or not (date_from or date_to) else rows.filter(F.lit(False))
    metrics = materialize(dimension_metrics(chosen, overall=True), "metrics")
    whole = metrics.filter(F.col("dimension") == OVERALL)
    total = F.coalesce(whole.select("total_appeals").scalar(), F.lit(0))
    source = rows.agg(F.count(F.lit(1)).alias("source_records"))
    status = source.select(_status(total, missing))
    sample_sizes = source.select(
        "source_records", total.alias("filtered_records"),
        *[F.coalesce(whole.select(c).scalar(), F.lit(0)).alias(name) for name, c in (
            ("sla_records", "sla_sample_size"), ("overdue_records", "overdue_sample_size"),
            ("multiline_records", "multiline_sample_size"), ("clarification_records", "clarification_sample_size"))])
    shares = metrics.filter(F.col("dimension").isin("category_groups", "lines")).select(
        "dimension", "value", "count", (F.col("count") / total).alias("share")
    ).orderBy("dimension", F.desc("count"), F.asc("value"))
    breakdowns = metrics.filter(F.col("dimension") != OVERALL).select("dimension", *METRIC_COLUMNS).orderBy(
        "dimension", F.desc("total_appeals"), F.asc("value"))
    risk = historical_risk(metrics, risk_min_group)
    if "is_overdue" in missing:
        risk = risk.filter(F.lit(False))
    plain = {"date_from": date_from, "date_to": date_to}
    chosen_labels = {"service": service, "category": category, "priority": priority, "line": line}
    applied = {k: None if x is None else str(x) for k, x in plain.items()}
    applied |= {k: (str(x).strip() or None) if x is not None and str(x).strip() != v.ALL_FILTER else None
                for k, x in chosen_labels.items()}
    return Overview(status, whole.select(*KPI_COLUMNS), shares, breakdowns, risk, sample_sizes, missing, applied)


def overview_long(answer: Overview) -> DataFrame:
    """All numbers of an overview as (section, item, metric, amount) rows."""
    def melt(part: DataFrame, section: Column, item: Column, names: Sequence[str]) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("amount")) for n in names]))
        return part.select(section.alias("section"), item.alias("item"), cells.alias("_cell")).select(
            "section", "item", "_cell.metric", "_cell.amount")

    measures = [c for c in METRIC_COLUMNS if c != "value"]
    parts = [
        melt(answer.kpis, F.lit("kpis"), F.lit(""), KPI_COLUMNS),
        melt(answer.sample_sizes, F.lit("sample_sizes"), F.lit(""), answer.sample_sizes.columns),
        melt(answer.distributions, F.concat(F.lit("distribution/"), "dimension"), F.col("value"), ("count", "share")),
        melt(answer.breakdowns, F.concat(F.lit("breakdown/"), "dimension"), F.col("value"), measures),
        melt(answer.risk, F.concat(F.lit("risk/"), "dimension"), F.col("value"),
             ("overdue_share_delta", "overdue_risk_ratio", "is_elevated_historical_risk")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def facet_values(rows: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """Distinct filter choices per dimension without the missing label, sorted."""
    chosen = dict(DIMENSIONS if dimensions is None else dimensions)
    if "category_original" in rows.columns:
        chosen.pop("category_groups", None)
    entries = [F.struct(F.lit(n).alias("dimension"), v.label(c, None).alias("value"))
               for n, c in chosen.items() if c in rows.columns]
    return (rows.select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")
            .filter(F.col("value").isNotNull() & (F.col("value") != v.MISSING_LABEL))
            .distinct().orderBy("dimension", "value"))


# Rows shown per section of the report.
SHOWN = {"distribution": 10, "breakdown": 8, "risk": 6}


def shown_distribution(dist: DataFrame) -> DataFrame:
    return dist.orderBy(F.desc("count"), F.asc("value")).limit(SHOWN["distribution"])


def shown_breakdown(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("total_appeals"), F.asc("value")).limit(SHOWN["breakdown"])


def shown_risk(risk: DataFrame) -> DataFrame:
    return (risk.filter("is_elevated_historical_risk")
            .orderBy(F.desc("overdue_share_delta"), F.desc("total_appeals"), F.asc("value")).limit(SHOWN["risk"]))


def _rounded(column: Column, digits: int = 2) -> Column:
    """Half-even rounding of the scaled value."""
    scale = F.lit(float(10 ** digits))
    return F.rint(column * scale) / scale


def _batch_sums(long: DataFrame) -> DataFrame:
    return sums_with_median(long, ("dimension", "value"), "fact_sla_h", {
        "_rows": F.lit(1),
        "tickets_count": F.col("ticket_id").isNotNull().cast("int"),
        "overdue_count": F.col("is_overdue"), "_overdue_n": F.col("is_overdue").isNotNull().cast("int"),
        "_sla": F.col("fact_sla_h"), "_sla_n": F.col("fact_sla_h").isNotNull().cast("int"),
        "_multi": F.col("is_multiline"), "_multi_n": F.col("is_multiline").isNotNull().cast("int"),
        "_clar": F.col("clarifications_cnt"), "_clar_n": F.col("clarifications_cnt").isNotNull().cast("int"),
    }, "median_sla_h")


BATCH_INPUT = ("ticket_id", "fact_sla_h", "is_overdue", "is_multiline", "clarifications_cnt")


def summary_kpis_batch(rows: DataFrame) -> DataFrame:
    """Batch summary with two decimals; no row for an empty input."""
    long = rows.select(F.lit(OVERALL).alias("dimension"), F.lit("").alias("value"), *BATCH_INPUT)
    sums = _batch_sums(long)
    share = F.coalesce(F.col("overdue_count"), F.lit(0)) / F.col("_rows") * 100
    return sums.select(
        F.col("_rows").alias("total"), F.coalesce("overdue_count", F.lit(0)).alias("overdue"),
        _rounded(share).alias("overdue_pct"),
        _rounded(F.try_divide("_sla", F.nullif("_sla_n", F.lit(0)))).alias("mean_sla_h"),
        _rounded(F.col("median_sla_h")).alias("median_sla_h"),
        _rounded(F.try_divide("_multi", F.nullif("_multi_n", F.lit(0))) * 100).alias("multiline_pct"),
        _rounded(F.try_divide("_clar", F.nullif("_clar_n", F.lit(0)))).alias("mean_clarifications"),
    )


def dimension_risk_batch(rows: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """Batch metrics and composite risk score of every dimension; the null group stays a group."""
    chosen = DIMENSIONS if dimensions is None else dimensions
    entries = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in chosen.items()])
    long = rows.select(*BATCH_INPUT, F.explode(entries).alias("_entry")).select("_entry.*", *BATCH_INPUT)
    sums = _batch_sums(long)

    def mean(total: str, count: str) -> Column:
        return F.try_divide(F.col(total), F.nullif(F.col(count), F.lit(0)))

    raw = sums.select(
        "dimension", "value", "tickets_count", F.coalesce("overdue_count", F.lit(0)).alias("overdue_count"),
        (mean("overdue_count", "_overdue_n") * 100).alias("overdue_share_pct"),
        mean("_sla", "_sla_n").alias("mean_sla_h"), "median_sla_h",
        (mean("_multi", "_multi_n") * 100).alias("multiline_share_pct"),
        mean("_clar", "_clar_n").alias("mean_clarifications"),
    )
    score = (F.col("overdue_share_pct") * 1.5 + F.col("multiline_share_pct") * 0.05
             + F.coalesce("mean_sla_h", F.lit(0.0)) * 0.1)
    scored = raw.withColumn("risk_score", score)
    digits = ("overdue_share_pct", "mean_sla_h", "median_sla_h", "multiline_share_pct", "mean_clarifications", "risk_score")
    return scored.withColumns({c: _rounded(F.col(c)) for c in digits}).orderBy(
        "dimension", F.desc("risk_score"), F.desc("tickets_count"), F.asc_nulls_last("value"))


def risk_matrix_batch(rows: DataFrame, column: str = "category_original", min_tickets: int = 20) -> DataFrame:
    return dimension_risk_batch(rows, {column: column}).drop("dimension").filter(F.col("tickets_count") >= min_tickets)
