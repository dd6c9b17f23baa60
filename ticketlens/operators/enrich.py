"""Cleaning and enrichment of the raw ticket table, in two dialects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.functions import values as v

LINES = (1, 2, 3, 4)
TOP_CATEGORIES = 15
SMALL_NEGATIVE_MINUTES = 5

# Headers of the raw ticket table.
TICKET = "Номер запроса"
REGISTERED = "Дата регистрации"
PLANNED = "Плановое время выполнения"
DEADLINE = "Крайний срок обработки"
FINISHED = "Фактическое время выполнения"
STATUS_ENTERED = "Время входа в статус"
MODIFIED = "Дата последнего изменения"
STATUS = "Статус"
USER_TYPE = "Пользователь"
SERVICE = "Услуга"
COMPONENT = "Компонент услуги 1 уровня"
CATEGORY = "Вид запроса"
REQUEST_TYPE = "Тип запроса"
CRITICALITY = "Критичность"
URGENCY = "Срочность"
PRIORITY = "Приоритет"
SERVICE_CLASS = "Класс обслуживания"
TIMEZONE = "Часовой пояс запроса"
DESCRIPTION = "Описание 2"
RESULT = "Результат работ"
SOLVED_BY = "Кем решен (группа)"
NORM_SLA = "Норматив ное время обработки (SLA)"
FACT_SLA = "Фактическая длительность выполнения запроса (SLA)"
OVERDUE = "Просрочен?*"
CLARIFICATIONS = "Количество уточнений"
CLARIFICATION_TIME = "Суммарное время уточнений"
REACT = {n: f"Суммарное время реакции {n} линии" for n in LINES}
WORK = {n: f"Суммарное время работы {n} линии" for n in LINES}

RUNTIME_INPUT = (TICKET, REGISTERED, SERVICE, CATEGORY, PRIORITY, FACT_SLA, OVERDUE, SOLVED_BY,
                 CLARIFICATIONS, *REACT.values(), *WORK.values())

# Output columns and the headers they are read from, as agreed with the users of these tables.
RUNTIME_OUTPUT = (
    "ticket_id", "reg_dt", "service", "category_original", "category_grouped", "priority", "resolved_line",
    "fact_sla_h", "fact_sla_source", "is_overdue", "lines_count", "is_multiline", "clarifications_cnt",
    "is_high_clarifications", "total_work_h", "total_react_h",
)

BATCH_DATES = {"reg_dt": REGISTERED, "plan_dt": PLANNED, "deadline_dt": DEADLINE, "fact_dt": FINISHED,
               "status_entry_dt": STATUS_ENTERED, "last_modified_dt": MODIFIED}
BATCH_TEXTS = {"status": STATUS, "user_type": USER_TYPE, "service": SERVICE, "request_type": REQUEST_TYPE,
               "criticality": CRITICALITY, "urgency": URGENCY, "priority": PRIORITY,
               "service_class": SERVICE_CLASS, "timezone": TIMEZONE, "resolution": RESULT,
               "resolved_line": SOLVED_BY}

# Columns known when a ticket is registered, columns that describe its outcome, and the batch output.
REGISTRATION_COLUMNS = (
    "ticket_id", "reg_dt", "service", "service_component", "category_original", "category_grouped",
    "request_type", "criticality", "urgency", "priority", "service_class", "norm_sla_h", "plan_dt",
    "deadline_dt", "text_clean",
)
WORKFLOW_COLUMNS = (
    "ticket_id", "fact_dt", "status_entry_dt", "last_modified_dt", "fact_sla_h", "fact_sla_source",
    "total_lifecycle_h", "has_datetime_anomaly", "is_overdue", "resolved_line", "clarifications_cnt",
    "clarification_h", "is_high_clarifications",
    *[f"line_{n}_{kind}_h" for n in LINES for kind in ("react", "work")],
    "total_work_h", "total_react_h", "lines_count", "is_multiline", "lines_count_changed",
)
BATCH_OUTPUT = (
    "ticket_id", *BATCH_DATES, "status", "user_type", "service", "service_component", "category_original",
    "category_grouped", "request_type", "criticality", "urgency", "priority", "service_class", "timezone",
    "text_clean", "norm_sla_h", "fact_sla_h", "fact_sla_source",
    *[f"line_{n}_{kind}_h" for n in LINES for kind in ("react", "work")],
    "clarification_h", "resolution", "resolved_line", "clarifications_cnt", "total_work_h", "total_react_h",
    "lines_count", "is_multiline", "lines_count_changed", "is_overdue", "is_high_clarifications",
    "total_lifecycle_h", "has_datetime_anomaly",
)


def supports_enrichment(columns: Sequence[str]) -> bool:
    return set(RUNTIME_INPUT) <= set(columns)


def needs_enrichment(columns: Sequence[str]) -> bool:
    return supports_enrichment(columns) and not set(RUNTIME_OUTPUT) <= set(columns)


def top_values(rows: DataFrame, column: str, limit: int = TOP_CATEGORIES, exclude: str | None = None,
               seen_order: str | None = None, weight: str | None = None) -> DataFrame:
    """The ``limit`` most frequent values. Ties go to the first seen value, or to the smaller one.

    ``weight`` names a row count when ``rows`` is already counted. The result
    never has more than ``limit`` rows, so it may always be broadcast.
    """
    present = rows.filter(F.col(column).isNotNull())
    if exclude is not None:
        present = present.filter(F.col(column) != exclude)
    measures = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("count")]
    order = [F.desc("count")]
    if seen_order:
        measures.append(F.min(seen_order).alias("first_seen"))
        order.append(F.asc("first_seen"))
    return present.groupBy(column).agg(*measures).orderBy(*order, F.asc(column)).limit(limit)


def group_tail(rows: DataFrame, column: str, out: str, top: DataFrame, other: str = v.OTHER_CATEGORY) -> DataFrame:
    """Keep values listed in ``top``; everything else, null included, becomes ``other``."""
    listed = F.broadcast(top.select(F.col(column).alias("_listed")))
    joined = rows.join(listed, F.col(column) == F.col("_listed"), "left")
    return joined.withColumn(out, F.coalesce("_listed", F.lit(other))).drop("_listed")


def _category_counts(raw: DataFrame, clean: Callable[[Column], Column], seen_order: str | None = None) -> DataFrame:
    """Rows per category: counted as written first, so that only distinct spellings are cleaned."""
    seen = [F.min(seen_order).alias("first_seen")] if seen_order else []
    counted = raw.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("rows"), *seen)
    return counted.select(clean(F.col(CATEGORY)).alias("category_original"), "rows", *(["first_seen"] if seen_order else []))


_LINE_COLUMNS = {f"line_{n}_{kind}_h": names[n] for n in LINES for kind, names in (("react", REACT), ("work", WORK))}


def _mapped(sources: Sequence[str], parse: Callable[[Column], Column]) -> Column:
    """One array expression for many columns of the same form: the generated code stays small."""
    return F.transform(F.array(*[F.col(s) for s in sources]), lambda cell: parse(cell))


def _spread(array: str, names: Sequence[str]) -> dict[str, Column]:
    return {name: F.col(array)[i] for i, name in enumerate(names)}


def _hours_of_lines(array: str) -> dict[str, Column]:
    return {name: F.coalesce(hours, F.lit(0.0)) for name, hours in _spread(array, list(_LINE_COLUMNS)).items()}


def _total(kind: str) -> Column:
    return reduce(add, [F.col(f"line_{n}_{kind}_h") for n in LINES])


def _sla_columns(source: str) -> dict[str, Column]:
    """Source value, else the sum of the line times when positive, with its provenance."""
    rebuilt = F.col("total_react_h") + F.col("total_work_h")
    return {
        "fact_sla_h": F.when(F.col(source).isNotNull(), F.col(source)).when(rebuilt > 0, rebuilt),
        "fact_sla_source": F.when(F.col(source).isNotNull(), "source")
        .when(rebuilt > 0, "reconstructed_from_lines").otherwise("missing"),
    }


def _active_lines(kinds: Sequence[str]) -> Column:
    def active(n: int) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"line_{n}_{kind}_h") > 0 for kind in kinds]).cast("int")
    return reduce(add, [active(n) for n in LINES])


#: What comes from the times of the lines, besides the duration, which needs them only where its source is missing.
_LINE_RESULTS = {*_LINE_COLUMNS, "total_work_h", "total_react_h", "lines_count", "is_multiline", "lines_count_changed"}
_SLA_RESULTS = {"fact_sla_h", "fact_sla_source"}


def _asked(sources: dict[str, str], wanted: set[str]) -> dict[str, str]:
    return {name: source for name, source in sources.items() if name in wanted}


def _parsed(array: str, sources: dict[str, str], parse: Callable[[Column], Column]) -> dict[str, Column]:
    """The array column of :func:`_mapped`, if there are any sources."""
    return {array: _mapped([*sources.values()], parse)} if sources else {}


def _with_line_times(rows: DataFrame, wanted: set[str], parse: Callable[[Column], Column]) -> DataFrame:
    """Times of the lines and their totals; for the duration alone, lines are parsed where ``_source_sla`` is missing."""
    if not wanted & (_LINE_RESULTS | _SLA_RESULTS):
        return rows
    hours = _mapped([*_LINE_COLUMNS.values()], parse)
    rows = rows.withColumn("_lines", hours if wanted & _LINE_RESULTS else F.when(F.col("_source_sla").isNull(), hours))
    rows = rows.withColumns(_hours_of_lines("_lines"))
    rows = rows.withColumns({"total_work_h": _total("work"), "total_react_h": _total("react")})
    return rows.withColumns({**(_sla_columns("_source_sla") if wanted & _SLA_RESULTS else {}), "lines_count": _active_lines(("react", "work"))})


def enrich_tickets(raw: DataFrame, seen_order: str | None = None, top_n: int = TOP_CATEGORIES, columns: Sequence[str] | None = None) -> DataFrame:
    """Append the sixteen analytic columns; source columns stay as they are, in place.

    ``seen_order`` names a row position that settles ties between equally
    frequent categories; without it the smaller category wins. ``columns``
    names the columns to return, and nothing else is parsed.
    """
    if not supports_enrichment(raw.columns):
        missing = sorted(set(RUNTIME_INPUT) - set(raw.columns))
        raise ValueError(f"missing columns: {missing}")
    kept = [c for c in raw.columns if c not in RUNTIME_OUTPUT]
    wanted = set(RUNTIME_OUTPUT if columns is None else columns)
    wanted |= {"category_original"} if "category_grouped" in wanted else set()
    texts = _asked({"ticket_id": TICKET, "service": SERVICE, "category_original": CATEGORY, "priority": PRIORITY,
                    "resolved_line": SOLVED_BY}, wanted)
    source = {"_source_sla": FACT_SLA} if wanted & _SLA_RESULTS else {}
    rows = raw.select(*kept).withColumns({
        "reg_dt": v.ticket_datetime(REGISTERED),
        "is_overdue": v.overdue_flag(OVERDUE),
        "clarifications_cnt": v.clarification_count(CLARIFICATIONS),
        **_parsed("_texts", texts, tx.clean_text),
        **_parsed("_hours", source, v.duration_hours),
    })
    rows = rows.withColumns({**_spread("_texts", list(texts)), **_spread("_hours", list(source))})
    rows = _with_line_times(rows, wanted, v.duration_hours)
    rows = rows.withColumns({
        **({"is_multiline": (F.col("lines_count") > 1).cast("int")} if "is_multiline" in wanted else {}),
        "is_high_clarifications": (F.col("clarifications_cnt") >= 2).cast("int"),
    })
    if "category_grouped" in wanted:
        top = top_values(_category_counts(raw, tx.clean_text, seen_order), "category_original", top_n, v.OTHER_CATEGORY,
                         "first_seen" if seen_order else None, "rows")
        rows = group_tail(rows, "category_original", "category_grouped", top)
    return rows.select(*(columns if columns is not None else (*kept, *RUNTIME_OUTPUT)))


def enrich_if_needed(raw: DataFrame, seen_order: str | None = None) -> DataFrame:
    """Enrich a recognised raw table once; any other table passes through unchanged."""
    return enrich_tickets(raw, seen_order) if needs_enrichment(raw.columns) else raw


def lifecycle_columns(start: str, end: str) -> dict[str, Column]:
    """Hours from start to end. Up to five minutes backwards counts as zero, more is null."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")
    hours = micros / F.lit(1_000_000) / 3600
    return {
        "has_datetime_anomaly": F.coalesce((hours < 0).cast("int"), F.lit(0)),
        "total_lifecycle_h": F.when(hours >= 0, hours).when(hours >= -SMALL_NEGATIVE_MINUTES / 60, F.lit(0.0)),
    }


def enrich_tickets_batch(raw: DataFrame, top_n: int = TOP_CATEGORIES, columns: Sequence[str] | None = None) -> DataFrame:
    """The 44-column analytic table of the batch dialect, or the named ``columns`` of it: nothing else is parsed."""
    wanted = set(BATCH_OUTPUT if columns is None else columns)
    wanted |= {"category_original"} if "category_grouped" in wanted else set()
    lifecycle = wanted & {"total_lifecycle_h", "has_datetime_anomaly"}
    wanted |= {"reg_dt", "fact_dt"} if lifecycle else set()
    texts = _asked({"ticket_id": TICKET, **BATCH_TEXTS, "service_component": COMPONENT, "text_clean": DESCRIPTION,
                    "category_original": CATEGORY}, wanted)
    dates = _asked(BATCH_DATES, wanted)
    hours = _asked({"norm_sla_h": NORM_SLA, "_source_sla": FACT_SLA, "clarification_h": CLARIFICATION_TIME},
                   wanted | ({"_source_sla"} if wanted & _SLA_RESULTS else set()))

    def parse_hours(text: Column) -> Column:
        return v.duration_hours(text, allow_infinite=True)

    parts = {**_parsed("_texts", texts, tx.clean_text_batch), **_parsed("_dates", dates, v.ticket_datetime), **_parsed("_hours", hours, parse_hours)}
    rows = raw.select(
        *[part.alias(name) for name, part in parts.items()], *_LINE_COLUMNS.values(),
        v.clarification_count_batch(CLARIFICATIONS).alias("clarifications_cnt"),
        v.overdue_flag_batch(OVERDUE).alias("is_overdue"),
    )
    rows = rows.withColumns({**_spread("_texts", list(texts)), **_spread("_dates", list(dates)), **_spread("_hours", list(hours))})
    if "clarification_h" in wanted:
        rows = rows.withColumn("clarification_h", F.coalesce("clarification_h", F.lit(0.0)))
    if "service_component" in wanted:
        rows = rows.withColumn("service_component", F.coalesce("service_component", F.lit("Не указан")))
    rows = _with_line_times(rows, wanted, parse_hours)
    rows = rows.withColumns({
        "is_high_clarifications": F.coalesce((F.col("clarifications_cnt") >= 2).cast("int"), F.lit(0)),
        **(lifecycle_columns("reg_dt", "fact_dt") if lifecycle else {}),
    })
    if wanted & {"is_multiline", "lines_count_changed"}:
        rows = rows.withColumns({
            "is_multiline": (F.col("lines_count") > 1).cast("int"),
            "lines_count_changed": (F.col("lines_count") != _active_lines(("work",))).cast("int"),
        })
    if "category_grouped" in wanted:
        top = top_values(_category_counts(raw, tx.clean_text_batch), "category_original", top_n, v.OTHER_CATEGORY, None, "rows")
        rows = group_tail(rows, "category_original", "category_grouped", top)
    return rows.select(*(BATCH_OUTPUT if columns is None else columns))


def registration_features(enriched: DataFrame) -> DataFrame:
    return enriched.select(*REGISTRATION_COLUMNS)


def workflow_outcomes(enriched: DataFrame) -> DataFrame:
    return enriched.select(*WORKFLOW_COLUMNS)


def check_no_outcomes(columns: Sequence[str]) -> None:
    """Reject a feature list that contains anything known only after registration."""
    leaked = sorted((set(columns) & set(WORKFLOW_COLUMNS)) - {"ticket_id"})
    if leaked:
        raise ValueError(f"outcome columns in the feature list: {leaked}")


# Names under which ticket tables carry the same field.
TEXT_ALIASES = (DESCRIPTION, "Описание", "Текст обращения", "Текст", "Тема", "description", "subject")
SERVICE_ALIASES = (SERVICE, "service")
COMPONENT_ALIASES = (COMPONENT, "Компонент услуги", "component")
NUMBER_ALIASES = (TICKET, "Номер обращения", "ticket_id")
CATEGORY_ALIASES = (CATEGORY, "category_original", "category_grouped", "category")
LINE_ALIASES = (SOLVED_BY, "resolved_line", "support_line")
RESOLUTION_ALIASES = (RESULT, "resolution", "result")


def first_present(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """First non-blank value among the aliases that the table has."""
    found = [tx.blank_to_null(F.col(f"`{a}`")) for a in aliases if a in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def searchable_text(columns: Sequence[str]) -> Column:
    """Distinct non-blank text, service and component values, one per line, in alias order."""
    names = [a for a in (*TEXT_ALIASES, *SERVICE_ALIASES, *COMPONENT_ALIASES) if a in columns]
    if not names:
        return F.lit("")
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[tx.blank_to_null(F.col(f"`{n}`")) for n in names]))), "\n")
