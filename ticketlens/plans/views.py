"""Ticket table derived from the order tables, as one SQL text for both engines.

The given tables hold no tickets, so orders stand in for them: a line item group
gives the line times, the customer the service, the nation the category. The
text columns carry the noise of a real export (stray blanks, several date
layouts, unreadable values) so that cleaning has something to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlens.operators import enrich as en
from ticketlens.session import discard, folder_state, materialize
from ticketlens.sources.tables import spread, table


def _two(x: str) -> str:
    return f"lpad(cast({x} AS varchar(10)), 2, '0')"


def _int(x: str) -> str:
    return f"cast(floor({x}) AS bigint)"


def _hms(x: str) -> str:
    return (f"concat(cast({_int(f'{x} / 3600')} AS varchar(10)), ':', {_two(_int(f'({x} % 3600) / 60'))}, ':', "
            f"{_two(f'{x} % 60')})")


def _day(ts: str) -> str:
    return _two(f"extract(day FROM {ts})")


def _month(ts: str) -> str:
    return _two(f"extract(month FROM {ts})")


def _year(ts: str) -> str:
    return f"cast(extract(year FROM {ts}) AS varchar(10))"


_CLOCK = (_two(_int("(secs % 86400) / 3600")), _two(_int("(secs % 3600) / 60")), _two("secs % 60"))


def _short(ts: str) -> str:
    return (f"concat({_day(ts)}, '.', {_month(ts)}, '.', substr({_year(ts)}, 3, 2), ' ', "
            f"{_CLOCK[0]}, ':', {_CLOCK[1]})")


_ISO = f"concat({_year('o_orderdate')}, '-', {_month('o_orderdate')}, '-', {_day('o_orderdate')}, 'T', {_CLOCK[0]}, ':', {_CLOCK[1]}, ':', {_CLOCK[2]})"
_LONG = f"concat({_day('o_orderdate')}, '.', {_month('o_orderdate')}, '.', {_year('o_orderdate')}, ' ', {_CLOCK[0]}, ':', {_CLOCK[1]}, ':', {_CLOCK[2]})"
_LONG_MINUTE = f"concat({_day('o_orderdate')}, '.', {_month('o_orderdate')}, '.', {_year('o_orderdate')}, ' ', {_CLOCK[0]}, ':', {_CLOCK[1]})"

_LINE_SUMS = ",\n         ".join(
    f"cast(sum(CASE WHEN l_suppkey % 4 = {n - 1} THEN cast(l_quantity AS bigint) * 97 END) AS bigint) AS w{n}, "
    f"cast(sum(CASE WHEN l_suppkey % 4 = {n - 1} AND l_linenumber > 1 THEN l_linenumber * 45 END) AS bigint) AS r{n}"
    for n in en.LINES)
_LINE_TEXTS = ",\n         ".join(
    f"CASE WHEN {k}{n} IS NOT NULL THEN {_hms(f'{k}{n}')} END AS {name}_{n}_raw"
    for n in en.LINES for k, name in (("r", "react"), ("w", "work")))

RAW_SQL = f"""li AS (
  SELECT l_orderkey, max(l_shipdate) AS ship, min(l_suppkey % 4) + 1 AS line_no,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS clar,
         {_LINE_SUMS}
  FROM {{lineitem}} GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
             cast(floor(o_totalprice) AS bigint) AS secs FROM {{orders}}),
base AS (
  SELECT o.*, li.*, c_name, c_mktsegment,
         CASE WHEN n_nationkey = 3 THEN 'Прочее' ELSE n_name END AS cat
  FROM o LEFT JOIN li ON l_orderkey = o_orderkey
         LEFT JOIN {{customer}} ON c_custkey = o_custkey
         LEFT JOIN {{nation}} ON n_nationkey = c_nationkey),
raw AS (
  SELECT o_orderkey AS position,
         CASE WHEN o_orderkey % 13 = 0 THEN concat('  T-', cast(o_orderkey AS varchar(20)), ' ')
              ELSE concat('T-', cast(o_orderkey AS varchar(20))) END AS ticket_raw,
         CASE WHEN o_orderkey % 101 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN {_ISO}
              WHEN o_orderkey % 5 = 1 THEN concat({_ISO}, '+03:00') WHEN o_orderkey % 5 = 2 THEN {_LONG_MINUTE}
              ELSE {_LONG} END AS reg_raw,
         {_short("(o_orderdate + INTERVAL 2 DAY)")} AS plan_raw,
         {_short("(o_orderdate + INTERVAL 3 DAY)")} AS deadline_raw,
         CASE WHEN ship IS NOT NULL THEN {_short("ship")} END AS fact_raw,
         CASE WHEN ship IS NOT NULL THEN {_short("ship")} END AS entered_raw,
         CASE WHEN o_orderkey % 61 = 0 THEN '31.02.99 25:00' ELSE {_short("(o_orderdate + INTERVAL 4 DAY)")} END AS modified_raw,
         CASE o_orderstatus WHEN 'F' THEN 'Закрыт' WHEN 'O' THEN 'В работе' ELSE 'закрыт' END AS status_raw,
         c_name AS user_raw,
         CASE WHEN o_orderkey % 37 = 0 THEN '---)' ELSE c_mktsegment END AS service_raw,
         CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
              ELSE concat('component ', cast(o_custkey % 7 AS varchar(10))) END AS component_raw,
         CASE WHEN o_orderkey % 17 = 0 THEN concat(' ', cat, '  ') ELSE cat END AS category_raw,
         CASE WHEN o_orderkey % 2 = 0 THEN 'Инцидент' ELSE 'Запрос' END AS request_raw,
         o_orderpriority AS criticality_raw, lower(o_orderpriority) AS urgency_raw,
         CASE WHEN o_orderkey % 31 = 0 THEN '   ' ELSE o_orderpriority END AS priority_raw,
         upper(c_mktsegment) AS class_raw, 'UTC+3' AS zone_raw,
         concat('Обращение ', cast(o_custkey % 50 AS varchar(10)), '  по услуге ', c_mktsegment) AS text_raw,
         CASE WHEN o_orderstatus = 'F' THEN 'Решение предоставлено' END AS result_raw,
         CASE WHEN line_no IS NOT NULL THEN concat('(', cast(line_no AS varchar(10)), ' линия)') END AS line_raw,
         {_hms("(secs % 50000)")} AS norm_raw,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 97 = 1 THEN 'n/a'
              WHEN o_orderkey % 89 = 2 THEN concat('-', {_hms("secs")})
              WHEN o_orderkey % 7 = 3 THEN concat(' ', cast({_int("secs / 3600")} AS varchar(10)), ':', {_two(_int("(secs % 3600) / 60"))})
              ELSE {_hms("secs")} END AS sla_raw,
         CASE WHEN o_orderstatus = 'F' THEN 'Просрочен'
              WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN 'не  ПРОСРОЧЕН'
              WHEN o_orderstatus = 'O' THEN 'Не просрочен'
              WHEN o_orderkey % 2 = 0 THEN 'ошибка' END AS overdue_raw,
         CASE WHEN clar IS NULL OR o_orderkey % 29 = 0 THEN ''
              WHEN o_orderkey % 19 = 0 THEN concat(cast(clar AS varchar(10)), ',0')
              WHEN o_orderkey % 23 = 0 THEN concat(cast(clar AS varchar(10)), '.5')
              ELSE cast(clar AS varchar(10)) END AS clar_raw,
         CASE WHEN clar > 0 THEN concat('0:', {_two("clar")}) END AS clartime_raw,
         {_LINE_TEXTS}
  FROM base)"""

HEADERS = {
    "ticket_raw": en.TICKET, "reg_raw": en.REGISTERED, "plan_raw": en.PLANNED, "deadline_raw": en.DEADLINE,
    "fact_raw": en.FINISHED, "entered_raw": en.STATUS_ENTERED, "modified_raw": en.MODIFIED,
    "status_raw": en.STATUS, "user_raw": en.USER_TYPE, "service_raw": en.SERVICE, "component_raw": en.COMPONENT,
    "category_raw": en.CATEGORY, "request_raw": en.REQUEST_TYPE, "criticality_raw": en.CRITICALITY,
    "urgency_raw": en.URGENCY, "priority_raw": en.PRIORITY, "class_raw": en.SERVICE_CLASS,
    "zone_raw": en.TIMEZONE, "text_raw": en.DESCRIPTION, "result_raw": en.RESULT, "line_raw": en.SOLVED_BY,
    "norm_raw": en.NORM_SLA, "sla_raw": en.FACT_SLA, "overdue_raw": en.OVERDUE,
    "clar_raw": en.CLARIFICATIONS, "clartime_raw": en.CLARIFICATION_TIME,
    **{f"react_{n}_raw": en.REACT[n] for n in en.LINES}, **{f"work_{n}_raw": en.WORK[n] for n in en.LINES},
}


def _hours(x: str) -> str:
    """Hours of a seconds count that was written as H:MM:SS."""
    return (f"(cast({_int(f'{x} / 3600')} AS double) + cast({_int(f'({x} % 3600) / 60')} AS double) / 60 "
            f"+ cast({x} % 60 AS double) / 3600)")


_SECONDS = "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 5 = 2 THEN (secs % 86400) - (secs % 60) ELSE secs % 86400 END"
_MINUTE = "(secs % 86400) - (secs % 60)"

# SQL view of the enriched ticket, computed from the numbers and not from the texts.
ENRICHED_SQL = RAW_SQL + f""",
numbers AS (
  SELECT b.*,
         o_orderdate + to_seconds({_SECONDS}) AS reg_dt,
         ship + to_seconds({_MINUTE}) AS fact_dt,
         CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 97 = 1 THEN NULL
              WHEN o_orderkey % 89 = 2 THEN -{_hours("secs")}
              WHEN o_orderkey % 7 = 3 THEN {_hours("(secs - secs % 60)")}
              ELSE {_hours("secs")} END AS source_sla,
         {", ".join(f"coalesce({_hours(f'{k}{n}')}, 0) AS line_{n}_{name}_h" for n in en.LINES for k, name in (("r", "react"), ("w", "work")))},
         CASE WHEN clar IS NULL OR o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN clar
              WHEN o_orderkey % 23 = 0 THEN NULL ELSE clar END AS clarifications_cnt,
         CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS is_overdue
  FROM base b),
totals AS (
  SELECT *, line_1_work_h + line_2_work_h + line_3_work_h + line_4_work_h AS total_work_h,
         line_1_react_h + line_2_react_h + line_3_react_h + line_4_react_h AS total_react_h,
         {" + ".join(f"(CASE WHEN line_{n}_react_h > 0 OR line_{n}_work_h > 0 THEN 1 ELSE 0 END)" for n in en.LINES)} AS lines_count,
         {" + ".join(f"(CASE WHEN line_{n}_work_h > 0 THEN 1 ELSE 0 END)" for n in en.LINES)} AS work_lines
  FROM numbers),
top15 AS (SELECT cat FROM totals WHERE cat IS NOT NULL AND cat <> 'Прочее' GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 15),
tickets AS (
  SELECT concat('T-', cast(o_orderkey AS varchar)) AS ticket_id, o_orderkey AS position, reg_dt, fact_dt,
         CASE WHEN o_orderkey % 37 = 0 THEN '---)' ELSE c_mktsegment END AS service,
         cat AS category_original,
         CASE WHEN cat IN (SELECT cat FROM top15) THEN cat ELSE 'Прочее' END AS category_grouped,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN line_no IS NOT NULL THEN concat('(', cast(line_no AS varchar), ' линия)') END AS resolved_line,
         CASE WHEN source_sla IS NOT NULL THEN source_sla WHEN total_work_h + total_react_h > 0
              THEN total_react_h + total_work_h END AS fact_sla_h,
         CASE WHEN source_sla IS NOT NULL THEN 'source' WHEN total_work_h + total_react_h > 0
              THEN 'reconstructed_from_lines' ELSE 'missing' END AS fact_sla_source,
         is_overdue, lines_count, CASE WHEN lines_count > 1 THEN 1 ELSE 0 END AS is_multiline,
         clarifications_cnt, CASE WHEN clarifications_cnt >= 2 THEN 1 WHEN clarifications_cnt < 2 THEN 0 END AS is_high_clarifications,
         total_work_h, total_react_h, work_lines,
         {", ".join(f"line_{n}_{name}_h" for n in en.LINES for name in ("react", "work"))}
  FROM totals)"""

_KEPT: dict[tuple[str, str, str], tuple[tuple, object]] = {}


def kept(spark: SparkSession, folder: str, name: str, build: Callable[[], object]) -> object:
    """Result of ``build`` for the present content of a folder; made anew, and the old table deleted, once a table has changed."""
    key, state = (spark.sparkContext.applicationId, folder, name), folder_state(spark, folder)
    known = _KEPT.get(key)
    if known is None or known[0] != state:
        if known is not None and isinstance(known[1], DataFrame):
            discard(known[1])
        _KEPT[key] = (state, build())
    return _KEPT[key][1]


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Table derived once for the present content of a folder, kept in the shared scratch folder."""
    return spread(kept(spark, folder, name, lambda: materialize(build(), name)))


def _derived(spark: SparkSession, folder: str) -> DataFrame:
    """Raw ticket rows as a plan: only columns that are asked for are derived."""
    names = ("lineitem", "orders", "customer", "nation")
    rows = spark.sql(f"WITH {RAW_SQL} SELECT * FROM raw", **{n: table(spark, folder, n) for n in names})
    return rows.withColumnsRenamed(HEADERS)


def _known(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a kept table of this name fits the present content of the folder."""
    found = _KEPT.get((spark.sparkContext.applicationId, folder, name))
    return found is not None and found[0] == folder_state(spark, folder)


def raw_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw ticket table under its original headers, plus its row position."""
    return once(spark, folder, "raw_tickets", lambda: _derived(spark, folder))


def raw_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Raw ticket table for a single reader: not written for it, but read where it is kept already."""
    return raw_tickets(spark, folder) if _known(spark, folder, "raw_tickets") else _derived(spark, folder)


def tickets(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Enriched ticket table (analytic columns only), or the named columns of it.

    Named columns alone are derived and kept, unless the whole table is kept
    already. Raw columns that do not enter them are never written.
    """
    if columns and _known(spark, folder, "tickets"):
        return tickets(spark, folder).select(*columns)

    return once(spark, folder, "-".join(["tickets", *columns]), lambda: en.enrich_tickets(
        raw_plan(spark, folder), columns=columns or ("position", *en.RUNTIME_OUTPUT)))


def batch_tickets(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Ticket table of the batch dialect, or the named columns of it, under the rules of :func:`tickets`."""
    if columns and _known(spark, folder, "batch_tickets"):
        return batch_tickets(spark, folder).select(*columns)
    return once(spark, folder, "-".join(["batch_tickets", *columns]), lambda: en.enrich_tickets_batch(raw_plan(spark, folder), columns=columns or None))


TABLES = {n: n for n in ("lineitem", "orders", "customer", "nation")}


def with_raw(query: str) -> str:
    return f"WITH {RAW_SQL.format(**TABLES)}\n{query}"


def with_tickets(query: str) -> str:
    return f"WITH {ENRICHED_SQL.format(**TABLES)}\n{query}"
