"""Queries over table ingest, sinks and data quality."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators import enrich as en
from ticketlens.operators import filters as fl
from ticketlens.operators import quality as qu
from ticketlens.plans.registry import query, sql_collapse, sql_fold
from ticketlens.plans.views import HEADERS, batch_tickets, raw_plan, raw_tickets, tickets, with_raw, with_tickets
from ticketlens.session import scratch_path
from ticketlens.sources import files, ingest
from ticketlens.sources.tables import table

# ---- files ------------------------------------------------------------------------------


@query("csv_scan", with_raw("""
    SELECT cast(position AS varchar) AS position, text_raw AS text, coalesce(service_raw, '') AS service,
           coalesce(component_raw, '') AS component, coalesce(overdue_raw, '') AS overdue FROM raw"""))
def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets written as a Windows-1251 CSV and scanned back as text."""
    path = scratch_path(spark, "csv")
    files.write_csv(raw_tickets(spark, folder), path, encoding="windows-1251")
    rows = files.read_ticket_csv(spark, path, encoding="windows-1251", required=en.RUNTIME_INPUT, multiline=False)
    return rows.select("position", F.col(en.DESCRIPTION).alias("text"), F.col(en.SERVICE).alias("service"),
                       F.col(en.COMPONENT).alias("component"), F.col(f"`{en.OVERDUE}`").alias("overdue"))


@query("csv_file_positions", "SELECT count(*) AS n, 2 AS low, count(*) + 1 AS high, count(*) AS positions FROM documents")
def _csv_positions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    docs = table(spark, folder, "documents")
    # A file with line breaks in its cells is read by one task: their number grows with the table.
    files.write_csv(docs.repartition(max(3, docs.rdd.getNumPartitions()), "doc_id"), path)
    rows = files.with_file_position(files.read_ticket_csv(spark, path, encoding="utf-8-sig"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("_source_row").cast("int").alias("low"), F.max("_source_row").alias("high"),
                    F.countDistinct("_source_row").alias("positions"))


_SPLIT_SQL = "CASE WHEN position % 10 < 7 THEN 'train' WHEN position % 10 < 8 THEN 'validation' WHEN position % 10 < 9 THEN 'test' ELSE 'review' END"


def _prepared_tickets(spark: SparkSession, folder: str) -> DataFrame:
    rows = tickets(spark, folder, "ticket_id", "position", "resolved_line", "priority", "service", "lines_count")
    return rows.select(
        "ticket_id", "position", F.expr(_SPLIT_SQL).alias("split"), F.coalesce("resolved_line", F.lit("")).alias("line"),
        F.array_compact(F.array(F.when(F.col("priority").isNull(), "no_priority"), F.when(F.col("service") == "---)", "unknown_service"),
                                F.when(F.col("lines_count") > 3, "many_lines"))).alias("quality_flags"))


@query("split_sink", with_tickets(f"SELECT {_SPLIT_SQL} AS split, count(*) AS n, cast(sum(position) AS bigint) AS positions FROM tickets GROUP BY 1"))
def _split_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    files.write_splits(_prepared_tickets(spark, folder), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"))


_MANIFEST_SQL = with_tickets("SELECT 1").rsplit("SELECT 1", 1)[0] + f""",
  p AS (SELECT {_SPLIT_SQL} AS split, coalesce(resolved_line, '') AS line, priority, service, lines_count FROM tickets)
  SELECT 'rows' AS section, '' AS item, '' AS detail, count(*) AS n FROM p
  UNION ALL SELECT 'split', split, '', count(*) FROM p GROUP BY split
  UNION ALL SELECT 'line', line, '', count(*) FROM p GROUP BY line
  UNION ALL SELECT 'coverage', split, line, count(*) FROM p GROUP BY split, line
  UNION ALL SELECT 'flag', 'no_priority', '', count(*) FROM p WHERE priority IS NULL
  UNION ALL SELECT 'flag', 'unknown_service', '', count(*) FROM p WHERE service = '---)'
  UNION ALL SELECT 'flag', 'many_lines', '', count(*) FROM p WHERE lines_count > 3"""


@query("manifest", _MANIFEST_SQL)
def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return files.manifest(_prepared_tickets(spark, folder), flags="quality_flags")


@query("import_checks", "SELECT count(*) AS rows_in, count(*) AS rows_out, cast(0 AS bigint) AS rows_lost, cast(0 AS bigint) AS rows_gained FROM orders")
def _import_checks(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_tickets(spark, folder)
    return files.import_checks(raw, en.enrich_tickets(raw))


@query("header_check", "SELECT count(doc_id) AS doc_id, count(text) AS \"Unnamed: 1\", count(lang) AS lang, count(source) AS source, count(n_chars) AS n_chars FROM documents")
def _header_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").toDF(" doc_id ", "", "lang", "\tsource", "n_chars")
    rows = files.with_checked_headers(rows, required=("doc_id", "lang"))
    return rows.agg(*[F.count(f"`{c}`").alias(c) for c in rows.columns])


# ---- ingest -----------------------------------------------------------------------------

SQL_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '.%f') = '.000000' THEN '' ELSE strftime(ts, '.%f') END"


@query("canonical_cells", f"""
    SELECT event_id, {SQL_TS} AS ts, user_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS event_type,
           CASE WHEN event_type <> 'click' THEN value END AS value, props FROM events""")
def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumns({
        "event_type": F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")),
        "value": F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))})
    return ingest.canonical_cells(rows)


def _written(x: str) -> str:
    return f"coalesce(length(cast({x} AS varchar)) || ':' || cast({x} AS varchar), '-')"


@query("ingest_rows", with_raw(f"""
    SELECT position, 'orders' AS dataset_id, 'Sheet0' AS _sheet, row_number() OVER (ORDER BY position) + 1 AS _source_row,
           substr(sha256(concat_ws('|', {_written("'orders'")}, {_written("'Sheet0'")}, {_written('row_number() OVER (ORDER BY position) + 1')},
             {_written('category_raw')}, {_written("nullif(component_raw, '')")}, {_written('service_raw')})), 1, 20) AS _record_id FROM raw"""))
def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_tickets(spark, folder).select(
        "position", F.col(en.SERVICE).alias("service"), F.col(en.COMPONENT).alias("component"), F.col(en.CATEGORY).alias("category"))
    return ingest.ingest(rows, "orders", "Sheet0", "position", width=1000).select(
        "position", "dataset_id", "_sheet", "_source_row", "_record_id")


_BLANKED = "CASE WHEN lang = 'de' THEN '  ' ELSE text END"


@query("blank_rows", f"""
    SELECT (SELECT count(*) FROM b WHERE doc_id <= (SELECT max(doc_id) FROM b WHERE trim(text) <> '')) AS kept,
           (SELECT count(*) FROM b WHERE trim(text) <> '') AS filled FROM (SELECT 1)
    """.replace("FROM b", f"FROM (SELECT doc_id, {_BLANKED} AS text FROM documents)"))
def _blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.expr(_BLANKED).alias("text"))
    filled = ingest.drop_blank_rows(rows, ["text"]).agg(F.count(F.lit(1)).alias("filled"))
    return ingest.drop_trailing_blank_rows(rows, "doc_id", ["text"]).agg(F.count(F.lit(1)).alias("kept")).withColumn("filled", filled.scalar())


@query("shape_budget", """
    SELECT lang, rows, filled, cells, CASE WHEN rows > 120 THEN 'rows' WHEN cells > 700 THEN 'cells' WHEN cells > filled * 1 THEN 'sparse' END AS reason,
           NOT (cells > 700 OR rows > 120 OR cells > filled) AS passed
    FROM (SELECT lang, count(*) AS rows, count(*) * 2 AS cells, count(nullif(trim(source), '')) + count(CASE WHEN n_chars > 500 THEN 1 END) AS filled
          FROM documents GROUP BY lang)""")
def _shape_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("lang", "source", F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("long"))
    return ingest.shape_budget(rows, "lang", ["source", "long"], max_rows=120, max_columns=200, max_cells=700, sparse_ratio=1)


@query("active_sheet", """
    SELECT source AS dataset_id, lang AS active_sheet, n AS row_count FROM (
      SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang)
    WHERE r = 1""")
def _active_sheet(spark: SparkSession, folder: str) -> DataFrame:
    sheets = table(spark, folder, "documents").groupBy(F.col("source").alias("dataset_id"), F.col("lang").alias("sheet")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("doc_id").alias("sheet_pos"))
    return ingest.active_sheet(sheets)


def _uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("uploaded_at"), "lang")
    registry = docs.filter("lang = 'en'").groupBy("content_hash").agg(F.min("upload_id").alias("dataset_id"), F.min("uploaded_at").alias("created_at"))
    return docs.filter("lang <> 'en'").drop("lang"), registry


_IMPORT_SQL = """WITH d AS (SELECT doc_id, sha256(text) AS h, lang FROM documents),
  reg AS (SELECT h, min(doc_id) AS dataset_id FROM d WHERE lang = 'en' GROUP BY h),
  up AS (SELECT * FROM d WHERE lang <> 'en'),
  fresh AS (SELECT h, min(doc_id) AS dataset_id FROM up WHERE h NOT IN (SELECT h FROM reg) GROUP BY h),
  known AS (SELECT h, dataset_id FROM reg UNION ALL SELECT h, dataset_id FROM fresh)"""


@query("plan_imports", _IMPORT_SQL + """
  SELECT 'new' AS kind, dataset_id AS upload_id, dataset_id FROM fresh
  UNION ALL SELECT 'activation', doc_id, dataset_id FROM up JOIN known USING (h)""")
def _plan_imports(spark: SparkSession, folder: str) -> DataFrame:
    fresh, activations = ingest.plan_imports(*_uploads(spark, folder))
    return fresh.select(F.lit("new").alias("kind"), F.col("dataset_id").alias("upload_id"), "dataset_id").unionByName(
        activations.select(F.lit("activation").alias("kind"), "upload_id", "dataset_id"))


@query("current_dataset", _IMPORT_SQL + """
  SELECT dataset_id, h AS content_hash FROM known WHERE dataset_id = (SELECT dataset_id FROM up JOIN known USING (h) ORDER BY doc_id DESC LIMIT 1)
  UNION ALL SELECT -dataset_id, h FROM reg WHERE dataset_id = (SELECT max(dataset_id) FROM reg)""")
def _current(spark: SparkSession, folder: str) -> DataFrame:
    uploads, registry = _uploads(spark, folder)
    fresh, activations = ingest.plan_imports(uploads, registry)
    known = registry.select("dataset_id", "content_hash", "created_at").unionByName(fresh)
    active = ingest.current_dataset(known, activations)
    newest = ingest.current_dataset(registry, activations.limit(0))
    return active.select("dataset_id", "content_hash").unionByName(
        newest.select((-F.col("dataset_id")).alias("dataset_id"), "content_hash"))


_LOOKUP = hashlib.md5(b"77").hexdigest()


@query("record_by_id", f"SELECT doc_id, lang FROM documents WHERE md5(cast(doc_id AS varchar)) = '{_LOOKUP}'")
def _record_by_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").withColumn("record_id", F.md5(F.col("doc_id").cast("string")))
    return fl.record_by_id(rows, _LOOKUP).select("doc_id", "lang")


@query("active_rows", "SELECT doc_id AS source_row, n_chars FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id")
def _active_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").withColumnsRenamed({"source": "dataset_id", "lang": "sheet", "doc_id": "source_row"})
    return fl.active_rows(rows, "src3", "en").select("source_row", "n_chars")


# ---- quality ----------------------------------------------------------------------------

def _sql_profile(name: str, type_name: str) -> str:
    text = f"cast({name} AS varchar)"
    present = f"nullif(trim({text}), '')"
    date = f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if type_name == "timestamp_ntz" else "cast(NULL AS varchar)"
    formula = f"count(CASE WHEN {text} LIKE '=%' THEN 1 END)" if type_name == "string" else "cast(0 AS bigint)"
    return (f"SELECT '{name}' AS \"column\", '{type_name}' AS type, count(*) - count({present}) AS missing, count(DISTINCT {present}) AS \"distinct\", "
            f"count({present}) AS present, {formula} AS formula_cells, min({date}) AS date_min, max({date}) AS date_max FROM src")


_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("column_profile", "WITH src AS (SELECT * REPLACE (CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN '=F' ELSE 'O' END AS o_orderstatus) FROM orders) "
       + " UNION ALL ".join(_sql_profile(n, t) for n, t in _PROFILED.items()))
def _column_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn(
        "o_orderstatus", F.expr("CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN '=F' ELSE 'O' END"))
    return qu.column_profile(rows)


@query("categories_outside_top", """
    SELECT count(*) AS categories, cast(sum(n) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC LIMIT 15)) AS bigint) AS outside_top
    FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)""")
def _outside(spark: SparkSession, folder: str) -> DataFrame:
    return qu.categories_outside(table(spark, folder, "customer").withColumn("nation", F.col("c_nationkey").cast("string")), "nation")


@query("exact_duplicates", """
    SELECT min(doc_id) OVER w AS group_row, count(*) OVER w AS group_size, doc_id FROM documents
    WINDOW w AS (PARTITION BY text, lang) QUALIFY count(*) OVER w > 1""")
def _exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return qu.exact_duplicates(table(spark, folder, "documents"), "doc_id", ["text", "lang"])


@query("text_duplicates", f"""
    SELECT min(doc_id) OVER w AS group_row, count(*) OVER w AS group_size, doc_id
    FROM (SELECT doc_id, {sql_collapse(sql_fold('text'))} AS t FROM documents) WHERE t <> ''
    WINDOW w AS (PARTITION BY t) QUALIFY count(*) OVER w > 1""")
def _text_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return qu.text_duplicates(table(spark, folder, "documents"), "doc_id", ["text"])


@query("conflicting_groups", "SELECT md5(text) AS g, count(*) AS rows FROM documents GROUP BY md5(text) HAVING count(DISTINCT source) > 1")
def _conflicting(spark: SparkSession, folder: str) -> DataFrame:
    return qu.conflicting_groups(table(spark, folder, "documents").select(F.md5("text").alias("g"), "source"), "g", "source")


_COVER_SPLIT = "CASE WHEN n_chars % 10 < 7 THEN 'train' WHEN n_chars % 10 = 7 THEN 'validation' WHEN n_chars % 10 = 8 THEN 'test' ELSE 'review' END"


@query("class_coverage", f"""
    SELECT source AS category, count(*) AS total, count(DISTINCT md5(text)) AS independent_groups,
           count(CASE WHEN s = 'train' THEN 1 END) AS train, count(CASE WHEN s = 'validation' THEN 1 END) AS validation,
           count(CASE WHEN s = 'test' THEN 1 END) AS test, count(CASE WHEN s = 'review' THEN 1 END) AS review
    FROM (SELECT *, {_COVER_SPLIT} AS s FROM documents) GROUP BY source""")
def _class_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return qu.class_coverage(table(spark, folder, "documents").select(
        F.col("source").alias("category"), F.md5("text").alias("duplicate_group"), F.expr(_COVER_SPLIT).alias("split")))


@query("flag_histogram", with_tickets("""
    SELECT 'no_priority' AS flag, count(*) AS n FROM tickets WHERE priority IS NULL
    UNION ALL SELECT 'unknown_service', count(*) FROM tickets WHERE service = '---)'
    UNION ALL SELECT 'many_lines', count(*) FROM tickets WHERE lines_count > 3"""))
def _flag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return files.flag_histogram(_prepared_tickets(spark, folder))


_LONG = "(position % 5 IN (3, 4) AND position % 101 <> 0)"
_STRICT = r"regexp_matches({x}, '^\d+:[0-5]\d:[0-5]\d$')"
_SQL_INVALID = f"""
    SELECT position, '{en.REGISTERED}' AS field FROM raw WHERE NOT {_LONG}
    UNION ALL SELECT position, '{en.MODIFIED}' FROM raw WHERE position % 61 = 0
    UNION ALL SELECT position, '{en.FACT_SLA}' FROM raw WHERE trim(sla_raw) <> '' AND NOT {_STRICT.format(x='sla_raw')}"""


@query("invalid_values", with_raw(_SQL_INVALID))
def _invalid(spark: SparkSession, folder: str) -> DataFrame:
    return qu.invalid_values(raw_tickets(spark, folder), "position")


@query("negative_intervals", with_tickets(f"""
    SELECT position, cast(epoch(fact_dt) - epoch(reg_dt) AS bigint) AS seconds FROM tickets WHERE {_LONG} AND fact_dt < reg_dt"""))
def _negative(spark: SparkSession, folder: str) -> DataFrame:
    return qu.negative_intervals(raw_tickets(spark, folder), "position")


def _strict_seconds(x: str) -> str:
    return (f"(CASE WHEN {_STRICT.format(x=x)} THEN cast(split_part({x}, ':', 1) AS bigint) * 3600 + cast(split_part({x}, ':', 2) AS bigint) * 60 "
            f"+ cast(split_part({x}, ':', 3) AS bigint) END)")


_SQL_DISAGREE = f"""SELECT position FROM raw WHERE overdue_raw IN ('Просрочен', 'Не просрочен')
    AND ({_strict_seconds('sla_raw')} > {_strict_seconds('norm_raw')}) <> (overdue_raw = 'Просрочен')"""


@query("sla_disagreements", with_raw(_SQL_DISAGREE))
def _disagreements(spark: SparkSession, folder: str) -> DataFrame:
    return qu.sla_disagreements(raw_tickets(spark, folder), "position")


_SQL_MISSING = " UNION ALL ".join(
    f"SELECT 'missing' AS section, '{header}' AS item, count(*) - count(nullif(trim({name}), '')) AS amount FROM raw" for name, header in HEADERS.items())


@query("table_audit", with_tickets(f"""
    SELECT 'rows' AS section, '' AS item, count(*) AS amount FROM raw
    UNION ALL SELECT 'unique_ids', '', count(DISTINCT ticket_raw) FROM raw
    UNION ALL SELECT 'categories', '', count(DISTINCT category_raw) + max(CASE WHEN category_raw IS NULL THEN 1 ELSE 0 END) FROM raw
    UNION ALL SELECT 'solving_line', line_raw, count(*) FROM raw GROUP BY line_raw
    UNION ALL SELECT 'sla_flag', overdue_raw, count(*) FROM raw GROUP BY overdue_raw
    UNION ALL {_SQL_MISSING}
    UNION ALL SELECT 'invalid', field, count(*) FROM ({_SQL_INVALID}) GROUP BY field
    UNION ALL SELECT 'negative_intervals', '', count(*) FROM tickets WHERE {_LONG} AND fact_dt < reg_dt
    UNION ALL SELECT 'sla_disagreements', '', count(*) FROM ({_SQL_DISAGREE})"""))
def _table_audit(spark: SparkSession, folder: str) -> DataFrame:
    return qu.table_audit(raw_plan(spark, folder), "position")


@query("date_ranges", with_tickets(f"""
    SELECT '{en.REGISTERED}' AS field, strftime(min(reg_dt), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(reg_dt), '%Y-%m-%d %H:%M:%S') AS last
    FROM tickets WHERE {_LONG}
    UNION ALL SELECT '{en.FINISHED}', strftime(min(fact_dt), '%Y-%m-%d %H:%M:%S'), strftime(max(fact_dt), '%Y-%m-%d %H:%M:%S') FROM tickets"""))
def _date_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_tickets(spark, folder).drop(en.PLANNED, en.DEADLINE, en.STATUS_ENTERED, en.MODIFIED)
    return qu.date_ranges(rows).select("field", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")])


@query("batch_quality_check", with_tickets("""
    , c AS (SELECT count(*) AS n, count(DISTINCT position) AS ids, count(CASE WHEN date_diff('microsecond', reg_dt, fact_dt) < 0 THEN 1 END) AS anomalies,
      count(CASE WHEN fact_sla_h IS NULL THEN 1 END) AS no_sla, sum(is_multiline) AS multi, count(CASE WHEN lines_count <> work_lines THEN 1 END) AS changed,
      count(CASE WHEN fact_sla_h = 0 AND is_overdue IS DISTINCT FROM 0 THEN 1 END) AS zero FROM tickets)
    SELECT unnest(['rows', 'unique_ticket_ids', 'duplicate_ticket_ids', 'duplicate_rows', 'datetime_anomalies', 'closed_zero_fact_sla', 'missing_fact_sla', 'multiline_tickets', 'changed_lines_count']) AS metric,
           unnest([n, ids, 0, 0, anomalies, zero, no_sla, cast(multi AS bigint), changed]) AS amount FROM c""").replace("\n\n    ,", ",").replace("\n\n", "\n"))
def _batch_quality(spark: SparkSession, folder: str) -> DataFrame:
    checks = qu.batch_quality_check(batch_tickets(spark, folder))
    return checks.filter(~F.col("metric").isin("total_missing_cells", "columns_with_missing"))


@query("missing_cells", with_tickets("""
    SELECT * FROM (SELECT 'fact_sla_h' AS field, count(*) - count(fact_sla_h) AS missing FROM tickets
      UNION ALL SELECT 'resolved_line', count(*) - count(resolved_line) FROM tickets
      UNION ALL SELECT 'reg_dt', count(*) - count(reg_dt) FROM tickets
      UNION ALL SELECT 'priority', count(*) - count(priority) FROM tickets
      UNION ALL SELECT 'is_overdue', count(*) - count(is_overdue) FROM tickets) WHERE missing > 0"""))
def _missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    return qu.missing_cells(tickets(spark, folder, "fact_sla_h", "resolved_line", "reg_dt", "priority", "is_overdue", "service"))


_OLD = """SELECT o_orderkey AS id, concat(o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '  x' ELSE ' x' END) AS text,
    CASE WHEN o_custkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS line FROM orders WHERE o_totalprice > 60000"""
_NEW = "SELECT o_orderkey AS id, concat(o_orderpriority, ' x') AS text, o_orderstatus AS line FROM orders WHERE o_totalprice < 400000"


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    return (spark.sql(_NEW.replace("FROM orders", "FROM {orders}"), orders=orders),
            spark.sql(_OLD.replace("FROM orders", "FROM {orders}"), orders=orders))


@query("version_difference", f"""WITH old AS ({_OLD}), new AS ({_NEW})
    SELECT count(*) AS new_rows, count(o.id) AS shared_ids, count(CASE WHEN o.id IS NULL OR o.text <> n.text THEN 1 END) AS different_text,
           count(CASE WHEN o.id IS NULL OR o.line <> n.line THEN 1 END) AS different_line, count(CASE WHEN o.id IS NULL THEN 1 END) AS normalized_text_differences,
           (SELECT count(*) FROM old) AS old_rows FROM new n LEFT JOIN old o ON o.id = n.id""")
def _version_difference(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _versions(spark, folder)
    return qu.version_difference(new, old, "id", ["text", "line"], "text")


@query("shared_ids", f"SELECT id FROM ({_NEW}) INTERSECT SELECT id FROM ({_OLD})")
def _shared(spark: SparkSession, folder: str) -> DataFrame:
    return qu.shared_ids(*_versions(spark, folder), "id")


@query("attach_prepared", f"""
    SELECT n.id, CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS matches, CASE WHEN o.id IS NOT NULL THEN 'train' END AS split,
           md5(o.text) AS duplicate_group FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON o.id = n.id""")
def _attach(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _versions(spark, folder)
    prepared = old.select("id", F.lit("train").alias("split"), F.md5("text").alias("duplicate_group"))
    return qu.attach_prepared(new.select("id"), prepared, "id")
