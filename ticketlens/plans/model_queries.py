"""Queries over models: policies and metrics with SQL counterparts, trained models, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators import evaluation as ev
from ticketlens.operators import models as ml
from ticketlens.operators import splits as sp
from ticketlens.operators import termindex as ti
from ticketlens.plans.data_queries import SQL_TS
from ticketlens.plans.registry import query, rounded
from ticketlens.plans.text_queries import prepared_documents, sql_counts, sql_tfidf, sql_weights
from ticketlens.plans.views import kept, once, tickets, with_tickets
from ticketlens.sources.tables import table

# ---- policies and metrics on a counting model -------------------------------------------
# Probabilities are the line shares among tickets of the same category and line count, so
# that every number can be said in SQL as well.

_CLASSES = ("(1 линия)", "(2 линия)", "(3 линия)", "(4 линия)")
_SHARES = ", ".join(f"count(CASE WHEN resolved_line = '{c}' THEN 1 END) / cast(greatest(count(resolved_line), 1) AS double) AS p{i}" for i, c in enumerate(_CLASSES, 1))
_VOTES = f"votes AS (SELECT category_original AS vc, lines_count AS vl, {_SHARES} FROM tickets GROUP BY category_original, lines_count)"
_SCORED = """asked AS (SELECT position AS doc, coalesce(resolved_line, '(4 линия)') AS actual, category_grouped, category_original, lines_count, clarifications_cnt,
             p1, p2, p3, p4, greatest(p1, p2, p3, p4) AS best, CASE WHEN category_grouped = 'Прочее' THEN 0 ELSE 1 END AS known_terms
      FROM tickets JOIN votes ON category_original = vc AND lines_count = vl)"""
_LINES = f"""lines AS (SELECT doc, actual, known_terms, category_grouped, category_original, clarifications_cnt, best, p1, p2, p3, p4,
             CASE WHEN known_terms > 0 THEN CASE best WHEN p1 THEN '{_CLASSES[0]}' WHEN p2 THEN '{_CLASSES[1]}' WHEN p3 THEN '{_CLASSES[2]}' ELSE '{_CLASSES[3]}' END END AS line,
             CASE WHEN known_terms > 0 THEN best ELSE 0.0 END AS confidence FROM asked),
      class_rows AS (SELECT resolved_line AS label, count(*) AS n FROM tickets WHERE resolved_line IS NOT NULL AND resolved_line <> '(3 линия)' GROUP BY 1),
      decided AS (SELECT lines.*, coalesce(n, 0) < 10 AS rare_class, line IS NULL OR confidence < 0.6 OR coalesce(n, 0) < 10 AS needs_review
                  FROM lines LEFT JOIN class_rows ON label = line)"""
_BASE = with_tickets("SELECT 1").rsplit("SELECT 1", 1)[0] + f", {_VOTES}, {_SCORED}, {_LINES}"


_ASKED_COLUMNS = ("position", "resolved_line", "category_grouped", "category_original", "lines_count", "clarifications_cnt")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        rows = tickets(spark, folder, *_ASKED_COLUMNS)
        joined = spark.sql(f"WITH tickets AS (SELECT * FROM {{rows}}), {_VOTES}, {_SCORED} SELECT * FROM asked", rows=rows)
        return joined.withColumn("probabilities", F.array("p1", "p2", "p3", "p4"))
    return once(spark, folder, "asked_lines", build)


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    counts = tickets(spark, folder, *_ASKED_COLUMNS).filter("resolved_line IS NOT NULL AND resolved_line <> '(3 линия)'").groupBy(
        F.col("resolved_line").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    rows = ev.recommend(_asked(spark, folder), _CLASSES, counts, 0.6)
    return rows.withColumn("predicted", F.col("line"))


@query("line_recommendation", f"{_BASE} SELECT doc, line, round(confidence, 6) AS confidence, needs_review FROM decided")
def _recommendation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_decided(spark, folder).select("doc", "line", "confidence", "needs_review"))


_SWEEP = f"""sweep AS (SELECT threshold, count(CASE WHEN ok THEN 1 END) AS accepted, count(CASE WHEN ok THEN 1 END) / cast(count(*) AS double) AS coverage,
        count(CASE WHEN ok AND actual = line THEN 1 END) / nullif(cast(count(CASE WHEN ok THEN 1 END) AS double), 0) AS accuracy
      FROM (SELECT threshold, actual, line, confidence >= threshold AND NOT rare_class AND line IS NOT NULL AS ok FROM decided,
            (VALUES {', '.join(f'(cast({t!r} AS double))' for t in ev.THRESHOLDS)}) AS v(threshold)) GROUP BY threshold)"""


@query("threshold_sweep", f"{_BASE}, {_SWEEP} SELECT round(threshold, 6) AS threshold, accepted, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM sweep")
def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.threshold_sweep(_decided(spark, folder)))


@query("best_threshold", f"""{_BASE}, {_SWEEP}
    SELECT round(coalesce((SELECT threshold FROM sweep WHERE accuracy >= 0.85 AND accepted >= 20 ORDER BY coverage DESC, threshold DESC LIMIT 1), 1.01), 6) AS threshold""")
def _best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.best_threshold(ev.threshold_sweep(_decided(spark, folder))))


@query("confusion_matrix", f"{_BASE} SELECT actual, coalesce(line, 'Нет рекомендации') AS predicted, count(*) AS n FROM decided GROUP BY 1, 2")
def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion(_decided(spark, folder))


def sql_report(source: str, extra: str = "") -> str:
    return f"""SELECT label, coalesce(tp / nullif(cast(pr AS double), 0), 0) AS "precision", coalesce(tp / nullif(cast(su AS double), 0), 0) AS recall,
        coalesce(2 * tp / nullif(cast(pr + su AS double), 0), 0) AS f1, su AS support FROM (
          SELECT label, (SELECT count(*) FROM {source} WHERE actual = label AND predicted = label) AS tp, (SELECT count(*) FROM {source} WHERE predicted = label) AS pr,
                 (SELECT count(*) FROM {source} WHERE actual = label) AS su
          FROM (SELECT actual AS label FROM {source} UNION SELECT predicted FROM {source} WHERE predicted IS NOT NULL {extra}))"""


_PREDICTED = "p AS (SELECT actual, line AS predicted, needs_review FROM decided)"


@query("class_report", f"""{_BASE}, {_PREDICTED}
    SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({sql_report('p', "UNION SELECT 'extra'")})""")
def _class_report(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "region").select(F.lit("extra").alias("label")).distinct()
    return rounded(ev.class_report(ev.confusion(_decided(spark, folder)), known))


@query("line_evaluation", f"""{_BASE}, {_PREDICTED}
    SELECT count(*) AS n, round(count(CASE WHEN actual = predicted THEN 1 END) / cast(count(*) AS double), 6) AS accuracy,
           round((SELECT avg(f1) FROM ({sql_report('p')}) WHERE support > 0), 6) AS macro_f1_supported,
           round(count(CASE WHEN NOT needs_review THEN 1 END) / cast(count(*) AS double), 6) AS automatic_coverage,
           round(count(CASE WHEN NOT needs_review AND actual = predicted THEN 1 END) / nullif(cast(count(CASE WHEN NOT needs_review THEN 1 END) AS double), 0), 6) AS accepted_accuracy FROM p""")
def _line_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.evaluation(_decided(spark, folder)))


_CATEGORY = f"""{_BASE}, c AS (SELECT doc, CASE WHEN category_grouped = 'Прочее' THEN 'Прочее / Неопределено' ELSE actual END AS actual,
      CASE WHEN category_original = 'NATION_1' THEN 'Прочее' WHEN category_original = 'NATION_2' THEN 'Прочее / Неопределено' ELSE coalesce(line, '{_CLASSES[0]}') END AS predicted,
      best AS confidence, coalesce(clarifications_cnt, 0) AS known_words, greatest(best / 2, 0.01) AS p_actual FROM decided),
    r AS (SELECT *, CASE WHEN known_words < 2 THEN 'insufficient-features' WHEN predicted = 'Прочее / Неопределено' THEN 'outside-top-15'
      WHEN predicted = 'Прочее' THEN 'ambiguous-category' WHEN confidence < 0.7 THEN 'low-confidence' END AS reason FROM c)"""


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decided(spark, folder)
    return rows.select(
        "doc", F.when(F.col("category_grouped") == "Прочее", sp.OUTSIDE_TOP).otherwise(F.col("actual")).alias("actual"),
        F.when(F.col("category_original") == "NATION_1", ev.BROAD_CATEGORY).when(F.col("category_original") == "NATION_2", sp.OUTSIDE_TOP)
        .otherwise(F.coalesce("line", F.lit(_CLASSES[0]))).alias("predicted"),
        F.col("best").alias("confidence"), F.coalesce("clarifications_cnt", F.lit(0)).alias("known_words"),
        F.greatest(F.col("best") / 2, F.lit(0.01)).alias("p_actual"))


@query("category_decision", f"""{_CATEGORY}
    SELECT doc, reason, CASE WHEN reason IS NULL THEN predicted END AS category, reason IS NOT NULL AS needs_manual_review,
           round(CASE WHEN reason = 'insufficient-features' THEN 0 ELSE confidence END, 6) AS confidence FROM r""")
def _category_decision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.category_decision(_categories(spark, folder)).select("doc", "reason", "category", "needs_manual_review", "confidence"))


_METRICS_SQL = f"""{_CATEGORY}, top AS (SELECT * FROM r WHERE actual <> 'Прочее / Неопределено'), auto AS (SELECT * FROM r WHERE reason IS NULL),
    outside AS (SELECT * FROM r WHERE actual = 'Прочее / Неопределено')
    SELECT metric, round(amount, 6) AS amount FROM (
      SELECT 'holdout_accuracy' AS metric, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) AS amount FROM r
      UNION ALL SELECT 'holdout_top15_accuracy', avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM top
      UNION ALL SELECT 'holdout_log_loss', -avg(ln(p_actual)) FROM r
      UNION ALL SELECT 'coverage', (SELECT count(*) FROM auto) / cast(count(*) AS double) FROM r
      UNION ALL SELECT 'fallback_rate', 1 - (SELECT count(*) FROM auto) / cast(count(*) AS double) FROM r
      UNION ALL SELECT 'automatic_count', count(*) FROM auto
      UNION ALL SELECT 'automatic_correct', count(CASE WHEN actual = predicted THEN 1 END) FROM auto
      UNION ALL SELECT 'automatic_accuracy', avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM auto
      UNION ALL SELECT 'outside_top15_count', count(*) FROM outside
      UNION ALL SELECT 'outside_top15_sent_to_manual', count(reason) FROM outside
      UNION ALL SELECT 'outside_top15_manual_recall', count(reason) / cast(count(*) AS double) FROM outside
      UNION ALL SELECT 'holdout_macro_f1', avg(f1) FROM ({sql_report('r')})
      UNION ALL SELECT 'holdout_top15_macro_f1', avg(f1) FROM ({sql_report('top')}) WHERE label <> 'Прочее / Неопределено'
      UNION ALL SELECT 'manual/' || reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY 1)"""


@query("category_evaluation", _METRICS_SQL)
def _category_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.category_evaluation(_categories(spark, folder)))


@query("class_holdout", f"""{_CATEGORY}
    SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support,
           (SELECT count(*) FROM r WHERE actual = label AND reason IS NULL) AS automatic_count FROM ({sql_report('r')})""")
def _class_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.class_holdout(_categories(spark, folder)))


@query("majority_baseline", with_tickets("""
    SELECT round(avg(CASE WHEN resolved_line = (SELECT resolved_line FROM tickets WHERE position % 5 <> 0 AND resolved_line IS NOT NULL
                 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1.0 ELSE 0.0 END), 6) AS majority_accuracy
    FROM tickets WHERE position % 5 = 0 AND resolved_line IS NOT NULL"""))
def _majority(spark: SparkSession, folder: str) -> DataFrame:
    rows = tickets(spark, folder, "position", "resolved_line").filter("resolved_line IS NOT NULL")
    return rounded(ev.majority_accuracy(rows.filter("position % 5 <> 0"), rows.filter("position % 5 = 0"), "resolved_line"))


_FALLBACK = f"""{_CATEGORY}, a AS (SELECT actual, CASE WHEN confidence >= 0.75 AND predicted <> 'Прочее / Неопределено' THEN predicted ELSE 'ОПЕРАТОР' END AS answer FROM c),
    auto AS (SELECT actual, answer AS predicted FROM a WHERE answer <> 'ОПЕРАТОР'), inside AS (SELECT * FROM auto WHERE actual <> 'Прочее / Неопределено')"""


@query("operator_fallback", f"""{_FALLBACK}
    SELECT round(avg(CASE WHEN answer = 'ОПЕРАТОР' THEN 1.0 ELSE 0 END), 6) AS fallback_rate,
           round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM auto), 6) AS accuracy, round((SELECT avg(f1) FROM ({sql_report('auto')})), 6) AS macro_f1,
           round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM inside), 6) AS business_accuracy, round((SELECT avg(f1) FROM ({sql_report('inside')})), 6) AS business_macro_f1 FROM a""")
def _fallback(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.fallback_metrics(ev.operator_fallback(_categories(spark, folder), 0.75)))


@query("triage_decisions", f"""{_CATEGORY}
    SELECT doc, CASE WHEN reason IS NULL THEN predicted END AS category, d.line, round(CASE WHEN reason = 'insufficient-features' THEN 0 ELSE r.confidence END, 6) AS category_confidence,
           round(d.confidence, 6) AS line_confidence, reason IS NOT NULL OR (CASE WHEN reason = 'insufficient-features' THEN 0 ELSE r.confidence END) < 0.5
             OR needs_review OR d.confidence < 0.5 OR d.line IS NULL AS manual_review_required
    FROM r JOIN decided d USING (doc)""")
def _triage(spark: SparkSession, folder: str) -> DataFrame:
    decisions = ev.category_decision(_categories(spark, folder))
    rows = ev.triage(decisions, _decided(spark, folder))
    return rounded(rows.select("doc", "category", "line", "category_confidence", "line_confidence", "manual_review_required"))


@query("line_evidence", f"""WITH counts AS ({sql_counts('documents', 'doc_id')}), weights AS ({sql_weights('counts', '(SELECT count(*) FROM documents)', 2)}),
    tfidf AS ({sql_tfidf('counts', 'weights')}), sums AS (SELECT lang, term, sum(weight) AS w FROM tfidf JOIN documents ON doc_id = doc GROUP BY 1, 2),
    coef AS (SELECT lang AS label, term, w / (SELECT count(*) FROM documents d WHERE d.lang = sums.lang) - 0.001 AS coefficient FROM sums)
    SELECT doc, place, term, round(contribution, 6) AS contribution FROM (
      SELECT doc, term, weight * coefficient AS contribution, cast(row_number() OVER (PARTITION BY doc ORDER BY round(weight * coefficient, 12) DESC, term) AS bigint) AS place
      FROM tfidf JOIN documents ON doc_id = doc JOIN coef USING (term) WHERE label = lang AND weight * coefficient > 0) WHERE place <= 5""")
def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence under coefficients that are the mean term weights of each language."""
    docs = table(spark, folder, "documents")
    postings, _ = ti.fit_index(docs, "doc_id", "text", min_df=2)
    answers = docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("label"))
    labelled = once(spark, folder, "labelled_postings", lambda: postings.join(answers, "doc").withColumn("space", F.lit("word")))
    sizes = F.broadcast(answers.groupBy("label").agg(F.count(F.lit(1)).alias("_n")))
    coefficients = labelled.groupBy("label", "space", "term").agg(F.sum("weight").alias("_w")).join(sizes, "label").select(
        "label", "space", "term", (F.col("_w") / F.col("_n") - 0.001).alias("coefficient"))
    return rounded(ml.evidence(labelled, None, coefficients).select("doc", "place", "term", "contribution"))


# ---- trained models ---------------------------------------------------------------------

def line_model(spark: SparkSession, folder: str):
    """Language as the support line: train on the train split, choose on validation."""
    def build():
        rows = prepared_documents(spark, folder).select("id", "text_clean", "lang", "split")
        return ml.fit_line_model(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), "id", "text_clean", "lang")
    return kept(spark, folder, "line_model", build)


#: Languages that are categories of their own; the rest are the outside class, which the model learns too.
TOP_LANGUAGES = 3


def _with_category(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared rows with the category: the most frequent languages of the training part, or the outside class."""
    rows = prepared_documents(spark, folder).select("id", "text_clean", "lang", "split")
    return sp.with_target(rows, "lang", TOP_LANGUAGES).withColumnRenamed("target", "category")


def category_model(spark: SparkSession, folder: str) -> ml.CategoryModel:
    def build():
        return ml.fit_category_model(_with_category(spark, folder).filter("split = 'train'"), "id", "text_clean", "category")
    return kept(spark, folder, "category_model", build)


def _test_rows(spark: SparkSession, folder: str) -> DataFrame:
    return prepared_documents(spark, folder).filter("split = 'test'").select("id", "text_clean", "lang")


@query("line_model_candidates")
def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return line_model(spark, folder)[1]


@query("line_model_sweep")
def _model_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return line_model(spark, folder)[2]


@query("line_model_evaluation")
def _model_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _test_rows(spark, folder)
    scored = line_model(spark, folder)[0].score(rows.select("id", "lang"), "id", "text_clean", ml.line_counts(rows, "id", "text_clean"))
    return ev.evaluation(scored.withColumns({"actual": F.col("lang"), "predicted": F.col("line")}))


@query("line_model_evidence")
def _model_evidence(spark: SparkSession, folder: str) -> DataFrame:
    model = line_model(spark, folder)[0]
    rows = _test_rows(spark, folder)
    counts = ml.line_counts(rows, "id", "text_clean")
    answers = model.score(rows.select("id"), "id", "text_clean", counts).filter("line IS NOT NULL").select(F.col("id").alias("doc"), F.col("line").alias("label"))
    return ml.evidence(ml.weigh(counts, model.features), answers, model.coefficients())


@query("category_model_evaluation")
def _category_model(spark: SparkSession, folder: str) -> DataFrame:
    model = category_model(spark, folder)
    scored = model.score(_with_category(spark, folder).filter("split = 'test'"), "id", "text_clean")
    position = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("category")).cast("int")
    return ev.category_evaluation(scored.withColumns({"actual": F.col("category"), "p_actual": F.element_at("probabilities", position)}))


@query("embedding_model_fallback")
def _embedding_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    rows = once(spark, folder, "embedding_split", lambda: sp.stratified_holdout(rows.withColumn("text", F.col("vec_id").cast("string"))).drop("text"))
    scored = ml.score_embeddings(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "vec_id", "embedding", "label")
    return ev.fallback_metrics(ev.operator_fallback(scored.withColumn("actual", F.col("label"))))


@query("triage_of_texts")
def _triage_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole decision for the test texts: category model, line model and similar training texts."""
    from ticketlens.streaming.jobs import triage_texts
    rows = _test_rows(spark, folder)
    train = prepared_documents(spark, folder).filter("split = 'train'")
    index = ti.fit_index(train, "id", "text_clean")
    decided = triage_texts(rows, "id", "text_clean", category_model(spark, folder), line_model(spark, folder)[0], *index)
    return decided.withColumn("similar", F.size(F.coalesce("similar", F.array().cast("array<struct<rank:int,doc:bigint,score:double>>"))))


_EVENT_CELLS = ", ".join(f"coalesce(length(x) || ':' || x, '-')".replace("x", f"cast({c} AS varchar)")
                         for c in ("event_id", "nullif(event_type, '')", "nullif(props, '')", f"({SQL_TS})", "user_id", "value"))


@query("incremental_import", " UNION ALL ".join(f"""
    SELECT substr(sha256(concat_ws('|', '{len(name)}:{name}', '6:stream', {_EVENT_CELLS})), 1, 20) AS _record_id, event_type, user_id, value, props, {SQL_TS} AS ts,
           1 AS n FROM events""" for name in ("web events", "app events")))
def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams of events into one table, each started twice: a second start finds every record of its own already there."""
    from ticketlens.session import scratch_path
    from ticketlens.streaming.jobs import import_stream
    target = scratch_path(spark, "imported")
    for name in ("web events", "app events"):
        for run in ("first", "second"):
            source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
            import_stream(source, target, f"{target}-state/{name[:3]}/{run}", name, "stream", "event_id")
    stored = spark.read.parquet(target)
    return stored.groupBy("_record_id", "event_type", "user_id", "value", "props", "ts").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("continuous_triage")
def _continuous(spark: SparkSession, folder: str) -> DataFrame:
    from ticketlens.session import scratch_path
    from ticketlens.streaming.jobs import triage_stream
    target = scratch_path(spark, "triaged")
    train = prepared_documents(spark, folder).filter("split = 'train'")
    postings, weights = ti.fit_index(train, "id", "text_clean")
    source = spark.readStream.schema(table(spark, folder, "benchmark").schema).option("pathGlobFilter", "benchmark.parquet").parquet(folder)
    triage_stream(source, "item_id", "text", target, f"{target}-state", category_model(spark, folder), line_model(spark, folder)[0],
                  once(spark, folder, "triage_postings", lambda: postings), weights)
    return spark.read.parquet(target).select("item_id", "category", "line", "category_confidence", "line_confidence", "manual_review_required",
                                             F.size("similar").alias("similar"))
