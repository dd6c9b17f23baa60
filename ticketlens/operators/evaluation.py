"""Scoring policies and evaluation, computed from small count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.splits import OUTSIDE_TOP

# Label of a missing recommendation, the broad class and the operator fallback.
NO_RECOMMENDATION = "Нет рекомендации"
BROAD_CATEGORY = "Прочее"
OPERATOR = "ОПЕРАТОР"

THRESHOLDS = tuple(0.35 + 0.05 * i for i in range(13))
ALWAYS_REVIEW = 1.01
MIN_ACCURACY = 0.85
MIN_ACCEPTED = 20
MIN_CLASS_ROWS = 10
CATEGORY_THRESHOLD = 0.70
MIN_KNOWN_WORDS = 2
TRIAGE_CONFIDENCE = 0.5


def confusion(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n); a missing prediction counts under its own label."""
    return scored.groupBy(F.col(actual).alias("actual"), F.coalesce(F.col(predicted), F.lit(NO_RECOMMENDATION)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label; zero where there is nothing to divide by.

    Labels are those that occur, without the missing recommendation, joined by
    ``known`` (one column ``label``) for classes that were never seen or predicted.
    """
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("_s"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("_hit"))
    # Both sides of a matrix cell carry its hit, so the hits are halved below.
    rows = sides.select("_s.label", "_s.support", "_s.predicted", "_hit")
    if known is not None:
        zero = F.lit(0).cast("bigint")
        rows = rows.unionByName(known.select("label", zero.alias("support"), zero.alias("predicted"), zero.alias("_hit")))
    sums = rows.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                     (F.sum("_hit") / 2).alias("_hits")).filter(F.col("label") != NO_RECOMMENDATION)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))

    hits = F.col("_hits")
    return sums.select(
        "label", ratio(hits, F.col("predicted")).alias("precision"), ratio(hits, F.col("support")).alias("recall"),
        ratio(2 * hits, F.col("predicted") + F.col("support")).alias("f1"), "support")


def evaluation(scored: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over supported classes, automatic coverage and accuracy of accepted answers.

    ``scored`` has actual, predicted and needs_review.
    """
    cells = scored.groupBy("actual", F.coalesce("predicted", F.lit(NO_RECOMMENDATION)).alias("predicted"), "needs_review").agg(
        F.count(F.lit(1)).alias("n"))
    matrix = cells.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    macro = class_report(matrix).filter("support > 0").agg(F.avg("f1").alias("f1")).scalar()
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    taken = F.when(~F.col("needs_review"), F.col("n")).otherwise(0)
    taken_right = F.when(~F.col("needs_review") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)
    return cells.agg(F.sum("n").alias("n"), F.sum(right).alias("_right"), F.sum(taken).alias("_taken"), F.sum(taken_right).alias("_taken_right")).select(
        "n", (F.col("_right") / F.col("n")).alias("accuracy"), macro.alias("macro_f1_supported"),
        (F.col("_taken") / F.col("n")).alias("automatic_coverage"),
        F.try_divide(F.col("_taken_right"), F.nullif(F.col("_taken"), F.lit(0))).alias("accepted_accuracy"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Coverage and accuracy of accepted answers at each threshold, in one pass.

    ``scored`` has actual, predicted, confidence and rare_class.
    """
    def accepted(t: float) -> Column:
        return (F.col("confidence") >= F.lit(t)) & ~F.col("rare_class") & F.col("predicted").isNotNull()

    right = F.col("actual") == F.col("predicted")
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(accepted(t)).alias(f"a{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(accepted(t) & right).alias(f"r{i}") for i, t in enumerate(thresholds)])
    cells = [F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("accepted"), F.col(f"r{i}").alias("right")) for i, t in enumerate(thresholds)]
    rows = sums.select("n", F.explode(F.array(*cells)).alias("_c")).select("n", "_c.*")
    return rows.select("threshold", "accepted", (F.col("accepted") / F.col("n")).alias("coverage"),
                       F.try_divide(F.col("right"), F.nullif(F.col("accepted"), F.lit(0))).alias("accuracy"))


def best_threshold(sweep: DataFrame, min_accuracy: float = MIN_ACCURACY, min_accepted: int = MIN_ACCEPTED) -> DataFrame:
    """Threshold of the largest coverage among the good enough ones; without any, review everything."""
    good = sweep.filter((F.col("accuracy") >= min_accuracy) & (F.col("accepted") >= min_accepted))
    return good.agg(F.coalesce(F.max_by("threshold", F.struct("coverage", "threshold")), F.lit(ALWAYS_REVIEW)).alias("threshold"))


def recommend(scored: DataFrame, classes: Sequence[str], class_rows: DataFrame, threshold: float | Column,
              known: str = "known_terms", probabilities: str = "probabilities") -> DataFrame:
    """Line with the highest probability, its confidence and whether a person has to look.

    ``class_rows`` (label, rows) counts training rows per class. A text without
    known terms gets no line; a class with few training rows is never automatic.
    """
    best = F.array_max(probabilities)
    names = F.array(*[F.lit(c) for c in classes])
    any_term = F.col(known) > 0
    rows = scored.withColumns({
        "line": F.when(any_term, F.element_at(names, F.array_position(F.col(probabilities), best).cast("int"))),
        "confidence": F.when(any_term, best).otherwise(0.0)})
    counts = class_rows.select(F.col("label").alias("_label"), "rows")
    joined = rows.join(counts, F.col("line") == F.col("_label"), "left")
    review = F.col("line").isNull() | (F.col("confidence") < threshold) | (F.coalesce("rows", F.lit(0)) < MIN_CLASS_ROWS)
    return joined.withColumn("needs_review", review).withColumn(
        "rare_class", F.coalesce("rows", F.lit(0)) < MIN_CLASS_ROWS).drop("_label", "rows")


def review_reason(category: Column | str, confidence: Column | str, known_words: Column | str,
                  threshold: float = CATEGORY_THRESHOLD) -> Column:
    """Why a category needs a person, null when it does not. The first rule that applies wins."""
    category = F.col(category) if isinstance(category, str) else category
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    known_words = F.col(known_words) if isinstance(known_words, str) else known_words
    return (F.when(known_words < MIN_KNOWN_WORDS, "insufficient-features").when(category == OUTSIDE_TOP, "outside-top-15")
            .when(category == BROAD_CATEGORY, "ambiguous-category").when(confidence < threshold, "low-confidence"))


def category_decision(scored: DataFrame, threshold: float = CATEGORY_THRESHOLD) -> DataFrame:
    """Adds reason, accepted category and reported confidence to predicted, confidence and known_words."""
    rows = scored.withColumn("reason", review_reason("predicted", "confidence", "known_words", threshold))
    return rows.withColumns({
        "category": F.when(F.col("reason").isNull(), F.col("predicted")),
        "confidence": F.when(F.col("reason") == "insufficient-features", 0.0).otherwise(F.col("confidence")),
        "needs_manual_review": F.col("reason").isNotNull()})


def category_evaluation(scored: DataFrame) -> DataFrame:
    """Holdout metrics of the category model as (metric, amount).

    ``scored`` has actual, predicted, confidence, known_words and p_actual, the
    probability given to the actual class.
    """
    rows = scored.withColumn("reason", review_reason("predicted", "confidence", "known_words"))
    cells = rows.groupBy("actual", "predicted", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log(F.greatest(F.col("p_actual"), F.lit(2.220446049250313e-16)))).alias("loss"))
    inside = F.col("actual") != OUTSIDE_TOP
    right = F.col("actual") == F.col("predicted")
    auto = F.col("reason").isNull()

    def total(condition: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col("n") if condition is None else F.when(condition, F.col("n"))), F.lit(0))

    def per(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))

    matrix = cells.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    macro = class_report(matrix).agg(F.avg("f1").alias("f1")).scalar()
    macro_top = class_report(matrix.filter(inside)).filter(F.col("label") != OUTSIDE_TOP).agg(F.avg("f1").alias("f1")).scalar()
    wide = cells.agg(
        per(total(right), total()).alias("holdout_accuracy"), per(total(right & inside), total(inside)).alias("holdout_top15_accuracy"),
        (F.sum("loss") / total()).alias("holdout_log_loss"), per(total(auto), total()).alias("coverage"),
        (1 - per(total(auto), total())).alias("fallback_rate"), total(auto).cast("double").alias("automatic_count"),
        total(auto & right).cast("double").alias("automatic_correct"), per(total(auto & right), total(auto)).alias("automatic_accuracy"),
        total(~inside).cast("double").alias("outside_top15_count"), total(~inside & ~auto).cast("double").alias("outside_top15_sent_to_manual"),
        per(total(~inside & ~auto), total(~inside)).alias("outside_top15_manual_recall"),
    ).withColumns({"holdout_macro_f1": macro, "holdout_top15_macro_f1": macro_top})
    metrics = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("amount")) for c in wide.columns])).alias("_m")).select("_m.*")
    reasons = cells.filter("reason IS NOT NULL").groupBy(F.concat(F.lit("manual/"), "reason").alias("metric")).agg(F.sum("n").cast("double").alias("amount"))
    return metrics.unionByName(reasons)


def class_holdout(scored: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per-class report with the number of accepted rows of each actual class."""
    rows = scored.withColumn("reason", review_reason("predicted", "confidence", "known_words"))
    accepted = rows.filter("reason IS NULL").groupBy("actual").agg(F.count(F.lit(1)).alias("automatic_count"))
    return class_report(confusion(rows), known).join(accepted, F.col("label") == F.col("actual"), "left").select(
        "label", "precision", "recall", "f1", "support", F.coalesce("automatic_count", F.lit(0)).alias("automatic_count"))


def majority_accuracy(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Accuracy of always answering the most frequent training label."""
    majority = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label)).limit(1).select(label).scalar()
    return test.agg(F.avg((F.col(label) == majority).cast("double")).alias("majority_accuracy"))


def operator_fallback(scored: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Answers below the threshold or outside the frequent classes go to the operator."""
    sure = (F.col("confidence") >= threshold) & (F.col("predicted") != OUTSIDE_TOP)
    return scored.withColumn("answer", F.when(sure, F.col("predicted")).otherwise(OPERATOR))


def fallback_metrics(answers: DataFrame) -> DataFrame:
    """Operator share, accuracy and macro F1 of automatic answers, and the same on frequent classes."""
    auto = answers.filter(F.col("answer") != OPERATOR).select("actual", F.col("answer").alias("predicted"))
    inside = auto.filter(F.col("actual") != OUTSIDE_TOP)

    def macro(rows: DataFrame) -> Column:
        return class_report(confusion(rows)).agg(F.avg("f1").alias("f1")).scalar()

    def accuracy(rows: DataFrame) -> Column:
        return rows.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("a")).scalar()

    share = answers.agg(F.avg((F.col("answer") == OPERATOR).cast("double")).alias("fallback_rate"))
    return share.select("fallback_rate", accuracy(auto).alias("accuracy"), macro(auto).alias("macro_f1"),
                        accuracy(inside).alias("business_accuracy"), macro(inside).alias("business_macro_f1"))


def triage(categories: DataFrame, lines: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One decision per ticket from category, line and similar cases.

    ``categories``: doc, category, confidence, needs_manual_review; ``lines``:
    doc, line, confidence, needs_review; ``hits``: query, doc, rank, score, at
    most five per query.
    """
    left = categories.select("doc", "category", F.col("confidence").alias("category_confidence"), F.col("needs_manual_review").alias("category_review"))
    right = lines.select("doc", "line", F.col("confidence").alias("line_confidence"), F.col("needs_review").alias("line_review"))
    rows = left.join(right, "doc").withColumn(
        "manual_review_required",
        F.col("category_review") | (F.col("category_confidence") < TRIAGE_CONFIDENCE) | F.col("line_review")
        | (F.col("line_confidence") < TRIAGE_CONFIDENCE) | F.col("line").isNull())
    if hits is None:
        return rows
    packed = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("similar"))
    return rows.join(packed.withColumnRenamed("query", "_query"), F.col("doc") == F.col("_query"), "left").drop("_query")
