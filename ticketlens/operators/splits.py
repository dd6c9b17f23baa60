"""Quality flags, group-wise splits and stratified holdouts, all reproducible by hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import casefold, strip
from ticketlens.operators.enrich import TOP_CATEGORIES, top_values
from ticketlens.operators.scaling import attach_by_key, hash_bucket, ranked
from ticketlens.session import materialize

SEED = 42
SHORT_TEXT = 30
HOLDOUT_SHARE = 0.15
TEST_SHARE = 0.2
RARE_LABEL = 5

# Texts that are an empty or a test form, and the service that stands for none.
PLACEHOLDERS = ("фио: , комментарий:", "фио: тест, комментарий: тест")
UNKNOWN_SERVICE = "---)"
# Fixed value: the class of labels outside the frequent ones, and labels no source row may carry.
OUTSIDE_TOP = "Прочее / Неопределено"
FORBIDDEN_LABELS = (OUTSIDE_TOP, "ОПЕРАТОР")


def seeded_hash(value: Column | str, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), value if isinstance(value, Column) else F.col(value)), 256)


def _is_placeholder(text: Column) -> Column:
    """Whether a text is one of the placeholders; only texts short enough to be one are folded."""
    longest = 2 * max(map(len, PLACEHOLDERS))
    return F.coalesce(casefold(F.when(F.length(text) <= longest, text)).isin(*PLACEHOLDERS), F.lit(False))


def group_facts(rows: DataFrame, group: str = "duplicate_group", category: str = "category") -> DataFrame:
    """Size, label conflict and placeholder mark of every duplicate group."""
    placeholder = _is_placeholder(F.col("text_clean")).cast("int")
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("group_size"), F.min(category).alias("group_category"),
        (F.min(category) != F.max(category)).alias("conflict"), (F.max(placeholder) == 1).alias("placeholder"))


def quality_flags(category_conflict: Column, group_size: Column) -> Column:
    """Flags of one row; needs text_clean, service and component next to the group facts."""
    text = F.col("text_clean")
    return F.array_compact(F.array(
        F.when(category_conflict, "conflicting_category"),
        F.when(group_size > 1, "repeated_text"),
        F.when(F.length(text) < SHORT_TEXT, "short_text_review"),
        F.when(_is_placeholder(text), "empty_or_test_template"),
        F.when(F.col("service") == UNKNOWN_SERVICE, "unknown_service"),
        F.when(strip(F.coalesce("component", F.lit(""))) == "", "missing_service_component")))


def assign_splits(groups: DataFrame, group: str = "duplicate_group", seed: int = SEED) -> DataFrame:
    """Split of every group: review for conflicts and placeholders, else by hash rank inside its category.

    A category with at least three groups gives ``max(1, round(0.15 n))`` groups
    to test and as many to validation; the rest trains. Ranks are exact and
    computed per hash bucket, so one large category does not gather in one task.
    """
    eligible = groups.filter(~F.col("conflict") & ~F.col("placeholder")).withColumn("_hash", seeded_hash(group, seed))
    placed = ranked(eligible, ["group_category"], hash_bucket("_hash"), [F.col("_hash"), F.col(group)], "_rank", "_total")
    share = F.when(F.col("_total") >= 3, F.greatest(F.lit(1.0), F.rint(F.col("_total") * F.lit(HOLDOUT_SHARE)))).otherwise(0.0)
    split = F.when(F.col("_rank") <= share, "test").when(F.col("_rank") <= 2 * share, "validation").otherwise("train")
    review = groups.filter(F.col("conflict") | F.col("placeholder")).select("*", F.lit("review").alias("split"))
    return placed.select(*groups.columns, split.alias("split")).unionByName(review)


def prepare_rows(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Flags, split and top-15 mark for rows with id, text_clean, category, service, component, duplicate_group."""
    groups = assign_splits(group_facts(rows), seed=seed)
    facts = materialize(groups.select("duplicate_group", "group_size", "conflict", "split"), "group_splits")
    joined = attach_by_key(rows, facts, "duplicate_group", ["id"])
    top = F.broadcast(top_values(rows, "category", TOP_CATEGORIES).select(F.col("category").alias("_top")))
    marked = joined.join(top, F.col("category") == F.col("_top"), "left")
    return marked.select(*rows.columns, quality_flags(F.col("conflict"), F.col("group_size")).alias("quality_flags"),
                         "split", F.col("_top").isNotNull().cast("int").alias("is_top15"))


def shared_groups(prepared: DataFrame, group: str = "duplicate_group", split: str = "split") -> DataFrame:
    """Groups that occur in more than one split: empty for a sound split."""
    return prepared.groupBy(group).agg(F.min(split).alias("_low"), F.max(split).alias("_high")).filter("_low <> _high").select(group)


def labels_without_training(prepared: DataFrame, label: str = "category", split: str = "split") -> DataFrame:
    """Labels of validation or test rows that no training row has."""
    held = prepared.filter(F.col(split).isin("validation", "test")).select(label).distinct()
    return held.join(prepared.filter(F.col(split) == "train").select(label).distinct(), label, "left_anti")


def eligible_rows(rows: DataFrame, text: str = "description", label: str = "label") -> DataFrame:
    """Rows with text and label; the label is trimmed."""
    present = (strip(F.coalesce(text, F.lit(""))) != "") & (strip(F.coalesce(label, F.lit(""))) != "")
    return rows.filter(present).withColumn(label, strip(label))


def forbidden_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.filter(F.col(label).isin(*FORBIDDEN_LABELS)).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def consistent_features(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row per feature text; a text with different labels is left out altogether."""
    facts = rows.groupBy(text).agg(F.min(label).alias(label), F.max(label).alias("_high"), F.count(F.lit(1)).alias("rows"))
    return facts.filter(F.col(label) == F.col("_high")).drop("_high")


def stratified_holdout(prepared: DataFrame, text: str = "text", label: str = "label", seed: int = SEED) -> DataFrame:
    """80/20 split by hash rank per label; labels with fewer than five texts share one stratum."""
    counts = prepared.groupBy(label).agg(F.count(F.lit(1)).alias("_count"))
    known = attach_by_key(prepared, counts, label, [text])
    known = known.withColumn("stratum", F.when(F.col("_count") >= RARE_LABEL, F.col(label)).otherwise(OUTSIDE_TOP))
    known = known.withColumn("_hash", seeded_hash(text, seed))
    placed = ranked(known, ["stratum"], hash_bucket("_hash"), [F.col("_hash"), F.col(text)], "_rank", "_total")
    test = F.col("_rank") <= F.rint(F.col("_total") * F.lit(TEST_SHARE))
    return placed.select(*prepared.columns, "stratum", F.when(test, "test").otherwise("train").alias("split"))


def train_top_labels(split_rows: DataFrame, label: str = "label", limit: int = TOP_CATEGORIES) -> DataFrame:
    """Most frequent labels of the training part alone."""
    return top_values(split_rows.filter("split = 'train'"), label, limit)


def with_target(split_rows: DataFrame, label: str = "label", limit: int = TOP_CATEGORIES) -> DataFrame:
    top = F.broadcast(train_top_labels(split_rows, label, limit).select(F.col(label).alias("_top")))
    return split_rows.join(top, F.col(label) == F.col("_top"), "left").withColumn(
        "target", F.coalesce("_top", F.lit(OUTSIDE_TOP))).drop("_top")


def fold_of(rows: DataFrame, label: str, key: str, folds: int = 3, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Stratified fold number: rows of each label are dealt out in hash order."""
    hashed = rows.withColumn("_hash", seeded_hash(F.col(key).cast("string"), seed))
    placed = ranked(hashed, [label], hash_bucket("_hash"), [F.col("_hash"), F.col(key)], "_rank")
    return placed.select(*rows.columns, ((F.col("_rank") - 1) % folds).cast("int").alias(name))


def hash_sample(rows: DataFrame, key: str, size: int = 30) -> DataFrame:
    """The ``size`` rows with the smallest digest of their id."""
    return rows.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(size)


def first_per_bucket(rows: DataFrame, buckets: dict[str, Column], order: str, size: int = 4) -> DataFrame:
    """First rows of every outcome bucket; a row may be in several.

    Each bucket is a bounded top-N of its own, so no bucket is sorted as a whole.
    """
    parts = [rows.filter(condition).orderBy(order).limit(size).select(F.lit(name).alias("bucket"), *rows.columns)
             for name, condition in buckets.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def row_accounting(source: DataFrame, text: str = "description", label: str = "label", feature: str = "text") -> DataFrame:
    """Source rows split into prepared, invalid, conflicting and repeated ones; the parts add up."""
    valid = eligible_rows(source, text, label)
    facts = valid.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    sums = facts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("conflict"), F.col("n"))), F.lit(0)).alias("conflict_rows_removed"),
        F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows_removed"),
        F.coalesce(F.sum((~F.col("conflict")).cast("bigint")), F.lit(0)).alias("prepared_rows"))
    total = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sums.select(total.alias("source_rows"), "prepared_rows", (total - F.col("valid")).alias("invalid_rows_removed"),
                       "conflict_rows_removed", "duplicate_rows_removed")


