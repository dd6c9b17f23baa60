"""Queries over texts: near duplicates, splits, training sets, TF-IDF and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.operators import neighbours as nb
from ticketlens.operators import quality as qu
from ticketlens.operators import splits as sp
from ticketlens.operators import termindex as ti
from ticketlens.plans.registry import query, rounded, sql_collapse, sql_fold
from ticketlens.plans.views import kept, once
from ticketlens.session import materialize
from ticketlens.sources.tables import table

_WORD = r"[\p{L}\p{N}_]+"

# ---- near duplicates --------------------------------------------------------------------

PAIRS_SQL = f"""normal AS (SELECT doc_id, source, lang, text, {sql_collapse(sql_fold('text'))} AS t FROM documents),
  toks AS (SELECT doc_id, t, list_sort(list_distinct(regexp_extract_all(t, '{_WORD}'))) AS ts FROM normal),
  sets AS (SELECT array_to_string(ts, ' ') AS k, min(doc_id) AS rep, count(*) AS copies, any_value(ts) AS ts, any_value(len(ts)) AS size
           FROM toks WHERE len(ts) > 0 GROUP BY 1),
  post AS (SELECT rep, size, unnest(ts) AS tok FROM sets),
  meetings AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.size AS na, b.size AS nb, count(*) AS o
         FROM post a JOIN post b ON a.tok = b.tok AND a.rep < b.rep GROUP BY ALL),
  pairs AS (SELECT rep_a, rep_b, o / cast(na + nb - o AS double) AS score FROM meetings WHERE o / cast(na + nb - o AS double) >= 0.85)"""


def _token_sets(spark: SparkSession, folder: str) -> nb.TokenSets:
    return kept(spark, folder, "token_sets", lambda: nb.token_sets(table(spark, folder, "documents"), "doc_id", "text"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "pairs", lambda: nb.similar_sets(_token_sets(spark, folder).sets))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "links", lambda: nb.spanning_links(_token_sets(spark, folder).sets))


@query("token_sets", f"WITH {PAIRS_SQL} SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS digest FROM toks")
def _token_set(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.token_set(tx.normalize_casefold("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("near_duplicate_pairs", f"""WITH {PAIRS_SQL}
    SELECT p.rep_a, p.rep_b, a.copies AS copies_a, b.copies AS copies_b, round(score, 6) AS jaccard
    FROM pairs p JOIN sets a ON a.rep = rep_a JOIN sets b ON b.rep = rep_b""")
def _near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return nb.similar_sets(nb.token_sets(docs, "doc_id", "text").sets)


@query("near_duplicate_copies", f"WITH {PAIRS_SQL} SELECT rep, doc_id AS id FROM toks JOIN sets ON array_to_string(ts, ' ') = k WHERE rep <> doc_id".replace("(ts, ' ') = k", "(toks.ts, ' ') = k"))
def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return nb.text_copies(table(spark, folder, "documents"), "doc_id", "text")


@query("near_duplicate_totals", f"""WITH {PAIRS_SQL},
    rows AS (SELECT toks.doc_id, rep, source FROM toks JOIN sets ON array_to_string(toks.ts, ' ') = k JOIN documents d ON d.doc_id = toks.doc_id),
    all_pairs AS (SELECT a.source AS sa, b.source AS sb FROM rows a JOIN rows b ON a.rep = b.rep AND a.doc_id < b.doc_id
                  UNION ALL SELECT a.source, b.source FROM pairs JOIN rows a ON a.rep = rep_a JOIN rows b ON b.rep = rep_b)
    SELECT count(*) AS near_pairs, count(CASE WHEN sa <> sb THEN 1 END) AS conflicting_pairs FROM all_pairs""")
def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return nb.near_pair_totals(_token_sets(spark, folder), _pairs(spark, folder), table(spark, folder, "documents"), "doc_id", "source")


GROUPS_SQL = PAIRS_SQL + """,
  edges AS (SELECT rep_a AS a, rep_b AS b FROM pairs UNION SELECT rep_b, rep_a FROM pairs),
  reach(v, r) AS (SELECT a, a FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r),
  comp AS (SELECT v, min(r) AS component FROM reach GROUP BY v),
  placed AS (SELECT toks.doc_id, t, coalesce(component, rep) AS component FROM toks LEFT JOIN sets ON array_to_string(toks.ts, ' ') = k LEFT JOIN comp ON v = rep),
  names AS (SELECT component, min(t) AS name FROM placed WHERE component IS NOT NULL GROUP BY component),
  grouped AS (SELECT doc_id, sha256(coalesce(name, t)) AS grp FROM placed LEFT JOIN names USING (component))"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "duplicate_groups", lambda: nb.duplicate_groups(
        _token_sets(spark, folder), _links(spark, folder)).select("id", "duplicate_group"))


@query("duplicate_components", f"WITH RECURSIVE {GROUPS_SQL} SELECT v AS vertex, component FROM comp")
def _components(spark: SparkSession, folder: str) -> DataFrame:
    return nb.connected_components(_links(spark, folder), "rep_a", "rep_b")


@query("duplicate_groups", f"WITH RECURSIVE {GROUPS_SQL} SELECT doc_id AS id, grp AS duplicate_group FROM grouped")
def _duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nb.duplicate_groups(_token_sets(spark, folder), _links(spark, folder)).select("id", "duplicate_group")


# ---- splits -----------------------------------------------------------------------------

PREPARED_SQL = GROUPS_SQL + f""",
  src AS (SELECT doc_id AS id, {sql_collapse('text')} AS text_clean, source AS category, grp,
            CASE WHEN n_chars % 41 = 0 THEN '---)' ELSE lang END AS service, CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE lang END AS component
          FROM documents JOIN grouped USING (doc_id)),
  facts AS (SELECT grp, count(*) AS n, min(category) AS cat, count(DISTINCT category) > 1 AS conflict FROM src GROUP BY grp),
  ranked AS (SELECT grp, row_number() OVER (PARTITION BY cat ORDER BY sha256('42:' || grp), grp) AS r, count(*) OVER (PARTITION BY cat) AS total FROM facts WHERE NOT conflict),
  quota AS (SELECT *, CASE WHEN total >= 3 THEN greatest(1, round_even(total * cast(0.15 AS double), 0)) ELSE 0 END AS k FROM ranked),
  splits AS (SELECT grp, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'validation' ELSE 'train' END AS split FROM quota
             UNION ALL SELECT grp, 'review' FROM facts WHERE conflict),
  top15 AS (SELECT category FROM src GROUP BY category ORDER BY count(*) DESC, category LIMIT 15),
  prepared AS (SELECT src.*, split, CASE WHEN category IN (SELECT category FROM top15) THEN 1 ELSE 0 END AS is_top15,
      concat_ws(';', CASE WHEN conflict THEN 'conflicting_category' END, CASE WHEN n > 1 THEN 'repeated_text' END,
        CASE WHEN length(text_clean) < 30 THEN 'short_text_review' END, CASE WHEN service = '---)' THEN 'unknown_service' END,
        CASE WHEN trim(component) = '' THEN 'missing_service_component' END) AS flags
    FROM src JOIN facts USING (grp) JOIN splits USING (grp))"""


def _documents_to_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), tx.normalize_text("text").alias("text_clean"), F.col("source").alias("category"), "lang",
        F.when(F.col("n_chars") % 41 == 0, "---)").otherwise(F.col("lang")).alias("service"),
        F.when(F.col("n_chars") % 3 == 0, " ").otherwise(F.col("lang")).alias("component"))
    return docs.join(_groups(spark, folder).select("id", "duplicate_group"), "id")


def prepared_documents(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "prepared", lambda: sp.prepare_rows(_documents_to_split(spark, folder)))


@query("prepared_splits", f"""WITH RECURSIVE {PREPARED_SQL}
    SELECT id, category, grp AS duplicate_group, split, is_top15, flags FROM prepared""")
def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    rows = sp.prepare_rows(_documents_to_split(spark, folder))
    return rows.select("id", "category", "duplicate_group", "split", "is_top15", F.array_join("quality_flags", ";").alias("flags"))


@query("split_coverage", f"""WITH RECURSIVE {PREPARED_SQL}
    SELECT category, count(*) AS total, count(DISTINCT grp) AS independent_groups, count(CASE WHEN split = 'train' THEN 1 END) AS train,
           count(CASE WHEN split = 'validation' THEN 1 END) AS validation, count(CASE WHEN split = 'test' THEN 1 END) AS test,
           count(CASE WHEN split = 'review' THEN 1 END) AS review FROM prepared GROUP BY category""")
def _split_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return qu.class_coverage(prepared_documents(spark, folder))


@query("split_checks", f"""WITH RECURSIVE {PREPARED_SQL}
    SELECT (SELECT count(*) FROM (SELECT grp FROM prepared GROUP BY grp HAVING count(DISTINCT split) > 1)) AS shared_groups,
           (SELECT count(DISTINCT category) FROM prepared WHERE split IN ('validation', 'test')
              AND category NOT IN (SELECT category FROM prepared WHERE split = 'train')) AS untrained_labels, count(*) AS rows FROM prepared""")
def _split_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared_documents(spark, folder)
    shared = sp.shared_groups(rows).agg(F.count(F.lit(1)).alias("n")).scalar()
    untrained = sp.labels_without_training(rows).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(shared.alias("shared_groups"), untrained.alias("untrained_labels"), "rows")


@query("hash_sample", f"""WITH RECURSIVE {PREPARED_SQL}
    SELECT id FROM prepared WHERE split = 'test' ORDER BY sha256(cast(id AS varchar)), id LIMIT 30""")
def _hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.hash_sample(prepared_documents(spark, folder).filter("split = 'test'"), "id").select("id")


@query("first_per_bucket", """
    (SELECT 'long' AS bucket, doc_id FROM documents WHERE n_chars > 2000 ORDER BY doc_id LIMIT 4)
    UNION ALL (SELECT 'short', doc_id FROM documents WHERE n_chars <= 2000 ORDER BY doc_id LIMIT 4)
    UNION ALL (SELECT 'review', doc_id FROM documents WHERE n_chars < 100 OR n_chars > 10000 ORDER BY doc_id LIMIT 4)""")
def _first_per_bucket(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("n_chars")
    return sp.first_per_bucket(table(spark, folder, "documents"), {
        "long": size > 2000, "short": size <= 2000, "review": (size < 100) | (size > 10000)}, "doc_id").select("bucket", "doc_id")


_TRAIN_SQL = f"""raw AS (SELECT doc_id, CASE WHEN n_chars < 20 THEN ' ' ELSE text END AS description, CASE WHEN lang = 'de' THEN 'topic' ELSE ' ' || source END AS label FROM documents),
  valid AS (SELECT doc_id, md5({sql_collapse(sql_fold('description'))}) AS text, trim(label) AS label FROM raw WHERE trim(description) <> '' AND trim(label) <> ''),
  clean AS (SELECT text, min(label) AS label, count(*) AS rows FROM valid GROUP BY text HAVING count(DISTINCT label) = 1)"""


def _training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions with labels; the feature text is a digest of the folded description."""
    raw = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("n_chars") < 20, " ").otherwise(F.col("text")).alias("description"),
        F.when(F.col("lang") == "de", "topic").otherwise(F.concat(F.lit(" "), "source")).alias("label"))
    return raw.withColumn("text", F.md5(tx.normalize_casefold("description")))


@query("training_eligibility", f"""WITH {_TRAIN_SQL}
    SELECT label, count(*) AS rows FROM valid GROUP BY label
    UNION ALL SELECT 'forbidden', count(*) FROM valid WHERE label IN ('Прочее / Неопределено', 'ОПЕРАТОР')""")
def _eligibility(spark: SparkSession, folder: str) -> DataFrame:
    rows = sp.eligible_rows(_training_rows(spark, folder))
    forbidden = sp.forbidden_labels(rows).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).unionByName(forbidden.select(F.lit("forbidden").alias("label"), "rows"))


@query("consistent_features", f"WITH {_TRAIN_SQL} SELECT text, label, rows FROM clean")
def _consistent(spark: SparkSession, folder: str) -> DataFrame:
    return sp.consistent_features(sp.eligible_rows(_training_rows(spark, folder)))


@query("row_accounting", f"""WITH {_TRAIN_SQL}, bad AS (SELECT text, count(*) AS n FROM valid GROUP BY text HAVING count(DISTINCT label) > 1)
    SELECT (SELECT count(*) FROM raw) AS source_rows, (SELECT count(*) FROM clean) AS prepared_rows,
           (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS invalid_rows_removed,
           cast((SELECT coalesce(sum(n), 0) FROM bad) AS bigint) AS conflict_rows_removed, cast((SELECT sum(rows - 1) FROM clean) AS bigint) AS duplicate_rows_removed""")
def _accounting(spark: SparkSession, folder: str) -> DataFrame:
    return sp.row_accounting(_training_rows(spark, folder))


HOLDOUT_SQL = _TRAIN_SQL + """,
  strata AS (SELECT text, label, CASE WHEN count(*) OVER (PARTITION BY label) >= 5 THEN label ELSE 'Прочее / Неопределено' END AS stratum FROM clean),
  dealt AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || text), text) AS r, count(*) OVER (PARTITION BY stratum) AS total FROM strata),
  held AS (SELECT text, label, stratum, CASE WHEN r <= round_even(total * cast(0.2 AS double), 0) THEN 'test' ELSE 'train' END AS split FROM dealt),
  toplabels AS (SELECT label FROM held WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 15)"""


@query("stratified_holdout", f"""WITH {HOLDOUT_SQL}
    SELECT text, label, stratum, split, CASE WHEN label IN (SELECT label FROM toplabels) THEN label ELSE 'Прочее / Неопределено' END AS target FROM held""")
def _holdout(spark: SparkSession, folder: str) -> DataFrame:
    clean = sp.consistent_features(sp.eligible_rows(_training_rows(spark, folder))).select("text", "label")
    return sp.with_target(sp.stratified_holdout(clean))


@query("calibration_folds", """SELECT doc_id, source, cast((row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || cast(doc_id AS varchar)), doc_id) - 1) % 3 AS integer) AS fold FROM documents""")
def _folds(spark: SparkSession, folder: str) -> DataFrame:
    return sp.fold_of(table(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id")


# ---- terms and weights ------------------------------------------------------------------

def _sql_bigrams(words: str) -> str:
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_SEARCH_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_CLASS_WORDS = rf"list_filter(regexp_extract_all(lower(text), '{_WORD}'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{Nl}}\p{{No}}]{{2,}}') AND w NOT IN ({_STOPS}))"


def sql_counts(source: str, key: str, words: str = _SEARCH_WORDS) -> str:
    return (f"SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({_sql_bigrams('ws')}) AS term "
            f"FROM (SELECT {key} AS doc, {words} AS ws FROM {source})) GROUP BY doc, term")


def sql_weights(counts: str, total: str, min_df: int, limit: int | None = None) -> str:
    return (f"SELECT term, count(*) AS df, ln((1.0 + {total}) / (1.0 + count(*))) + 1 AS idf FROM {counts} GROUP BY term "
            f"HAVING count(*) >= {min_df}" + (f" ORDER BY sum(tf) DESC, term LIMIT {limit}" if limit else ""))


def sql_tfidf(counts: str, weights: str) -> str:
    return (f"SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM "
            f"(SELECT doc, term, (1 + ln(tf)) * idf AS w FROM {counts} JOIN {weights} USING (term))")


@query("word_terms", f"""SELECT doc AS doc_id, count(*) AS terms, cast(sum(tf) AS bigint) AS total, md5(string_agg(term, '|' ORDER BY term)) AS digest
    FROM ({sql_counts('documents', 'doc_id')}) GROUP BY doc""")
def _word_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(ti.term_counts(table(spark, folder, "documents"), "doc_id", "text"))


def _digest(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"),
        F.md5(F.array_join(F.sort_array(F.collect_list("term")), "|")).alias("digest"))


@query("classifier_terms", f"""SELECT doc AS doc_id, count(*) AS terms, cast(sum(tf) AS bigint) AS total, md5(string_agg(term, '|' ORDER BY term)) AS digest
    FROM ({sql_counts('documents', 'doc_id', _CLASS_WORDS)}) GROUP BY doc""")
def _classifier_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(ti.term_counts(table(spark, folder, "documents"), "doc_id", "text", tx.classifier_words))


_CHAR_SQL = f"""SELECT doc, term, count(*) AS tf FROM (
    SELECT doc, unnest(flatten(list_transform(range(3, least(5, length(w)) + 1), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS term
    FROM (SELECT doc_id AS doc, ' ' || unnest(list_filter(string_split({sql_collapse('lower(text)')}, ' '), lambda x: x <> '')) || ' ' AS w FROM documents)) GROUP BY doc, term"""


@query("char_terms", f"SELECT doc AS doc_id, count(*) AS terms, cast(sum(tf) AS bigint) AS total, md5(string_agg(term, '|' ORDER BY term)) AS digest FROM ({_CHAR_SQL}) GROUP BY doc")
def _char_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(ti.char_counts(table(spark, folder, "documents"), "doc_id", "text"))


@query("vocabulary", f"""WITH counts AS ({sql_counts('documents', 'doc_id')})
    SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS total FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 40000""")
def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return ti.vocabulary(ti.term_counts(table(spark, folder, "documents"), "doc_id", "text"), min_df=2, limit=ti.WORD_FEATURES)


@query("tfidf_weights", f"""WITH counts AS ({sql_counts('documents', 'doc_id')}),
    weights AS ({sql_weights('counts', '(SELECT count(*) FROM documents)', 2)}), tfidf AS ({sql_tfidf('counts', 'weights')})
    SELECT doc AS doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS strongest FROM tfidf GROUP BY doc""")
def _tfidf(spark: SparkSession, folder: str) -> DataFrame:
    postings, _ = ti.fit_index(table(spark, folder, "documents"), "doc_id", "text", min_df=2)
    return rounded(postings.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("strongest")))


@query("known_word_counts", f"""WITH counts AS ({sql_counts('documents', 'doc_id', _CLASS_WORDS)}), weights AS ({sql_weights('counts', '1', 2, 40000)}),
    words AS (SELECT item_id AS doc, unnest(list_distinct({_CLASS_WORDS})) AS term FROM benchmark)
    SELECT item_id AS doc, count(weights.term) AS known_words FROM benchmark LEFT JOIN words ON doc = item_id LEFT JOIN weights USING (term) GROUP BY item_id""")
def _known_words(spark: SparkSession, folder: str) -> DataFrame:
    _, weights = ti.fit_index(table(spark, folder, "documents"), "doc_id", "text", tx.classifier_words, min_df=2, limit=ti.WORD_FEATURES)
    return ti.known_word_counts(table(spark, folder, "benchmark"), "item_id", "text", weights)


# ---- retrieval --------------------------------------------------------------------------

SEARCH_SQL = f"""counts AS ({sql_counts('documents', 'doc_id')}),
    weights AS ({sql_weights('counts', '(SELECT count(*) FROM documents)', 1)}), corpus AS ({sql_tfidf('counts', 'weights')}),
    qcounts AS ({sql_counts('benchmark', 'item_id')}), asked AS ({sql_tfidf('qcounts', 'weights')}),
    scores AS (SELECT q.doc AS query, c.doc AS doc, round(sum(q.weight * c.weight), 9) AS score FROM asked q JOIN corpus c USING (term) GROUP BY 1, 2),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores WHERE score > 0) WHERE rank <= 5)"""


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return ti.fit_index(table(spark, folder, "documents"), "doc_id", "text")


@query("similar_documents", f"WITH {SEARCH_SQL} SELECT query, doc, cast(rank AS bigint) AS rank, round(least(1, score), 6) AS score FROM hits")
def _similar(spark: SparkSession, folder: str) -> DataFrame:
    postings, weights = _index(spark, folder)
    return rounded(ti.search(table(spark, folder, "benchmark"), "item_id", "text", postings, weights, limit=100))


@query("hit_explanations", f"""WITH {SEARCH_SQL}
    SELECT query, doc, place, term, round(p, 6) AS product FROM (
      SELECT h.query, h.doc, term, q.weight * c.weight AS p, row_number() OVER (PARTITION BY h.query, h.doc ORDER BY q.weight * c.weight DESC, term) AS place
      FROM hits h JOIN asked q ON q.doc = h.query JOIN corpus c USING (term) WHERE c.doc = h.doc) WHERE place <= 5""")
def _explanations(spark: SparkSession, folder: str) -> DataFrame:
    postings, weights = _index(spark, folder)
    queries = table(spark, folder, "benchmark")
    asked = materialize(ti.known_terms(queries, "item_id", "text", weights), "queries")
    postings = ti.query_postings(asked, postings)
    hits = ti.search(queries, "item_id", "text", postings, weights, asked=asked)
    return rounded(ti.explain_hits(hits, asked, postings))


_CASES_SQL = SEARCH_SQL.replace(f"qcounts AS ({sql_counts('benchmark', 'item_id')})",
                                f"appeals AS (SELECT item_id, CASE WHEN trim(text) <> '' THEN 'records ' || text END AS text FROM benchmark), "
                                f"qcounts AS ({sql_counts('appeals', 'item_id')})")


@query("similar_cases", f"""WITH {_CASES_SQL},
    best AS (SELECT query, doc, string_agg(term, ', ' ORDER BY place) AS explanation FROM (
      SELECT h.query, h.doc, term, row_number() OVER (PARTITION BY h.query, h.doc ORDER BY q.weight * c.weight DESC, term) AS place
      FROM hits h JOIN asked q ON q.doc = h.query JOIN corpus c USING (term) WHERE c.doc = h.doc) WHERE place <= 5 GROUP BY 1, 2)
    SELECT h.query, h.doc, cast(rank AS bigint) AS rank, round(least(1, score), 6) AS score, lang AS category, source AS line, n_chars, explanation
    FROM hits h JOIN best USING (query, doc) JOIN documents ON doc_id = h.doc""")
def _similar_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Appeals with a fixed service word, and the cases they find with their fields and explanation."""
    postings, weights = _index(spark, folder)
    appeals = table(spark, folder, "benchmark").withColumn("appeal", ti.appeal_text("text", F.lit("records")))
    asked = materialize(ti.known_terms(appeals, "item_id", "appeal", weights), "queries")
    postings = ti.query_postings(asked, postings)
    hits = ti.search(appeals, "item_id", "appeal", postings, weights, asked=asked)
    cases = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("category"), F.col("source").alias("line"), "n_chars")
    return rounded(ti.hit_cases(hits, cases, ti.explain_hits(hits, asked, postings)).select(
        "query", "doc", "rank", "score", "category", "line", "n_chars", "explanation"))


RETRIEVAL_SQL = PREPARED_SQL + f""",
    train AS (SELECT id, text_clean AS text FROM prepared WHERE split = 'train'), asked_rows AS (SELECT id, text_clean AS text FROM prepared WHERE split = 'test'),
    counts AS ({sql_counts('train', 'id')}), weights AS ({sql_weights('counts', '(SELECT count(*) FROM train)', 2)}), corpus AS ({sql_tfidf('counts', 'weights')}),
    qcounts AS ({sql_counts('asked_rows', 'id')}), asked AS ({sql_tfidf('qcounts', 'weights')}),
    scores AS (SELECT q.doc AS query, c.doc AS doc, round(sum(q.weight * c.weight), 9) AS score FROM asked q JOIN corpus c USING (term) GROUP BY 1, 2),
    others AS (SELECT s.*, d.grp FROM scores s JOIN prepared d ON d.id = s.doc JOIN prepared q ON q.id = s.query
               WHERE score >= 0.1 AND s.doc <> s.query AND d.grp <> q.grp),
    single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, grp ORDER BY score DESC, doc) AS g FROM others) WHERE g = 1),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM single) WHERE rank <= 5),
    checks AS (SELECT q.id AS query, count(h.doc) AS hits, coalesce(max(CASE WHEN d.category = q.category THEN 1 ELSE 0 END), 0) AS category_hit,
                      coalesce(max(CASE WHEN d.service = q.service THEN 1 ELSE 0 END), 0) AS line_hit
               FROM prepared q LEFT JOIN hits h ON h.query = q.id LEFT JOIN prepared d ON d.id = h.doc WHERE q.split = 'test' GROUP BY q.id)"""


def _hits_in_train(spark: SparkSession, folder: str, test: DataFrame, asked_name: str) -> DataFrame:
    """Hits of ``test``, rows of the test part, in the train part, over one duplicate group each."""
    train = prepared_documents(spark, folder).filter("split = 'train'")
    postings, weights = ti.fit_index(train, "id", "text_clean", min_df=2)
    asked = ti.known_terms(test, "id", "text_clean", weights)
    return ti.similar_elsewhere(
        once(spark, folder, asked_name, lambda: asked), postings,
        test.select(F.col("id").alias("query"), F.col("duplicate_group").alias("group")),
        train.select(F.col("id").alias("doc"), F.col("duplicate_group").alias("group")), weights=weights, blocks=True)


def _offline_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the whole test part in the train part."""
    return once(spark, folder, "offline_hits", lambda: _hits_in_train(
        spark, folder, prepared_documents(spark, folder).filter("split = 'test'"), "asked"))


def _checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared_documents(spark, folder).withColumn("line", F.col("service"))
    test = rows.filter("split = 'test'").select(F.col("id").alias("query"), "category", "line")
    return ti.retrieval_checks(test, _offline_hits(spark, folder), rows.select(F.col("id").alias("doc"), "category", "line"))


@query("similar_outside_group", f"WITH RECURSIVE {RETRIEVAL_SQL} SELECT query, doc, cast(rank AS bigint) AS rank, round(score, 6) AS score FROM hits")
def _similar_outside(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_offline_hits(spark, folder).select("query", "doc", "rank", "score"))


@query("retrieval_checks", f"WITH RECURSIVE {RETRIEVAL_SQL} SELECT query, hits, category_hit, line_hit FROM checks")
def _retrieval_checks(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(spark, folder)


@query("retrieval_metrics", f"""WITH RECURSIVE {RETRIEVAL_SQL}
    SELECT count(*) AS queries, round(avg(category_hit), 6) AS category_hit_at_5, round(avg(line_hit), 6) AS line_hit_at_5, count(CASE WHEN hits = 0 THEN 1 END) AS no_results FROM checks""")
def _retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ti.retrieval_metrics(_checks(spark, folder)))


@query("review_worksheet", f"""WITH RECURSIVE {RETRIEVAL_SQL}, sample AS (SELECT id FROM prepared WHERE split = 'test' ORDER BY sha256(cast(id AS varchar)), id LIMIT 30)
    SELECT id AS query, cast(coalesce(rank, 0) AS bigint) AS rank, doc AS result, round(coalesce(score, 0), 6) AS similarity FROM sample LEFT JOIN hits ON query = id""")
def _worksheet(spark: SparkSession, folder: str) -> DataFrame:
    """A query's hits do not depend on other queries, so those of the sampled ones alone are looked for."""
    test = prepared_documents(spark, folder).filter("split = 'test'")
    sample = once(spark, folder, "review_sample", lambda: sp.hash_sample(test.select(F.col("id").alias("query")), "query"))
    sampled = test.join(F.broadcast(sample.select(F.col("query").alias("id"))), "id", "left_semi")
    hits = once(spark, folder, "sample_hits", lambda: _hits_in_train(spark, folder, sampled, "sample_asked"))
    return rounded(ti.review_worksheet(sample, hits))


@query("precision_at_1", f"""WITH RECURSIVE {RETRIEVAL_SQL}
    SELECT count(*) AS assessed, round(avg(CASE WHEN q.service = d.service THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1
    FROM hits h JOIN prepared q ON q.id = query JOIN prepared d ON d.id = doc WHERE rank = 1""")
def _precision(spark: SparkSession, folder: str) -> DataFrame:
    """Judgments derived from the service of query and hit."""
    rows, hits = prepared_documents(spark, folder), _offline_hits(spark, folder)
    judged = (hits.select("query", "doc").join(rows.select(F.col("id").alias("query"), F.col("service").alias("_q")), "query")
              .join(rows.select(F.col("id").alias("doc"), F.col("service").alias("_d")), "doc")
              .select("query", "doc", (F.col("_q") == F.col("_d")).cast("int").alias("relevant")))
    return rounded(ti.precision_at_1(judged, hits))
