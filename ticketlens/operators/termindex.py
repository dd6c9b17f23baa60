"""Vocabulary, TF-IDF weights and term-based retrieval as long (document, term) tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.operators.scaling import ranked
from ticketlens.operators.scoreblocks import block_scores
from ticketlens.session import materialize

WORD_FEATURES = 40_000
CHAR_FEATURES = 60_000
TOP_HITS = 5
#: Totals below this have a bin of their own in the histogram of a vocabulary; larger ones share bins.
EXACT_BINS = 4096
BINS_PER_OCTAVE = 64
#: Most frequent terms of a corpus that every task gets whole; postings of the others meet their weights in a shuffle.
BROADCAST_TERMS = 50_000
MIN_SIMILARITY = 0.1
Words = Callable[[Column], Column]
# Scores are compared at this precision, so that equal texts tie whatever the order of their sums.
SCORE_DIGITS = 9
# Sums in another order may differ by this much; bounds are compared with it to spare.
_SLACK = 1e-7
#: Postings per wanted hit that a query's rarest terms are followed for, to learn how good its hits are.
SEED_POSTINGS = 50
#: Bands of documents by their largest weight; the last one has all that are smaller.
MOST_BANDS = 24


def by_document(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """Texts hashed by document over all shuffle partitions.

    The count is explicit because texts grow many times over when they are cut
    into terms: partitions must not be merged by the size of the texts.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select(F.col(id_column).alias("doc"), F.col(text).alias("_text")).repartition(partitions, "doc")


def term_counts(texts: DataFrame, id_column: str, text: str, words: Words = tx.search_words) -> DataFrame:
    """(doc, term, tf) of words and of pairs of neighbouring words.

    The texts are placed by document once; everything per document then needs
    no shuffle. Each word is laid next to its follower, so one pass over the
    positions gives both the word and the pair.
    """
    placed = by_document(texts, id_column, text).select("doc", words(F.col("_text")).alias("_words"))
    follower = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0)))
    spots = placed.select("doc", F.explode(F.arrays_zip(F.col("_words").alias("a"), follower.alias("b"))).alias("_at"))
    pair = F.concat(F.col("_at.a"), F.lit(" "), F.col("_at.b"))
    terms = spots.select("doc", F.explode(F.array(F.col("_at.a"), pair)).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def char_counts(texts: DataFrame, id_column: str, text: str, shortest: int = 3, longest: int = 5) -> DataFrame:
    """(doc, term, tf) of character n-grams inside padded words; repeated words are cut up once."""
    placed = by_document(texts, id_column, text)
    words = placed.select("doc", F.explode(tx.padded_words("_text")).alias("_word")).groupBy("doc", "_word").agg(
        F.count(F.lit(1)).alias("_n"))
    starts = words.select("doc", "_n", "_word", F.explode(F.sequence(F.lit(1), F.length("_word") - (shortest - 1))).alias("_at"))
    cuts = [F.when(F.col("_at") + (n - 1) <= F.length("_word"), F.substring("_word", F.col("_at"), F.lit(n)))
            for n in range(shortest, longest + 1)]
    grams = starts.select("doc", "_n", F.explode(F.array(*cuts)).alias("term")).filter(F.col("term").isNotNull())
    return grams.groupBy("doc", "term").agg(F.sum("_n").alias("tf"))


def _total_bin(total: Column) -> Column:
    """Bin that never decreases with a count: every small count its own, about 1 % wide beyond."""
    wide = EXACT_BINS + F.floor((F.log2(total) - math.log2(EXACT_BINS)) * BINS_PER_OCTAVE)
    return F.when(total < EXACT_BINS, total).otherwise(wide).cast("bigint")


def vocabulary(counts: DataFrame, min_df: int = 1, limit: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` documents; with a ``limit`` the most frequent ones, ties in term order.

    A limit is a parameter of a classifier's features. Retrieval has none:
    every term can find documents. The limit is found in a histogram of the
    written totals (some thousand bins, whatever the number of terms): bins
    above it are kept whole, and only the bin it falls into is ranked.
    """
    totals = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return totals if limit is None else most_frequent(materialize(totals, "term_totals"), limit)


def most_frequent(totals: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of written totals with the largest ``total``, ties in term order."""
    at = _total_bin(F.col("total"))
    above = 0
    for last, n in sorted(totals.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if above + n > limit:
            tied = F.struct(-F.col("total"), F.substring("term", 1, 3))
            edge = ranked(totals.filter(at == last), [], tied, [F.desc("total"), F.asc("term")], "_rank")
            return totals.filter(at > last).unionByName(edge.filter(F.col("_rank") <= limit - above).drop("_rank"))
        above += n
    return totals


def term_weights(vocab: DataFrame, documents: Column) -> DataFrame:
    """(term, df, idf) with the smoothed idf ``ln((1 + n) / (1 + df)) + 1``."""
    return vocab.select("term", "df", _idf(documents, F.col("df")).alias("idf"))


def _idf(documents: Column, df: Column) -> Column:
    return F.log((documents + 1.0) / (df + 1.0)) + 1.0


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc, term, weight): sublinear tf times idf, each document scaled to length one.

    ``weights`` is a written table: Spark broadcasts it if its size allows,
    and then ``counts`` stay placed by document; otherwise terms are joined in
    a shuffle, where AQE splits frequent ones.
    """
    return _scaled(counts.join(weights.select("term", "idf"), "term"))


def _scaled(met: DataFrame) -> DataFrame:
    """(doc, term, weight) of counts that have met their idf."""
    raw = met.select("doc", "term", ((F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("_w") / norm).alias("weight"))


def _frequent(weights: DataFrame, most: int) -> int:
    """The number of documents from which on a term is among the frequent ones, of which there are ``most`` at most."""
    at = _total_bin(F.col("df"))
    kept = 0
    least = None
    for r in sorted(weights.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("df")).collect(), reverse=True):
        kept += r["n"]
        if kept > most:
            break
        least = r["df"]
    return least if least is not None else 1 << 62


def corpus_tfidf(counts: DataFrame, weights: DataFrame, single: Column | None = None) -> DataFrame:
    """:func:`tfidf` of a whole corpus, whose ``counts`` are placed by document.

    The most frequent terms, a bounded number with most of the postings, are
    broadcast, and their postings stay where they are. Only postings of the
    other terms are shuffled to their weights and back. With ``single``, the
    idf of a term that one document alone has, every term has a weight, and
    such terms need not be in the join.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = weights.select("term", "idf", "df")
    least = _frequent(weights, BROADCAST_TERMS)
    frequent = F.broadcast(known.filter(F.col("df") >= least).select("term", "idf"))
    rest = known.filter(F.col("df") < least)
    rare = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti")
    if single is None:
        rare = rare.join(rest.select("term", "idf"), "term")
    else:
        rare = rare.join(rest.filter("df > 1").select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", single))
    names = ("doc", "term", "tf", "idf")
    met = counts.join(frequent, "term").select(*names).unionByName(rare.select(*names).repartition(partitions, "doc"))
    return _scaled(met)


def fit_index(texts: DataFrame, id_column: str, text: str, words: Words = tx.search_words,
              min_df: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of a corpus and the (term, df, idf) table that weighs later queries.

    Texts are cut into terms again by each reader of the postings: that costs less than to write all terms.
    """
    counts = term_counts(texts, id_column, text, words)
    total = texts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    weights = materialize(term_weights(vocabulary(counts, min_df, limit), F.lit(total)), "weights")
    single = _idf(F.lit(total), F.lit(1)) if min_df <= 1 and limit is None else None
    return corpus_tfidf(counts, weights, single), weights


def known_terms(texts: DataFrame, id_column: str, text: str, weights: DataFrame,
                words: Words = tx.search_words) -> DataFrame:
    """Postings of new texts under the weights of a fitted corpus.

    The terms of the texts are written, so that Spark knows when they are few
    and does not shuffle the weights of the whole corpus for them.
    """
    return tfidf(materialize(term_counts(texts, id_column, text, words), "asked_counts"), weights)


def pair_scores(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, doc, score): cosine of every pair that shares a term.

    ``queries`` is materialised, so Spark knows its size: below the broadcast
    threshold the corpus is not shuffled at all and, being placed by document,
    not even for the sum. A larger query set meets the corpus in a shuffle join;
    ``spread_terms`` keeps its frequent terms from filling one partition.
    """
    wanted = queries.select(F.col("doc").alias("query"), "term", F.col("weight").alias("_q"))
    return (postings.join(wanted, "term").groupBy("doc", "query")
            .agg(F.round(F.sum(F.col("weight") * F.col("_q")), SCORE_DIGITS).alias("score")).select("query", "doc", "score"))


def spread_terms(queries: DataFrame, postings: DataFrame, weights: DataFrame, rows_per_lane: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Give frequent terms several lanes: postings go to one lane by document, query terms to all of them.

    The lane becomes part of the term, so :func:`pair_scores` works on the
    result unchanged and gives the same scores.
    """
    # A term in this list has more than rows_per_lane postings, so it is short beside the postings; Spark decides on its size.
    lanes = weights.select("term", F.ceil(F.col("df") / rows_per_lane).cast("int").alias("_lanes")).filter("_lanes > 1")
    corpus = postings.join(lanes, "term", "left").select(
        "doc", F.struct("term", F.when(F.col("_lanes").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("_lanes"))).cast("int").alias("lane")).alias("term"), "weight")
    asked = queries.join(lanes, "term", "left").select(
        "doc", "term", "weight", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_lanes"), F.lit(1)) - 1)).alias("lane")).select(
        "doc", F.struct("term", "lane").alias("term"), "weight")
    return asked, corpus


def banded(postings: DataFrame) -> DataFrame:
    """Postings with the ``band`` of their document: how small its largest weight is, in steps of the root of two.

    Long documents have small weights only, so bounds that hold for a band of
    documents are much closer than bounds that hold for all. Postings come
    from :func:`tfidf`, placed by document, and are not shuffled for this.
    """
    largest = F.max("weight").over(Window.partitionBy("doc"))
    return postings.select("doc", "term", "weight", F.least(F.floor(-2 * F.log2(largest)), F.lit(MOST_BANDS - 1)).cast("int").alias("band"))


def query_postings(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """:func:`banded` postings of the terms that the queries have, written once for a search and the explanations of its hits."""
    return materialize(banded(postings).join(queries.select("term").distinct(), "term", "left_semi"), "query_postings")


def query_bounds(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """What the terms of each query can add to a score in each band: (query, band, term, q, most, square).

    Terms are taken from the most frequent to the rarest. A document of the
    band that has none but the terms up to one of them scores at most
    ``most``, the sum of query weight times the largest weight of the term in
    the band, and at most the root of ``square``, the sum of squared query
    weights, times the length of the rest of the document.
    """
    peaks = postings.groupBy("band", "term").agg(F.max("weight").alias("peak"), F.count(F.lit(1)).alias("df"))
    terms = queries.select(F.col("doc").alias("query"), "term", F.col("weight").alias("q")).join(peaks, "term")
    common = Window.partitionBy("query", "band").orderBy(F.desc("df"), F.asc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return terms.select("query", "band", "term", "q", F.sum(F.col("q") * F.col("peak")).over(common).alias("most"),
                        F.sum(F.col("q") * F.col("q")).over(common).alias("square"))


def rarest_terms(queries: DataFrame, weights: DataFrame, postings: int) -> DataFrame:
    """(query, term): the rarest terms of each query, until they have so many postings; one term at least."""
    rarer = Window.partitionBy("query").orderBy(F.asc("df"), F.asc("term")).rowsBetween(Window.unboundedPreceding, -1)
    known = queries.select(F.col("doc").alias("query"), "term").join(weights.select("term", "df"), "term")
    return known.withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0))).filter(F.col("before") < postings).select("query", "term")


def _scores_of(pairs: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, doc, score) of given pairs, not rounded; ``queries`` has query, term and q."""
    return pairs.join(queries, "query").join(postings.select("doc", "term", "weight"), ["doc", "term"]).groupBy("query", "doc").agg(
        F.sum(F.col("weight") * F.col("q")).alias("score"))


def pruned_scores(queries: DataFrame, postings: DataFrame, weights: DataFrame, settle: Callable[[DataFrame], DataFrame], limit: int,
                  floor: float = 0.0) -> DataFrame:
    """(query, doc, score): cosine of every pair that can be among the hits, and of few others.

    ``settle`` makes hits with ``rank`` up to ``limit`` from scores, and takes
    none below ``floor``. The same hits come from these scores as from
    :func:`pair_scores`:

    1. The documents of a query's rarest terms are scored in full. The score
       of the last hit among them is a threshold that hits must reach.
    2. Frequent terms that together cannot reach it in a band of documents
       lead to no document of that band: only the other terms are joined with
       its postings.
    3. A pair met there is finished only if what it has, and the most that the
       frequent terms can add, reach the threshold.
    """
    if "band" not in postings.columns:
        postings = query_postings(queries, postings)
    asked = queries.select(F.col("doc").alias("query"), "term", F.col("weight").alias("q"))
    tried = postings.join(rarest_terms(queries, weights, SEED_POSTINGS * limit), "term").select("query", "doc").distinct()
    first = settle(_scores_of(tried, asked, postings).withColumn("score", F.round("score", SCORE_DIGITS)))
    reached = materialize(first.filter(F.col("rank") == limit).select("query", F.col("score").alias("least")), "thresholds")
    aimed = query_bounds(queries, postings).join(reached, "query", "left").withColumn(
        "least", F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(floor)) - _SLACK)
    aimed = materialize(aimed.withColumn("leads", F.least("most", F.sqrt("square")) >= F.col("least")), "query_terms")

    met = postings.join(aimed.filter("leads").select("query", "band", "term", "q"), ["band", "term"]).groupBy("query", "band", "doc").agg(
        F.sum(F.col("weight") * F.col("q")).alias("part"), F.sum(F.col("weight") * F.col("weight")).alias("mass"))
    rest = aimed.groupBy("query", "band").agg(F.first("least").alias("least"), *[
        F.coalesce(F.max(F.when(~F.col("leads"), F.col(c))), F.lit(0.0)).alias(c) for c in ("most", "square")])
    reach = F.col("part") + F.least("most", F.sqrt(F.col("square") * F.greatest(F.lit(1.0) - F.col("mass"), F.lit(0.0))))
    open_pairs = materialize(met.join(rest, ["query", "band"]).filter(reach >= F.col("least") - _SLACK).select("query", "band", "doc", "part"), "open_pairs")
    resting = aimed.filter("NOT leads").select("query", "band", "term", "q")
    added = open_pairs.select("query", "band", "doc").join(resting, ["query", "band"]).join(postings.select("doc", "term", "weight"), ["doc", "term"]).groupBy(
        "query", "doc").agg(F.sum(F.col("weight") * F.col("q")).alias("more"))
    return open_pairs.join(added, ["query", "doc"], "left").select(
        "query", "doc", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), SCORE_DIGITS).alias("score"))


def top_hits(scores: DataFrame, limit: int = TOP_HITS, min_score: float | None = None) -> DataFrame:
    """Best documents per query, ties in document order. ``min_score`` None keeps every positive score."""
    if limit < 1:
        return scores.filter(F.lit(False)).withColumn("rank", F.lit(1))
    kept = scores.filter(F.col("score") > 0)
    if min_score is not None:
        if not 0 <= min_score <= 1:
            raise ValueError("min_score must be in [0, 1]")
        kept = kept.filter(F.col("score") >= min_score)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).withColumn(
        "score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))


def search(queries: DataFrame, id_column: str, text: str, postings: DataFrame, weights: DataFrame,
           limit: int = TOP_HITS, min_score: float | None = None, ceiling: int | None = TOP_HITS, asked: DataFrame | None = None) -> DataFrame:
    """Top documents of each query text; blank queries and queries without a known term give no rows.

    ``ceiling`` is the rule of the interactive search, which never shows more
    hits than that; None leaves the number to ``limit``. ``asked`` are the
    :func:`known_terms` of the queries, where a caller has written them;
    ``postings`` may be their :func:`query_postings` then.
    """
    if asked is None:
        asked = materialize(known_terms(queries, id_column, text, weights), "queries")
    shown = limit if ceiling is None else min(ceiling, limit)

    def settle(scores: DataFrame) -> DataFrame:
        return top_hits(scores, shown, min_score)

    if shown < 1:
        return settle(pair_scores(asked, postings))
    return settle(pruned_scores(asked, postings, weights, settle, shown, min_score or 0.0))


def appeal_text(text: Column | str, *context: Column | str) -> Column:
    """Text of a query with its service and component; context alone asks nothing, so a blank text stays null."""
    body = tx.as_column(text)
    return F.when(tx.strip(body) != "", F.concat_ws(" ", *[tx.as_column(c) for c in context], body))


def hit_cases(hits: DataFrame, cases: DataFrame, explanations: DataFrame) -> DataFrame:
    """Hits with the fields of their cases and the terms that explain them, strongest first.

    Fields are joined after the top-k cut, so that only shown cases meet them.
    ``cases`` has ``doc``; ``explanations`` comes from :func:`explain_hits`.
    """
    terms = explanations.groupBy("query", "doc").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("explanation"))
    return hits.join(terms, ["query", "doc"], "left").join(cases, "doc", "left")


def explain_hits(hits: DataFrame, queries: DataFrame, postings: DataFrame, limit: int = TOP_HITS) -> DataFrame:
    """Up to ``limit`` shared terms of each hit, strongest product of weights first."""
    wanted = queries.select(F.col("doc").alias("query"), "term", F.col("weight").alias("_q"))
    shared = (hits.select("query", "doc").join(wanted, "query").join(postings, ["doc", "term"])
              .select("query", "doc", "term", (F.col("weight") * F.col("_q")).alias("product")))
    strongest = Window.partitionBy("query", "doc").orderBy(F.desc("product"), F.asc("term"))
    return shared.withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= limit)


def similar_elsewhere(queries: DataFrame, postings: DataFrame, query_groups: DataFrame, doc_groups: DataFrame,
                      limit: int = TOP_HITS, min_score: float = MIN_SIMILARITY, weights: DataFrame | None = None, blocks: bool = False) -> DataFrame:
    """Top documents outside the query itself and its duplicate group, at most one per group.

    ``query_groups`` and ``doc_groups`` map ids (``query``, ``doc``) to ``group``.
    With ``weights``, the (term, df, idf) of the index, pairs that cannot be
    hits are not scored. With ``blocks``, for queries about as many as the
    documents, :func:`block_scores` scores all pairs without listing them; the
    hits of each block of queries are written before the next one is scored.
    """
    def settle(scores: DataFrame) -> DataFrame:
        placed = scores.filter((F.col("score") > 0) & (F.col("score") >= min_score)).join(
            query_groups.select("query", F.col("group").alias("_own")), "query").join(doc_groups.select("doc", "group"), "doc")
        others = placed.filter((F.col("query") != F.col("doc")) & ~F.col("group").eqNullSafe(F.col("_own")))
        best = others.groupBy("query", "group").agg(F.min_by(F.struct("score", "doc"), F.struct(-F.col("score"), F.col("doc"))).alias("_best"))
        return top_hits(best.select("query", "group", F.col("_best.score").alias("score"), F.col("_best.doc").alias("doc")), limit)

    if blocks:
        n_postings = 0 if weights is None else weights.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
        rounds = block_scores(queries, postings, query_groups, doc_groups, limit, min_score, SCORE_DIGITS, n_postings)
        hits = [materialize(settle(scores), "block_hits") for scores in rounds]
        return reduce(DataFrame.unionByName, hits) if hits else settle(pair_scores(queries, postings))
    if weights is None:
        return settle(pair_scores(queries, postings))
    return settle(pruned_scores(queries, postings, weights, settle, limit, min_score))


def known_word_counts(texts: DataFrame, id_column: str, text: str, weights: DataFrame) -> DataFrame:
    """Distinct single words of each text that the vocabulary knows; zero for texts without any."""
    words = texts.select(F.col(id_column).alias("doc"), F.explode(F.array_distinct(tx.classifier_words(text))).alias("term"))
    known = words.join(weights.select("term"), "term").groupBy("doc").agg(F.count(F.lit(1)).alias("known_words"))
    return texts.select(F.col(id_column).alias("doc")).join(known, "doc", "left").select(
        "doc", F.coalesce("known_words", F.lit(0)).alias("known_words"))


def retrieval_checks(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Per query: hits, and whether any hit has the same category or line.

    ``queries`` has query, category and line; ``docs`` has doc, category and line.
    """
    found = (hits.select("query", "doc").join(docs.select("doc", F.col("category").alias("_c"), F.col("line").alias("_l")), "doc")
             .join(queries, "query").groupBy("query").agg(
                 F.count(F.lit(1)).alias("hits"), F.max((F.col("_c") == F.col("category")).cast("int")).alias("category_hit"),
                 F.max((F.col("_l") == F.col("line")).cast("int")).alias("line_hit")))
    return queries.select("query").join(found, "query", "left").select(
        "query", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "category_hit", "line_hit")])


def retrieval_metrics(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("category_hit").alias("category_hit_at_5"), F.avg("line_hit").alias("line_hit_at_5"),
        F.coalesce(F.sum((F.col("hits") == 0).cast("bigint")), F.lit(0)).alias("no_results"))


def review_worksheet(sample: DataFrame, hits: DataFrame) -> DataFrame:
    """Sampled queries with their ranked hits; a query without hits keeps one row of rank 0."""
    return sample.select("query").join(hits.select("query", "doc", "rank", "score"), "query", "left").select(
        "query", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("doc").alias("result"), F.coalesce("score", F.lit(0.0)).alias("similarity"))


def precision_at_1(judgments: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of relevant first hits among the judged queries."""
    first = hits.filter("rank = 1").select("query", "doc")
    return judgments.join(first, ["query", "doc"]).agg(
        F.count(F.lit(1)).alias("assessed"), F.avg(F.col("relevant").cast("double")).alias("precision_at_1"))
