import itertools
import re

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import neighbours as nb
from ticketlens.operators import quality as qu
from ticketlens.operators import splits as sp
from ticketlens.operators import termindex as ti
from ticketlens.plans.views import table
from ticketlens.session import materialize

FOLDER = "/root/testdata/sf0.001"


def pairs_of(spark, texts, threshold=nb.THRESHOLD):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [(r.rep_a, r.rep_b, r.jaccard) for r in nb.similar_sets(nb.token_sets(rows, "id", "text").sets, threshold).collect()]


def test_near_pairs_ignore_case_order_and_blanks(spark):
    rows = spark.createDataFrame(list(enumerate(["The pump leaks oil", "OIL  leaks the PUMP", "a new filter is due", "   "])), "id int, text string")
    prepared = nb.token_sets(rows, "id", "text")
    assert [(r.rep, r.id) for r in nb.copies_of(prepared).collect()] == [(0, 1)]
    assert nb.similar_sets(prepared.sets).count() == 0


def test_copies_of_texts_alone_are_those_of_the_token_sets(spark):
    texts = [(5, "The pump leaks"), (3, "leaks  the PUMP"), (3, "pump the leaks the"), (9, "leaks the pump"), (None, "the pump leaks"),
             (4, ""), (6, None), (7, " ... "), (8, "Straße"), (2, "STRASSE"), (1, "a new filter")]
    rows = spark.createDataFrame(texts, "id int, text string")
    found = [sorted((r.rep, r.id) for r in x.collect()) for x in (nb.copies_of(nb.token_sets(rows, "id", "text")), nb.text_copies(rows, "id", "text"))]
    assert found[0] == found[1] == [(2, 8), (3, 5), (3, 9)]


def test_threshold_boundary(spark):
    assert pairs_of(spark, ["a b c d", "a b c d e"], 0.8) == [(0, 1, 0.8)]
    assert pairs_of(spark, ["a b c d", "a b c d e"], 0.81) == []
    with pytest.raises(ValueError):
        pairs_of(spark, ["a"], 0)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_pruned_pairs_equal_all_pairs(spark, threshold):
    docs = table(spark, FOLDER, "documents")
    got = {(r.rep_a, r.rep_b) for r in nb.similar_sets(nb.token_sets(docs, "doc_id", "text").sets, threshold).collect()}
    sets = {}
    for r in docs.orderBy("doc_id").collect():
        words = frozenset(re.findall(r"\w+", r.text.casefold()))
        if words:
            sets.setdefault(words, r.doc_id)
    want = {(min(sets[a], sets[b]), max(sets[a], sets[b])) for a, b in itertools.combinations(sets, 2)
            if len(a & b) / len(a | b) >= threshold}
    assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(50)] + [(900, 1040)]
    edges = spark.createDataFrame(chain + hub, "a bigint, b bigint")
    got = {r.vertex: r.component for r in nb.connected_components(edges, "a", "b").collect()}
    assert set(got[v] for v in range(61)) == {0}
    assert got[900] == got[1000] == got[1050] == 900
    assert nb.connected_components(edges.limit(0), "a", "b").count() == 0


def near_copies(spark, n):
    """A family of texts that differ in one or two of 30 words, and some of no family."""
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words[:i % 30], f"x{i}", *words[i % 30 + 1:]]) for i in range(n)] + [f"alone{i} w{i % 30} y z" for i in range(n // 4)]
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def grouping(frame):
    return {r.vertex: r.component for r in nb.connected_components(frame, "rep_a", "rep_b").collect()}


@pytest.mark.parametrize("threshold, copies", [(0.85, 0), (0.5, 60)])
def test_spanning_links_connect_what_all_pairs_do(spark, threshold, copies):
    documents = table(spark, FOLDER, "documents").select(F.col("doc_id").alias("id"), "text")
    sets = nb.token_sets(near_copies(spark, copies) if copies else documents, "id", "text").sets
    pairs = nb.similar_sets(sets, threshold)
    links = nb.spanning_links(sets, threshold)
    assert grouping(links) == grouping(pairs)
    assert links.join(pairs, ["rep_a", "rep_b"], "left_anti").isEmpty()


def test_links_of_a_large_family_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHAIN_ROWS", 100)
    count = {}
    for n in (100, 400):
        sets = nb.token_sets(near_copies(spark, n), "id", "text").sets
        count[n] = nb.chained(nb.prefixes(sets), nb.THRESHOLD).count()
    assert count[400] <= 6 * count[100]
    links = nb.spanning_links(sets)
    assert set(grouping(links).values()) == {0} and len(grouping(links)) == 400
    assert links.count() <= 6 * 400


def test_no_bound_drops_a_similar_pair(spark):
    sets = nb.token_sets(near_copies(spark, 60), "id", "text").sets
    tokens = {r.rep: set(r.tokens) for r in sets.collect()}
    got = {(r.rep_a, r.rep_b) for r in nb.similar_sets(sets).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(tokens), 2)
                   if len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) >= nb.THRESHOLD}


def test_wordless_equal_texts_share_a_group(spark):
    rows = spark.createDataFrame([(0, "!!!"), (1, "!!!"), (2, "???"), (3, "a b"), (4, "B a")], "id int, text string")
    prepared = nb.token_sets(rows, "id", "text")
    group = {r.id: r.duplicate_group for r in nb.duplicate_groups(prepared, nb.similar_sets(prepared.sets)).collect()}
    assert group[0] == group[1] != group[2] and group[3] == group[4]


def test_duplicate_groups_of_the_audit(spark):
    rows = spark.createDataFrame([(10, "Pump  OFF", "k1", 4), (11, "pump off", "k2", None), (12, None, "k1", 4), (13, "valve", "k1", 4),
                                  (14, "Pump  OFF", "k1", 4), (15, "PUMP OFF ", "k3", 4)], "row int, text string, category string, count int")
    assert sorted((r.group_row, r.row) for r in qu.exact_duplicates(rows, "row").collect()) == [(10, 10), (10, 14)]
    assert sorted(r.row for r in qu.text_duplicates(rows, "row", ["text"]).collect()) == [10, 11, 14, 15]
    profile = {r["column"]: r for r in qu.column_profile(rows).collect()}
    assert profile["count"].missing == 1 and profile["text"].missing == 1
    many = spark.createDataFrame([(f"kind {i}",) for i in range(21)], "category string")
    assert tuple(qu.categories_outside(many, "category").first()) == (21, 6)


def split_rows(spark, outcome="x"):
    rows = [(i, f"text {i} of some length to pass the check", f"c{i % 4}" if i % 4 < 3 else ("c3" if i < 8 else "c0"), outcome, f"g{i // 2}", "s", "k") for i in range(400)]
    return spark.createDataFrame(rows, "id int, text_clean string, category string, outcome string, duplicate_group string, service string, component string")


def test_splits_keep_groups_together_and_ignore_outcomes(spark):
    one = sp.prepare_rows(split_rows(spark))
    assert sp.shared_groups(one).count() == 0 and sp.labels_without_training(one).count() == 0
    assert one.count() == 400
    two = sp.prepare_rows(split_rows(spark, outcome="leak"))
    assert one.drop("outcome").exceptAll(two.drop("outcome")).count() == 0


def test_placeholder_groups_go_to_review(spark):
    rows = [(i, "ФИО: , Комментарий:" if i == 0 else f"long enough text number {i} for this", "c", "g0" if i < 2 else f"g{i}", "s", "k") for i in range(12)]
    rows = spark.createDataFrame(rows, "id int, text_clean string, category string, duplicate_group string, service string, component string")
    split = {r.id: (r.split, r.quality_flags) for r in sp.prepare_rows(rows).collect()}
    assert split[0][0] == split[1][0] == "review" and "empty_or_test_template" in split[0][1]
    assert sorted(s for s, _ in split.values()).count("test") == 2


def test_training_accounting(spark):
    rows = [(f"report {word} number {i} of the week", word) for word in ("pump", "valve", "meter") for i in range(15)]
    rows += [(rows[3][0], "pump"), (rows[3][0], "pump"), (rows[20][0], "pump"), ("\t", "valve"), (None, "meter")]
    source = spark.createDataFrame(rows, "description string, label string").withColumn("text", F.col("description"))
    report = sp.row_accounting(source).first()
    assert (report.invalid_rows_removed, report.conflict_rows_removed, report.duplicate_rows_removed, report.prepared_rows) == (2, 2, 2, 44)
    held = sp.with_target(sp.stratified_holdout(sp.consistent_features(sp.eligible_rows(source)).select("text", "label")))
    train, test = held.filter("split = 'train'"), held.filter("split = 'test'")
    assert train.join(test, "text").count() == 0 and train.count() + test.count() == 44
    assert {r.label for r in test.select("label").distinct().collect()} == {"pump", "valve", "meter"}


def test_frequent_labels_come_from_training_alone(spark):
    rows = [(f"t{i}-{j}", f"l{i:02d}", "train") for i in range(16) for j in range(5)] + [(f"x{j}", "l15", "test") for j in range(40)]
    held = sp.with_target(spark.createDataFrame(rows, "text string, label string, split string"))
    assert {r.target for r in held.filter("label = 'l15'").collect()} == {sp.OUTSIDE_TOP}


CASES = [(1, "red pump leaks under load", "east"), (2, "pump leaks oil", "west"), (3, "pump noise", "west"), (4, "meter shows nothing", "east"),
         (5, "red pump leaks", "north")]


def test_retrieval_excludes_the_query_and_its_group(spark):
    docs = spark.createDataFrame(CASES, "id int, text string, group string")
    postings, weights = ti.fit_index(docs, "id", "text")
    groups = docs.select(F.col("id").alias("doc"), "group")

    def hits(query_id, group, **options):
        asked = ti.known_terms(docs.filter(F.col("id") == query_id), "id", "text", weights)
        own = spark.createDataFrame([(query_id, group)], "query int, group string")
        return [r.doc for r in ti.similar_elsewhere(asked, postings, own, groups, min_score=0.0, **options).orderBy("rank").collect()]

    assert hits(1, "east") == [5, 2]  # of the two in the west only the better one
    assert hits(1, "north") == [2] and hits(4, "east") == []
    assert hits(1, "east", limit=1) == [5]


def test_search_limits_ties_and_unknown_words(spark):
    docs = spark.createDataFrame([(10 * i, "pump and valve and gauge") for i in range(9)] + [(3, "valve")], "id int, text string")
    postings, weights = ti.fit_index(docs, "id", "text")
    asked = spark.createDataFrame([(1, "gauge pump"), (2, "qqq www"), (3, ""), (4, None)], "id int, text string")

    def found(**options):
        return [(r["query"], r.doc) for r in ti.search(asked, "id", "text", postings, weights, **options).orderBy("rank").collect()]

    assert found(limit=50) == [(1, 10 * i) for i in range(5)]
    assert found(limit=50, ceiling=None) == [(1, 10 * i) for i in range(9)]
    assert found(limit=2) == [(1, 0), (1, 10)] and found(limit=0) == []


def test_context_alone_finds_nothing_and_hits_show_their_cases(spark):
    docs = spark.createDataFrame(CASES, "id int, text string, group string")
    postings, weights = ti.fit_index(docs, "id", "text")
    appeals = spark.createDataFrame([(1, "  ", "pump"), (2, None, "pump"), (3, "leaks oil", "pump")], "id int, t string, service string").withColumn(
        "appeal", ti.appeal_text("t", "service"))
    hits = ti.search(appeals, "id", "appeal", postings, weights, limit=1)
    asked = ti.known_terms(appeals, "id", "appeal", weights)
    cases = docs.select(F.col("id").alias("doc"), "group")
    shown = ti.hit_cases(hits, cases, ti.explain_hits(hits, asked, postings)).collect()
    assert [(r["query"], r.doc, r.group) for r in shown] == [(3, 2, "west")]
    assert set(shown[0].explanation.split(", ")) == {"leaks oil", "oil", "pump leaks", "leaks", "pump"}


def test_a_rare_term_beyond_any_limit_still_finds_its_document(spark):
    docs = spark.createDataFrame([(i, f"common words only{i}") for i in range(50)] + [(99, "common needle")], "id int, text string")
    postings, weights = ti.fit_index(docs, "id", "text")
    assert weights.count() > 100
    hits = ti.search(spark.createDataFrame([(1, "needle")], "id int, text string"), "id", "text", postings, weights).collect()
    assert [r.doc for r in hits] == [99]


def test_spread_terms_give_the_same_scores(spark):
    docs = table(spark, FOLDER, "documents")
    postings, weights = ti.fit_index(docs, "doc_id", "text")
    asked = ti.known_terms(table(spark, FOLDER, "benchmark"), "item_id", "text", weights)
    plain = ti.pair_scores(asked, postings)
    wide = ti.pair_scores(*ti.spread_terms(asked, postings, weights, rows_per_lane=20))
    assert plain.count() == wide.count()
    assert plain.join(wide.withColumnRenamed("score", "other"), ["query", "doc"]).filter("abs(score - other) > 1e-8").count() == 0


def test_pruned_search_finds_what_all_pairs_find(spark):
    """Same hits, ranks and scores as from every pair that shares a term, from far fewer pairs."""
    docs = table(spark, FOLDER, "documents")
    postings, weights = ti.fit_index(docs, "doc_id", "text")
    asked = ti.known_terms(table(spark, FOLDER, "benchmark"), "item_id", "text", weights)
    every = ti.pair_scores(asked, postings)
    for limit, floor in ((1, None), (5, None), (5, 0.2)):
        def settle(scores):
            return ti.top_hits(scores, limit, floor)
        scored = ti.pruned_scores(asked, postings, weights, settle, limit, floor or 0.0)
        expected = {(r["query"], r["doc"], r["rank"]): r["score"] for r in settle(every).collect()}
        found = {(r["query"], r["doc"], r["rank"]): r["score"] for r in settle(scored).collect()}
        assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-7 for k in found)
        assert scored.count() < every.count()


def test_pruned_search_of_random_words(spark):
    import random
    maker = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(maker.choices(words, [1 / (n + 1) for n in range(30)], k=maker.randrange(1, 12)))) for i in range(150)]
                                 + [(1000 + i, "w0 w1") for i in range(20)], "id int, text string")
    groups = docs.select(F.col("id").alias("doc"), (F.col("id") % 40).alias("group"))
    postings, weights = ti.fit_index(docs, "id", "text")
    asked = ti.known_terms(docs, "id", "text", weights)
    own = groups.withColumnRenamed("doc", "query")
    for limit, floor in ((3, 0.1), (50, 0.0), (1, 0.6)):
        plain = ti.similar_elsewhere(asked, postings, own, groups, limit, floor)
        pruned = ti.similar_elsewhere(asked, postings, own, groups, limit, floor, weights)
        rows = [sorted((r["query"], r["doc"], r["rank"], round(r["score"], 6)) for r in x.collect()) for x in (plain, pruned)]
        assert rows[0] == rows[1] and rows[0]


def test_blocks_of_documents_give_the_hits_of_all_pairs(spark, monkeypatch):
    """Same hits from one block and from many, with repeated and null groups, ids without a group and null ids."""
    import random

    from ticketlens.operators import scoreblocks as sb
    maker = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(maker.choices(words, [1 / (n + 1) for n in range(30)], k=maker.randrange(1, 12)))) for i in range(150)]
                                 + [(1000 + i, "w0 w1") for i in range(20)] + [(None, "w0 w2"), (2000, ""), (2001, None)], "id int, text string")
    groups = docs.select(F.col("id").alias("doc"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("g"), F.col("id") % 40)).alias("group")).filter("doc <> 7")
    groups = groups.unionByName(spark.createDataFrame([(3, "g9"), (3, "g3"), (11, None)], "doc int, group string"))
    postings, weights = ti.fit_index(docs, "id", "text")
    asked = ti.known_terms(docs, "id", "text", weights)
    own = groups.withColumnRenamed("doc", "query")
    for limit, floor, size in ((3, 0.1, 4096), (3, 0.1, 40), (50, 0.0, 40)):
        monkeypatch.setattr(sb, "BLOCK_ROWS", size)
        plain = ti.similar_elsewhere(asked, postings, own, groups, limit, floor)
        blocks = ti.similar_elsewhere(asked, postings, own, groups, limit, floor, blocks=True)
        found = [sorted((r["query"], r["doc"], r["rank"], round(r["score"], 6)) for r in x.collect()) for x in (plain, blocks)]
        assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("cells", [0, 8, 10 ** 9])
def test_dense_and_sparse_products_are_the_same(monkeypatch, cells):
    import numpy as np

    from ticketlens.operators import scoreblocks as sb
    maker = np.random.default_rng(4)
    monkeypatch.setattr(sb, "DENSE_CELLS", cells)
    monkeypatch.setattr(sb, "DENSE_TERMS", 3)
    monkeypatch.setattr(sb, "SLAB_PRODUCTS", 7)
    sides = [np.where(maker.random((n, 20)) < np.linspace(0, 1, 20), maker.random((n, 20)), 0.0) for n in (6, 9)]
    by_term = [sb._by_term(*np.nonzero(x), x[np.nonzero(x)], 20) for x in sides]
    assert np.allclose(sb._products(20, *by_term, 6, 9), sides[0] @ sides[1].T)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
@pytest.mark.parametrize("min_df", [1, 2])
def test_corpus_weights_do_not_depend_on_broadcast_terms(spark, monkeypatch, frequent, min_df):
    docs = spark.createDataFrame([(i, f"pump valve pump {'gauge' if i % 2 else 'meter'} word{i % 5} single{i}") for i in range(12)]
                                 + [(3, "pump again"), (None, "pump valve"), (50, None)], "id int, text string")
    monkeypatch.setattr(ti, "BROADCAST_TERMS", frequent)
    postings, weights = ti.fit_index(docs, "id", "text", min_df=min_df)
    plain = ti.tfidf(ti.term_counts(docs, "id", "text"), weights)
    rows = [sorted((r.doc is None, r.doc or 0, r.term, round(r.weight, 9)) for r in x.collect()) for x in (postings, plain)]
    assert rows[0] == rows[1] and rows[0]


def test_postings_of_a_corpus_are_shuffled_once_as_texts(spark):
    """Postings of frequent terms stay with their document: no exchange stands between the terms and the scaling of a document."""
    docs = spark.createDataFrame([(i, "pump valve gauge meter") for i in range(20)], "id int, text string")
    postings, _ = ti.fit_index(docs, "id", "text")
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Window"):plan.index("Union")]


@pytest.mark.parametrize("limit", [1, 7, 50, 399, 400, 1000])
def test_limited_vocabulary_equals_a_sorted_one(spark, limit):
    # Many ties among small totals, and large totals that share a bin.
    counts = spark.range(400).select(F.lit(1).alias("doc"), F.format_string("t%03d", (F.col("id") * 7) % 400).alias("term"),
                                     F.when(F.col("id") < 300, F.col("id") % 5 + 1).otherwise(1_000_000 + F.col("id") * 3).alias("tf"))
    got = {(r.term, r.total) for r in ti.vocabulary(counts, limit=limit).collect()}
    want = sorted(((r.term, r.tf) for r in counts.collect()), key=lambda x: (-x[1], x[0]))[:limit]
    assert got == set(want)


def test_frequent_words_make_no_fragment_of_unrelated_texts(spark):
    """Texts of the same 400 words, 60 in each, shared 24,000 rows of rare-word prefixes and met in all pairs; whole fragments keep them apart."""
    import random
    draw = random.Random(4)
    texts = [" ".join(f"w{i}" for i in draw.sample(range(400), 60)) for _ in range(400)]
    family = [" ".join([*texts[0].split(), f"x{i}"]) for i in range(3)]
    sets = nb.token_sets(spark.createDataFrame(list(enumerate(texts + family)), "id int, text string"), "id", "text").sets
    shared = nb.prefixes(sets)
    met = shared.alias("a").join(shared.alias("b"), F.expr("a.token = b.token AND a.rep < b.rep")).select("a.rep", "b.rep").distinct().count()
    assert met < 400 * 10
    assert {(r.rep_a, r.rep_b) for r in nb.similar_sets(sets).collect()} == set(itertools.combinations([0, 400, 401, 402], 2))


def test_components_of_large_graphs_are_those_of_small_ones(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 6), (7, 7), (None, 4), (20, 21), (21, 5)], "a int, b int")
    small = sorted(map(tuple, nb.connected_components(edges, "a", "b").collect()))
    monkeypatch.setattr(nb, "SMALL_EDGES", 0)
    assert small == sorted(map(tuple, nb.connected_components(edges, "a", "b").collect()))
    assert dict(small) == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 5, 20: 5, 21: 5}


def test_materialize_leaves_no_shuffle_files(spark):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.length()))

    before = left()
    frame = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert left() <= before and frame.count() == 7


def test_blocks_of_documents_are_written_once_for_all_blocks_of_queries(spark, monkeypatch):
    import numpy as np

    from ticketlens.operators import scoreblocks as sb
    docs = spark.createDataFrame([(i, f"pump{i % 7} valve{i % 5} gauge") for i in range(90)], "id int, text string")
    postings, weights = ti.fit_index(docs, "id", "text")
    asked = materialize(ti.known_terms(docs, "id", "text", weights))
    groups = docs.select(F.col("id").alias("doc"), F.col("id").alias("group"))
    written = {}
    monkeypatch.setattr(sb, "materialize", lambda df, label="step": written.setdefault(label, []).append(materialize(df, label)) or written[label][-1])
    for rows, postings_of_block, rounds in ((10, 10 ** 6, 9), (100, 10 ** 6, 1), (100, 100, 5)):
        monkeypatch.setattr(sb, "BLOCK_ROWS", rows)
        monkeypatch.setattr(sb, "BLOCK_POSTINGS", postings_of_block)
        written.clear()
        frames = list(sb.block_scores(asked, postings, groups.withColumnRenamed("doc", "query"), groups, 3, 0.1, 9, postings.count()))
        assert len(frames) == rounds and len(written["doc_blocks"]) == 1
        stored = written["doc_blocks"][0].collect()
        assert sum(len(np.frombuffer(r["term"])) for r in stored) == postings.count() and sum(len(r["ids"]) for r in stored) == 90


def test_worksheet_scores_its_sample_alone(spark, monkeypatch, tmp_path):
    from ticketlens.plans import load_queries
    rows = [(i, f"pump{i} valve{i % 9} gauge{i % 11} leaks{i % 13} oil{i % 17}", "en", f"s{i % 2}", 40) for i in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    scored = []
    whole = ti.similar_elsewhere
    monkeypatch.setattr(ti, "similar_elsewhere", lambda asked, postings, own, groups, **options: scored.append(own.count()) or whole(asked, postings, own, groups, **options))
    columns = {"result": "doc", "similarity": "score"}
    sheet = load_queries()["review_worksheet"].run(spark, str(tmp_path)).withColumnsRenamed(columns).filter("rank > 0")
    hits = load_queries()["similar_outside_group"].run(spark, str(tmp_path)).join(sheet.select("query").distinct(), "query", "left_semi")
    assert scored[0] == 30 and scored[1] == 90
    assert sorted(sheet.select("query", "doc", "rank", "score").collect()) == sorted(hits.select("query", "doc", "rank", "score").collect()) != []
