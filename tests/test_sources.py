import pytest
from pyspark.sql import functions as F

from ticketlens.operators import evaluation as ev
from ticketlens.operators import models as ml
from ticketlens.session import scratch_path, scratch_root
from ticketlens.sources import files, ingest
from ticketlens.streaming import jobs


def test_headers():
    assert files.check_headers([" A ", "", None, "B"]) == ["A", "Unnamed: 1", "Unnamed: 2", "B"]
    assert files.check_headers(["A", "", "B"], blank="drop") == ["A", "B"]
    for names, checks in ((["A", " A "], {}), (["_sheet"], {}), (["A", ""], {"blank": "reject"}), (["A"], {"required": ["B"]}), ([], {})):
        with pytest.raises(ValueError):
            files.check_headers(names, **checks)


def test_csv_scan_keeps_text_and_rejects_ragged_rows(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes("﻿id,text\n001,\"two\nlines, \"\"quoted\"\"\"\n002,\n".encode())
    rows = files.read_ticket_csv(spark, str(good), "utf-8-sig").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("001", 'two\nlines, "quoted"'), ("002", "")]
    cyrillic = tmp_path / "cyr.csv"
    cyrillic.write_bytes("номер,текст\n1,Привет\n".encode("cp1251"))
    assert files.read_ticket_csv(spark, str(cyrillic), "windows-1251").first()["текст"] == "Привет"
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        files.read_ticket_csv(spark, str(ragged), "utf-8").collect()
    twice = tmp_path / "twice.csv"
    twice.write_text("a, a\n1,2\n")
    with pytest.raises(ValueError):
        files.read_ticket_csv(spark, str(twice), "utf-8")


def test_blank_rows_budget_and_active_sheet(spark):
    rows = spark.createDataFrame([(2, "x"), (3, ""), (4, "y"), (5, " "), (6, None)], "pos int, a string")
    assert [r.pos for r in ingest.drop_trailing_blank_rows(rows, "pos", ["a"]).orderBy("pos").collect()] == [2, 3, 4]
    assert ingest.drop_blank_rows(rows, ["a"]).count() == 2
    budget = ingest.shape_budget(rows.withColumn("sheet", F.lit("s")), "sheet", ["a"], max_rows=4).first()
    assert (budget.rows, budget.filled, budget.reason, budget.passed) == (5, 2, "rows", False)
    sheets = spark.createDataFrame([("d", "one", 3, 0), ("d", "two", 3, 1), ("d", "empty", 0, 2)], "dataset_id string, sheet string, row_count int, sheet_pos int")
    assert ingest.active_sheet(sheets).first().active_sheet == "one"


def test_record_ids_depend_on_content_position_and_dataset(spark):
    rows = spark.createDataFrame([(0, "a", "bc"), (1, "ab", "c"), (2, "a", "bc")], "n int, x string, y string")
    one = {r.n: r for r in ingest.ingest(rows, "d", "s", "n").collect()}
    again = {r.n: r for r in ingest.ingest(rows, "d", "s", "n").collect()}
    other = {r.n: r for r in ingest.ingest(rows, "e", "s", "n").collect()}
    assert [one[i]._source_row for i in range(3)] == [2, 3, 4]
    assert len({r._record_id for r in one.values()}) == 3 and one[0]._record_id == again[0]._record_id != other[0]._record_id


def test_scratch_follows_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark).startswith(configured)


def test_import_stream_stores_each_record_once(spark, tmp_path):
    landing, target = tmp_path / "in", scratch_path(spark, "stream-test")
    landing.mkdir()
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, t string").coalesce(1).write.mode("append").json(str(landing))
    source = lambda: spark.readStream.schema("id int, t string").json(str(landing))
    jobs.import_stream(source(), target, f"{target}-state", "d", "s", "id")
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, t string").coalesce(1).write.mode("append").json(str(landing))
    jobs.import_stream(source(), target, f"{target}-state", "d", "s", "id")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_two_streams_into_one_table_keep_all_their_rows(spark, tmp_path):
    target = scratch_path(spark, "two-streams")
    for name, state in (("one", "team-00/stream-08"), ("two", "team-04/stream-50")):
        landing = tmp_path / name
        spark.createDataFrame([(i, f"{name} {i}") for i in range(10)], "id int, t string").coalesce(1).write.json(str(landing))
        jobs.import_stream(spark.readStream.schema("id int, t string").json(str(landing)), target, f"{tmp_path}/{state}", "d", "s", "id")
    assert spark.read.parquet(target).count() == 20


def test_tables_kept_for_a_folder_follow_its_content(spark, tmp_path):
    from ticketlens.plans.views import once
    folder = str(tmp_path / "tables")
    count = lambda: once(spark, folder, "all", lambda: spark.read.parquet(f"{folder}/t.parquet")).count()
    spark.range(5).write.parquet(f"{folder}/t.parquet")
    assert count() == 5 == count()
    spark.range(3).write.mode("append").parquet(f"{folder}/t.parquet")
    assert count() == 8


def test_review_rules_in_order(spark):
    rows = spark.createDataFrame([("A", 0.7, 2), ("A", 0.69, 2), ("Прочее", 0.95, 2), ("Прочее / Неопределено", 0.95, 2), ("A", 0.9, 1)],
                                 "predicted string, confidence double, known_words int")
    assert [r[0] for r in rows.select(ev.review_reason("predicted", "confidence", "known_words")).collect()] == [
        None, "low-confidence", "ambiguous-category", "outside-top-15", "insufficient-features"]


def test_reported_f1_follows_from_a_confusion_matrix(spark):
    # Rows: actual line 1, 2, 3; columns: predicted line 1, 2, 3.
    matrix = [[149, 11, 0], [44, 38, 6], [5, 10, 8]]
    cells = spark.createDataFrame([(str(i), str(j), n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n], "actual string, predicted string, n long")
    report = {r.label: r for r in ev.class_report(cells).collect()}
    assert report["0"].f1 == pytest.approx(0.8324022346368715)
    assert report["1"].recall == pytest.approx(0.4318181818181818)
    assert report["2"].precision == pytest.approx(0.5714285714285714)


def test_threshold_choice(spark):
    scored = spark.createDataFrame([("a", "a", 0.9, False)] * 30 + [("a", "b", 0.5, False)] * 10, "actual string, predicted string, confidence double, rare_class boolean")
    assert ev.best_threshold(ev.threshold_sweep(scored)).first()[0] == pytest.approx(0.9, abs=1e-9)
    assert ev.best_threshold(ev.threshold_sweep(scored.limit(10))).first()[0] == 1.01


def test_triage_with_any_classifier_and_router(spark):
    rows = spark.createDataFrame([(1, 0.9, "3", 0.9, True), (2, 0.9, "3", 0.9, False), (3, 0.4, "3", 0.9, False), (4, 0.9, None, 0.0, True)],
                                 "doc int, c double, l string, lc double, review boolean")
    got = jobs.protocol_triage(
        rows, lambda d: d.select("doc", F.lit("x").alias("category"), F.col("c").alias("confidence"), F.lit(False).alias("needs_manual_review")),
        lambda d: d.select("doc", F.col("l").alias("line"), F.col("lc").alias("confidence"), F.col("review").alias("needs_review")))
    assert {r.doc: r.manual_review_required for r in got.collect()} == {1: True, 2: False, 3: True, 4: True}


WORDS = {"net": "сеть роутер интернет обрыв связь", "mail": "почта письмо ящик спам адрес", "door": "дверь замок ключ пропуск карта"}


def corpus(spark, size=60):
    rows = []
    for n, (label, words) in enumerate(WORDS.items()):
        w = words.split()
        rows += [(n * size + i, f"{w[i % 5]} {w[(i + 1) % 5]} {w[(i * 3 + 2) % 5]} сегодня {w[(i + i // 5) % 5]}", label) for i in range(size)]
    return spark.createDataFrame(rows, "id int, text string, label string")


def test_line_model_learns_abstains_and_explains(spark):
    rows = corpus(spark)
    train, held = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    model, candidates, _ = ml.fit_line_model(train, held, "id", "text", "label", max_iter=30)
    assert candidates.count() == 2
    scored = model.score(held, "id", "text").withColumns({"actual": F.col("label"), "predicted": F.col("line")})
    assert ev.evaluation(scored).first().accuracy > 0.95 > ev.majority_accuracy(train, held, "label").first()[0]
    unknown = model.score(spark.createDataFrame([(1, "zzzz"), (2, "")], "id int, text string"), "id", "text").collect()
    assert all(r.line is None and r.confidence == 0 and r.needs_review for r in unknown)
    counts = ml.line_counts(held, "id", "text")
    terms = ml.evidence(ml.weigh(counts, model.features), scored.select(F.col("id").alias("doc"), F.col("line").alias("label")), model.coefficients())
    assert terms.count() > 0 and terms.filter("contribution <= 0 OR place > 5").count() == 0


def test_evidence_takes_positive_coefficients_of_the_label_of_each_posting(spark):
    postings = spark.createDataFrame([(1, "word", "a", 0.5), (1, "word", "b", 0.9), (2, "word", "a", 0.4)], "doc int, space string, term string, weight double")
    answers = spark.createDataFrame([(1, "x"), (2, "y")], "doc int, label string")
    coefficients = spark.createDataFrame([("x", "word", "a", 1.0), ("x", "word", "b", -1.0), ("y", "word", "a", 0.0)],
                                         "label string, space string, term string, coefficient double")
    apart = ml.evidence(postings, answers, coefficients).select("doc", "place", "term", "contribution").collect()
    beside = ml.evidence(postings.join(answers, "doc"), None, coefficients).select("doc", "place", "term", "contribution").collect()
    assert apart == beside == [(1, 1, "a", 0.5)]


def test_category_model_is_calibrated(spark):
    rows = corpus(spark, 30)
    train, held = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    model = ml.fit_category_model(train, "id", "text", "label")
    scored = model.score(held, "id", "text").collect()
    assert sum(r.predicted == r.label for r in scored) / len(scored) > 0.95
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in scored) and all(r.known_words >= 2 for r in scored)


def test_import_checks_find_every_difference(spark):
    schema = "a int, b string, `c.d` double"
    rows = [(i, f"t{i % 3}", i / 2) for i in range(50)] + [(1, None, 1.0), (None, "x", None), (7, "t1", 3.5), (7, "t1", 3.5)]

    def checks(one, two, **options):
        frames = [spark.createDataFrame(part, schema) for part in (one, two)]
        return tuple(files.import_checks(frames[0], frames[1].withColumn("extra", F.lit(1)), **options).first())

    assert checks(rows, rows[::-1]) == (54, 54, 0, 0)
    assert checks(rows, rows[1:] + [(99, "new", None)], buckets=4) == (54, 54, 1, 1)
    # A copy more, and a null that changes places with its neighbour.
    assert checks(rows, rows + rows[-1:]) == (54, 55, 0, 1)
    assert checks([(1, "a", None)] * 2, [(1, "a", None)]) == (2, 1, 1, 0)
    swapped = [spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x"))]
    assert tuple(files.import_checks(*swapped).first()) == (1, 1, 1, 1)
    assert checks([], []) == (0, 0, 0, 0)


def test_equal_tables_are_not_compared_in_full(spark, monkeypatch):
    rows = spark.range(100).withColumn("t", F.col("id").cast("string"))
    monkeypatch.setattr(type(rows), "exceptAll", lambda *_: pytest.fail("full comparison"))
    assert tuple(files.import_checks(rows, rows).first()) == (100, 100, 0, 0)


def test_csv_files_grow_in_number_with_the_table(spark, monkeypatch):
    from ticketlens.plans import data_queries
    parts, write = [], data_queries.files.write_csv
    monkeypatch.setattr(data_queries.files, "write_csv", lambda rows, path: (parts.append(rows.rdd.getNumPartitions()), write(rows, path)))
    got = data_queries._csv_positions(spark, "/root/testdata/sf0.001").first()
    assert (got.low, got.high, got.positions) == (2, got.n + 1, got.n)
    assert parts[0] >= spark.sparkContext.defaultParallelism > 3


def test_column_profile_sorts_no_cells(spark):
    import datetime as dt

    from ticketlens.operators import quality as qu
    rows = spark.createDataFrame([(1, "=a", dt.date(2020, 1, 2)), (2, " ", None), (2, None, dt.date(2019, 3, 4))], "k int, t string, d date")
    got = qu.column_profile(rows)
    assert "SortAggregate(key=[column" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r.missing, r.distinct, r.formula_cells, r.date_min, r.date_max) for r in got.collect()} == {
        "k": (0, 2, 0, None, None), "t": (2, 1, 1, None, None), "d": (1, 2, 0, "2019-03-04 00:00:00", "2020-01-02 00:00:00")}
    assert qu.column_profile(rows.limit(0)).count() == 0


def test_machines_of_all_sets_share_one_copy_of_the_terms(spark):
    """Slopes of every set vanish at its weights, by dense algebra, also for a row whose terms were counted in two folds."""
    import numpy as np

    from ticketlens.operators import linear as ln
    maker = np.random.default_rng(3)
    sets, codes = [0, 1, 2, 3], 12
    places = {n: np.full(codes, -1, np.int32) for n in sets}
    idfs = {n: np.zeros(codes) for n in sets}
    for n in sets:
        own = np.flatnonzero(np.arange(codes) % 5 != n)
        places[n][own], idfs[n][own] = np.arange(len(own)), 1.0 + maker.random(len(own))
    terms = ln.Terms(places, idfs, np.repeat([0, 1], codes // 2))
    rows = []
    for i in range(60):
        chosen = sorted(maker.choice(codes, maker.integers(0, 6), replace=False).tolist())
        rows.append((i % 2, i % 3, chosen, maker.integers(1, 9, len(chosen)).tolist(), [i % 3] * len(chosen)))
    rows[7] = (1, 1, [2, 2, 8], [3, 3, 1], [0, 1, 1])
    counted = spark.createDataFrame(rows, "class_index int, fold int, codes array<int>, tf array<int>, folds array<int>")

    packed = ln.packed_sets(counted, terms).collect()
    plain = [row for i, row in enumerate(rows) if i != 7]
    assert sum(len(r["codes"]) // 4 for r in packed if len(r["fits"]) == 3) == sum(len(r[2]) for r in plain)
    weights = ln.fit_one_vs_rest(counted, terms, {n: [1.0, 2.0] for n in sets}, tol=1e-3)
    for n in sets:
        x, labels = [], []
        for label, fold, row_codes, tf, folds in rows:
            if fold == n - 1:
                continue
            dense = np.zeros((2, codes))
            squares = np.zeros(2)
            for code, times, entry_fold in zip(row_codes, tf, folds):
                if entry_fold != n - 1 and places[n][code] >= 0:
                    w = (1 + np.log(times)) * idfs[n][code]
                    dense[code // 6, code] += w
                    squares[code // 6] += w * w
            dense /= np.sqrt(np.where(squares > 0, squares, 1.0))[:, None]
            x.append(np.r_[dense.sum(axis=0)[places[n] >= 0], 1.0])
            labels.append(label)
        x = np.array(x)
        for machine in (0, 1):
            sign = np.where(np.array(labels) == machine, 1.0, -1.0)
            cost = np.where(sign > 0, [1.0, 2.0][machine], 1.0)

            def slope(w):
                return w - 2 * x.T @ (cost * sign * np.maximum(0.0, 1 - sign * (x @ w)))

            assert np.linalg.norm(slope(weights[n][machine])) < 1.001e-3 * np.linalg.norm(slope(np.zeros(x.shape[1])))
