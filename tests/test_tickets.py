import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import analytics as an
from ticketlens.operators import enrich as en
from ticketlens.operators import filters as fl
from ticketlens.operators.scaling import attach_by_key, ranked, sums_with_median

COLUMNS = {"ticket_id": "string", "reg_dt": "string", "service": "string", "category_original": "string", "category_grouped": "string",
           "priority": "string", "resolved_line": "string", "fact_sla_h": "double", "is_overdue": "int", "is_multiline": "int",
           "is_high_clarifications": "int", "total_work_h": "double", "total_react_h": "double"}
MAIL, BILLING = "почта", "оплата"


def ticket_table(spark, rows):
    """Tickets given as (time, service, hours, overdue, further values by name); the rest follows a simple pattern."""
    full = []
    for number, (time, service, hours, overdue, *more) in enumerate(rows, 100):
        row = {"ticket_id": f"n-{number}", "reg_dt": time, "service": service, "category_original": f"про {service}", "category_grouped": f"про {service}",
               "priority": "p3", "resolved_line": "L1", "fact_sla_h": hours, "is_overdue": overdue, "is_multiline": number % 2,
               "is_high_clarifications": 1, "total_work_h": hours and hours / 4, "total_react_h": 0.25}
        full.append(tuple((row | (more[0] if more else {})).values()))
    return spark.createDataFrame(full, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def test_key_figures_and_shares(spark):
    rows = spark.createDataFrame([("x1", 0.5, 1, "net", "L2"), ("x2", 2.5, 1, "net", "L2"), ("x3", 4.0, 1, None, "L3"), ("x4", 13.0, 0, "db", None),
                                  ("x5", None, 0, "net", "L2")],
                                 "ticket_id string, fact_sla_h double, is_overdue int, category_grouped string, resolved_line string")
    answer = an.overview(rows)
    assert answer.status.first()[0] == "partial-data"
    kpis = answer.kpis.first()
    assert (kpis.total_appeals, kpis.overdue_count, kpis.overdue_share) == (5, 3, 0.6)
    assert (kpis.mean_sla_h, kpis.median_sla_h, kpis.multiline_count) == (5.0, 3.25, None)
    shares = {r[0]: (r[1], r[2]) for r in an.distribution(rows, "category_grouped").collect()}
    assert shares == {"net": (3, 0.6), "db": (1, 0.2), "Не указано": (1, 0.2)}
    assert answer.missing == an.missing_columns(rows.columns)


def test_figures_of_few_columns_and_of_no_rows(spark):
    kpis = an.overview(spark.createDataFrame([("7.25",), ("x",), ("0.75",), (None,)], "fact_sla_h string")).kpis.first()
    assert (kpis.total_appeals, kpis.overdue_count, kpis.mean_sla_h, kpis.median_sla_h) == (4, None, 4.0, 4.0)
    nothing = an.overview(ticket_table(spark, []))
    assert nothing.status.first()[0] == "no-data" and nothing.sample_sizes.first().filtered_records == 0


def test_period_keeps_the_whole_last_day_and_labels_narrow_it(spark):
    rows = ticket_table(spark, [
        ("2031-06-09T23:59:59.999", MAIL, 1.0, 0), ("2031-06-10T00:00:00", MAIL, 6.0, 1), ("2031-06-11T18:30:00", MAIL, 2.0, 0, {"priority": "p1"}),
        ("2031-06-11T23:59:59", BILLING, 3.0, 0), ("2031-06-12T00:00:00", MAIL, 5.0, 0), ("soon", MAIL, 9.0, 0)])

    def left(**choice):
        return sorted(int(r.ticket_id[2:]) - 100 for r in fl.filter_tickets(rows, **choice).collect())

    assert left(date_from="2031-06-10", date_to="2031-06-11") == [1, 2, 3]
    assert left(date_from="2031-06-10", date_to=dt.date(2031, 6, 11), service=MAIL) == [1, 2]
    assert left(date_to="2031-06-10T00:00:00") == [0, 1] and left(date_to=dt.datetime(2031, 6, 9, 23)) == []
    assert left(date_from="no date", priority=" p1 ") == [2] and left(category="Все", line="") == list(range(6))
    answer = an.overview(rows, date_from="2031-06-10", date_to="2031-06-11", category=f"про {MAIL}", line="L1")
    assert answer.applied_filters["date_from"] == "2031-06-10" and answer.kpis.first().total_appeals == 2
    assert (answer.sample_sizes.first()[0], answer.sample_sizes.first().filtered_records) == (6, 2)


def test_period_uses_the_written_time_and_ends_with_the_calendar(spark):
    rows = ticket_table(spark, [("2031-06-10T01:15:00+05:00", MAIL, 1.0, 0), ("9999-12-31T21:00:00", MAIL, 1.0, 0)])
    assert fl.filter_tickets(rows, date_from="2031-06-10", date_to="2031-06-10").count() == 1
    assert fl.filter_tickets(rows, date_to=dt.date(9999, 12, 31)).count() == 2
    with pytest.raises(ValueError):
        fl.check_date_range(dt.date(2031, 6, 11), dt.date(2031, 6, 10))


def test_risk_needs_rows_and_a_higher_share(spark):
    rows = ticket_table(spark, [("2031-06-10T00:00:00", s, 1.0, int(i < late)) for s, n, late in (("calm", 8, 1), ("late", 5, 4), ("rare", 2, 2))
                                for i in range(n)])
    risk = {r.value: r for r in an.historical_risk(an.dimension_metrics(rows, overall=True), 4, ["services"]).collect()}
    assert risk["late"].status == "elevated" and risk["late"].overdue_share == pytest.approx(0.8)
    assert risk["rare"].status == "insufficient-sample" and not risk["rare"].is_elevated_historical_risk
    assert not risk["calm"].is_elevated_historical_risk


def raw_table(spark, changes):
    base = {c: None for c in en.RUNTIME_INPUT}
    base.update({en.TICKET: " 1 ", en.CATEGORY: "A", en.WORK[1]: "01:00:00"})
    rows = [{**base, **c} for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in en.RUNTIME_INPUT) + (i,) for i, r in enumerate(rows)],
                                 ", ".join(f"`{c}` string" for c in en.RUNTIME_INPUT) + ", position int")


def test_sla_source_and_lines(spark):
    rows = en.enrich_tickets(raw_table(spark, [
        {en.FACT_SLA: "0:00:00"}, {en.FACT_SLA: None, en.REACT[2]: "0:30"}, {en.FACT_SLA: "bad", en.WORK[1]: None}])).orderBy("position")
    got = [(r.fact_sla_h, r.fact_sla_source, r.lines_count, r.is_multiline) for r in rows.collect()]
    assert got == [(0.0, "source", 1, 0), (1.5, "reconstructed_from_lines", 2, 1), (None, "missing", 0, 0)]
    assert rows.columns[: len(en.RUNTIME_INPUT)] == list(en.RUNTIME_INPUT)
    again = en.enrich_if_needed(rows)
    assert again is rows
    with pytest.raises(ValueError):
        en.enrich_tickets(rows.drop(en.SERVICE))


def test_top_categories_settle_ties_by_first_row(spark):
    names = [f"c{i:02d}" for i in reversed(range(17))] + ["Прочее"] * 5
    raw = raw_table(spark, [{en.CATEGORY: n} for n in names])
    by_name = {r.category_original for r in en.enrich_tickets(raw).filter("category_grouped <> 'Прочее'").collect()}
    by_row = {r.category_original for r in en.enrich_tickets(raw, seen_order="position").filter("category_grouped <> 'Прочее'").collect()}
    assert by_name == {f"c{i:02d}" for i in range(15)}
    assert by_row == {f"c{i:02d}" for i in range(2, 17)}


def test_outcomes_are_no_features():
    en.check_no_outcomes(en.REGISTRATION_COLUMNS)
    with pytest.raises(ValueError):
        en.check_no_outcomes(["service", "fact_sla_h"])


def test_search_takes_every_character_as_it_is(spark):
    rows = spark.createDataFrame([("50% off", "a_b", None, "Straße", 31, True, "hidden"), ("half off", "a-b", "", "STRASSE", 4, False, "hidden")],
                                 "title string, `x.y` string, none string, place string, n int, open boolean, _sheet string")
    found = {q: fl.search_values(rows, q).count() for q in ("%", "_", "strasse", "31", "true", "hidden", "title", "x.y", "50% OFF", "null", "")}
    assert found == {"%": 1, "_": 1, "strasse": 2, "31": 1, "true": 1, "hidden": 0, "title": 0, "x.y": 0, "50% off".upper(): 1, "null": 0, "": 2}


def test_search_of_objects_folds_and_leaves_metadata_out(spark):
    rows = spark.createDataFrame([(1, '{"a":"Straße","_sheet":"one"}'), (2, '{"b":true,"a":null}'), (3, '{"a":"x","c":"1"}'), (4, None)], "id int, o string")

    def ids(query, **options):
        return [r.id for r in fl.search_payload(rows, "o", query, **options).orderBy("id").collect()]

    assert ids("strasse") == [1] and ids("TRUE") == [2] and ids("one") == [] and ids("a") == [1]
    assert ids("1", columns=["a"]) == [] and ids("1", columns=["c"]) == [3]


def test_pages_end_with_the_last_rows():
    assert [fl.last_offset(n, 10) for n in (0, 1, 10, 11, 95)] == [0, 0, 0, 10, 90]


def test_median_of_skewed_groups_is_exact(spark):
    rows = spark.range(4001).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") == 1, "one").otherwise("b").alias("g"),
                                    (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7 - 3000).alias("x"))
    got = {r.g: r for r in sums_with_median(rows, ["g"], "x", {"n": F.lit(1)}, "m").collect()}
    for r in rows.groupBy("g").agg(F.median("x").alias("m"), F.count("x").alias("n")).collect():
        assert got[r.g].m == pytest.approx(r.m, rel=1e-12) and got[r.g].n == r.n


def test_rank_and_hot_key_join(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach_by_key(rows, facts, "k", ["id"])
    assert joined.count() == 500 and joined.filter("k = 'hot' AND n = 300").count() == 300 and joined.filter("n IS NULL").count() == 0
    placed = ranked(rows, ["k"], F.floor(F.col("id") / 7), [F.col("id")], "r", "total")
    assert placed.filter("k = 'hot' AND (r <> id + 1 OR total <> 300)").count() == 0


def test_named_ticket_columns_are_derived_alone(spark, tmp_path):
    import shutil

    from ticketlens.plans import views
    folder = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", folder)
    named = views.tickets(spark, folder, "position", "resolved_line", "category_grouped")
    assert not any(views._known(spark, folder, name) for name in ("raw_tickets", "tickets"))
    whole = views.tickets(spark, folder)
    assert sorted(map(tuple, named.collect()), key=str) == sorted(
        map(tuple, whole.select("position", "resolved_line", "category_grouped").collect()), key=str)
    assert views.tickets(spark, folder, "service").columns == ["service"] and not views._known(spark, folder, "tickets-service")


def test_named_columns_of_both_dialects_are_those_of_the_whole_table(spark, tmp_path):
    import shutil

    from ticketlens.plans import views
    from ticketlens.plans.ticket_queries import QUERY_COLUMNS
    folder = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", folder)
    raw = views._derived(spark, folder).limit(400).localCheckpoint()
    chosen = [*QUERY_COLUMNS.values(), ("fact_sla_source",), ("total_work_h", "fact_sla_h", "is_high_clarifications")]
    for enrich, more in ((en.enrich_tickets_batch, ("has_datetime_anomaly", "clarification_h", "lines_count_changed")), (en.enrich_tickets, ("position", "reg_dt"))):
        whole = enrich(raw).localCheckpoint()
        for columns in (*chosen, more):
            assert sorted(map(str, enrich(raw, columns=columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    rows = views.batch_tickets(spark, folder, *QUERY_COLUMNS["feature_partition"])
    assert rows.columns == ["service", "fact_sla_h"] and not any(views._known(spark, folder, name) for name in ("raw_tickets", "batch_tickets"))


def test_table_audit_writes_no_raw_table_and_blank_is_what_strips_to_nothing(spark, tmp_path):
    import shutil

    from ticketlens.functions import text as tx
    from ticketlens.plans import load_queries, views
    folder = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", folder)
    amounts = {(r.section, r["item"]): r.amount for r in load_queries()["table_audit"].run(spark, folder).collect()}
    assert not views._known(spark, folder, "raw_tickets")
    rows = views.raw_tickets(spark, folder)
    assert amounts["rows", ""] == rows.count() == sum(n for (section, _), n in amounts.items() if section == "sla_flag")
    texts = spark.createDataFrame([(x,) for x in (None, "", " ", "\n", " 　\x1c", "a", " a\n", "\n\na", "\U0001f600")], "x string")
    assert all(r.a == r.b for r in texts.select(tx.is_blank("x").alias("a"), tx.blank_to_null("x").isNull().alias("b")).collect())
