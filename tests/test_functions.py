import math
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import text as tx
from ticketlens.functions import values as v
from ticketlens.operators.termindex import char_counts, term_counts


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_duration_hours(spark):
    got = column(spark, ["60:15:09", "2:30", "-0:30", "1.5:30", "5", "1:2:3:4", "", "n/a", "inf:1", None], v.duration_hours)
    assert got[0] == pytest.approx(216909 / 3600)
    assert got[1:4] == [2.5, -0.5, 2.0]
    assert got[4:] == [None] * 6


def test_batch_duration_may_be_infinite(spark):
    got = column(spark, ["inf:10", "-inf:0"], lambda x: v.duration_hours(x, allow_infinite=True))
    assert got == [math.inf, -math.inf]


def test_strict_duration(spark):
    values = ["60:15:09", "", "12:65:00", None]
    assert column(spark, values, v.strict_duration_seconds) == [216909, None, None, None]
    assert column(spark, values, v.strict_duration_invalid) == [False, False, True, False]


def test_dates_keep_the_written_wall_clock(spark):
    got = column(spark, ["2025-01-02T00:30:00+03:00", "02.01.2025 3:04:05", "2.1.25 3:04", "01.13.2025", "31.02.2024", "x", None],
                 lambda x: F.date_format(v.ticket_datetime(x), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2025-01-02 00:30:00", "2025-01-02 03:04:05", "2025-01-02 03:04:00", "2025-01-13 00:00:00", None, None, None]


def test_counts_flags_labels(spark):
    assert column(spark, ["1", "2,0", "2.5", "inf", "", None], v.clarification_count) == [1, 2, None, None, None, None]
    assert column(spark, ["Просрочен", " не  ПРОСРОЧЕН ", "ошибка", None], v.overdue_flag) == [1, 0, None, None]
    assert column(spark, [" A ", "  ", None], v.label) == ["A", "Не указано", "Не указано"]
    assert column(spark, [0.0, 1.0, 2.0, math.nan], lambda x: v.binary_flag(x, T.DoubleType()), "double") == [0, 1, None, None]
    assert column(spark, [True, False], lambda x: v.finite_number(x, T.BooleanType()), "boolean") == [None, None]


def test_white_space_is_that_of_unicode(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    got = column(spark, [f"a{s}{s}b{s}" for s in spaces], tx.clean_text)
    assert set(got) == {"a b"}
    assert column(spark, ["", "   ", None], tx.clean_text) == [None, None, None]


def test_text_outside_the_stable_class_is_normalised_too(spark):
    samples = ["ﬁle ①", "Ｆｕｌｌ", "é", "№ 5", "Straße", "ΣΑΣ", "plain text", "İstanbul"]
    assert column(spark, samples, tx.normalize_text) == [
        " ".join(unicodedata.normalize("NFKC", s).split()) for s in samples]
    assert column(spark, samples, tx.normalize_casefold) == [
        " ".join(unicodedata.normalize("NFKC", s).casefold().split()) for s in samples]


def test_stable_class_never_needs_python(spark):
    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c < 0x3000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").filter(F.col("c").rlike(tx.STABLE_TEXT))
    for c, folded in rows.select("c", tx.simple_casefold("c")).collect():
        assert unicodedata.normalize("NFKC", c) == c
        assert folded == c.casefold(), hex(ord(c))


def test_classifier_text_and_features(spark):
    got = column(spark, ["Добрый день! Ошибка 12 на http://x.ru/a a12", None], tx.classifier_text)
    assert got == ["ошибка <NUM> на <URL> a12", ""]
    rows = spark.createDataFrame([("Текст", "Портал", None)], "a string, b string, c string")
    assert rows.select(tx.feature_text("a", "b", "c")).first()[0] == "текст | портал | "


def test_terms(spark):
    rows = spark.createDataFrame([(1, "Не работает вход в портал2"), (2, "")], "id int, text string")
    assert {(r.doc, r.term) for r in term_counts(rows, "id", "text", tx.classifier_words).collect()} == {
        (1, "работает"), (1, "вход"), (1, "работает вход")}
    rows = spark.createDataFrame([(1, "ab  c ab")], "id int, text string")
    assert {(r.term, r.tf) for r in char_counts(rows, "id", "text").collect()} == {(" ab", 2), ("ab ", 2), (" ab ", 2), (" c ", 1)}


def test_values_beyond_any_number_are_null_and_end_no_job(spark):
    texts = ["1e30", "9999999999999999999", "3", "9000000000000000000:00:00", "1:00:00", "9" * 400 + ":00", "1e3:30", "9" * 120 + ":00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(v.clarification_count("t").alias("n"), v.clarification_count_batch("t").alias("m"), v.strict_duration_seconds("t").alias("s"),
                      v.duration_hours("t").alias("h")).collect()
    assert [r.n for r in got] == [None, None, 3, None, None, None, None, None] == [r.m for r in got]
    assert [r.s for r in got] == [None, None, None, None, 3600, None, None, None]
    assert got[4].h == 1.0 and got[5].h is None and got[6].h == 1000.5 and got[7].h > 1e119


def test_fractions_of_a_second_stay_in_canonical_cells(spark):
    rows = spark.sql("select timestamp_ntz'2031-06-10 10:00:00.123456' a, timestamp_ntz'2031-06-10 10:00:00' b, timestamp'2031-06-10 10:00:00.5' c")
    row = rows.select(*[v.canonical(f.name, f.dataType).alias(f.name) for f in rows.schema]).first()
    assert tuple(row) == ("2031-06-10T10:00:00.123456", "2031-06-10T10:00:00", "2031-06-10T10:00:00.500000")
