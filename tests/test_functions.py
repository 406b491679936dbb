import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanloom.functions import facts
from spanloom.functions import text as T
from spanloom.functions import urls as U


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("1,234", "1234"), ("1.234,50", "1234.5"), ("1,234.50", "1234.5"), ("3,5", "3.5"), ("007", "7"), ("0.50", "0.5"), ("12%", "12%"), ("1,234,567", "1234567"), ("000", "0")])
def test_canonical_number(spark, raw, want):
    assert one(spark, T.canonical_number, raw) == "#number:" + want


def test_sentences_lose_nothing(spark):
    text = "First one. Second\nThird! 🚨 Fourth?  "
    rows = T.sentences(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "id string, text string"), ["id"]).orderBy("ordinal").collect()
    assert "".join(r["sentence"] for r in rows) == text
    assert all(text[r["start_off"] : r["end_off"]] == r["sentence"] for r in rows)


def test_sentence_like(spark):
    for text, want in (("", False), ("Myth : it is so, they say.", False), ("One two three four five", True), ("Short.", True), ("Prices rose 5", False), ("Nobel Prize 1998", True), ("Heading only", False), ("- An entry", True)):
        assert one(spark, T.is_sentence_like, text) is want, text


def test_utf16(spark):
    assert one(spark, T.utf16_length, "a🚨é") == 4
    df = spark.createDataFrame([("a🚨é",)], "x string")
    assert df.select(T.utf16_slice(F.col("x"), F.lit(1), F.lit(3))).first()[0] == "🚨"


def test_urls(spark):
    assert one(spark, U.canonical_url, "HTTP://Host.Example:80?b=2&a=1#top") == "https://host.example:80/?a=1&b=2"
    assert one(spark, U.source_identity, "https://web.archive.org/web/20200101/http://a.example//x//y") == "https://a.example/x/y"
    assert one(spark, U.raw_archive_url, "https://web.archive.org/web/2020/http://a.example/") == "https://web.archive.org/web/2020id_/http://a.example/"


def test_clean_and_title(spark):
    assert one(spark, T.clean_text, " a  b \r\n\r\n\r\n\r\nc\t\td ") == "a b\n\nc d"
    assert one(spark, T.html_title, "<title>\n A &amp; B\n</title>") == "A & B"


@pytest.mark.parametrize(("text", "want"), [
    ("It cost $2,050.10 in May 2020.", [(Decimal("2050.10"), "currency:$")]), ("rose 5 percentage points", [(Decimal(5), "percentage_point")]), ("12.5% of 3 million", [(Decimal("12.5"), "percent"), (Decimal(3000000), "count")]),
    ("COVID-19 and a 5-year plan", []), ("ran 10 km", [(Decimal(10), "unsupported:km")]), ("37 °C", [(Decimal(37), "temperature_celsius")]), ("no number", []),
])
def test_numbers(text, want):
    assert [(v, u) for v, u, _ in facts.numbers(text)] == want


@pytest.mark.parametrize(("text", "want"), [
    ("on March 5, 1997", [(dt.date(1997, 3, 5), dt.date(1997, 3, 5))]), ("5 March 1997", [(dt.date(1997, 3, 5), dt.date(1997, 3, 5))]), ("in February 2020", [(dt.date(2020, 2, 1), dt.date(2020, 2, 29))]), ("in 2001", [(dt.date(2001, 1, 1), dt.date(2001, 12, 31))]),
    ("February 30, 2020", []), ("in 1850", []),
])
def test_intervals(text, want):
    assert [(a, b) for a, b, _ in facts.intervals(text)] == want


def test_day_takes_the_only_year():
    assert (dt.date(2019, 6, 4), dt.date(2019, 6, 4)) in [(a, b) for a, b, _ in facts.intervals("In 2019 it began on June 4 there")]


def test_comparator_and_lists():
    assert facts.comparator("at least 3") == ">=" and facts.comparator("recovered 3") == ">" and facts.comparator("x ≤ 3") == "≤" and facts.comparator("none") is None
    assert facts.complete_lists("The board has three members: A, B and C.")[0]["items"] == ["a", "b", "c"]
    assert facts.complete_lists("The board has four members: A, B and C.") == []
    assert facts.complete_lists("This is the complete list:\n- One\n- Two\n")[0]["n_items"] == 2


def test_comparator_expression(spark):
    for text in ("at least 3", "no more than 4", "recovered", "x > 3", "nothing"):
        assert one(spark, facts.comparator_in, text) == facts.comparator(text)


def test_materialized_results_have_an_owner(spark, tmp_path):
    import glob

    from spanloom import session

    kept = session.materialize(spark.range(5), "numbers")
    assert kept.count() == 5
    folder = f"{session.shared_dir(spark)}/spanloom-{spark.sparkContext.applicationId}".replace("file://", "")
    assert glob.glob(f"{folder}/numbers-*")
    session.release(spark)
    assert not glob.glob(f"{folder}/*")
    assert session.materialize(spark.range(3), "numbers").count() == 3


def test_numbers_of_any_length_are_ordered(spark):
    said = ["0", "0.0000001", "0.000001", "0.5", "7", "12", "120", "120.5", "1 million", "9" * 22, "1" + "0" * 31, "1" + "0" * 32, "12" + "0" * 40, "9" * 600]
    rows = [one(spark, facts.numbers_in, x)[0] for x in said]
    keys = [r["key"] for r in rows]
    assert keys[0] == keys[1] and keys[1:] == sorted(set(keys)) and one(spark, facts.numbers_in, "12.50")[0]["key"] == one(spark, facts.numbers_in, "12.5")[0]["key"]
    assert [r["value"] for r in rows[4:6]] == [Decimal(7), Decimal(12)] and rows[10]["value"] == Decimal(10**31) and [r["value"] for r in rows[11:]] == [None] * 3
