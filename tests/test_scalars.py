"""Scalars and orders that no query shows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, dates
from tidemark.operators import boards, views

D = datetime.date


def test_today_is_that_of_the_zone(spark):
    row = spark.range(1).select(dates.today("Pacific/Kiritimati").alias("east"), dates.today("Etc/GMT+12").alias("west"), dates.today().alias("here")).first()
    assert (row["east"] - row["west"]).days in (1, 2) and row["west"] <= row["here"] <= row["east"]


@pytest.mark.parametrize(
    ("title", "elsewhere"),
    [("Travaux au Togo", True), ("Travaux au Bénin", False), ("Bénin et Togo", False), ("Etude régionale", False), ("Niger : puits", True), ("Nigeria", True), ("", False), (None, False)],
)
def test_titles_that_name_another_country(spark, title, elsewhere):
    got = spark.createDataFrame([(title,)], "t string").select(classify.names_elsewhere(F.col("t"), ["benin"]).alias("x")).first()["x"]
    assert bool(got) == elsewhere


def test_ranks_and_orders(spark):
    rows = [("a", "2 - A VOIR", "Togo", 3), ("b", "3 - PRIORITAIRE", None, None), ("c", "3 - PRIORITAIRE", "Benin", 9), ("d", "3 - PRIORITAIRE", "Togo", 1), ("e", None, "Benin", 1), ("f", "3 - PRIORITAIRE", "Bénin", 2)]
    df = spark.createDataFrame(rows, "ord string, relevance string, country string, days_left int").withColumn("rank", classify.country_rank(F.col("country"), "Benin; Togo"))
    assert {r["ord"]: r["rank"] for r in df.collect()} == {"a": 1, "b": 9999, "c": 0, "d": 1, "e": 0, "f": 0}
    assert [r["ord"] for r in df.orderBy(*views.by_relevance("ord", F.col("rank"))).collect()] == ["f", "c", "d", "b", "a", "e"]
    assert [r["ord"] for r in df.orderBy(*views.by_relevance()).collect()] == ["d", "f", "c", "b", "a", "e"]
    plans = spark.createDataFrame([("P2", D(2026, 9, 1)), ("P1", D(2026, 9, 1)), ("P0", D(2026, 10, 1)), ("P9", None)], "reference string, launch date")
    assert [r["reference"] for r in plans.orderBy(*boards.plan_order()).collect()] == ["P9", "P1", "P2", "P0"]


def test_reminders_of_a_file(spark):
    rows = [(7, "", True), (6, "", False), (7, "Gagne", False), (None, "", False), (0, None, True)]
    df = spark.createDataFrame(rows, "days int, status string, want boolean")
    got = df.select("want", classify.reminds(F.col("days"), F.col("status"), [7, 0], ("Gagne",)).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_what_a_form_lacks(spark):
    rows = [("T", "2026-09-30", "https://x.org", "12.5", 0), (" ", None, "x.org", "much", 4), ("T", "31/02/2026", None, None, 1), ("T", "2026-02-31", "", "", 1)]
    df = spark.createDataFrame(rows, "title string, deadline string, link string, budget string, want int")
    got = df.select("want", views.errors_of({c: F.col(c) for c in ("title", "deadline", "link", "budget")}).alias("e")).collect()
    assert [len(r["e"]) for r in got] == [r["want"] for r in got] and got[1]["e"][0] == "Le titre est obligatoire."
