"""Keyed state over restarts: changed pages, late and repeated ones, expiry; the calls of a day."""

import datetime

import pytest

from tidemark.streaming.state import daily_calls, keep_state, page_changes

T = lambda d, h=0: datetime.datetime(2026, 9, d, h)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keep_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, schema, make, batches):
    """Each batch lands, and a query starts anew from the checkpoint; what each start has put out."""
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = f"{tmp_path}/out{n}"
        stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(lambda b, _, out=out: b.write.mode("append").parquet(out)).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        got.append([tuple(r) for r in spark.read.parquet(out).collect()])
    return got


def test_changed_pages_over_restarts(rocks, tmp_path):
    schema = "source_id string, url string, seen timestamp, content string"
    page = lambda d, c, u="u": ("s", u, T(d), c)
    got = run(
        rocks, tmp_path, schema, lambda s: page_changes(s, keep=datetime.timedelta(days=5)),
        [[page(1, "a"), page(1, "x", "v")], [page(2, "a"), page(3, "b")], [page(3, "b"), page(2, "z")], [page(20, "w", "t")], [page(21, "b"), page(21, "x", "v")]],
    )
    told = [sorted((r[1], r[2].day, r[3], r[4]) for r in rows) for rows in got]
    assert told[0] == [("u", 1, "a", True), ("v", 1, "x", True)]
    assert told[1] == [("u", 2, "a", False), ("u", 3, "b", True)]
    assert told[2] == []  # repeated, and older than what is known
    assert told[3] == [("t", 20, "w", True)]
    assert told[4] == [("u", 21, "b", True), ("v", 21, "x", True)]  # forgotten in between


def test_calls_of_a_day_under_a_cap(rocks, tmp_path):
    got = run(rocks, tmp_path, "call string, at timestamp", lambda s: daily_calls(s, most=3), [[("a", T(1, 1)), ("b", T(1, 2))], [("b", T(1, 2)), ("c", T(1, 3)), ("d", T(1, 4)), ("e", T(2, 1))]])
    assert sorted((r[0][-2:], r[1], r[3], r[4]) for r in got[0]) == [("01", "a", 1, True), ("01", "b", 2, True)]
    assert sorted((r[0][-2:], r[1], r[3], r[4]) for r in got[1]) == [("01", "c", 3, True), ("01", "d", 4, False), ("02", "e", 1, True)]
