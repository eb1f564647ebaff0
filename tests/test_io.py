"""Archives as a data source and the calendar sink: pruning, replay from an offset, whole files or none."""

import base64
import datetime
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.notify import calendar_days
from tidemark.sources import archive, calendar
from tidemark.sources.calendar import EVENT, escaped, event, folded


def put(root: Path, run: int, source: str, *texts: str, whole: bool = True):
    folder = root / f"source={source}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"method": "RSS", "url": f"https://{source}.org", "page": n + 1, "status": 200, "content_type": "text/html", "content": base64.b64encode(t.encode()).decode()}) for n, t in enumerate(texts)]
    (folder / f"{run:06d}.jsonl").write_text("\n".join([*lines, "not json"]) + "\n")
    if whole:
        (root / "_runs").mkdir(exist_ok=True)
        (root / "_runs" / str(run)).touch()


def test_published_runs_are_read_and_sources_pruned(spark, tmp_path):
    archive.register(spark)
    put(tmp_path, 1, "a", "x", "é")
    put(tmp_path, 1, "b", "y")
    put(tmp_path, 2, "a", "z", whole=False)
    read = spark.read.format("tidemark_landed").load(str(tmp_path))
    rows = read.filter("status = 200").collect()
    assert sorted((r["source_id"], r["page"], bytes(r["content"]).decode(), r["run"]) for r in rows) == [("a", 1, "x", 1), ("a", 2, "é", 1), ("b", 1, "y", 1)]
    assert read.filter("status = 0").count() == 2  # lines that can't be read
    one = read.filter("source_id = 'b'")
    assert one.rdd.getNumPartitions() == 1 and one.filter("status = 200").count() == 1
    assert read.filter(F.col("source_id").isin("b", "c")).rdd.getNumPartitions() == 1
    assert read.filter("source_id = 'c'").count() == 0


def test_a_stream_goes_on_from_its_offset_and_replays(spark, tmp_path):
    archive.register(spark)
    root = tmp_path / "in"

    def run(check, **options):
        got = []
        stream = spark.readStream.format("tidemark_landed").options(path=str(root), **options).load().filter("status = 200")
        stream.writeStream.foreachBatch(lambda b, _: got.extend((r["run"], r["source_id"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    put(root, 1, "a", "x")
    put(root, 2, "b", "y")
    assert run("c1") == [(1, "a"), (2, "b")]
    put(root, 4, "a", "z", whole=False)
    put(root, 3, "a", "w")
    assert run("c1") == [(3, "a")]
    (root / "_runs" / "4").touch()
    assert run("c1") == [(4, "a")] and run("c1") == []
    assert run("c2", after="2") == [(3, "a"), (4, "a")]  # replay from an offset
    assert run("c3", sources="b") == [(2, "b")]


def events(spark, rows):
    df = spark.createDataFrame(rows, "id string, title string, deadline date, description string, link string, setting string")
    return df.withColumn("remind", calendar_days(F.col("setting"))).drop("setting")


def parsed(text):
    """Lines of a calendar, unfolded."""
    assert text.endswith("\r\n") and all(len(line.encode()) <= 75 for line in text.split("\r\n"))
    return text.replace("\r\n ", "").split("\r\n")


def test_entries_are_written_whole_with_reminders_and_ids(spark, tmp_path):
    calendar.register(spark)
    title = "Étude; d'eau, « forage » " * 6
    rows = [("TP-1", title, datetime.date(2026, 9, 30), "l1\nl2\\", "https://x.org", "7;1"), ("TP-2", "B", datetime.date(2026, 10, 1), None, None, ""), (None, "no id", datetime.date(2026, 10, 1), None, None, ""), ("TP-3", "no day", None, None, None, "")]
    events(spark, rows).repartition(3).write.format("tidemark_calendar").mode("append").save(str(tmp_path / "cal"))
    files = sorted((tmp_path / "cal").glob("*.ics"))
    lines = [x for f in files for x in parsed(f.read_bytes().decode())]
    assert lines.count("BEGIN:VEVENT") == 2 and lines.count("BEGIN:VCALENDAR") == len(files) and "SUMMARY:" + escaped(title) in lines
    assert [x for x in lines if x.startswith("TRIGGER")] == ["TRIGGER:-P1D", "TRIGGER:-P7D"] and "DESCRIPTION:l1\\nl2\\\\" in lines and "DTEND;VALUE=DATE:20261001" in lines
    known = {r["id"]: r["event"] for r in spark.read.json(str(tmp_path / "cal" / "*.ids.json")).collect()}
    assert set(known) == {"TP-1", "TP-2"} and all(f"UID:{u}" in lines for u in known.values())
    assert not [p for p in os.listdir(tmp_path / "cal") if p.startswith(".") and p.endswith(".ics")]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    calendar.register(spark)
    rows = [(f"TP-{i}", "t", datetime.date(2026, 9, 30), None, None, "1") for i in range(20)]
    broken = events(spark, rows).repartition(4).withColumn("title", F.when(F.col("id") == "TP-13", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("tidemark_calendar").mode("append").save(str(tmp_path / "cal"))
    assert not [p for p in (os.listdir(tmp_path / "cal") if (tmp_path / "cal").exists() else []) if p.endswith(".ics")]


def test_folding_never_cuts_a_character():
    for text in ("a" * 75, "a" * 76, "é" * 200, "x" + "中" * 90, ""):
        out = folded(text)
        assert all(len(p.encode()) <= 75 for p in out.removesuffix("\r\n").split("\r\n")) and out.replace("\r\n ", "") == text + "\r\n"
    assert event("a", "t", datetime.date(2026, 12, 31), None, None, None).split("\r\n")[4] == "DTEND;VALUE=DATE:20270101"
    assert event("a", "t", datetime.date(2026, 1, 1), None, None, [3, 3]).count("VALARM") == 2 and EVENT.startswith("id")
