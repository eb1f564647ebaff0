"""A calendar sink: deadlines as iCalendar entries with their reminders, written by tasks and published only if all of them end."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.sources.archive import file_system

#: What the sink takes: the notice, its day, and days before it on which to remind (see operators.notify.calendar_days).
EVENT = "id string, title string, deadline date, description string, link string, remind array<int>"
# Fixed value: the longest line of a calendar file in bytes, its end not counted.
LINE = 75


def escaped(text: str | None) -> str:
    return re.sub(r"([\\;,])", r"\\\1", text or "").replace("\r\n", "\n").replace("\n", "\\n").replace("\r", "")


def folded(line: str) -> str:
    """The line in parts of LINE bytes at most, each but the first behind a blank; no character is cut in two."""
    out, held, room = [], b"", LINE
    for c in line:
        data = c.encode("utf-8", "replace")
        if len(held) + len(data) > room:
            out.append(held)
            held, room = b"", LINE - 1
        held += data
    return b"\r\n ".join([*out, held]).decode() + "\r\n"


def event_id(notice: str) -> str:
    """The same for a notice in every run, so that a calendar which gets it again changes the entry and adds none."""
    return f"{uuid.uuid5(uuid.NAMESPACE_URL, f'tidemark:{notice}')}@tidemark"


def event(id: str, title: str | None, day: date, description: str | None, link: str | None, remind: list[int] | None) -> str:
    """One all-day entry."""
    lines = ["BEGIN:VEVENT", f"UID:{event_id(id)}", f"DTSTAMP:{day:%Y%m%d}T000000Z", f"DTSTART;VALUE=DATE:{day:%Y%m%d}", f"DTEND;VALUE=DATE:{day + timedelta(days=1):%Y%m%d}", f"SUMMARY:{escaped(title)}", f"DESCRIPTION:{escaped(description)}"]
    lines += [f"URL:{link}"] if link else []
    for n in sorted(set(remind or [])):
        lines += ["BEGIN:VALARM", "ACTION:DISPLAY", f"TRIGGER:-P{n}D", f"DESCRIPTION:{escaped(title)}", "END:VALARM"]
    return "".join(map(folded, [*lines, "END:VEVENT"]))


@dataclass
class Written(WriterCommitMessage):
    """A task's file and the entries in it."""

    path: str
    ids: list[tuple[str, str]]


class CalendarWriter(DataSourceWriter):
    """Each task writes a hidden file of its own; commit renames those of tasks that counted, abort removes them.

    A task that was lost leaves a hidden file that no reader sees and the next commit removes. Rows without id or day are left out.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        path, ids = f"{root}/.{self.job}-{uuid.uuid4().hex}.ics", []
        with system.open_output_stream(path) as out:
            out.write(b"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//tidemark//EN\r\n")
            for r in iterator:
                if r["id"] is not None and r["deadline"] is not None:
                    out.write(event(r["id"], r["title"], r["deadline"], r["description"], r["link"], r["remind"]).encode())
                    ids.append((r["id"], event_id(r["id"])))
            out.write(b"END:VCALENDAR\r\n")
        return Written(path, ids)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        known, n = [], 0
        for m in filter(None, messages):
            if m.ids:
                system.move(m.path, f"{root}/{self.job}-{n:05d}.ics")
                known, n = known + m.ids, n + 1
            else:
                system.delete_file(m.path)
        with system.open_output_stream(f"{root}/{self.job}.ids.json") as out:
            out.write("".join(json.dumps({"id": a, "event": b}) + "\n" for a, b in known).encode())
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(f".{self.job}-"):
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith((f".{self.job}-", f"{self.job}-")):
                system.delete_file(f.path)


class CalendarSink(DataSource):
    """Format `tidemark_calendar`, to append rows of EVENT under `path`. What was written is read back as JSON lines of `*.ids.json`: id and event."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_calendar"

    def schema(self) -> str:
        return EVENT

    def writer(self, schema, overwrite: bool) -> CalendarWriter:
        return CalendarWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CalendarSink)
