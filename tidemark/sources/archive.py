"""Archives of landed bodies as a data source, in batches and as a stream.

A fetcher's run writes one file of JSON lines for each source, `source=ID/NUMBER.jsonl`, and then publishes the run by an empty file
`_runs/NUMBER`. Runs that aren't published are not read, so a run that is still being written, or was lost, is no half of one. Bodies are base64.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tidemark.sources.landing import LANDED

SCHEMA = f"{LANDED}, run long"


def file_system(path: str):
    """(file system, path there), by the path's scheme; executors must reach it too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Archive(InputPartition):
    """One file: a source's bodies of a run."""

    path: str
    source: str
    run: int


def _listed(path: str, folder: str) -> list[str]:
    from pyarrow import fs

    system, root = file_system(path)
    return [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))]


def published(path: str) -> list[int]:
    """Numbers of the runs that are whole."""
    return sorted(int(p.rsplit("/", 1)[1]) for p in _listed(path, "_runs"))


def archives(path: str, runs: list[int], sources: set[str] | None) -> list[Archive]:
    """Files of these runs. Folders of sources that nobody asks for are not listed."""
    wanted, out = set(runs), []
    for folder in _listed(path, ""):
        name = folder.rstrip("/").rsplit("/", 1)[1]
        source = name.removeprefix("source=")
        if name.startswith("source=") and (sources is None or source in sources):
            out += [Archive(f, source, run) for f in _listed(path, name) if f.endswith(".jsonl") and (run := int(f.rsplit("/", 1)[1].removesuffix(".jsonl"))) in wanted]
    return sorted(out, key=lambda a: (a.run, a.source))


def bodies(path: str, archive: Archive) -> Iterator[tuple]:
    """The rows of a file, a line at a time; a line that can't be read is a page that failed."""
    system, _ = file_system(path)
    with system.open_input_stream(archive.path) as raw:
        import io

        for line in io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8"):
            try:
                x = json.loads(line)
                row = (x.get("method"), x.get("url"), int(x.get("page") or 0), int(x.get("status") or 0), x.get("content_type"), base64.b64decode(x.get("content") or ""))
            except (ValueError, TypeError, AttributeError):
                row = (None, None, 0, 0, None, b"")
            yield (archive.source, *row, archive.run)


class ArchiveReader(DataSourceReader):
    """All published runs, a task for each file. Equality and membership of source_id are answered by not listing the other folders."""

    def __init__(self, path: str):
        self.path, self.sources = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source_id",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("source_id",):
                found = set(f.value)
            else:
                yield f
                continue
            self.sources = found if self.sources is None else self.sources & found

    def partitions(self) -> list[Archive]:
        return archives(self.path, published(self.path), self.sources)

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        return iter(()) if partition is None else bodies(self.path, partition)


class ArchiveStream(DataSourceStreamReader):
    """Runs in order of their numbers; an offset is the last run that has been read. A stream that starts from an offset again reads the same files."""

    def __init__(self, path: str, after: int, sources: set[str] | None):
        self.path, self.after, self.sources = path, after, sources

    def initialOffset(self) -> dict:  # noqa: N802
        return {"run": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"run": max([self.after, *published(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[Archive]:
        return archives(self.path, [r for r in published(self.path) if start["run"] < r <= end["run"]], self.sources)

    def read(self, partition: Archive) -> Iterator[tuple]:
        return bodies(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveSource(DataSource):
    """Format `tidemark_landed`. Options: path; for streams `after` (the run to start behind) and `sources` (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStream:  # noqa: N802
        named = [s.strip() for s in self.options.get("sources", "").split(",") if s.strip()]
        return ArchiveStream(self.options["path"], int(self.options.get("after", -1)), set(named) or None)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
