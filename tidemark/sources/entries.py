"""What all readers return: an array of entries for each body, so that one scan reads feeds, APIs and pages alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ENTRY

Reader = Callable[[Column], Column]


def entry(**fields: Column | str | None) -> Column:
    """An entry; fields that aren't given are null, dates given as ISO text become dates."""

    def value(f):
        given = fields.get(f.name)
        c = given if isinstance(given, Column) else F.lit(given)
        return (F.call_function("try_to_date", c.cast("string"), F.lit("yyyy-MM-dd")) if f.dataType.typeName() == "date" else c.cast(f.dataType)).alias(f.name)

    return F.struct(*(value(f) for f in ENTRY))


def each(blocks: Column, make: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """make() of every block, those with a title that keep() accepts."""
    made = F.transform(blocks, make)
    return F.filter(made, lambda e: (F.coalesce(e["title"], F.lit("")) != "") & (keep(e) if keep else F.lit(True)))


def first_by(entries: Column, field: str) -> Column:
    """The first entry of each value of a field, in order."""
    values = F.transform(entries, lambda e: e[field])
    return F.filter(entries, lambda e, i: F.array_position(values, e[field]) == i + 1)


def read_entries(pages: DataFrame, readers: dict[str, Reader], *, method: str = "method", body: str = "body") -> DataFrame:
    """The entries of landed pages: the page's other columns, ord (its place on the page) and the entry's fields.

    One scan reads all: each row's method chooses its reader. A method without reader gives none, and so does a body that
    its reader can't make sense of.
    """
    carried = [c for c in pages.columns if c != body]
    found = F.when(F.lit(False), F.lit(None))
    for name, read in readers.items():
        found = found.when(F.lower(F.trim(method)) == name.lower(), read(F.col(body)).cast(f"array<{ENTRY.simpleString()}>"))
    return pages.select(*carried, F.posexplode(found).alias("ord", "e")).select(*carried, "ord", "e.*")
