"""What the training-data operators share: row keys, checkpoints, names that don't clash, dictionary batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.components import settled as settle
from tidemark.operators.components import shared_folder

__all__ = ["Memo", "chunks", "col", "fresh", "only", "read", "row_key", "settle", "shared_folder"]

#: ASCII white space as the word rules of this package see it.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until it clashes with no column of df (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(text: Column, doc_id: Column) -> Column:
    """128 bits and the id that tell documents apart: rows that repeat both id and text are one document.

    The struct orders by id, a null id last, then by the text's hash.
    """
    return F.struct(
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"),
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def chunks(rows: Iterator, weight: Callable[[object], int], most: int) -> Iterator[list]:
    """Lists of rows that weigh about `most` each; a row heavier than that stands alone or ends its list."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


_held: dict = {}


def only(make: Callable, *args):
    """make(*args), kept in the worker for later tasks until another is asked for. Dictionaries of several stages would add up in a worker that Spark uses again."""
    key = (make, args)
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()  # what an earlier stage's batches took
        _held[key] = make(*args)
    return _held[key]


class Memo(dict):
    """word -> make(word), forgotten as a whole at `most` entries so that memory stays bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out
