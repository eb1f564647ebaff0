"""Landed bodies: what a fetcher has written, as bytes with their headers. The engine itself never fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import blank, text, trimmed
from tidemark.operators.resolve import earlier_page

#: The control characters that windows-1252 uses for letters and signs, and what it means by them.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
MEANT = "".join(bytes([b]).decode("windows-1252", "ignore") or chr(b) for b in range(0x80, 0xA0))

LANDED = "source_id string, method string, url string, page int, status int, content_type string, content binary"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(path)


def charset(content_type: Column) -> Column:
    """The charset that a header names, as Spark spells it; UTF-8 if it names none that is known."""
    said = F.upper(F.regexp_extract(text(content_type), r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1))
    return F.when(said.isin("ISO-8859-1", "LATIN1", "LATIN-1", "WINDOWS-1252", "CP1252"), "ISO-8859-1").when(said.isin("UTF-16", "UTF-16BE", "UTF-16LE"), said).when(said == "US-ASCII", "US-ASCII").otherwise("UTF-8")


def decoded(content: Column, content_type: Column) -> Column:
    """The body as text; bytes that are no UTF-8 become replacement characters, which text.repair() handles. What calls itself Latin-1 is read as windows-1252, as browsers do."""
    named = charset(content_type)
    out = F.when(named == "UTF-8", F.call_function("make_valid_utf8", content.cast("string")))
    for name in ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE"):
        read = F.decode(content, name)
        out = out.when(named == name, F.translate(read, CONTROLS, MEANT) if name == "ISO-8859-1" else read)
    return out


def pages_to_read(landed: DataFrame, most: int = 20) -> DataFrame:
    """List pages that answered (from page 1; page 0 is a detail page), up to the page before a source's first failure after page 1, and no more than `most`."""
    stops = landed.filter((F.col("status") != 200) & (F.col("page") > 1)).groupBy("source_id").agg(F.min("page").alias("stop"))
    return landed.join(stops, "source_id", "left").filter((F.col("status") == 200) & F.col("page").between(1, most) & (F.col("stop").isNull() | (F.col("page") < F.col("stop")))).drop("stop")


def until_empty(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries up to the second of two pages in a row on which a source has none; pages: source_id and page of all that were read."""
    held = entries.groupBy("source_id", "page").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("source_id").orderBy("page")  # a source has some twenty pages
    told = pages.select("source_id", "page").distinct().join(held, ["source_id", "page"], "left").withColumn("empty", F.col("n").isNull())
    twice = told.withColumn("again", F.col("empty") & F.lag("empty").over(in_order)).filter("again").groupBy("source_id").agg(F.min("page").alias("_stop"))
    return entries.join(twice, "source_id", "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).select(*entries.columns)


def page_dedup(entries: DataFrame) -> DataFrame:
    """Entries that no earlier page of their source has, by link and title."""
    from tidemark.functions.text import normalize

    keyed = entries.withColumn("_key", F.concat_ws("|", normalize(F.col("link")), normalize(F.col("title"))))
    return earlier_page(keyed, ["source_id", "_key"], "page").drop("_key")


def address(entries: DataFrame) -> Column:
    """Where an entry's detail page is: not always where the notice is."""
    return F.coalesce(F.when(~blank(F.col("detail_url")), trimmed(F.col("detail_url"))), F.when(~blank(F.col("link")), trimmed(F.col("link"))))


def lacking() -> Column:
    """An entry of a source with detail pages lacks what only those tell: a deadline or the notice's own link."""
    return F.col("deadline").isNull() | blank(F.col("link"))


def details(landed: DataFrame, methods: DataFrame, readers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """source_id, address and what the detail pages say (link, source, deadline, published, summary; null where they don't). landed: page 0 is a detail page.

    methods: source_id, method. Of several pages of one address the last, by their bytes, stays.
    """
    named = landed.filter((F.col("page") == 0) & (F.col("status") == 200)).drop("method").join(methods, "source_id")
    body, fields = decoded(F.col("content"), F.col("content_type")), {"link": "string", "source": "string", "deadline": "date", "published": "date", "summary": "string"}
    said = F.lit(None).cast(f"struct<{','.join(f'{k}:{t}' for k, t in fields.items())}>")
    for method, read in readers.items():
        told = read(body)
        there = named.select(told.alias("d")).schema["d"].dataType.names
        said = F.when(F.lower(trimmed(F.col("method"))) == method.lower(), F.struct(*((told[k] if k in there else F.lit(None)).cast(t).alias(k) for k, t in fields.items()))).otherwise(said)
    read_ones = named.select("source_id", trimmed(F.col("url")).alias("address"), F.xxhash64("content").alias("h"), said.alias("d"))
    return read_ones.groupBy("source_id", "address").agg(F.max_by("d", "h").alias("d")).select("source_id", "address", "d.*")


def complete(entries: DataFrame, told: DataFrame) -> DataFrame:
    """Entries whose blanks are filled from their detail pages, with `address`."""
    from tidemark.operators.resolve import fill_blanks

    keyed = entries.withColumn("address", address(entries)).withColumn("_at", F.concat_ws(" ", "source_id", "address"))
    return fill_blanks(keyed, told.withColumn("_at", F.concat_ws(" ", "source_id", "address")), "_at", ["link", "source", "deadline", "published", "summary"]).drop("_at")


def ask(waiting: DataFrame, most: int = 12) -> DataFrame:
    """waiting with `asked`: the first `most` of each source, as read, are what the fetcher looks up before the next pass. The others wait.

    The rank stops at `most` rows of each task before the shuffle, and no order over all sources is made.
    """
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("page", "ord", "address"))
    first = waiting.select("source_id", "page", "ord", "address").withColumn("_n", nth).filter(F.col("_n") <= most).select("source_id", "address", F.lit(True).alias("asked"))
    return waiting.join(first, ["source_id", "address"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def errors(landed: DataFrame) -> DataFrame:
    """source_id, message of the pages that failed: one source's failure is a row, not the end of the pass."""
    return landed.filter(F.col("status") != 200).select("source_id", F.substring(F.format_string("HTTP %d on page %d", "status", "page"), 1, 500).alias("message"))
