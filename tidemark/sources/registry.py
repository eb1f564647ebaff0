"""The registry of sources: reading, checks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blank, text, trimmed, truthy
from tidemark.schemas import SOURCE, conform

METHODS = r"(?i)^(RSS|MANUAL|JSON:.+|HTML:.+)$"


def is_id(c: Column) -> Column:
    """1 to 40 characters, none of them white space."""
    return F.coalesce(F.length(trimmed(c)).between(1, 40) & ~trimmed(c).rlike(r"(?U)\s"), F.lit(False))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a CSV or Parquet file; rows whose id is none are left out."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    ready = conform(raw.withColumn("active", truthy(F.col("active"))) if "active" in raw.columns else raw, SOURCE)
    return ready.filter(is_id(F.col("source_id")))


def problems(sources: DataFrame) -> DataFrame:
    """code, problem: codes that repeat, sources without address that aren't manual, unknown methods."""
    twice = sources.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("code", F.lit("code repeats").alias("problem"))
    manual = F.upper(trimmed(text(F.col("method")))) == "MANUAL"
    no_url = sources.filter(~manual & blank(F.col("url"))).select("code", F.lit("no address").alias("problem"))
    odd = sources.filter(~trimmed(text(F.col("method"))).rlike(METHODS)).select("code", F.lit("unknown method").alias("problem"))
    return twice.unionByName(no_url).unionByName(odd)


def counts(sources: DataFrame) -> DataFrame:
    """kind (RSS, JSON, HTML, MANUAL), sources and active ones."""
    return sources.groupBy(F.upper(F.substring_index(trimmed(F.col("method")), ":", 1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("n_active"))


def with_defaults(entries: DataFrame, sources: DataFrame, *, key: str = "source_id") -> DataFrame:
    """Entries as notices: what an entry says of itself, else its source's default, else what its title gives away.

    Sources join by key; Spark broadcasts them if their size is under its limit, and shuffles both sides if not.
    """
    from tidemark.functions import vocabulary as v
    from tidemark.functions.classify import infer_sector, normalize_type
    from tidemark.functions.text import or_null, truncate

    joined = entries.withColumnRenamed("source", "_source").join(sources.select(F.col("source_id").alias(key), "name", "default_country", "default_sector", "default_type"), key, "left")
    first = lambda *cs: F.coalesce(*(or_null(F.col(c)) for c in cs))
    return joined.withColumns(
        {
            "organisation": first("organisation", "name"), "country": first("country", "default_country"),
            "sector": F.coalesce(first("sector", "default_sector"), or_null(infer_sector(F.col("title"))), F.lit(v.UNKNOWN_SECTOR)),
            "type": F.coalesce(or_null(normalize_type(first("type", "default_type"))), F.lit(v.UNKNOWN_SECTOR)), "source": first("_source", key), "link": first("link"), "summary": truncate(F.col("summary")),
        }
    ).filter(~blank(F.col("title"))).drop("_source", "name", "default_country", "default_sector", "default_type")
