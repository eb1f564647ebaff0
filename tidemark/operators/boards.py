"""What a pass reports and what boards show: filters by preference, verdicts of a model, summaries, tiles, facets, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, canonical, or_null, trimmed, truthy
from tidemark.operators.views import alert_level

# Fixed value: the type of entries that are read only if a client asks for them.
EVENT = "Evenement"
#: What a model's verdict may say; days are never taken from it.
JUDGED = ("sector", "type", "summary", "relevant", "opportunity")


def opportunities(entries: DataFrame) -> DataFrame:
    """Entries that nobody has judged to be no opportunity; one without verdict stays."""
    return entries.filter(~F.col("opportunity").eqNullSafe(F.lit(False)))


def relevant_ones(entries: DataFrame) -> DataFrame:
    """Opportunities that nobody has judged to be irrelevant."""
    return opportunities(entries).filter(~F.col("relevant").eqNullSafe(F.lit(False)))


def by_preferences(entries: DataFrame, *, events: bool = False, by_zone: bool = False) -> DataFrame:
    """Opportunities, without events unless asked for, and by zone if asked for. The zone is a choice of the client's, no rule."""
    kept = relevant_ones(entries) if by_zone else opportunities(entries)
    return kept if events else kept.filter(~F.col("type").eqNullSafe(F.lit(EVENT)))


def with_verdicts(entries: DataFrame, verdicts: DataFrame, on: list[str], sectors: list[str], types: list[str]) -> DataFrame:
    """Entries with what a model says of them: a sector or type of the closed lists, a summary that isn't blank, and two
    yes or no. What it leaves out or says wrongly keeps the entry's own value, as does an entry without verdict; a verdict of no
    entry is ignored, and of several for one the largest by its fields counts. No other field can come from a verdict.
    """
    one = verdicts.groupBy(*on).agg(F.max(F.struct(*JUDGED)).alias("_v"))
    joined = entries.join(one, on, "left")
    said = {
        "sector": canonical(F.col("_v.sector"), sectors), "type": canonical(F.col("_v.type"), types), "summary": or_null(trimmed(F.col("_v.summary"))),
        "relevant": F.col("_v.relevant"), "opportunity": F.col("_v.opportunity"),
    }
    return joined.select(*(F.coalesce(said[c], F.col(c)).alias(c) if c in said else F.col(c) for c in entries.columns))


def run_summary(notices: DataFrame, sent: int = 0) -> DataFrame:
    """added, updated, followed, sent: a pass in one row. notices: with `outcome` and `followed`."""
    return notices.agg(F.count_if(F.col("outcome") == "new").alias("added"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(truthy(F.col("followed"))).alias("followed"), F.lit(sent).cast("long").alias("sent"))


def tiles(notices: DataFrame, sources: DataFrame, days: str = "days_left", mark: str = "sent_new") -> DataFrame:
    """total, within_week (their deadline is in the coming week), sources (active ones) and alerts: a board's four tiles."""
    active = sources.agg(F.count_if(F.coalesce("active", F.lit(False))).alias("n")).first()["n"]
    alerts = F.count_if(alert_level(F.col(days), F.col(mark)).isNotNull())
    return notices.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(days).between(0, 7)).alias("within_week"), F.lit(active).cast("long").alias("sources"), alerts.alias("alerts"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: how often each value of each column stands there, blank ones left out, in one pass."""
    values = F.array(*(F.struct(F.lit(c).alias("facet"), trimmed(F.col(c).cast("string")).alias("value")) for c in columns))
    return rows.select(F.explode(values).alias("f")).select("f.*").filter(~blank(F.col("value"))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def by_facets(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that have the wanted value in each column for which one is given."""
    return reduce(lambda df, x: df.filter(F.col(x[0]) == x[1]), [(c, v) for c, v in wanted.items() if v], rows)


def form_options(rows: DataFrame, column: str) -> DataFrame:
    """The values of a list for a form: distinct, not blank."""
    return rows.select(trimmed(F.col(column)).alias("value")).filter(~blank(F.col("value"))).distinct()


def watch_lists(rows: DataFrame) -> DataFrame:
    """block, values: what is checked in each block of a watchlist (columns block, value, checked)."""
    return rows.filter(truthy(F.col("checked")) & ~blank(F.col("value"))).groupBy("block").agg(F.array_sort(F.collect_set(trimmed(F.col("value")))).alias("values"))


def calendar_candidates(notices: DataFrame, event: str) -> DataFrame:
    """Followed notices with a deadline that have no calendar event yet."""
    return notices.filter(truthy(F.col("followed")) & F.col("deadline").isNotNull() & blank(F.col(event)))


def calendar_text(*parts: Column) -> Column:
    """The parts of a calendar entry that aren't blank, a line each."""
    return F.concat_ws("\n", *(or_null(p) for p in parts))


def plan_order() -> list[Column]:
    """Plans as boards list them: by launch, then by reference."""
    return [F.col("launch").asc(), F.col("reference").asc()]


def deadline_list(notices: DataFrame, bucket: Column, wanted: list[str]) -> DataFrame:
    """Notices of some buckets, by days left."""
    return notices.withColumn("bucket", bucket).filter(F.col("bucket").isin(*wanted)).orderBy(F.col("days_left").asc_nulls_last(), "id")


def section_completeness(fields: DataFrame, section: str, value: str) -> DataFrame:
    """section, filled, fields, share: how much of each section of a profile is filled in."""
    told = fields.groupBy(section).agg(F.count_if(~blank(F.col(value))).alias("filled"), F.count(F.lit(1)).alias("fields"))
    return told.withColumn("share", F.round(F.col("filled") / F.col("fields"), 4))


def import_counters(entries: DataFrame, known: Column, excluded: Column, failed: Column) -> DataFrame:
    """imported, skipped, excluded, failed: each entry once; one that fails counts nowhere else, then what is known, then what is excluded."""
    told = entries.select(F.when(failed, "failed").when(known, "skipped").when(excluded, "excluded").otherwise("imported").alias("o"))
    return told.agg(*(F.count_if(F.col("o") == name).alias(name) for name in ("imported", "skipped", "excluded", "failed")))
