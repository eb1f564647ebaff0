"""One pass over landed pages: read, fill in, filter, resolve, derive, and what to tell whom."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.functions.classify import is_plan_title, relevance
from tidemark.functions.ids import assign_ids, number_of
from tidemark.operators import messages, notify, resolve, sending, views
from tidemark.operators.components import settled
from tidemark.schemas import ENTRY, LOG, NOTICE, PLAN, conform
from tidemark.sources import apis, feeds, landing, pages
from tidemark.sources.entries import read_entries
from tidemark.sources.landing import decoded, page_dedup, pages_to_read, until_empty
from tidemark.sources.registry import with_defaults


@dataclass(frozen=True)
class Settings:
    """What a client follows and how a pass behaves."""

    countries: str = "Benin"
    sectors: str = ""
    keep_expired: bool = False
    keep_plans: bool = False
    per_source: int = 40
    details: int = 12
    sending: sending.Sending = field(default_factory=sending.Sending)
    notify: notify.Rules = field(default_factory=notify.Rules)


def all_readers(as_of: date) -> dict:
    return {"RSS": feeds.read_feed} | apis.READERS | pages.readers(F.lit(as_of))


#: Detail pages by the method of their source.
DETAILS = {"JSON:fundpilote.com": apis.fundpilote_detail, "HTML:jobrelais.com": pages.jobrelais_detail}
#: Entries that wait for their detail page, between passes.
PENDING = StructType([StructField("source_id", StringType()), StructField("page", IntegerType()), StructField("ord", IntegerType()), *ENTRY.fields, StructField("address", StringType()), StructField("asked", BooleanType())])


@dataclass
class Collected:
    """What a pass has read: entries as notices with ord, their place in the pass; entries that wait for details; a row for each source; counts."""

    notices: DataFrame
    pending: DataFrame
    report: DataFrame
    counts: dict[str, int]


def with_details(entries: DataFrame, landed: DataFrame, active: DataFrame, tracked: DataFrame | None, pending: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(entries that are whole or known, entries that wait). Only sources with detail pages have entries that wait.

    What waited before meets the detail pages that have landed since, and is asked for again if none has. An entry whose page was read and still
    lacks something goes: its page could not be read, which does not say that there is no deadline.
    """
    methods = active.select("source_id", "method").filter(F.lower(F.trim("method")).isin(*(m.lower() for m in DETAILS)))
    lists = entries.join(methods.select("source_id", F.lit(True).alias("_detailed")), "source_id", "left")
    lacks = F.coalesce(F.col("_detailed"), F.lit(False)) & landing.lacking()
    if tracked is not None:
        marked = settled(lists.withColumn("_place", F.monotonically_increasing_id()))
        ref = F.lit(None).cast("string")
        keys = resolve.dedup_keys(F.col("link"), F.col("title"), ref, F.col("organisation"), F.col("deadline"))
        met = resolve.known(marked.filter(lacks).select("_place", keys.alias("keys")), keyed(tracked), "keys", is_known=True).select("_place", F.lit(True).alias("_known"))
        lists = marked.join(met, "_place", "left").drop("_place")
    else:
        lists = lists.withColumn("_known", F.lit(False))
    needs = lacks & ~F.coalesce(F.col("_known"), F.lit(False))
    whole = lists.filter(~needs).select(*entries.columns)
    new = lists.filter(needs).select(*entries.columns)
    new = new.withColumn("address", landing.address(new)).filter(F.col("address").isNotNull())
    before = conform(pending, PENDING).drop("asked") if pending is not None else entries.sparkSession.createDataFrame([], PENDING).drop("asked")
    both = resolve.keep_first(before.withColumn("_new", F.lit(0)).unionByName(conform(new, PENDING).drop("asked").withColumn("_new", F.lit(1))), ["source_id", "address"], "_new").drop("_new")
    told = settled(landing.details(landed, methods, DETAILS))
    read = told.select("source_id", "address", F.lit(True).alias("_read"))
    filled = settled(landing.complete(both.drop("address"), told).join(read, ["source_id", "address"], "left"))
    done = filled.filter(F.col("_read") & ~landing.lacking())
    waits = landing.ask(filled.filter("_read is null").drop("_read"), most)
    return whole.unionByName(conform(done, whole.schema)), settled(conform(waits, PENDING))


def collect(landed: DataFrame, sources: DataFrame, as_of: date, settings: Settings, tracked: DataFrame | None = None, pending: DataFrame | None = None) -> Collected:
    """Reads the landed pages of active sources. A page whose source is unknown or not active is not read.

    Counts of what was read and kept come from the jobs that make the tables, by observation, not from further scans.
    """
    active = sources.filter(F.coalesce("active", F.lit(False)))
    ours = landed.join(active.select("source_id").distinct(), "source_id", "left_semi")
    bodies = settled(pages_to_read(ours).withColumn("body", decoded(F.col("content"), F.col("content_type"))).select("source_id", "method", "page", "body"))
    used = {r["m"] for r in active.select(F.lower(F.trim("method")).alias("m")).distinct().collect()}  # the registry names a few dozen
    readers = {k: v for k, v in all_readers(as_of).items() if k.lower() in used}
    seen, left = Observation(), Observation()
    read = settled(read_entries(bodies, readers or {"RSS": feeds.read_feed}).observe(seen, F.count(F.lit(1)).alias("read")))  # this table and the next are joined with their own aggregates
    entries = settled(page_dedup(until_empty(read, bodies)))
    if pending is None and not used & {m.lower() for m in DETAILS}:  # no source has detail pages
        whole, waits = entries, landed.sparkSession.createDataFrame([], PENDING)
    else:
        whole, waits = with_details(entries, ours, active, tracked, pending, settings.details)
        whole = settled(whole)
    repaired = resolve.identical_titles(whole, "source_id")
    open_ones = repaired if settings.keep_expired else repaired.filter(F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of)))
    calls = open_ones if settings.keep_plans else open_ones.filter(~is_plan_title(F.col("title")))
    placed = calls.withColumn("place", F.struct("page", "ord"))
    capped = views.cap_per_source(placed, "source_id", "place", settings.per_source).drop("place")
    filled = with_defaults(capped, sources)
    kept = settled(filled.withColumn("ord", F.format_string("%s|%08d|%08d", "source_id", "page", "ord")).observe(left, F.count(F.lit(1)).alias("kept")))
    report = source_report(active, ours, bodies, read, kept, as_of)
    return Collected(kept, waits, report, {"read": seen.get["read"], "kept": left.get["kept"]})


def source_report(active: DataFrame, landed: DataFrame, bodies: DataFrame, read: DataFrame, kept: DataFrame, as_of: date) -> DataFrame:
    """source_id, failed, read, kept, status: how each active source that has landed pages did. An empty feed is told from a page that can't be read."""
    pages_of = landed.groupBy("source_id").agg(F.bool_or((F.col("page") == 1) & (F.col("status") != 200)).alias("failed"))
    known = bodies.groupBy("source_id").agg(F.bool_or(feeds.is_feed(F.col("body"))).alias("recognised"))
    found = read.groupBy("source_id").agg(F.count(F.lit(1)).alias("read"), F.datediff(F.lit(as_of), F.max("published")).alias("age"), F.bool_or(F.coalesce(F.col("deadline") >= F.lit(as_of), F.lit(False))).alias("any_open"))
    left = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("kept"))
    joined = active.select("source_id").join(pages_of, "source_id").join(known, "source_id", "left").join(found, "source_id", "left").join(left, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = views.source_status(F.coalesce("failed", F.lit(False)), zero("read"), zero("kept"), F.coalesce("recognised", F.lit(False)), F.col("age"), F.col("any_open"))
    return joined.select("source_id", F.coalesce("failed", F.lit(False)).alias("failed"), zero("read").alias("read"), zero("kept").alias("kept"), status.alias("status"))


def keyed(notices: DataFrame) -> DataFrame:
    ref = F.col("ref") if "ref" in notices.columns else F.lit(None).cast("string")
    return notices.withColumn("keys", resolve.dedup_keys(F.col("link"), F.col("title"), ref, F.col("organisation"), F.col("deadline")))


@dataclass
class Pass:
    """A pass's tables: notices (with outcome), pending entries, plans, a report of sources, and LOG rows."""

    notices: DataFrame
    pending: DataFrame
    plans: DataFrame
    report: DataFrame
    log: DataFrame


def read_plans(landed: DataFrame, sources: DataFrame, as_of: date, held: DataFrame | None) -> DataFrame:
    """The forecast plans after a pass: those of before that are still ahead, and the lines of landed plan pages, the later of a reference. A plan's source has method PLAN; its name is the authority's."""
    named = landed.filter(F.col("status") == 200).drop("method").join(sources.filter(F.coalesce("active", F.lit(False)) & (F.upper(F.trim("method")) == "PLAN")).select("source_id", "name"), "source_id")
    lines = named.select("source_id", "page", F.posexplode(apis.plan_lines(decoded(F.col("content"), F.col("content_type")), F.col("name"), F.lit(as_of))).alias("nth", "l"))
    place = F.row_number().over(Window.partitionBy("l.reference").orderBy("source_id", "page", "nth"))
    new = lines.withColumn("ord", place).select("l.*", "ord")
    before = (conform(held, PLAN) if held is not None else landed.sparkSession.createDataFrame([], PLAN)).withColumn("ord", F.lit(0))
    return conform(views.merge_plans(before, new.select(*PLAN.names, "ord"), F.lit(as_of)), PLAN)


def full_pass(tracked: DataFrame, landed: DataFrame, sources: DataFrame, as_of: date, settings: Settings | None = None, *, pending: DataFrame | None = None, plans: DataFrame | None = None) -> Pass:
    """All that a pass makes of landed pages. Running the same pass again changes nothing: what was new is then known."""
    settings = settings or Settings()
    held = settled(conform(tracked, NOTICE).withColumn("ord", F.format_string("%020d", F.coalesce(number_of(F.col("id")), F.lit(0)))))
    found = collect(landed, sources, as_of, settings, held, pending)
    said = Observation()
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("new", "updated", "tracked")]
    merged = settled(resolve.upsert(keyed(held), keyed(found.notices), fields=resolve.UPDATABLE).observe(said, *counts))
    old = merged.filter("tracked").join(held.select("ord", *(c for c in held.columns if c not in (*resolve.UPDATABLE, "ord"))), "ord")
    new = assign_ids(conform(merged.filter("not tracked"), StructType([*NOTICE.fields, StructField("ord", StringType())])).withColumn("outcome", F.lit("new")), held, "ord")
    every = old.select(*NOTICE.fieldNames(), "outcome").unionByName(new.select(*NOTICE.fieldNames(), "outcome"))
    derived = views.derive(every, F.lit(as_of), relevance(F.col("country"), F.col("sector"), F.col("title"), settings.countries, settings.sectors))
    totals = found.counts | said.get
    return Pass(derived, found.pending, read_plans(landed, sources, as_of, plans), found.report, log_rows(found.report, landed, totals, as_of))


def log_rows(report: DataFrame, landed: DataFrame, totals: dict[str, int], as_of: date) -> DataFrame:
    """LOG rows of a pass: one for each source, one for each page that failed, and one with the pass's counts."""
    at = F.lit(as_of.isoformat())
    told = report.select(at.alias("at"), F.col("source_id").alias("source"), F.lit("Collecte").alias("action"), F.when(F.col("failed"), "ERROR").otherwise("SUCCESS").alias("status"), F.format_string("%s : %d lue(s), %d gardee(s)", "status", "read", "kept").alias("message"))
    failed = landing.errors(landed).select(at.alias("at"), F.col("source_id").alias("source"), F.lit("Page").alias("action"), F.lit("ERROR").alias("status"), "message")
    line = ", ".join(f"{k} {totals[k]}" for k in ("read", "kept", "new", "updated"))
    whole = report.sparkSession.createDataFrame([(as_of.isoformat(), None, "Passage", "SUCCESS", line)], LOG)
    return conform(told.unionByName(failed), LOG).unionByName(whole)


def run_pass(tracked: DataFrame, landed: DataFrame, sources: DataFrame, as_of: date, settings: Settings | None = None) -> DataFrame:
    """The tracked table after a pass, with `outcome`."""
    return full_pass(tracked, landed, sources, as_of, settings).notices


def outgoing(notices: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(messages, marks) of a pass: what goes out on each channel, and which rows are marked when all of a channel's messages are written.

    notices: with `outcome`; a row is new if the pass has just added it.
    """
    held = settled(notices)
    is_new = F.col("outcome") == "new"
    is_digest, planned = sending.plan(held, is_new, settings.sending)
    flagged = settled(sending.recap(planned.join(held.select("id", "days_left"), "id"), F.col("days_left")))
    return settled(messages.compose(held, flagged, is_digest, is_new)), flagged.filter("passes").select("id", "channel", "mark")


def mark_sent(notices: DataFrame, sent: DataFrame, channel: str) -> DataFrame:
    """notices with the marks of what was sent on a channel."""
    joined = notices.join(sent.filter(F.col("channel") == channel).select("id", "mark"), "id", "left")
    kinds = ("new", "j7", "j3", "j1", "expired")
    marked = {f"sent_{k}": F.when(F.array_contains("mark", k), notify.add_channel(F.col(f"sent_{k}"), channel)).otherwise(F.col(f"sent_{k}")) for k in kinds}
    return joined.withColumns(marked).drop("mark")
