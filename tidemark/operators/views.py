"""Views of the tracked table: orders, counts, alerts, digests, boards and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import vocabulary as v
from tidemark.functions.classify import deadline_status
from tidemark.functions.text import blank, matches_any, trimmed
from tidemark.operators.components import settled
from tidemark.operators.rounds import ranked

# Alert levels in order, and days after which a source is silent.
LEVELS = ("urgent", "bientot", "expire", "nouvelle")
SILENT_AFTER = 180


def derive(notices: DataFrame, as_of: Column, relevance: Column, deadline: str = "deadline") -> DataFrame:
    """Days left, status and relevance of every row, computed anew."""
    days = F.datediff(F.col(deadline), as_of)
    return notices.withColumns({"days_left": days, "status": deadline_status(days), "relevance": relevance})


def by_relevance(order: str = "ord", rank: Column | None = None) -> list[Column]:
    """Order: relevance down, country rank if given, days up with none last, then as read."""
    first = [F.coalesce("relevance", F.lit("")).desc()]
    return [*first, *([rank.asc()] if rank is not None else []), F.coalesce("days_left", F.lit(9999)).asc(), F.col(order).asc()]


def by_deadline(order: str = "ord") -> list[Column]:
    """Order: days down with none last, relevance down, id; rows without days as read."""
    dated = F.col("days_left").isNotNull()
    return [F.col("days_left").desc_nulls_last(), F.when(dated, F.coalesce("relevance", F.lit(""))).desc_nulls_last(), F.when(dated, F.coalesce("id", F.lit(""))).asc(), F.col(order).asc()]


def inventory(notices: DataFrame, countries: list[str], sectors: list[str]) -> DataFrame:
    """kind, value, n, followed: notices by country and by sector in one pass, blank values left out."""
    named = notices.select(trimmed(F.coalesce("country", F.lit(""))).alias("country"), trimmed(F.coalesce("sector", F.lit(""))).alias("sector"))
    sets = named.groupingSets([["country"], ["sector"]], "country", "sector").agg(F.count(F.lit(1)).alias("n"), F.grouping("sector").alias("g"))
    kind = F.when(F.col("g") == 1, "Pays").otherwise("Secteur")
    told = sets.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("country")).otherwise(F.col("sector")).alias("value"), "n").filter("value <> ''")
    followed = F.when(F.col("kind") == "Pays", matches_any(F.col("value"), countries)).otherwise(matches_any(F.col("value"), sectors))
    return told.select("kind", "value", "n", F.when(followed, "OUI").otherwise("NON").alias("followed"))


def alert_level(days: Column, new_mark: Column) -> Column:
    """The level of a row's alert, or null: the coming week, the past week, or new without a deadline."""
    return F.when(days.between(0, 3), "urgent").when(days.between(4, 7), "bientot").when(days.between(-7, -1), "expire").when(days.isNull() & blank(new_mark), "nouvelle")


def alert_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def alerts(notices: DataFrame, most: int = 20, order: str = "ord") -> DataFrame:
    """The first `most` alerts, by level, then days. Spark keeps only so many of each partition."""
    level = alert_level(F.col("days_left"), F.col("sent_new"))
    held = notices.withColumn("level", level).filter("level is not null")
    return held.orderBy(alert_rank(F.col("level")), F.coalesce("days_left", F.lit(9999)), order).limit(most)


def count_levels(listed: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Rows of each level, zeros included."""
    return listed.agg(*(F.count_if(F.col(column) == name).alias(name) for name in levels))


def digest(notices: DataFrame, group: str | None, order: str = "ord") -> DataFrame:
    """position, group, n, nth, title: a row for each title. Groups stand in the order in which the sorted list first names them; nth goes on over all groups.

    Only a row for each group is gathered; titles are numbered over ranges, so a group may hold most of them.
    """
    best = F.translate(F.coalesce("relevance", F.lit("")), "0123456789", "9876543210")
    key = F.struct(F.when(best == "", "~").otherwise(best).alias("r"), F.coalesce("days_left", F.lit(9999)).alias("d"), F.col(order).alias("o"))
    name = F.coalesce(F.when(~blank(F.col(group)), trimmed(F.col(group))), F.lit(v.UNKNOWN_SECTOR)) if group else F.lit("")
    named = settled(notices.select(name.alias("group"), key.alias("key"), "title"))
    groups = ranked(named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")), ["first"], "position")
    placed = ranked(named.join(groups, "group"), ["position", "key"], "nth")
    return placed.select((F.col("position") + 1).cast("int").alias("position"), "group", "n", (F.col("nth") + 1).alias("nth"), "title")


def freshness(entries: DataFrame, source: str, published: str, as_of: Column) -> DataFrame:
    """source, age in days of its newest publication, silent; null age without any date."""
    age = F.datediff(as_of, F.max(published))
    return entries.groupBy(source).agg(age.alias("age")).withColumn("silent", F.coalesce(F.col("age") > SILENT_AFTER, F.lit(False)))


def source_status(failed: Column, read: Column, kept: Column, recognised: Column, age: Column, any_open: Column) -> Column:
    """The status of a source after a pass."""
    silent = F.coalesce(age > SILENT_AFTER, F.lit(False)) & ~F.coalesce(any_open, F.lit(False))
    return (
        F.when(failed, "ERREUR").when((read == 0) & recognised, "FLUX VIDE").when(read == 0, "RIEN LU").when(silent, F.format_string("SILENCIEUSE %d j", age)).when(kept == 0, "EN ATTENTE").otherwise("OK")
    )


def cap_per_source(entries: DataFrame, source: str, order: str, most: int = 40) -> DataFrame:
    """The first `most` rows of each source, as read: a report per source, so the limit is the feature."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def batches(place: Column, size: int) -> Column:
    """The batch of a row by its place from 1."""
    return F.floor((place - 1) / size).cast("int")


def rotation(place: Column, start: int, n: Column | int) -> Column:
    """The turn of a row, from 0, if the round starts at `start`."""
    return F.pmod(place - start, n if isinstance(n, Column) else F.lit(n))


def merge_plans(existing: DataFrame, new: DataFrame, as_of: Column, order: str = "ord") -> DataFrame:
    """Plans by reference: past ones of before go, new ones replace old ones, the last of several new ones stays."""
    held = existing.filter((F.col("launch") >= as_of) & ~blank(F.col("reference"))).withColumn("_turn", F.struct(F.lit(0).alias("a"), F.col(order).cast("long").alias("b")))
    both = held.unionByName(new.filter(~blank(F.col("reference"))).withColumn("_turn", F.struct(F.lit(1).alias("a"), F.col(order).cast("long").alias("b"))), allowMissingColumns=True)
    return both.groupBy("reference").agg(F.max_by(F.struct(*(c for c in both.columns if c != "_turn")), "_turn").alias("_r")).select("_r.*")


def sync_catalogue(held: DataFrame, shipped: DataFrame, key: str, technical: Sequence[str], own: Sequence[str]) -> DataFrame:
    """The catalogue after a release: missing sources are added, technical fields follow unless blank, `own` fields stay, nothing goes.

    outcome: added, updated, same or own (not shipped).
    """
    a, b = held.alias("h"), shipped.alias("s")
    joined = a.join(b, F.col(f"h.{key}") == F.col(f"s.{key}"), "full_outer")
    there, here = F.col(f"s.{key}").isNotNull(), F.col(f"h.{key}").isNotNull()
    new = {f: there & ~blank(F.col(f"s.{f}").cast("string")) & ~F.col(f"s.{f}").eqNullSafe(F.col(f"h.{f}")) for f in technical}
    any_new = F.lit(False)
    for c in new.values():
        any_new = any_new | c
    values = [F.when(~here | new[f], F.col(f"s.{f}")).otherwise(F.col(f"h.{f}")).alias(f) for f in technical]
    kept = [F.when(here, F.col(f"h.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in own]
    outcome = F.when(~here, "added").when(~there, "own").when(any_new, "updated").otherwise("same")
    return joined.select(F.coalesce(F.col(f"h.{key}"), F.col(f"s.{key}")).alias(key), *values, *kept, outcome.alias("outcome"))


def kpis(files: DataFrame, as_of: Column, *, status: str = "status", deadline: str = "deadline", added: str = "added") -> DataFrame:
    """One row: files in all, open, added in a week, deadlines by window among the open ones, and the share won of those decided."""
    closed = F.col(status).isin(*v.CLOSED)
    days = F.datediff(F.col(deadline), as_of)
    won, lost = F.count_if(F.col(status) == "Gagne"), F.count_if(F.col(status) == "Perdu")
    return files.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~closed).alias("open"), F.count_if(F.datediff(as_of, F.col(added)).between(0, 7)).alias("added_week"),
        F.count_if(~closed & days.between(0, 2)).alias("due_2"), F.count_if(~closed & days.between(0, 7)).alias("due_7"), F.count_if(~closed & days.between(0, 15)).alias("due_15"), F.count_if(~closed & (days < 0)).alias("overdue"),
        won.alias("won"), lost.alias("lost"), F.when(won + lost > 0, F.round(100 * won / (won + lost), 1)).alias("win_rate"),
    )


def counts_with_zero(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts of each value of a dimension, zeros included; facts are counted before they meet it."""
    return dimension.join(facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pipeline_share(files: DataFrame, status: str) -> DataFrame:
    """status, n and its share of all."""
    return files.groupBy(status).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def go_no_go(criteria: DataFrame, by: str, *, threshold: int = 70) -> DataFrame:
    """by, eligibility and readiness (weighted means of 100, 50 and 0), verdict.

    criteria: id, category, mandatory, eliminatory (OUI or NON), result, weight. What eliminates is asked before the score.
    """
    score = F.create_map(*(F.lit(x) for pair in v.RESULT_SCORES.items() for x in pair))
    counted = F.col("result").isNotNull() & F.col("weight").isNotNull()
    points, weight = F.when(counted, F.col("weight") * F.try_element_at(score, F.col("result"))), F.when(counted, F.col("weight"))
    ready = F.col("category").isin(*v.READINESS)
    open_results = ("Partiellement satisfait", "A verifier")
    told = criteria.groupBy(by).agg(
        F.count("id").alias("n"), F.count_if(F.col("id").isNotNull() & F.col("result").isNull()).alias("n_open"),
        F.count_if((F.col("eliminatory") == "OUI") & (F.col("result") == "Non satisfait")).alias("n_out"),
        F.count_if((F.col("eliminatory") == "OUI") & F.col("result").isin(*open_results)).alias("n_unclear"),
        F.count_if((F.col("mandatory") == "OUI") & (F.col("eliminatory") == "NON") & F.col("result").isin("Non satisfait", *open_results)).alias("n_gaps"),
        (F.sum(points) / F.nullif(F.sum(weight), F.lit(0))).alias("e"), (F.sum(F.when(ready, points)) / F.nullif(F.sum(F.when(ready, weight)), F.lit(0))).alias("r"),
    )
    verdict = (
        F.when(F.col("n") == 0, "Aucun critere saisi").when(F.col("n_out") > 0, "NO_GO").when(F.col("n_unclear") > 0, "NO_GO_CONDITIONAL").when(F.col("n_open") > 0, "NO_GO_CONDITIONAL")
        .when(F.col("e").isNull() | (F.round("e", 1) < threshold), "NO_GO").when(F.col("n_gaps") > 0, "GO_WITH_ACTIONS").otherwise("GO")
    )
    return told.select(by, F.round("e", 1).alias("eligibility"), F.round("r", 1).alias("readiness"), verdict.alias("verdict"))


def document_state(expiry: Column, present: Column, as_of: Column) -> Column:
    """The state of an organisation's document by its expiry."""
    days = F.datediff(expiry, as_of)
    return F.when(~present, "Manquant").when(days.isNull(), "Sans expiration").when(days < 0, "Expire").when(days <= 15, "Expire sous 15 j").when(days <= 30, "Expire sous 30 j").otherwise("Valide")


def errors_of(notice: dict[str, Column]) -> Column:
    """What a form's entry lacks, as an array of messages."""
    return F.array_compact(
        F.array(
            F.when(blank(notice["title"]), "Le titre est obligatoire."),
            F.when(blank(notice["deadline"]), "La deadline est obligatoire.").when(F.call_function("try_to_date", notice["deadline"]).isNull(), "La deadline n est pas une date valide."),
            F.when(~blank(notice["link"]) & ~notice["link"].rlike("^https?://"), "Le lien doit commencer par http:// ou https://"),
            F.when(~blank(notice["budget"]) & notice["budget"].try_cast("double").isNull(), "Le budget doit etre un nombre."),
        )
    )
