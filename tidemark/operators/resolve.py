"""Entity resolution: ordered keys, first match, and the ordered upsert into the tracked table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, normalize
from tidemark.operators.components import components, settled

#: Fields that a later copy of a notice may change. Blank values never do.
UPDATABLE = ("title", "organisation", "country", "type", "sector", "budget", "source", "link", "pdf", "published", "deadline", "summary")


def dedup_keys(link: Column, title: Column, ref: Column, organisation: Column, deadline: Column) -> Column:
    """Up to three keys, the surest first: link with title, reference, title with organisation and day."""
    n = normalize
    day = F.coalesce(deadline.cast("string"), F.lit(""))
    return F.array_compact(
        F.array(
            F.when(~blank(link), F.concat(F.lit("url:"), n(link), F.lit("|"), n(title))),
            F.when(~blank(ref), F.concat(F.lit("ref:"), n(ref))),
            F.when(~blank(title), F.concat(F.lit("t:"), F.concat_ws("|", n(title), n(organisation), day))),
        )
    )


def key_index(rows: DataFrame, row: str, order: str, keys: str) -> DataFrame:
    """key, row: the first row in order that owns each key."""
    return rows.select(row, order, F.explode(keys).alias("key")).groupBy("key").agg(F.min_by(row, order).alias(row))


def match(incoming: DataFrame, tracked: DataFrame, *, row: str, tracked_row: str, order: str, keys: str) -> DataFrame:
    """row, tracked_row: for each incoming row, what its first key that is known belongs to, or null."""
    index = key_index(tracked, tracked_row, order, keys)
    tried = incoming.select(row, F.posexplode_outer(keys).alias("priority", "key")).join(index, "key", "left")
    return tried.groupBy(row).agg(F.min_by(tracked_row, F.when(F.col(tracked_row).isNotNull(), F.col("priority"))).alias(tracked_row))


def known(incoming: DataFrame, tracked: DataFrame, keys: str, *, is_known: bool) -> DataFrame:
    """Incoming rows that share a key with the tracked table, or those that don't."""
    of = tracked.select(F.explode(keys).alias("key")).distinct()
    marked = settled(incoming.withColumn("_n", F.monotonically_increasing_id()))
    hits = marked.select("_n", F.explode(keys).alias("key")).join(of, "key", "left_semi").select("_n").distinct()
    return marked.join(hits, "_n", "left_semi" if is_known else "left_anti").drop("_n")


def keep_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row in order of each key. Nothing but each key's first row goes through the second shuffle."""
    packed = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(packed, order).alias("_r")).select("_r.*")


def earlier_page(rows: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Rows whose key no earlier page has; twins on one page stay."""
    named = [f"_k{i}" for i in range(len(keys))]
    first = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).agg(F.min(page).alias("_first"))
    same = F.col(page) == F.col("_first")
    for k, n in zip(keys, named, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(first, same).select(*rows.columns)


def changed(old: Column, new: Column) -> Column:
    """The new value is there and is another."""
    return ~blank(new.cast("string")) & ~new.eqNullSafe(old)


def update_fields(joined: DataFrame, fields: Sequence[str], old: str, new: str) -> tuple[dict[str, Column], Column]:
    """For rows with structs `old` and `new`: the value of each field after the update, and the names of those that change, in order."""
    values = {f: F.when(changed(F.col(f"{old}.{f}"), F.col(f"{new}.{f}")), F.col(f"{new}.{f}")).otherwise(F.col(f"{old}.{f}")) for f in fields}
    names = F.array_compact(F.array(*(F.when(changed(F.col(f"{old}.{f}"), F.col(f"{new}.{f}")), F.lit(f)) for f in fields)))
    return values, names


def last_value(c: str, order: str) -> Column:
    """An aggregate: the last value in order that is not blank."""
    return F.max_by(c, F.when(~blank(F.col(c).cast("string")), F.col(order)))


def first_value(c: str, order: str) -> Column:
    """An aggregate: the first value in order that is not blank."""
    return F.min_by(c, F.when(~blank(F.col(c).cast("string")), F.col(order)))


def fill_blanks(base: DataFrame, detail: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """base with blank fields filled from the row of detail that has the same key; nothing is overwritten."""
    of = detail.select(on, *(F.col(f).alias(f"_d_{f}") for f in fields))
    filled = {f: F.when(blank(F.col(f).cast("string")), F.coalesce(F.when(~blank(F.col(f"_d_{f}").cast("string")), F.col(f"_d_{f}")), F.col(f))).otherwise(F.col(f)) for f in fields}
    return base.join(of, on, "left").withColumns(filled).select(*base.columns)


#: Rounds in which rows find their owners together; what is undecided then, long chains of keys, is decided along each chain.
ROUNDS = 12


def _decide_chains(pairs: DataFrame) -> DataFrame:
    """row of the owners among rows that are all undecided: along each chain of shared keys, a row owns if no owner before it shares a key.

    pairs: row, key. Only keys and places of rows go to a chain's task, no fields.
    """
    first = pairs.groupBy("key").agg(F.min("row").alias("first"))
    of = components(pairs.join(first, "key").filter(F.col("row") != F.col("first")).select(F.col("first").alias("a"), F.col("row").alias("b")).distinct())
    held = pairs.join(of.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    listed = held.groupBy("comp", "row").agg(F.collect_list("key").alias("keys")).select("comp.place", "row.new", F.col("row.place").alias("at"), F.col("row.n").alias("n"), "keys")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken, owns = rows.sort_values(["new", "at", "n"], kind="stable"), set(), []
        for keys in rows["keys"]:
            owns.append(taken.isdisjoint(keys))
            if owns[-1]:
                taken.update(keys)
        return rows[owns][["new", "at", "n"]]

    kind = pairs.schema["row"].dataType["place"].dataType.simpleString()
    found = listed.groupBy("place").applyInPandas(walk, f"new boolean, at {kind}, n long")
    return found.select(F.struct("new", F.col("at").alias("place"), "n").alias("row"))


def owners(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, owner: for each row that shares a key with others, the row that it goes to; itself if it is tracked or new.

    pairs: row (struct<new, place, n>, which sorts as rows come, tracked ones first), priority, key. A row that is not tracked follows if an
    owner before it has one of its keys: of its keys in order, the first that such an owner has decides. All other rows own.

    In each round a row is settled if an owner before it shares a key (it follows), or if it comes first among the undecided at each of
    its keys (it owns). A key's first rows are minima, so they combine before the shuffle however many copies a notice has; all copies of an
    owner are settled in the round after it. A chain in which each row waits for the one before settles two rows a round, so after
    `rounds` what is left is decided along the chains.
    """
    tracked = ~F.col("row.new")
    owned = settled(pairs.filter(tracked).groupBy("key").agg(F.min("row").alias("owner")))
    waiting = settled(pairs.filter(F.col("row.new")).select("row", "key"))
    for _ in range(rounds):
        first = waiting.groupBy("key").agg(F.min("row").alias("first"))
        met = waiting.join(first, "key").join(owned, "key", "left")
        told = met.groupBy("row").agg(F.max(F.coalesce(F.col("owner") < F.col("row"), F.lit(False))).alias("follows"), F.min(F.col("first") == F.col("row")).alias("leads"))
        state = settled(waiting.join(told, "row").withColumn("owns", F.col("leads") & ~F.col("follows")))
        new = state.filter("owns").groupBy("key").agg(F.min("row").alias("owner"))
        owned = settled(owned.unionByName(new).groupBy("key").agg(F.min("owner").alias("owner")))
        waiting = settled(state.filter(~F.col("owns") & ~F.col("follows")).select("row", "key"))
        if waiting.isEmpty():
            break
    else:
        late = waiting.join(owned, "key", "left").groupBy("row").agg(F.max(F.coalesce(F.col("owner") < F.col("row"), F.lit(False))).alias("follows")).filter("not follows").select("row")
        left = settled(waiting.join(late, "row"))
        own = left.join(_decide_chains(left), "row").groupBy("key").agg(F.min("row").alias("owner"))
        owned = settled(owned.unionByName(own).groupBy("key").agg(F.min("owner").alias("owner")))
    met = pairs.join(owned, "key").filter(F.col("owner") < F.col("row"))
    hits = met.filter(F.col("row.new")).groupBy("row").agg(F.min_by("owner", "priority").alias("owner"))
    return pairs.select("row").distinct().join(hits, "row", "left").withColumn("owner", F.coalesce("owner", "row"))


def upsert(tracked: DataFrame, incoming: DataFrame, *, fields: Sequence[str] = UPDATABLE, order: str = "ord", keys: str = "keys") -> DataFrame:
    """The tracked table after the incoming rows, each met in order: columns order, tracked, keys, the fields, and outcome (tracked, updated or new).

    Of a row's keys, the first that a row before it owns decides where it goes. On a tracked row, fields that are there replace what
    differs: the last that is there stays. On a row new in this run they fill what is blank: the first that is there. Neither brings keys. A row
    that no key knows is new and owns its keys that are free. That is the fold of the rows in order; which rows own is found by owners(), in rounds over
    keys alone, and the fields by aggregates that combine before the shuffle, so neither a notice with many copies nor a large component is in one task.
    """
    names = [order, "tracked", keys, *fields]
    both = tracked.withColumn("tracked", F.lit(True)).select(*names).unionByName(incoming.withColumn("tracked", F.lit(False)).select(*names))
    rows = settled(both.withColumn("_n", F.monotonically_increasing_id()).withColumn("_row", F.struct((~F.col("tracked")).alias("new"), F.col(order).alias("place"), F.col("_n").alias("n"))).drop("_n"))
    exploded = rows.select(F.col("_row").alias("row"), F.posexplode(keys).alias("priority", "key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    of = settled(owners(settled(exploded.join(shared, "key"))))
    follows = of.filter(F.col("row") != F.col("owner"))
    there = lambda f: F.when(~blank(F.col(f).cast("string")), F.col(f))
    copies = rows.join(follows.withColumnRenamed("row", "_row"), "_row")
    told = [x for f in fields for x in (first_value(f, "_row").alias(f"_first_{f}"), last_value(f, "_row").alias(f"_last_{f}"), F.min(there(f)).alias(f"_min_{f}"), F.max(there(f)).alias(f"_max_{f}"))]
    merged = copies.groupBy(F.col("owner").alias("_row")).agg(*told)
    own = rows.join(follows.select(F.col("row").alias("_row")), "_row", "left_anti").join(merged, "_row", "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"_min_{f}").isNotNull() & (~F.col(f"_min_{f}").eqNullSafe(F.col(f)) | ~F.col(f"_max_{f}").eqNullSafe(F.col(f))))
    value = lambda f: F.when(F.col("tracked"), F.coalesce(f"_last_{f}", f)).otherwise(F.coalesce(there(f), F.col(f"_first_{f}"), F.col(f)))
    outcome = F.when(~F.col("tracked"), "new").when(differs, "updated").otherwise("tracked")
    return own.select(order, "tracked", keys, *(value(f).alias(f) for f in fields), outcome.alias("outcome"))


def identical_titles(entries: DataFrame, feed: str, *, title: str = "title", summary: str = "summary", kind: str = "type") -> DataFrame:
    """Feeds of two entries or more that all have one title, and summaries that all differ: the title was a category.

    There the summary becomes the title (if there is one), the title the summary, and the type where there is none.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    told = entries.groupBy(feed).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(plain(title)).alias("_titles"), F.count_distinct(plain(summary)).alias("_summaries"))
    wrong = (F.col("_n") >= 2) & (F.col("_titles") == 1) & (F.col("_summaries") == F.col("_n"))
    new_title = F.when(wrong & ~blank(F.col(summary)), F.col(summary)).otherwise(F.col(title))
    return entries.join(told, feed).select(
        *(
            new_title.alias(c) if c == title
            else F.when(wrong, F.trim(F.col(title))).otherwise(F.col(summary)).alias(c) if c == summary
            else F.when(wrong, F.coalesce(F.col(kind), F.trim(F.col(title)))).otherwise(F.col(kind)).alias(c) if c == kind
            else F.col(c)
            for c in entries.columns
        )
    )
