"""Line deduplication over the suffix array of line ids, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col, fresh, row_key, settle

_POS = ("k", "seq")


def _lines(docs: DataFrame, text: Column, key: Column) -> DataFrame:
    """k, seq (place among the document's lines with a word), i (place among all lines), n (words), a and b (128 bits that name the line)."""
    line = lambda x, i: F.struct(
        i.alias("i"), F.regexp_count(x, F.lit(r"[^\x09-\x0D ]+")).alias("n"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(3), x, F.length(x)).alias("b"), x.rlike(r"[^\x09-\x0D ]").alias("word")
    )
    held = docs.select(key.alias("k"), F.filter(F.transform(F.split(text, "\n"), line), lambda s: s["word"]).alias("lines"))
    return held.select("k", F.posexplode("lines").alias("seq", "l")).select("k", "seq", "l.i", "l.n", "l.a", "l.b").distinct()


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with `name`: the rank of the columns `by` among all that occur, null where one of them is null.

    Distinct values are sorted over all executors by ranges; the rank grows along the order and has gaps. Equal values are
    counted before the shuffle, so a frequent value is one row.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    values = settle(rows.filter(known).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by))
    ranked = settle(values.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))
    return rows.join(ranked, by, "left")


def repeated_lines(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that line deduplication deletes: k (the document's key, see row_key) and i (the line's place in it).

    A run of lines is a repeat if it has `min_words` words or more and an equal run starts earlier, in the order of
    (doc_id, text hash, line), and ends before it. All lines of all repeats go. The first copy of each line stays, since
    nothing before it can equal a run that holds it. The first copy of a run stays whole but for lines that are themselves
    later copies in another run. A run that overlaps its own earlier copy, as in a line that a document repeats, is no repeat of that:
    of six copies of a line of 30 words the first two, 60 words, stay.

    How: lines that occur once end every run. What is left of a document falls into stretches; those under `min_words`
    words can't hold a repeat. Over the rest the suffixes are sorted by prefix doubling: the rank of 2^(j+1) lines is that
    of the pair of ranks of their halves, until 2^j lines cover the longest shortest run of `min_words` words. Suffixes
    with equal ranks are an interval of the suffix array whose common prefix is as long. A run of m lines is named by two
    ranks of 2^j lines, at its start and at its end, 2^j <= m < 2^(j+1); its interval's earliest suffix is the copy that
    stays. Every line of a maximal repeat is in a shortest run of `min_words` words that starts or ends in it, so these,
    two for each place, give all lines of maximal repeats without listing the intervals of each length.
    """
    lines = _lines(docs, col(text_col).cast("string"), row_key(col(text_col).cast("string"), col(id_col)))
    lines = settle(lines)
    twice = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("a", "b")
    doc = Window.partitionBy("k").orderBy("seq")
    stretch = Window.partitionBy("k", "g")
    inside = stretch.orderBy("seq")
    kept = (
        lines.join(twice, ["a", "b"])
        .withColumn("g", F.col("seq") - F.row_number().over(doc))
        .withColumn("total", F.sum("n").over(stretch))
        .filter(F.col("total") >= min_words)
        .withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn("ahead", F.count(F.lit(1)).over(stretch.orderBy("before").rangeBetween(0, min_words - 1)))
        .withColumn("behind", F.count(F.lit(1)).over(stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0)))
        .select("k", "g", "seq", "i", "a", "b", F.when(F.col("total") - F.col("before") >= min_words, F.col("ahead")).alias("ahead"), F.when(F.col("upto") >= min_words, F.col("behind")).alias("behind"))
    )
    suffixes = settle(_ranked(settle(kept), ["a", "b"], "r0").drop("a", "b"))
    longest = suffixes.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0
    levels = max(0, longest.bit_length() - 1)
    for j in range(levels):
        after = suffixes.withColumn("next", F.lead(f"r{j}", 1 << j).over(inside))
        suffixes = settle(_ranked(settle(after), [f"r{j}", "next"], f"r{j + 1}").drop("next"))

    runs = (
        suffixes.select("k", "seq", F.col("ahead").alias("m"))
        .unionByName(suffixes.select("k", (F.col("seq") - F.col("behind") + 1).alias("seq"), F.col("behind").alias("m")))
        .filter("m is not null")
        .distinct()
        .withColumn("level", F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int"))
        .withColumn("tail", (F.col("seq") + F.col("m") - F.expr("shiftleft(1, level)")).cast("int"))
    )
    ranks = suffixes.select("k", "seq", F.array(*(f"r{j}" for j in range(levels + 1))).alias("ranks"))
    at = lambda c: F.element_at(F.col(c), F.col("level") + 1)
    named = settle(
        runs.join(ranks, ["k", "seq"])
        .join(ranks.select("k", F.col("seq").alias("tail"), F.col("ranks").alias("tail_ranks")), ["k", "tail"])
        .select("k", "seq", "m", at("ranks").alias("head"), at("tail_ranks").alias("foot"))
    )
    name = ["m", "head", "foot"]
    first = named.groupBy(*name).agg(F.min(F.struct("k", "seq")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    overlaps = (F.col("k") == F.col("first.k")) & (F.col("seq") < F.col("first.seq") + F.col("m"))
    later = named.join(first, name).filter((F.struct("k", "seq") > F.col("first")) & ~overlaps)
    gone = later.select("k", F.explode(F.sequence(F.col("seq").cast("int"), (F.col("seq") + F.col("m") - 1).cast("int"))).alias("seq")).distinct()
    return gone.join(suffixes.select("k", "seq", "i"), ["k", "seq"]).select("k", "i")


def dedup_lines(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text, and two more columns: n_lines (lines that have a
    word, before) and n_deleted.

    Which lines go is told at repeated_lines(). Lines are what newlines separate, compared as they are; lines of ASCII white
    space alone never count, never go and don't end a run. Null text stays null with 0 lines; a text that loses no line
    stays as it is; one that loses all but blank lines keeps those. Rows that repeat both id and text are one document: each keeps what the first keeps.
    A null id orders after all ids. Empty tables give none; other columns stay. If docs has columns of the new names, the new ones get underscores.
    """
    key, gone, n_lines, n_deleted = fresh(docs, "tm_key", "tm_gone", "n_lines", "n_deleted")
    text = col(text_col).cast("string")
    found = repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col).groupBy(F.col("k").alias(key)).agg(F.collect_set("i").alias(gone))
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    counted = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"[^\x09-\x0D ]"))), F.lit(0))
    joined = docs.withColumn(key, row_key(text, col(id_col))).join(found, key, "left")
    return joined.select(
        *(F.when(F.col(gone).isNull(), col(c)).otherwise(left).alias(c) if c.lower() == text_col.lower() else col(c) for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(counted).alias(n_lines),
        F.coalesce(F.size(F.col(gone)), F.lit(0)).alias(n_deleted),
    )
