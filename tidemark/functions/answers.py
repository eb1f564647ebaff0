"""What a language model answers: the first whole JSON value in its prose, and the verdicts in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let, text, trimmed

#: A verdict on one entry of a batch, by its number there.
VERDICT = "array<struct<i:int,opportunite:boolean,secteur:string,type:string,resume:string,pertinent:boolean>>"

# Names under which a model may wrap its list.
WRAPPERS = ("annonces", "resultats", "items", "data")


def first_json(answer: Column) -> Column:
    """The first balanced JSON array or object in a text, as text; null if none is closed.

    A fold over pieces of the text with depth, string and escape as its state: the pieces are single brackets, quotes and backslashes and what lies
    between, so a long answer is a few pieces. Brackets inside strings don't count, and a quote outside of any value opens no string.
    """
    piece = r'[\[\]{}"\\]|[^\[\]{}"\\]+'
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("done"), F.lit("").alias("held"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.isin("[", "{"), x.isin("]", "}")
        inside = s["depth"] > 0
        depth = F.when(s["quoted"], s["depth"]).when(opens, s["depth"] + 1).when(closes & inside, s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when((x == '"') & inside & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        escaped = s["quoted"] & (x == "\\") & ~s["escaped"]
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.cast("int").alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), (inside & (depth == 0)).alias("done"), F.when(inside | opens, F.concat(s["held"], x)).otherwise("").alias("held")
            )
        )

    return F.aggregate(F.regexp_extract_all(text(answer), F.lit(piece), F.lit(0)), state, step, lambda s: F.when(s["done"], s["held"]))


def verdicts(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, i and the fields of boards.JUDGED for each verdict in an answer; answers without a readable list give none.

    A list may stand alone or under one of a few names. Only yes and no count as such; entries without a number are dropped.
    """
    said = answers.select(key, first_json(F.col(answer)).alias("_json"))
    wrapped = F.from_json("_json", "struct<" + ",".join(f"{name}:{VERDICT}" for name in WRAPPERS) + ">")
    lists = F.when(F.col("_json").startswith("["), F.from_json("_json", VERDICT)).otherwise(let(wrapped, lambda w: F.coalesce(*(w[name] for name in WRAPPERS))))
    each = said.select(key, F.explode(lists).alias("v")).filter("v.i is not null")
    return each.select(key, F.col("v.i").alias("i"), F.col("v.secteur").alias("sector"), F.col("v.type").alias("type"), trimmed(F.col("v.resume")).alias("summary"), F.col("v.pertinent").alias("relevant"), F.col("v.opportunite").alias("opportunity"))
