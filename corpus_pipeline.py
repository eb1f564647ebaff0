"""A corpus pipeline over `documents`: quality rules, line deduplication, near-duplicate removal, packing.

Each stage reads all rows that the one before it wrote, and its decisions take effect: rejected documents, deleted lines and
near copies are gone for the stages after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, read, shared_folder
from tidemark.llm.lines import dedup_lines
from tidemark.llm.near import near_copies
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality
from tidemark.operators.components import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. A null text has no words and goes; rows that repeat are judged each; an empty table gives none.

    In a session that has run the other stages before, the executors' heaps are full, so workers hold fewer words than where nothing else runs.
    """
    rated = quality(docs, [public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")], pass_through=tuple(docs.columns), held=200_000)
    return rated.filter(col(rated.columns[-1])).select(*map(col, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; n_chars follows the text. A document that had words and lost all of them goes.

    A null or blank text has no lines to lose and stays; of rows that repeat id and text all keep what the first keeps; an empty table gives none.
    """
    out = dedup_lines(docs, min_words=50)
    n_lines, n_deleted = out.columns[-2:]
    left = out.filter((col(n_lines) == 0) | (col(n_deleted) < col(n_lines)))
    columns = [F.when(col(n_deleted) > 0, F.length("text")).otherwise(col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else col(c) for c in docs.columns]
    return left.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (of equal ids, the smallest text hash; then any).

    Null texts count as empty and are copies of each other; a null id comes after all others; an empty table gives none.
    """
    return near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences. A null text is its end alone; repeated rows are packed each; an empty table gives none.

    The stages before leave the executors' heaps full, so workers hold fewer words than in a session that only packs, and encode some anew.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, held=200_000, chunk=1 << 21)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Tokenizers and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet into the shared checkpoint folder and read again by the next.

    The last stage checkpoints what it takes from its documents before it returns, so the folder goes then.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return out
