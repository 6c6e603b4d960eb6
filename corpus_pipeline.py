"""From raw documents to token ids, in five stages over a shared folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
Null texts count as empty; null and repeated doc_ids are allowed.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prismatica.llm.common import stored, table, whole_text  # noqa: E402
from prismatica.llm.decontaminate import contaminated  # noqa: E402
from prismatica.llm.near_dedup import near_duplicates  # noqa: E402
from prismatica.llm.pieces import encoded, load_pieces  # noqa: E402
from prismatica.llm.span_dedup import repeated_spans  # noqa: E402
from prismatica.llm.queries import TOXICITY  # noqa: E402
from prismatica.llm.toxicity import chain_scores, train_chain  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the last category, toxic, is under a half."""
    models = train_chain(docs, table(spark, sf_dir, "labels"), TOXICITY)
    columns = docs.columns
    scored = chain_scores(docs, models, carry=columns)
    return scored.filter(F.col("probabilities")[len(TOXICITY) - 1] < 0.5).select(*columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of least doc_id, rows without
    one last. Rows are told apart by doc_id and text (64-bit hash), so rows that share a doc_id are documents of
    their own; of rows equal in both one stays. Texts without words are near to nothing."""
    key = _free(docs, "row_key")
    named = docs.withColumn(key, F.xxhash64("doc_id", whole_text()))
    found = near_duplicates(named, key=key)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    first = (named.select("doc_id", key).distinct().join(found.select(key, "component_id").distinct(), key)
             .groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias(key)))
    return named.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a repeated 200-byte string covers."""
    cut = repeated_spans(docs).withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")})
    return cut.select(*docs.columns)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with the same or with other values."""
    key = _free(docs, "text_digest")
    named = docs.withColumn(key, F.sha2(whole_text(), 256))
    held = contaminated(named, table(spark, sf_dir, "benchmark"), key=key).select(key).distinct()
    return named.join(held, key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back."""
    return encoded(docs, load_pieces(), carry=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeated_passages),
          ("decontamination", drop_benchmark_items), ("encoding", encode)]

#: None of the stages can be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
