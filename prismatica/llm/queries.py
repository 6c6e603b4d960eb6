"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismatica.llm.backoff_lm import backoff_scores
from prismatica.llm.common import table
from prismatica.llm.cover_tree import near_vectors
from prismatica.llm.decontaminate import contaminated
from prismatica.llm.licenses import license_scan
from prismatica.llm.lz_fingerprint import edited_likeness
from prismatica.llm.main_text import main_text
from prismatica.llm.near_dedup import near_duplicates
from prismatica.llm.pieces import encoded, load_pieces
from prismatica.llm.quality_rank import ranked_quality, train_ranking
from prismatica.llm.span_dedup import repeated_spans
from prismatica.llm.token_alignment import aligned_tokens, load_byte_bpe
from prismatica.llm.token_alignment import load_pieces as load_piece_bytes
from prismatica.llm.toxicity import chain_scores, train_chain
from prismatica.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a repeated 200-byte string covers, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs, length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 85 in 100."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


@query
def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts, learnt from those outside the held-out seventh."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = backoff_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Categories of the chain, in order, as the labels table has them.
TOXICITY = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


@query
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category for all documents, and whether a document is rejected."""
    docs = table(spark, sf_dir, "documents")
    models = train_chain(docs, table(spark, sf_dir, "labels"), TOXICITY)
    p = F.col("probabilities")
    return chain_scores(docs, models, carry=["doc_id"]).select(
        "doc_id", *[p[i].alias(name) for i, name in enumerate(TOXICITY)], (p[len(TOXICITY) - 1] >= 0.5).alias("rejected"))


@query
def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from pairs outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train_ranking(docs, table(spark, sf_dir, "labels"), only=~held_out)
    return ranked_quality(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents; same tells that decoding gives the text back."""
    return encoded(table(spark, sf_dir, "documents"), load_pieces(), carry=["doc_id"])


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, also with other values."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their likeness to an edited text and the next document."""
    return edited_likeness(table(spark, sf_dir, "documents"))


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups between the tokens that two tokenizers cut all documents into."""
    return aligned_tokens(table(spark, sf_dir, "documents"), load_byte_bpe(), load_piece_bytes())


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen leading whitened components of all embeddings."""
    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings of one label whose cosines reach 0.93."""
    found = near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
