"""The queries of this subpackage: each applies one operator to its whole table and returns its whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .html import extract
from .jaccard import jaccard_components, jaccard_links
from .langid import identify
from .lexical import rank_documents
from .mixing import mix_sources
from .neighbours import finite_vectors, nearest
from .packing import pack_documents
from .repair import COUNTS, damage, repair, repaired_text
from .rules import judge
from .sharding import shard_documents
from .topk import scaled, top_products
from .toxicity import score_toxicity

#: Rows whose id is divisible by it are the queries of searches.
QUERY_EACH = 50


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), size=1024, end=2)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite_vectors(table(spark, sf_dir, "embeddings"), zero=False)
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_EACH == 0), k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(finite_vectors(table(spark, sf_dir, "embeddings"), zero=True), by=256)
    return top_products(vectors, vectors.filter(F.col("vec_id") % QUERY_EACH == 0), k=5)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered conversation, its length in code points and the checksum of its UTF-8 bytes."""
    chats = format_chats(table(spark, sf_dir, "conversations"))
    return chats.withColumn("n_chars", F.length("rendered").cast("long")).withColumn("n_copies", F.col("n_copies").cast("long")).withColumn("n_turns", F.col("n_turns").cast("long"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", "held_out")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(damage(table(spark, sf_dir, "conversations")), F.col("dropped"))
    return repaired.select("conv_id", *COUNTS, "audit", F.sha2(repaired_text(), 256).alias("repaired_sha256"))


_ALL = (op1_sharding, op2_packing, op3_neighbours, op4_toxicity, op5_topk, op6_html, op7_language, op8_chat_formatting, op9_mixing, op10_jaccard, op10_links, op11_lexical, op12_quality_rules, op13_conversation_repair)
QUERIES = {f.__name__: f for f in _ALL}
