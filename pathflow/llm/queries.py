"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, conversation_trie, fingerprint, html_text, infill, jaccard, langid, packing, quality, sharding, topk, toxicity, url_filter
from .shared import written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Digest rows of all pieces with their places."""
    pieces = packing.cut_documents(docs, path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    digests = written(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return packing.pack_pieces(digests, order=("doc_id", "start", "ids_crc32"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a Jaccard similarity of 0.9 of their 3-word shingles."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded again."""
    place = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), **place)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    decoded = bpe.decode_ids(digests, **place, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def remainder(divisor: int) -> str:
    """SQL for the CRC-32 of the doc_id's decimal text, modulo the divisor."""
    return f"pmod(crc32(cast(cast(doc_id AS string) AS binary)), {divisor})"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"), learn=f"{remainder(5)} <> 0")
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", F.expr(f"{remainder(5)} = 0").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.train_on(docs, learn=f"{remainder(3)} <> 1")
    predicted = langid.predict_languages(docs, network)
    return predicted.select("doc_id", F.expr(f"{remainder(3)} = 1").alias("held_out"), "lang_pred", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the four fixed rules on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vec_id divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by rendezvous hashing, and their shard of 17."""
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, and the text rebuilt from it."""
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    rebuilt = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    nodes = conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).nodes
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Score from which a document's quality counts as good.
GOOD_QUALITY = 0.3


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_on(docs, table(spark, sf_dir, "labels"), learn=f"{remainder(5)} <> 0")
    scored = quality.score_texts(docs, model)
    return scored.select("doc_id", F.expr(f"{remainder(5)} = 0").alias("held_out"), "score", F.when(F.col("score") >= GOOD_QUALITY, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe": op3_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_exact_topk": op8_exact_topk,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op7_url_filter": url_filter.SQL, "op8_exact_topk": topk.SQL, "op11_fill_in_middle": infill.SQL, "op12_conversation_trie": conversation_trie.SQL}
