"""The queries of this folder, over the whole of their tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm import alignment, embedding_dedup, exact_topk, language_id, line_dedup, merkle, mixing, packing, simhash, substring_dedup, token_files, url_rules, warc
from aspectra.llm.common import read_table
from aspectra.llm.tokens import vocabulary_path

WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
TOPICS = {
    "code": ("def ", "return ", "import ", "{", "}", ";"),
    "legal": ("icense", "opyright", "arranty"),
    "web": ("http", "www.", "@"),
    "table": ("|",),
}
MIX_TARGETS = {
    "source": None,  # present shares to the power 0.5: large sources down, small ones up
    "lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15},
    "topic": {"general": 0.6, "legal": 0.1, "web": 0.1, "table": 0.1, "code": 0.1},
}
MIX_KEEP = 0.5
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, vocabulary_path(WORD_VOCABULARY), window=2048, end_id=1, pieces="words", with_ids=False, special_as_text=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY), end_id=2, pieces="spaced", special_as_text=False)
    return token_files.read_token_files(spark, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def mix_documents(docs: DataFrame, keep: float = MIX_KEEP, carry: list[str] | None = None) -> DataFrame:
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"), TOPICS)}
    return mixing.mix(docs, MIX_TARGETS, columns, mixing.tokens(F.col("text")), keep=keep, carry=carry)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_documents(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").cast("long").alias("n_tokens"),
        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), F.col("kept").cast("long").alias("kept"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = language_id.held_out()
    return out.select(F.col("doc.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    out = exact_topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    tampered = merkle.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields])
    made = merkle.manifest(read_table(spark, sf_dir, "documents"), "doc_id", "lang", fields, {"claimed": F.when(changed, tampered)})
    out = made.proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found, _ = alignment.align(docs, vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing, op2_warc, op3_suffix_dedup, op4_token_files, op5_mixing, op6_simhash,
        op7_embedding_dedup, op8_language_id, op9_line_dedup, op10_topk, op11_merkle, op12_url_rules,
        op13_alignment,
    )
    return {f.__name__: f for f in found}
