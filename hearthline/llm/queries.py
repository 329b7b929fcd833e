"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontaminate, lattice_lm, lexical_search, line_dedup, media, minhash, pii, quality, sentence_pieces, simhash, token_store, toxicity, whitening
from hearthline.llm.common import table
from hearthline.llm.labelled import held_out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_shards(table(spark, sf_dir, "documents"))
    return token_store.read_documents(shards).withColumnRenamed("key", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.tag_documents(docs, pii.fit_tagger(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), learn=True)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read_media(*media.store_media(table(spark, sf_dir, "documents")))
    return out.withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "mean_weight", "peak_weight")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.minhash_components(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("_component") == F.col("_id"), F.lit(True))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), kept.alias("kept"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_token_store": op3_token_store,
    "op4_pii": op4_pii,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

SQL = {
    "op1_line_dedup": line_dedup.oracle_sql(),
    "op5_decontaminate": decontaminate.oracle_sql(),
    "op11_minhash": minhash.oracle_sql(),
    "op13_lexical_search": lexical_search.oracle_sql(),
}
