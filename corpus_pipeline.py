"""From raw documents to piece ids: toxicity filter, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm.common import saved, table
from hearthline.llm.decontaminate import drop_contaminated
from hearthline.llm.line_dedup import drop_recurring_lines
from hearthline.llm.near_copies import drop_near_copies
from hearthline.llm.sentence_pieces import encode_pieces
from hearthline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template came before in another document go."""
    return drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest id stays.

    Candidates are what the BK-trees of SimHash fingerprints link, and what shares a MinHash band.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; items of any length count."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, checked by decoding them."""
    return encode_pieces(docs).select("doc_id", "lang", "source", "n_pieces", "piece_ids", "round_trip")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", piece_encoding)]

#: SQL can't express the learned filter, the fingerprints and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
