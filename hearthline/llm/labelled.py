"""Training rows for the learned classifiers: a bounded sample of the labelled documents, chosen by hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import hash_share, id_bucket

#: Most labelled rows of one class that a classifier is fitted on (in expectation; the choice is by hash).
CLASS_BOUND = 4_000
#: Folds of crc32(doc_id as text); this one is held out.
FOLDS, HELD_OUT = 3, 1


def held_out(column: str = "doc_id"):
    return F.coalesce(id_bucket(column, FOLDS) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = CLASS_BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label int, weight double, fold int) of at most about bound documents of each class that aren't held out.

    Ids labelled more than once take the largest label. weight restores the classes' shares; fold is 0 to 4. The labels
    kept are bounded, so they are broadcast and the texts are not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    kept = None
    for c in (0, 1):
        part = known.where((F.col("label") == c) & hash_share(n.get(c, 0), bound, "_id")).withColumn("weight", F.lit(max(1.0, n.get(c, 0) / bound)))
        kept = part if kept is None else kept.unionByName(part)
    kept = kept.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(5)).cast("int"))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(kept), "_id")
