"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of every text operator's input that names the row, and the one that holds the text.
ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-hearthline-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in the one column of keys; rows with a null id stay.

    The keys are written first: by their size Spark knows whether to send them to all tasks or to shuffle the documents.
    """
    gone = unused(docs, "_gone")
    return docs.join(saved(keys.toDF(gone), "gone"), F.col(id_col) == F.col(gone), "left_anti")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed folds of the learned operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def hash_share(n_rows: int, bound: int, column: str = ID, salt: str = "sample") -> Column:
    """Predicate that keeps about bound of n_rows rows, all when there are no more than that; chosen by hash of the id."""
    if n_rows <= bound:
        return F.lit(True)
    h = F.xxhash64(F.lit(salt), F.col(column))
    return F.pmod(h, F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n_rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of so many rows and, while these have more than one, about so many bytes at most."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))


class Memo:
    """Values of the words that a process met lately: when ``most`` are held they become the older ones, and older ones go unless met again."""

    def __init__(self, make: Callable[[list], Iterable], most: int):
        self.make, self.most, self.now, self.older = make, most, {}, {}

    def of(self, words: set) -> dict:
        """A table that has each of the words."""
        if not words <= self.now.keys():
            if len(self.now) + len(words) > self.most:
                self.now, self.older = {}, self.now
            self.now.update((w, self.older[w]) for w in words if w in self.older and w not in self.now)
            new = [w for w in words if w not in self.now]
            self.now.update(zip(new, self.make(new)))
        return self.now


def parts_of(texts: pa.Array, lead: str = "") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of texts between spaces, the place of each part of all texts among them, and where each text's parts begin and end.

    A space is put before every line break first, so that a part may begin with one but never holds one further on;
    lead goes in front of each text.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n")
    lists = pc.split_pattern(pc.binary_join_element_wise(lead, texts, "") if lead else texts, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def strung(values: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of the values at some places one after another, and where each place's begin and end."""
    flat = np.frombuffer(b"".join(values), dtype="<u4")
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    starts, taken = np.cumsum(sizes) - sizes, sizes[places]
    ends = np.concatenate(([0], np.cumsum(taken)))
    return flat[np.repeat(starts[places] - ends[:-1], taken) + np.arange(ends[-1])], ends
