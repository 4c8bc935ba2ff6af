"""What several operators share: reading tables, cutting lineage, words and shingles of Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 4 << 20
#: Multipliers of the word hashes in a shingle (odd 64-bit constants).
ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/tapedeck-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: later stages survive a lost executor without redoing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of `stored` that no later stage reads, once what came of it is stored itself."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of Arrow batches of about `limit` text bytes each; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (split at ASCII white space, A-Z lower-cased) of all texts in order: codes, distinct words, word offsets by text."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    flat, parent = flat.filter(full), parent.filter(full).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = np.searchsorted(parent, np.arange(len(texts) + 1))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and word offsets by text."""
    codes, words, offsets = words_of(texts)
    return word_hashes(words)[codes], offsets


def shingle_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; of the whole sequence if it is shorter; none for no words."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    if len(tokens) < n:
        out = np.uint64(len(tokens))
        with np.errstate(over="ignore"):
            for i, t in enumerate(tokens):
                out = out * np.uint64(3) + t * ODD[i]
        return mix(np.array([out], np.uint64))
    m = len(tokens) - n + 1
    out = tokens[:m] * ODD[0]
    for i in range(1, n):
        out = out + tokens[i : i + m] * ODD[i]
    return mix(out)


def renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the ids in gone (doc_id); other columns stay, whatever their names."""
    gone = gone.select(F.col("doc_id").alias("gone_doc_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_doc_id"], "left_anti")
