"""What both ways to find repeated passages share: one text for each document, and the words of both documents of a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import blocks, renamed, stored, token_hashes

#: Document ids and lengths that may be broadcast (16 bytes each); beyond that they are joined by a shuffle.
MOST_IDS = 1_000_000
#: Pairs that a task looks at together.
TOGETHER = 128
#: Bytes of a word's hash: two words look equal once in 2^24 times.
WORD = 3


def one_text_each(docs: DataFrame) -> DataFrame:
    """doc_id and text of rows that have both; of rows with one id, the greatest text."""
    d = renamed(docs, ["doc_id", "text"]).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    again = stored(d.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return d
    few = F.broadcast(again) if again.count() <= MOST_IDS else again
    return d.join(few, "doc_id", "left_anti").unionByName(d.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def _words(batches):
    for b in blocks(batches):
        tokens, offsets = token_hashes(b.column("text"))
        low = np.ascontiguousarray((tokens >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WORD])
        kept = [pa.scalar(low[x:y].tobytes(), pa.binary()) for x, y in zip(offsets, offsets[1:], strict=False)]
        yield pa.record_batch([b.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "words"])


def unpacked(words: bytes) -> np.ndarray:
    out = np.zeros((len(words) // WORD, 4), np.uint8)
    out[:, :WORD] = np.frombuffer(words, np.uint8).reshape(-1, WORD)
    return out.view("<u4").ravel()


def with_words(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The longer document of each pair (a, b, ...) as `home`, with its word hashes, before its pairs.

    A row without `guest` holds home's words; the rows after it are its pairs, each with the words of the shorter
    document, the guest. So a text is sent once for itself and once for each pair in which it is the shorter.
    docs: one row for each doc_id.
    """
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    few = F.broadcast if ids.count() <= MOST_IDS else (lambda x: x)
    sizes = stored(docs.join(few(ids), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n")), "sizes")
    sized = pairs
    for c in "ab":
        sized = sized.join(few(sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"))), c)
    longer = F.col("a_n") >= F.col("b_n")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    home, guest = F.when(longer, F.col("a")).otherwise(F.col("b")), F.when(longer, F.col("b")).otherwise(F.col("a"))
    sized = stored(sized.select(home.alias("home"), guest.alias("guest"), *rest), "sized")

    def words(side):
        of = few(sized.select(F.col(side).alias("doc_id")).distinct())
        return docs.join(of, "doc_id", "left_semi").mapInArrow(_words, "doc_id long, words binary").withColumnRenamed("doc_id", side)

    guests = sized.join(words("guest"), "guest")
    return words("home").unionByName(guests, allowMissingColumns=True).repartition("home").sortWithinPartitions("home", F.asc_nulls_first("guest"))


def visits(batches):
    """Of the rows of `with_words`, a few at a time: lists of (pair, home's words, guest's words)."""
    own = None
    for batch in batches:
        for i in range(0, batch.num_rows, TOGETHER):
            out = []
            for r in batch.slice(i, TOGETHER).to_pylist():
                words = unpacked(r.pop("words"))
                if r["guest"] is None:
                    own = words
                else:
                    out.append((r, own, words))
            yield out
