"""Near-duplicate lyrics: an exact join of sets by their rarest members.

Sets are made of the texts anew where they are needed: hashes of all words take more room than the texts themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.sources.shared import cut

#: Sets that may meet over one shingle in one task; more are dealt to pairs of blocks.
BLOCK = 500
#: Shingles are counted in so many buckets; any order of shingles gives the same pairs, this one keeps common shingles last.
BUCKETS = 1 << 19
#: Bytes of text that a task turns into sets at once, about.
SLICE_BYTES = 4 << 20
#: Ids that may be broadcast; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Of how many pairs a family is dealt to pairs of blocks; and sets that are compared together, about.
FAMILY, TOGETHER = 100_000, 500


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _sets(batches, words: int):
    """(id, set) of each row whose text has `words` words (letters, digits and _) of the lower-cased text or more: 64-bit hashes of
    the different runs of so many words."""
    odd = np.random.default_rng(5).integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.diff(ends, prepend=-1)) if len(ends) else []
        for at, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            some = batch.slice(at, stop - at)
            texts = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(some.column(1), "")).cast(pa.large_string()), "[^a-z0-9_]+", " ")
            lists = pc.ascii_split_whitespace(texts)
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
            full = pc.not_equal(flat, "")
            coded, parent = flat.filter(full).dictionary_encode(), parent.filter(full).to_numpy(zero_copy_only=False)
            if not len(coded):
                continue
            h = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]
            m = max(len(h) - words + 1, 0)
            runs = np.zeros(m, np.uint64)
            for i in range(words):
                runs += h[i : i + m] * odd[i]
            runs = _mixed(_mixed(runs, 0xBF58476D1CE4E5B9), 0x94D049BB133111EB)
            ends = np.searchsorted(parent, np.arange(len(some) + 1))
            for id, a, b in zip(some.column(0).to_pylist(), ends, ends[1:], strict=False):
                if id is not None and b - a >= words:
                    yield id, np.unique(runs[a : b - words + 1])


def _table(df: DataFrame, words: int, of, schema: str) -> DataFrame:
    """A row of `of(set)` for each set, and its id."""
    kind, types = dict(df.dtypes)["id"], {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    named = [c.split() for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for id, x in _sets([b], words):
                ids.append(id)
                rows.append(of(x))
            if ids:
                columns = [pa.array(values, types[t]) for values, (_, t) in zip(zip(*rows, strict=True), named, strict=True)]
                yield pa.record_batch([pa.array(ids, b.column(0).type), *columns], names=["id", *[n for n, _ in named]])

    return df.mapInArrow(run, f"id {kind}, {schema}")


def _whole(x: np.ndarray):
    """What tells a set from others: 128 bits, whatever the order."""
    return len(x), int(_mixed(x, 0x9E3779B97F4A7C15).sum(dtype=np.uint64).view(np.int64)), int(_mixed(x, 0xC2B2AE3D27D4EB4F).sum(dtype=np.uint64).view(np.int64))


def _ranks(df: DataFrame, words: int) -> np.ndarray:
    """A rank of each bucket of shingles: how often they occur in all sets, on a scale of 255 steps at most."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for _, x in _sets(batches, words):
            np.add.at(n, (x % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 50_000):
            some = at[i : i + 50_000]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    counted = df.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    n = np.zeros(BUCKETS, np.int64)
    n[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return np.minimum(8 * np.log2(1 + n), 255).astype(np.uint8)


def _prefixes(df: DataFrame, threshold: float, words: int) -> DataFrame:
    """token, set, n, pos, rows: the rarest shingles of each different set (the first half of what `_whole` gives), so many that
    two similar sets share one, and in how many sets' rows; only those that several sets have there."""
    ranks = _ranks(df, words)

    def run(batches):
        for b in batches:
            firsts, sets, sizes = [], [], []
            for _, x in _sets([b], words):
                x = x[np.argsort(ranks[(x % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")]
                n, own, _ = _whole(x)
                firsts.append(x[: n - int(np.ceil(n * threshold - 1e-9)) + 1].view(np.int64))
                sets.append(own)
                sizes.append(n)
            if sets:
                ks = [len(f) for f in firsts]
                columns = [np.concatenate(firsts), np.repeat(np.array(sizes, np.int32), ks), np.repeat(np.array(sets, np.int64), ks), np.concatenate([np.arange(k, dtype=np.int32) for k in ks])]
                yield pa.record_batch([pa.array(c) for c in columns], names=["token", "n", "set", "pos"])

    each = df.mapInArrow(run, "token long, n int, set long, pos int").repartition("token").distinct()
    return each.withColumn("rows", F.count("*").over(Window.partitionBy("token"))).where("rows > 1")


def _meetings(p: DataFrame, threshold: float) -> DataFrame:
    """x, y: sets that share a token of their prefixes and may be similar by their sizes and the token's places.

    A token's sets are listed by blocks; each list meets itself, and the lists of one token meet one another, dealt by both blocks.
    """
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("i")
    of = p.select("token", "set", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos")).alias("at")).select("*", block)
    lists = cut(of.groupBy("token", "blocks", "i").agg(F.collect_list("set").alias("sets"), F.collect_list("at").alias("ats")))

    def pairs(df: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
        def member(own, at):
            return F.struct(own.alias("set"), F.shiftright(at, 32).alias("n"), at.bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))

        def alike(x, y):
            sizes = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold - 1e-9
            places = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= (x["n"] + y["n"]) * (threshold / (1 + threshold)) - 1e-9
            return (x["set"] != y["set"]) & sizes & places

        own = df.select(F.zip_with(*left, member).alias("own"), F.zip_with(*right, member).alias("others")).select(F.explode("own").alias("x"), "others")
        both = own.select("x", F.explode(F.filter("others", lambda y: alike(F.col("x"), y))).alias("y"))
        return both.select(F.least("x.set", "y.set").alias("x"), F.greatest("x.set", "y.set").alias("y"))

    alone = pairs(lists, ("sets", "ats"), ("sets", "ats"))
    hot = lists.where("blocks > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = hot.select("token", "i", every.alias("j"), "sets", "ats").where("i < j")
    two = hot.select("token", every.alias("i"), F.col("i").alias("j"), F.col("sets").alias("sets_2"), F.col("ats").alias("ats_2")).where("i < j")
    return alone.unionByName(pairs(one.join(two, ["token", "i", "j"]), ("sets", "ats"), ("sets_2", "ats_2"))).distinct()


def _compared(pairs: DataFrame, sets: DataFrame, of: int) -> DataFrame:
    """pairs (a, b) with the similarity of their sets (id, shingles), of which there are `of`.

    A pair is compared where the least of a's partners is dealt to, so that a family's sets are sent there once, not once
    a pair; a family of very many pairs is dealt to pairs of its blocks.
    """
    kind = dict(sets.dtypes)["id"]
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    home = ends.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("home"))
    placed = pairs.join(home.select(F.col("id").alias("a"), "home"), "a")
    sizes = placed.groupBy("home").agg(F.ceil(F.sqrt(F.count("*") / FAMILY)).cast("int").alias("k"))
    deal = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("a"), F.col("k")), F.pmod(F.xxhash64("b"), F.col("k"))), F.lit(1 + of // TOGETHER))
    placed = cut(placed.join(sizes, "home").select("a", "b", deal.alias("place")))
    sent = placed.select(F.col("place").alias("there"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")

    def compare(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        known = {i: np.asarray(x) for i, x in zip(sets["id"], sets["shingles"], strict=True)}
        out = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = known.get(a), known.get(b)
            if x is not None and y is not None:
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                out.append((a, b, shared / (len(both) - shared)))
        return pd.DataFrame(out, columns=["a", "b", "jaccard"])

    return placed.groupBy("place").cogroup(sent.groupBy("there")).applyInPandas(compare, f"a {kind}, b {kind}, jaccard double")


def similar_lyrics(df: DataFrame, *, id: str, text: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """Lyrics that are alike: a, b, jaccard, same.

    The Jaccard similarity of their sets of word shingles is `threshold` or more. Rows of one set (`same`) are linked with
    the smallest id among them (a) and by it with others: pairs between different sets are pairs of those, a < b, none is
    left out. Texts of fewer than `words` words, empty and null ones are like nothing. Sets meet over their rarest
    shingles only; a shingle that many sets have there is dealt to pairs of blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    texts = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sets = _table(texts, words, _whole, "n int, h1 long, h2 long").groupBy("id").agg(F.min(F.struct("n", "h1", "h2")).alias("x")).select("id", "x.*")
    sets = cut(sets)
    least = sets.groupBy("n", "h1", "h2").agg(F.min("id").alias("representative"))
    classes = cut(sets.join(least, ["n", "h1", "h2"]).select("id", "n", "h1", "h2", "representative"))
    alone = classes.where("id = representative").select("id", "n", "h1", "h2")
    met = _meetings(_prefixes(texts, threshold, words), threshold)
    one, two = (alone.select(F.col("id").alias(c), F.col("h1").alias(side)) for c, side in (("a", "x"), ("b", "y")))
    pairs = cut(met.join(one, "x").join(two, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(alone, "id"))
    n = ids.count()
    few = F.broadcast(ids) if n <= MOST_IDS else ids
    again = _table(texts.join(few, "id", "left_semi"), words, lambda x: (*_whole(x), x.view(np.int64)), "n int, h1 long, h2 long, shingles array<long>")
    again = cut(again.join(few, ["id", "n", "h1", "h2"], "left_semi").select("id", "shingles"))
    near = _compared(pairs, again, n).where(F.col("jaccard") >= threshold).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.lit(False).alias("same"))
    copies = classes.where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("same"))
    return near.unionByName(copies)
