"""MinHash near-duplicate detection by an LSH forest.

Each document's set of distinct word shingles gets LEVELS MinHash values. A tree of the forest is the list of all
signatures in sorted order, each tree starting at other levels. The depth at which documents meet follows the region:
first those meet that stand next to each other in a sorted order, and so share the longest prefixes of their region,
however crowded it is. They are confirmed on their full sets, and what is linked is one component from then on. Then
the forest is climbed to where prefixes of TREE_DEPTH levels, in a tree for each TREE_DEPTH levels, are shared: there
all documents of different components meet, in blocks where there are many. Those of which one-bit sketches of the
signatures or bitmaps of the sets show that they are too unlike are dropped, and the others are confirmed.

Of links at a similarity of just 0.8, 3 in 10^6 share no such prefix, and one in 10^8 has too unlike sketches; bitmaps
reject no true pair. Other cuts there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapedeck.llm.common import blocks, mix, renamed, shingle_hashes, stored, token_hashes, without
from tapedeck.llm.components import components
from tapedeck.llm.passages import one_text_each

LEVELS, ORDERS = 96, 8
TREE_DEPTH = 4
#: Neighbours on either side that are compared in a sorted order.
NEIGHBOURS = 3
#: Levels of neighbours that must agree before sets are compared, and bits of two sketches: a pair at similarity 0.8
#: has 76.8 and 86.4 on average.
AGREE, SAME_BITS = 56, 70
#: Rows of one prefix that a task pairs at once; more are cut into blocks, and pairs of blocks are dealt out.
BLOCK = 4096
#: Document ids that may be broadcast (8 bytes each); beyond that the texts are joined by a shuffle.
MOST_IDS = 2_000_000

_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 2**63, LEVELS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, LEVELS, dtype=np.uint64)

SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("sketch_a", T.LongType()),
        T.StructField("sketch_b", T.LongType()),
    ]
)


def minhash(shingles: np.ndarray) -> bytes:
    """LEVELS values of 16 bits, big-endian, so that bytes sort as values do."""
    low = np.full(LEVELS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        low = np.minimum(low, (part[None, :] * _MULT[:, None] + _ADD[:, None]).min(axis=1))
    return (mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def sketch(signature: bytes) -> tuple[int, int]:
    """A bit of each value, in two integers."""
    bits = np.packbits(np.frombuffer(signature, ">u2") & 1).tobytes()
    return int.from_bytes(bits[: LEVELS // 16], "big"), int.from_bytes(bits[LEVELS // 16 :], "big")


def _sign(n: int):
    def run(batches):
        for b in blocks(batches):
            tokens, offsets = token_hashes(b.column("text"))
            rows = []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                s = np.unique(shingle_hashes(tokens[offsets[i] : offsets[i + 1]], n))
                with np.errstate(over="ignore"):
                    a, c = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                sig = minhash(s) if len(s) else None
                rows.append((doc, len(s), int(a.astype(np.int64)), int(c.astype(np.int64)), sig, *(sketch(sig) if sig else (0, 0))))
            yield pa.record_batch([pa.array(c, pa.binary() if k == "sig" else pa.int64()) for c, k in zip(zip(*rows, strict=True), SIGNED.names, strict=True)], names=SIGNED.names)

    return run


def _sets(n: int):
    def run(batches):
        for b in blocks(batches):
            tokens, offsets = token_hashes(b.column("text"))
            sets = [np.unique(shingle_hashes(tokens[offsets[i] : offsets[i + 1]], n)).view(np.int64) for i in range(b.num_rows)]
            yield pa.record_batch([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _neighbours(batches):
    """Candidate pairs of near neighbours in a sorted part; then the part's first and last rows, for the seams."""
    window: list[tuple] = []
    head: list[tuple] = []
    for b in batches:
        found = set()
        for row in zip(b.column("tree").to_pylist(), b.column("path").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
            for other in reversed(window):
                if other[0] != row[0] or other[1][: 2 * TREE_DEPTH] != row[1][: 2 * TREE_DEPTH]:
                    break
                if (np.frombuffer(other[1], ">u2") == np.frombuffer(row[1], ">u2")).sum() >= AGREE:
                    found.add((min(other[2], row[2]), max(other[2], row[2])))
            window = [*window[1 - NEIGHBOURS :], row]
            if len(head) < NEIGHBOURS:
                head.append(row)
        if found:
            a, c = zip(*found, strict=True)
            k = len(a)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=NEAR.names)
    if seam := {*head, *window}:
        tree, path, ids = zip(*seam, strict=True)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(tree, pa.int32()), pa.array(path, pa.binary())], names=NEAR.names)


NEAR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("tree", T.IntegerType()), T.StructField("path", T.BinaryType())])


def candidates(signatures: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of neighbours in some tree whose signatures agree in AGREE levels."""
    step = 2 * (LEVELS // ORDERS)
    rotated = [F.concat(F.substring("sig", step * t + 1, 2 * LEVELS), F.substring("sig", 1, step * t)) for t in range(ORDERS)]
    trees = signatures.select("doc_id", F.posexplode(F.array(*rotated)).alias("tree", "path"))
    # the id ends the order, so that equal signatures too are dealt evenly over the parts
    order = ["tree", "path", "doc_id"]
    near = stored(trees.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, NEAR), "near")
    # a few rows from each part: their number is the number of parts times 2 * NEIGHBOURS
    seams = near.where("tree is not null").select("tree", "path", F.col("a").alias("doc_id")).repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours, NEAR)
    return near.where("tree is null").unionByName(seams.where("tree is null")).select("a", "b").where("a != b").distinct()


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each of 2 bits a shingle or more, a power of two of bits.

    Bits in which two bitmaps differ are at most the shingles in which the sets differ.
    """
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded."""
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    if len(a) < len(b):
        x, y, a, b, n = y, x, b, a, 8 * len(b)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ y).bit_count()


MET = ["key", "n", "doc_id", "component", "sketch_a", "sketch_b"]
ROWS = T.StructType([T.StructField(c, T.LongType()) for c in MET])
MEETING = T.StructType([*[T.StructField(c, T.LongType()) for c in ("a", "b", "key", "block", "n", "component", "sketch_a", "sketch_b")], T.StructField("bits", T.BinaryType())])


def _bitmaps(words: int):
    def run(batches):
        for b in blocks(batches):
            tokens, offsets = token_hashes(b.column("text"))
            sets = [np.unique(shingle_hashes(tokens[offsets[i] : offsets[i + 1]], words)) for i in range(b.num_rows)]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary())], names=["doc_id", "n", "bits"])

    return run


def _close(rows: np.ndarray, percent: int):
    """Pairs of places of rows (MET; in order of key and n) with one key, of two components, whose sizes and sketches
    let them be alike enough."""
    key, n, _, component, *sketches = rows
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mixed = np.minimum.reduceat(component, begins) != np.maximum.reduceat(component, begins)
    own, step = np.flatnonzero(np.repeat(mixed, np.diff(np.append(begins, len(key))))), 0
    at = np.arange(len(own))
    while len(at):
        step += 1
        at = at[: np.searchsorted(at, len(own) - step)]
        x, y = own[at], own[at + step]
        # rows of a key go by size: behind one that is too large there are only larger ones
        near = (key[x] == key[y]) & (100 * n[x] >= percent * n[y])
        at, x, y = at[near], x[near], y[near]
        fit = component[x] != component[y]
        x, y = x[fit], y[fit]
        fit = LEVELS - sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketches) >= SAME_BITS
        yield x[fit], y[fit]


def _groups(batches, more: bool, whole: bool = False):
    """(rows, bitmaps, whether it is cut) of whole keys in order; if not `whole`, keys of many rows by themselves, in blocks of BLOCK."""
    held, bits, cut = np.zeros((len(MET), 0), np.int64), np.zeros(0, object), False
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in MET])], axis=1)
        if more:
            bits = np.concatenate([bits, batch.column("bits").to_numpy(zero_copy_only=False)])
        if cut and held[0, 0] != held[0, -1]:
            end = int(np.searchsorted(held[0] != held[0, 0], True))
            yield held[:, :end], bits[:end], True
            held, bits, cut = held[:, end:], bits[end:], False
        last = int(np.flatnonzero(np.concatenate([[True], held[0, 1:] != held[0, :-1]]))[-1])
        if last:
            yield held[:, :last], bits[:last], False
            held, bits = held[:, last:], bits[last:]
        while not whole and held.shape[1] > 2 * BLOCK:
            yield held[:, :BLOCK], bits[:BLOCK], True
            held, bits, cut = held[:, BLOCK:], bits[BLOCK:], True
    if held.shape[1]:
        yield held, bits, cut


def _not_alone(percent: int):
    """Rows that meet another one; of a key of many blocks, all."""

    def run(batches):
        for rows, _, cut in _groups(batches, False):
            keep = np.full(rows.shape[1], cut)
            if not cut:
                for x, y in _close(rows, percent):
                    keep[x] = keep[y] = True
            if keep.any():
                yield pa.record_batch([pa.array(r) for r in rows[:, keep]], names=MET)

    return run


def _meetings(percent: int, nearest: bool, whole: bool):
    """Pairs of rows with bitmaps that meet and that their bitmaps let be alike enough, or of each row only the pair of
    the nearest bitmaps; keys of more than BLOCK rows go out as rows of numbered blocks, if not `whole`."""

    def pairs(parts):
        for rows, bits in parts:
            found, best = set(), {}
            for x, y in _close(rows, percent):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    apart, n = differ(bits[i], bits[j]), int(rows[1, i] + rows[1, j])
                    # both >= percent / (100 + percent) of the sizes, so they differ in the rest at most
                    if apart * (100 + percent) <= n * (100 - percent):
                        pair = (min(rows[2, i], rows[2, j]), max(rows[2, i], rows[2, j]))
                        if nearest:
                            for k in (i, j):
                                best[k] = min(best.get(k, (2.0, pair)), (apart / n, pair))
                        else:
                            found.add(pair)
            found |= {pair for _, pair in best.values()}
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(a), pa.int64())] * 6, pa.nulls(len(a), pa.binary())], names=MEETING.names)

    def run(batches):
        key, number = None, 0
        for rows, bits, cut in _groups(batches, True, whole):
            if not cut:
                yield from pairs([(rows, bits)])
                continue
            key, number = (key, number + 1) if key == rows[0, 0] else (rows[0, 0], 0)
            m = rows.shape[1]
            yield pa.record_batch([pa.array(rows[2]), pa.nulls(m, pa.int64()), pa.array(rows[0]), pa.array(np.full(m, number)), pa.array(rows[1]), *map(pa.array, rows[3:]), pa.array(bits, pa.binary())], names=MEETING.names)

    return run


def climbed(d: DataFrame, classes: DataFrame, words: int, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of documents of two components that share a prefix and may be alike enough: all, or of each document
    under each prefix the nearest. classes: doc_id, n, component, sig, sketches. Rows go twice through the trees: without bitmaps to see which meet any other, then these with them."""
    prefixes = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 2 * TREE_DEPTH * t + 1, 2 * TREE_DEPTH)) for t in range(LEVELS // TREE_DEPTH)])
    order = ["key", "n", "doc_id"]
    trees = classes.select(F.explode(prefixes).alias("key"), *MET[1:])
    some = stored(trees.repartition("key").sortWithinPartitions(*order).mapInArrow(_not_alone(percent), ROWS), "some")
    ids = stored(some.select("doc_id").distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    bits = stored(d.join(few, "doc_id", "left_semi").mapInArrow(_bitmaps(words), "doc_id long, n long, bits binary").drop("n"), "bits")
    full = some.join(bits, "doc_id").select(*MET, "bits")
    met = stored(full.repartition("key").sortWithinPartitions(*order).mapInArrow(_meetings(percent, nearest, False), MEETING), "met")
    # keys of many rows: each pair of their blocks whose sizes and components let rows link is a key of its own
    rows = met.where("key is not null")
    spans = rows.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("least"), F.max("component").alias("most"))
    x, y = (spans.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high", "least", "most")]) for s in "xy")
    cells = x.join(y, "key").where(F.col("block_x") <= F.col("block_y")).where(F.col("high_x") * 100 >= F.col("low_y") * percent)
    cells = cells.where(F.least("least_x", "least_y") != F.greatest("most_x", "most_y")).select("key", "block_x", "block_y")
    cell = cells.select("key", F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"), F.xxhash64("key", "block_x", "block_y").alias("cell"))
    dealt = rows.join(cell, ["key", "block"]).select(F.col("cell").alias("key"), "n", F.col("a").alias("doc_id"), *MET[3:], "bits")
    across = dealt.repartition("key").sortWithinPartitions(*order).mapInArrow(_meetings(percent, nearest, True), MEETING)
    return met.where("key is null").select("a", "b").unionByName(across.select("a", "b")).distinct()


def confirmed(d: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    sets = stored(d.join(few, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return both.where(F.col("both") * (100 + percent) >= F.col("sizes") * percent).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of distinct word shingles have 100 * intersection >= percent * union.

    Takes doc_id and text of docs (A-Z lower-cased, words between ASCII white space); other columns are not looked
    at. Returns doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links, itself included) and
    kept (doc_id = component_id), a row for each row. A text of fewer words than a shingle is one shingle. Null and
    empty texts have no shingles and link with nothing. Rows with a null doc_id link with nothing and are kept, with a
    null component. Repeated rows share a component; rows of one id and different texts are counted each, and of their
    texts the greatest links. An empty table gives an empty result.
    """
    d = renamed(docs, ["doc_id", "text"])
    signed = stored(d.mapInArrow(_sign(words), SIGNED), "signed")
    d = one_text_each(docs)
    key = ["n_shingles", "set_a", "set_b"]
    classes = stored(signed.where("sig is not null and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("sig", "sketch_a", "sketch_b")]), "classes")
    pairs = stored(candidates(classes.select(F.col("rep").alias("doc_id"), "sig")), "pairs")
    links = stored(confirmed(d, pairs, words, percent), "confirmed")
    found = components(links)
    # first the nearest of other components, which leaves few of them, then all that are left apart
    for nearest in (True, False):
        of = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"), "sig", "sketch_a", "sketch_b")
        more = stored(climbed(d, of, words, percent, nearest), "climbed")
        links = stored(links.unionByName(confirmed(d, more, words, percent)), "confirmed")
        found = components(links)
    out = signed.join(classes.drop("sig", "sketch_a", "sketch_b"), key, "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without those that are not the first of their group; of repeated rows with the kept doc_id, all stay.

    Rows with null or empty texts or null ids stay; all columns stay, whatever their names; an empty table stays empty.
    """
    gone = near_duplicates(docs, **how).where("not kept").select("doc_id").distinct()
    return without(docs, gone)
