"""Links between rows that share a key, so that what is alike enough stays connected, without all pairs of a group.

A row is (key, doc_id, pos) and a payload that says how alike two rows are. Rows of equal payload hang on the first of
them; different payloads are joined by a spanning forest of the largest likeness, which connects whatever any chain of
alike pairs connects. A group of n rows gives about n links.

Keys that a sample shows to be hot are refined where their rows are made: each row goes under several narrower keys, of
which rows that are alike enough share one. Groups that are still larger than BLOCK rows are cut into blocks by the
task that streams them. A block is linked and reduced to what stands for it, and what stands for two blocks meets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapedeck.llm.common import discard, mix, stored

#: Rows of a key that are linked at once, rows that are held until they are linked, and payloads of a key that are linked together with those of other keys.
BLOCK, HELD, SMALL = 4096, 100_000, 24
#: One in SAMPLED documents is looked at for keys of more than BLOCK and a HOT-th of all rows; there are less than HOT such keys.
SAMPLED, HOT = 64, 10_000
LINKS = ["a", "a_pos", "b", "b_pos"]

#: How alike the rows x and y (columns of payloads) are; 0 if too little.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def changes(*rows: np.ndarray) -> np.ndarray:
    """Where one of the rows differs from the value before it; true at the first place."""
    out = np.ones(len(rows[0]), bool)
    if len(out):
        out[1:] = False
    for r in rows:
        out[1:] |= r[1:] != r[:-1]
    return out


def forest(payload: np.ndarray, alike: Alike) -> np.ndarray:
    """A spanning forest of the largest likeness over columns of payloads, by growing one tree after the other."""
    n = payload.shape[1]
    best, parent, outside = np.zeros(n, np.int64), np.full(n, -1), np.ones(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        outside[at], best[at] = False, -1
        w = alike(payload[:, at : at + 1], payload)
        better = (w > best) & outside
        best[better], parent[better] = w[better], at
        at = int(best.argmax())
        if best[at] > 0:
            out.append((parent[at], at))
    return np.array(out, np.int64).reshape(-1, 2).T


def forests(payload: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many small groups of one size: payload is (columns, groups, size); the groups of links and their ends."""
    _, many, size = payload.shape
    w = alike(payload[:, :, :, None], payload[:, :, None, :])
    best, parent, outside = np.zeros((many, size), np.int64), np.full((many, size), -1), np.ones((many, size), bool)
    each, at, out = np.arange(many), np.zeros(many, np.int64), [np.zeros((3, 0), np.int64)]
    for _ in range(size - 1):
        outside[each, at], best[each, at] = False, -1
        now = w[each, at]
        better = (now > best) & outside
        best, parent = np.where(better, now, best), np.where(better, at[:, None], parent)
        at = best.argmax(axis=1)
        ok = best[each, at] > 0
        out.append(np.stack([each[ok], parent[each, at][ok], at[ok]]))
    return tuple(np.concatenate(out, axis=1))


def links(rows: np.ndarray, alike: Alike) -> np.ndarray:
    """Links (a, a_pos, b, b_pos; a < b) between rows (key, doc_id, pos, payload...) of one key and two documents."""
    rows = rows[:, np.lexsort((rows[2], rows[1], *rows[:2:-1], rows[0]))]
    new_kind = changes(rows[0], *rows[3:])
    new_node = new_kind | changes(rows[1])
    # a node: the rows of one document that are alike in all; a kind: the nodes of one payload
    nodes, node = np.flatnonzero(new_node), np.cumsum(new_node) - 1
    kinds = np.flatnonzero(new_kind[nodes])
    kind = np.cumsum(new_kind[nodes]) - 1
    every = np.arange(len(nodes))
    hang = every != kinds[kind]
    pairs = [np.stack([kinds[kind[hang]], every[hang]])]
    # kinds of one key, by their first documents, lest each key picks others to hang the rest on
    count = np.diff(np.append(kinds, len(nodes)))
    order = np.lexsort((rows[1, nodes[kinds]], rows[0, nodes[kinds]]))
    kinds, count = kinds[order], count[order]
    first, key = nodes[kinds], rows[0, nodes[kinds]]
    begins = np.flatnonzero(changes(key))
    size = np.diff(np.append(begins, len(kinds)))
    found = []
    # kinds that one and the same document has alone are not alike
    held = np.concatenate([rows[3:, first], [rows[1, first], count == 1]])

    def apart(x, y):
        return np.where((x[-2] == y[-2]) & (x[-1] & y[-1] > 0), 0, alike(x[:-2], y[:-2]))

    for n in range(2, SMALL + 1):
        some = begins[size == n]
        for i in range(0, len(some), 1 + HELD // n**2):
            at = some[i : i + 1 + HELD // n**2, None] + np.arange(n)
            of, x, y = forests(held[:, at], apart)
            found.append(np.stack([at[of, x], at[of, y]]))
    for i, n in zip(begins[size > SMALL], size[size > SMALL], strict=True):
        found.append(forest(held[:, i : i + n], apart) + i)
    if found:
        x, y = np.concatenate(found, axis=1)
        p, q, doc = kinds[x], kinds[y], rows[1, nodes]
        # where both first ones are of one document, the next node of either kind is of another
        same = doc[p] == doc[q]
        other = same & (count[y] > 1)
        q = q + other
        p = p + (same & ~other & (count[x] > 1))
        apart = doc[p] != doc[q]
        pairs.append(np.stack([p[apart], q[apart]]))
    x, y = np.concatenate(pairs, axis=1)
    # a document's other rows of a node go where one link of the node goes
    partner = np.full(len(nodes), -1)
    partner[x], partner[y] = y, x
    more = np.flatnonzero(~new_node & (partner[node] >= 0))
    i, j = np.concatenate([nodes[x], more]), np.concatenate([nodes[y], nodes[partner[node[more]]]])
    swap = rows[1, i] > rows[1, j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return np.stack([rows[1, i], rows[2, i], rows[1, j], rows[2, j]])


def once_each(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (key, doc_id, pos, payload...), of those of one document that are alike in all but pos the first one."""
    with np.errstate(over="ignore"):
        whole = sum(mix(r.view(np.uint64) + np.uint64(i)) * np.uint64(2 * i + 1) for i, r in enumerate(rows) if i != 2)
    at = np.lexsort((rows[2], whole))
    at = np.sort(at[changes(whole[at])])
    return [r[at] for r in rows]


def first_of_kinds(rows: np.ndarray) -> np.ndarray:
    """The first row of each payload (and, lest they be of one document, the first of another document too)."""
    rows = rows[:, np.lexsort((rows[2], rows[1], *rows[:2:-1], rows[0]))]
    kind = changes(rows[0], *rows[3:])
    node = kind | changes(rows[1])
    second = np.zeros(rows.shape[1], bool)
    at = np.flatnonzero(node)
    second[at[1:]] = kind[at[:-1]] & ~kind[at[1:]]
    return rows[:, kind | second]


def _refined(rows_of, hot: list[int], refine, columns: list[str]):
    """rows_of, with rows of hot keys under narrower keys."""
    keys = np.array(sorted(hot), np.int64)

    def run(batches):
        for b in rows_of(batches):
            if len(keys):
                key = b.column("key").to_numpy()
                is_hot = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                if is_hot.any():
                    rows = np.stack([b.column(c).to_numpy() for c in columns])
                    rows = np.concatenate([rows[:, ~is_hot], refine(rows[:, is_hot])], axis=1)
                    b = pa.record_batch([pa.array(r) for r in rows], names=columns)
            yield b

    return run


def _linked(alike: Alike, payload: list[str], reduce=None):
    """Links within a part in order of its keys. Keys of more than BLOCK rows are linked in blocks, and what `reduce`
    makes of a block goes out as rows of numbered blocks; without `reduce`, keys are linked whole."""
    columns = ["key", "doc_id", "pos", *payload]

    def out(found):
        return pa.record_batch([*map(pa.array, found), *[pa.nulls(found.shape[1], pa.int64())] * (2 + len(payload))], names=[*LINKS, "key", "block", *payload])

    def blocks(rows, number):
        found, rows, number = reduce(rows, number)
        if found.shape[1]:
            yield out(found)
        none = pa.nulls(rows.shape[1], pa.int64())
        number = np.broadcast_to(np.int64(number), rows.shape[1])
        yield pa.record_batch([pa.array(rows[1]), pa.array(rows[2]), none, none, pa.array(rows[0]), pa.array(number), *map(pa.array, rows[3:])], names=[*LINKS, "key", "block", *payload])

    def run(batches):
        held, number = [], 0  # rows that wait, and blocks of the first key among them that are out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            held.append(rows)
            if sum(h.shape[1] for h in held) < HELD:
                continue
            rows = np.concatenate(held, axis=1)
            if number:
                end = int(np.searchsorted(rows[0], rows[0, 0], side="right"))
                if end < rows.shape[1]:
                    yield from blocks(rows[:, :end], number)
                    rows, number = rows[:, end:], 0
            last = 0 if number else int(np.searchsorted(rows[0], rows[0, -1], side="left"))
            if last and (found := links(rows[:, :last], alike)).shape[1]:
                yield out(found)
            rows = rows[:, last:]
            while reduce and rows.shape[1] > 2 * BLOCK:
                yield from blocks(rows[:, :BLOCK], number)
                rows, number = rows[:, BLOCK:], number + 1
            held = [rows]
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            end = int(np.searchsorted(rows[0], rows[0, 0], side="right")) if number else 0
            if end:
                yield from blocks(rows[:, :end], number)
            if end < rows.shape[1] and (found := links(rows[:, end:], alike)).shape[1]:
                yield out(found)

    return run


def hot_keys(sample: DataFrame) -> list[int]:
    """Keys that hold more than BLOCK rows and a HOT-th of all (of one in SAMPLED documents): less than HOT of them."""
    counts = sample.groupBy("key").agg(F.count("*").alias("n"))
    found = counts.agg(F.sum("n")).first()[0] or 0
    return [r["key"] for r in counts.where(F.col("n") > max(BLOCK // SAMPLED, found // HOT)).collect()]


def linked(docs: DataFrame, rows_of, alike: Alike, payload: list[str], refine, reduce) -> DataFrame:
    """a, a_pos, b, b_pos (a < b): links between the rows that `rows_of` makes of docs, as stored.

    refine(rows): rows under narrower keys. reduce(rows, number): of a block of a key, links, rows that stand for the
    block, and its number (0 if the rows have keys under which they need no blocks). All rows are shuffled once.
    """
    columns = ["key", "doc_id", "pos", *payload]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in columns])
    result = T.StructType([T.StructField(c, T.LongType()) for c in (*LINKS, "key", "block", *payload)])
    hot = hot_keys(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(rows_of, kind).select("key"))
    rows = docs.mapInArrow(_refined(rows_of, hot, refine, columns), kind)
    met = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(alike, payload, reduce), result), "met")
    cut = met.where("key is not null").select(*[F.col(c) for c in ("key", "block", *payload)], F.col("a").alias("doc_id"), F.col("a_pos").alias("pos"))
    cut = cut.join(cut.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "key")
    # a block meets each other one, and itself if it is alone
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where((F.col("other") != F.col("block")) | (F.col("blocks") == 1))
    cells = cut.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).select(*columns)
    across = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(alike, payload), result)
    out = stored(met.where("key is null").select(*LINKS).unionByName(across.select(*LINKS)).distinct(), "links")
    discard(met)
    return out
