"""Near-duplicate embeddings by lattice hashing: random projections, decoded to E8 lattice points, in several tables.

A table projects a unit vector to BLOCKS times eight dimensions and takes the nearest E8 point of each block as its
cell. A vector also probes the cells next nearest to it. What meets in a cell is compared by cosine, in blocks of a
bounded number of rows, however many a cell holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import mix, renamed, stored
from tapedeck.llm.components import components

TABLES, BLOCKS, SCALE, PROBES = 16, 2, 0.55, 3
COSINE = 0.9
#: Rows of one cell that are compared at once; larger cells are cut, and their pieces meet in pairs.
CELL_ROWS = 2048
BUNDLE_ROWS = 8192
BLOCK = ["table", "dims", "cell", "low", "high"]


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are whole with an even sum."""
    out = np.rint(y)
    odd = out.sum(axis=-1) % 2 != 0
    gap = y - out
    worst = np.abs(gap).argmax(axis=-1)
    at = np.flatnonzero(odd)
    rows = worst[at]
    out[at, rows] += np.where(gap[at, rows] >= 0, 1.0, -1.0)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8, or D8 moved by a half in each coordinate. Doubled, so that they are whole."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=-1) < ((y - a) ** 2).sum(axis=-1)
    return (2 * np.where(closer[:, None], b, a)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: they lead from a point to its neighbours."""
    whole = []
    for i in range(8):
        for j in range(i):
            for s in (-2, 2):
                for t in (-2, 2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = s, t
                    whole.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([np.array(whole), signs[signs.prod(axis=1) == 1]])


def projections(dims: int) -> np.ndarray:
    return np.random.default_rng([816, dims]).standard_normal((TABLES, dims, 8 * BLOCKS)) * SCALE


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: home cells, by table, and cells to probe, by table and rank."""
    steps, n = minimal_vectors(), len(x)
    home, probe = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES, PROBES), np.uint64)
    odd = np.random.default_rng(5).integers(1, 2**63, (BLOCKS, 8), dtype=np.uint64) | np.uint64(1)

    def code(points, block):
        return mix((points.astype(np.uint64) * odd[block]).sum(axis=-1, dtype=np.uint64) + np.uint64(block))

    for t, p in enumerate(projections(x.shape[1])):
        y = (x @ p).reshape(n, BLOCKS, 8)
        points = np.stack([nearest_e8(y[:, k]) for k in range(BLOCKS)], axis=1)
        codes = np.stack([code(points[:, k], k) for k in range(BLOCKS)], axis=1)
        whole = codes.sum(axis=1, dtype=np.uint64)
        salt = np.uint64(1000003 * (t + 1))
        home[:, t] = mix(whole ^ salt)
        # distances to neighbouring cells' points, by block: |r - v|^2 = |r|^2 - 2 r.v + |v|^2, |v|^2 all the same
        far = np.concatenate([-((2 * y[:, k] - points[:, k]) @ steps.T) for k in range(BLOCKS)], axis=1)
        best = np.argpartition(far, PROBES, axis=1)[:, :PROBES]
        for r in range(PROBES):
            block, step = best[:, r] // len(steps), best[:, r] % len(steps)
            moved = points[np.arange(n), block] + steps[step]
            new = np.where(block == 0, code(moved, 0), code(moved, 1)) if BLOCKS == 2 else code(moved, 0)
            probe[:, t, r] = mix((whole - codes[np.arange(n), block] + new) ^ salt)
    return home, probe


def _cells(batches):
    for b in batches:
        vectors = b.column("embedding").to_pylist()
        for dims in sorted({len(v) for v in vectors}):
            which = [i for i, v in enumerate(vectors) if len(v) == dims]
            x = np.array([vectors[i] for i in which], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            home, probe = cells(x)
            n = len(which)
            ids = b.column("vec_id").take(pa.array(which))
            every = np.concatenate([home[:, :, None], probe], axis=2).reshape(n, -1).view(np.int64)
            k = every.shape[1]
            yield pa.record_batch(
                [
                    ids.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), PROBES + 1), n)), pa.array(np.full(n * k, dims, np.int32)),
                    pa.array(every.ravel()), pa.array(np.tile(np.arange(PROBES + 1) == 0, n * TABLES)),
                ],
                names=["vec_id", "table", "dims", "cell", "home"],
            )


def _compare(cosine: float):
    def links(ids, x, home, side, same) -> np.ndarray:
        """Pairs of one block of a cell: where it is one piece, of all its rows, else between its two sides."""
        rows = np.flatnonzero(side == 0)
        others = rows if same else np.flatnonzero(side == 1)
        out = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(rows), 512):
            r = rows[i : i + 512]
            # a pair meets where one of both is at home
            p, q = np.nonzero((x[r] @ x[others].T >= cosine) & (home[r][:, None] | home[others][None, :]))
            a, b = ids[r[p]], ids[others[q]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        return np.concatenate(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks of a bundle."""
        pdf = pdf.sort_values(BLOCK, kind="stable")
        keys = pdf[BLOCK].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ids, home, side, same = (pdf[c].to_numpy() for c in ("vec_id", "home", "side", "pieces_same"))
        vectors, out = pdf["embedding"].tolist(), [np.zeros((0, 2), np.int64)]
        for i, j in zip(first, [*first[1:], len(pdf)], strict=True):
            if home[i:j].any() and j - i > 1:
                x = np.array(vectors[i:j], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out.append(links(ids[i:j], x, home[i:j], side[i:j], same[i]))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def similar_pairs(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs a < b of vectors (vec_id, embedding; ids unique, components finite, not all zero) with such a cosine that meet in a cell."""
    placed = stored(vectors.mapInArrow(_cells, "vec_id long, table int, dims int, cell long, home boolean"), "cells")
    key = ["table", "dims", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    pieces = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    cut = placed.join(sizes.select(*key, pieces.alias("pieces")), key)
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("vec_id", "home"), F.col("pieces")).cast("int"))
    # piece p meets itself and every other piece: block (low, high), on side 0 as the low one
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    block = cut.select("vec_id", *key, "home", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), F.when(F.col("piece") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("piece") == F.col("other")).alias("pieces_same"))
    filled = block.join(vectors, "vec_id")
    # cells are mostly small: some go together, about BUNDLE_ROWS rows at a time
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bundle = F.pmod(F.xxhash64(*BLOCK), F.lit(1 + total // BUNDLE_ROWS))
    return filled.groupBy(bundle.alias("bundle")).applyInPandas(_compare(cosine), "a long, b long").distinct()


def near_duplicate_vectors(embeddings: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """Links between vectors of cosine `cosine` or more, and their groups: vec_id, n_links, component_id, kept.

    Takes vec_id and embedding. A vector that is null, empty or all zero, or holds a null or non-finite component, and
    one without an id, links with nothing (without an id, component_id is null and the row is kept). Vectors of
    different lengths don't link. Equal vectors link by definition and are searched for once. Repeated rows of one id
    and vector count as one, and each has its row; other columns are not looked at; an empty table gives no rows.
    """
    rows = renamed(embeddings, ["vec_id", "embedding"])
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = rows.where("vec_id is not null and embedding is not null").where(sound).distinct()
    classes = stored(vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    pairs = stored(similar_pairs(classes.select(F.col("rep").alias("vec_id"), "embedding"), cosine), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("rep").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("others"))
    found = components(pairs)
    per_class = classes.join(others, F.col("rep") == F.col("a"), "left").join(found, F.col("rep") == F.col("node"), "left").select("embedding", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = vectors.join(per_class, "embedding").select(F.col("vec_id").alias("id"), "n_links", "component_id").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(members, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
