"""Repeated passages by a sparse suffix array: suffixes at minimiser positions, sorted, compared and extended.

A position is kept if its run of SHINGLE words has the least hash among WINDOW runs in a row, which the words around
it alone decide: a passage of LEAST_WORDS words keeps a position among its first WINDOW, wherever it stands. Suffixes
that begin with the same FIRST words are sorted by the words that follow, then by those before them; equal ones are
neighbours, and different ones are linked by how many words they share in both directions, so that the occurrences of
a passage stay linked whatever other documents share only its beginning. Links are extended on the full texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import blocks, mix, shingle_hashes, token_hashes
from tapedeck.llm.groups import linked, links, once_each
from tapedeck.llm.passages import one_text_each, visits, with_words

LEAST_WORDS, WINDOW, SHINGLE = 50, 30, 5
#: Words of a suffix's key, and words behind them and before the suffix of which it carries FOUR bits each.
FIRST, CARRIED, FOUR = LEAST_WORDS - WINDOW, 32, 4
PAYLOAD = ["after", "later", "before", "earlier"]
#: Bits of a key that say which of the narrower keys it is; 0 for a suffix's own.
LEVEL = np.uint64(31)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def minimisers(x: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some `width` values in a row: each place where a value is that low."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    least = sliding_least(x, width)
    # a position is kept if a window that holds it has it as its least: the highest of those windows' leasts
    high = np.concatenate([np.zeros(width - 1, x.dtype), least, np.zeros(width - 1, x.dtype)])
    top = ~sliding_least(~high, width)
    return np.flatnonzero(x == top)


def prefix_hashes(tokens: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of words: run i..j hashes as (sums[j] - sums[i]) * back[i]."""
    return np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers(len(tokens)), dtype=np.uint64)])


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_backs = np.ones(1, np.uint64)


def _grow(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = _grow(_BASE, 2 * n)
    return _powers[:n]


def backs(n: int) -> np.ndarray:
    """Inverses of powers, so that a run's hash doesn't hang on where it stands."""
    global _backs
    if len(_backs) < n:
        _backs = _grow(pow(_BASE, -1, 2**64), 2 * n)
    return _backs[:n]


def separated(tokens: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words of many texts in a row; 0, the least value, for runs that leave their text."""
    x = shingle_hashes(tokens, n)
    for k in range(1, n):
        at = offsets[1:] - k
        x[at[(at >= 0) & (at < len(x))]] = 0
    return x


def packed(words: np.ndarray) -> np.ndarray:
    """FOUR bits of each of the 16 words from each place on, the first one lowest; past the end, of nothing."""
    x = np.concatenate([words >> np.uint64(64 - FOUR), np.zeros(CARRIED, np.uint64)])
    for k in (1, 2, 4, 8):
        x = x | (np.concatenate([x[k:], np.zeros(k, np.uint64)]) << np.uint64(FOUR * k))
    return x


def _suffixes(batches):
    for b in blocks(batches):
        tokens, offsets = token_hashes(b.column("text"))
        if len(tokens) < LEAST_WORDS:
            continue
        x = separated(tokens, offsets, SHINGLE)
        at = minimisers(x, WINDOW)
        of = np.searchsorted(offsets, at, side="right") - 1
        keep = (x[at] != 0) & (at + FIRST <= offsets[of + 1]) & (offsets[of + 1] - offsets[of] >= LEAST_WORDS)
        at, of = at[keep], of[keep]
        start, end, n = offsets[of], offsets[of + 1], len(tokens)
        sums, back = prefix_hashes(tokens), backs(n + 1)
        key = mix((sums[at + FIRST] - sums[at]) * back[at]) & ~LEVEL
        ahead, behind = packed(tokens), packed(tokens[::-1])
        # past the ends of a text stands what its length says: it is the same in copies, and seldom in other texts
        beyond = mix((end - start).astype(np.uint64))
        rows = [key.view(np.int64), b.column("doc_id").to_numpy()[of], at - start]
        for way, place, there in ((ahead, at + FIRST, end - at - FIRST), (ahead, at + FIRST + 16, end - at - FIRST - 16), (behind, n - at, at - start), (behind, n - at + 16, at - start - 16)):
            bits = (FOUR * np.clip(there, 0, 16)).astype(np.uint64)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
            rows.append(((way[place] & mask) | (beyond & ~mask)).view(np.int64))
        yield pa.record_batch([pa.array(r) for r in once_each(rows)], names=["key", "doc_id", "pos", *PAYLOAD])


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of 16 packed words agree from the first one on."""
    v = x.view(np.uint64) ^ y.view(np.uint64)
    return (np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1)) // FOUR).astype(np.int64)


def shared_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that suffixes of one key share, ahead and behind, as far as they carry them; 0 if too few for a passage.

    It is never less than what they share, and now and then some words more.
    """
    n = np.full(np.broadcast_shapes(x.shape, y.shape)[1:], FIRST, np.int64)
    for near in (0, 2):
        some = _equal(x[near], y[near])
        n += some + np.where(some == 16, _equal(x[near + 1], y[near + 1]), 0)
    return np.where(n >= LEAST_WORDS, n, 0)


def equal_runs(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches (start in a, length) over which a[i] == b[i - shift], of `least` words or more."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < least:
        return []
    same = np.concatenate([[False], a[low:high] == b[low - shift : high - shift], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(low + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2], strict=True) if y - x >= least]


#: Rows of a hot key share a run of LEAST_WORDS words only if they share one of GRID words less that begins a multiple
#: of GRID + 1 words before the suffix.
GRID = 4


def _narrower(rows: np.ndarray, words: int, steps) -> np.ndarray:
    """Rows under keys of `words` words: those that begin with so many words before the suffix, for each of steps."""
    key, after, later, before, earlier = (r.view(np.uint64) for r in rows[[0, 3, 4, 5, 6]])
    out = []
    for k in steps:
        k_left, k_right = k, words - FIRST - k

        def part(near, far, n):
            low = np.uint64((1 << (FOUR * min(n, 16))) - 1)
            high = np.uint64((1 << (FOUR * min(max(n - 16, 0), 16))) - 1)
            return (near & low) * np.uint64(0x9E3779B97F4A7C15) + mix((far & high) + np.uint64(n))

        new = rows.copy()
        hashed = mix(key + np.uint64(words * 64 + k) + mix(part(after, later, k_right)) * np.uint64(0xC2B2AE3D27D4EB4F) + mix(part(before, earlier, k_left) ^ np.uint64(0x165667B19E3779F9)))
        new[0] = ((hashed & ~LEVEL) | np.uint64(1 + k // (GRID + 1))).view(np.int64)
        out.append(new)
    return np.concatenate(out, axis=1)


def _refine(rows: np.ndarray) -> np.ndarray:
    return _narrower(rows, LEAST_WORDS - GRID, range(0, LEAST_WORDS - FIRST - GRID + 1, GRID + 1))


def _reduce(rows: np.ndarray, number: int):
    """Rows of a large key under each run of LEAST_WORDS words that they may share: all that share one are alike, so the
    first row stands for its block."""
    level = int(rows[0, 0]) & int(LEVEL)
    steps = range((level - 1) * (GRID + 1), level * (GRID + 1)) if level else range(LEAST_WORDS - FIRST + 1)
    every = _narrower(rows, LEAST_WORDS, [k for k in steps if k <= LEAST_WORDS - FIRST])
    every[3:] = 0
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    new = np.concatenate([[True], every[0, 1:] != every[0, :-1]])
    found = links(every, shared_words)
    return (np.unique(found, axis=1) if found.shape[1] else found), every[:, new], 0


REPEATS = "doc_id long, start long, other_doc_id long, other_start long, n_words long"


def _extended(batches):
    for some in visits(batches):
        rows = []
        for r, own, other in some:
            shifts = sorted({p["a_pos"] - p["b_pos"] for p in r["seeds"]})
            if r["home"] > r["guest"]:
                shifts = [-s for s in shifts]
            for shift in shifts:
                for start, n in equal_runs(own, other, shift, LEAST_WORDS):
                    rows += [(r["home"], start, r["guest"], start - shift, n), (r["guest"], start - shift, r["home"], start, n)]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "other_doc_id", "other_start", "n_words"])


def repeats(docs: DataFrame) -> DataFrame:
    """Passages of LEAST_WORDS words or more that a document shares with another: doc_id, start, other_doc_id,
    other_start, n_words.

    Words are compared with A-Z lower-cased; starts count words from 0; a passage is as long as it goes on both sides.
    Each pair has a row for either document. Not every pair of the occurrences of a passage has rows, but each
    occurrence has one, and rows lead from each to all others; of occurrences in one document that stand in the same
    words for CARRIED words around, as in a line said over and over, one has rows. Null and empty texts and null ids have no rows; of rows
    with one id the greatest text counts; passages within one document are not reported; other columns are not looked
    at; an empty table gives no rows.
    """
    d = one_text_each(docs)
    near = linked(d, _suffixes, shared_words, PAYLOAD, _refine, _reduce)
    pairs = near.withColumn("shift", F.col("a_pos") - F.col("b_pos")).groupBy("a", "b", "shift").agg(F.min("a_pos").alias("a_pos"), F.min("b_pos").alias("b_pos"))
    return with_words(pairs.groupBy("a", "b").agg(F.collect_list(F.struct("a_pos", "b_pos")).alias("seeds")), d).mapInArrow(_extended, REPEATS)
