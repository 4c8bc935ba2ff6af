"""Scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 decision nodes has its own context tree, whose contexts are the
DEPTH bytes before, the last one first. Every node holds a Krichevsky-Trofimov estimate of its training counts, and
the tree mixes the estimates of all depths with the weights that the training bytes give them. Scoring uses the frozen
mixture: at a context never seen in training, the deepest seen one on its path is the last that is mixed in.

The block probability of a Krichevsky-Trofimov estimate depends on counts only, so training is counting: runs of
DEPTH + 1 bytes are counted in parallel, and subtrees are weighted in parallel, one for each branch, the last TOP bytes:
below one lie at most 256 ** (DEPTH - TOP + 1) runs, however much text there is. Their roots are summed to the nodes of
two bytes, those to the at most 65,536 nodes of one byte; weights come down again the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import blocks, renamed, stored, words_of

DEPTH, TOP = 5, 3
END = 0x0A
#: Runs of one or more whole branches that are weighted in one call.
CHUNK = 100_000
#: Runs of bytes (16 bytes each) and words that may be broadcast; beyond that they are joined by a shuffle.
MOST_GRAMS = 8_000_000
HOT_WORDS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HALF = np.log(0.5)
_TABLE = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(4095) + 0.5))])


def plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that are scored, of all texts in a row, with each text's start and length: A-Z lower-cased, each
    word followed by one space, and a line feed at the end. They say exactly which words a text has, in order."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    data = b"".join(x for t in raw for x in (t, b" \n"))
    buf = _LOWER[np.frombuffer(data, np.uint8)]
    lengths = np.array([len(t) + 2 for t in raw], np.int64)
    ends = np.cumsum(lengths) - 1
    space = _SPACE[buf]
    space[ends] = False
    after = np.empty_like(space)
    after[1:] = space[:-1]
    after[ends - lengths + 1] = True
    keep = ~(space & after)
    buf[space] = 0x20
    new_ends = np.cumsum(keep)[ends]
    starts = np.concatenate([[0], new_ends[:-1]])
    return buf[keep], starts, new_ends - starts


def grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with its context as one integer (the last byte before it on top, the byte itself lowest), and the
    number of bytes of each text. Before a text stand line feeds."""
    b, starts, lengths = plain_bytes(texts)
    key = b.astype(np.int64)
    for j in range(1, depth + 1):
        before = np.empty_like(b)
        before[j:] = b[:-j]
        for k in range(j):
            before[starts[lengths > k] + k] = END
        key |= before.astype(np.int64) << (8 * (depth - j + 1))
    return key, lengths


def _count_grams(depth: int):
    """Counts of the runs in training texts; runs of the others come with a count of 0, so that they get a probability too."""

    def merged(keys, counts):
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return [keys[at]], [np.add.reduceat(counts, at)]

    def batch(keys, counts):
        return pa.record_batch([pa.array(keys[0]), pa.array(counts[0])], names=["gram", "n"])

    def run(batches):
        keys, counts = [], []
        for b in blocks(batches):
            held = b.column("held_out").fill_null(False)
            for own, weight in ((pc.invert(held), 1), (held, 0)):
                texts = b.column("text").filter(own).fill_null("")
                if len(texts):
                    k, n = np.unique(grams(texts, depth)[0], return_counts=True)
                    keys.append(k)
                    counts.append(n.astype(np.int64) * weight)
            if sum(map(len, keys)) > 4_000_000:
                keys, counts = merged(keys, counts)
                if len(keys[0]) > 2_000_000:
                    yield batch(keys, counts)
                    keys, counts = [], []
        if keys:
            yield batch(*merged(keys, counts))

    return run


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole n >= 0."""
    n = np.asarray(n, np.int64)
    x = n + 0.5
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_TABLE), _TABLE[np.minimum(n, len(_TABLE) - 1)], large)


def log_gamma_one(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) for whole n >= 0."""
    n = np.asarray(n, np.int64)
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])
    x = np.maximum(n, 1) + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, small[np.minimum(n, 4095)], large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the probability that a Krichevsky-Trofimov estimate gives a sequence with so many zeros and ones."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - log_gamma_one(zeros + ones) - np.log(np.pi)


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def deeper(state: tuple, zeros: np.ndarray, ones: np.ndarray, kt: np.ndarray, weighted: np.ndarray) -> tuple:
    """From above a level to below it, where it was seen in training: what is mixed so far, the weight left, the last
    seen level's estimate, and the share of the weight left that it keeps if a deeper level is seen."""
    mixed, rest, leaf, share = state
    seen = zeros + ones > 0
    return (
        np.where(seen, mixed + rest * share * leaf, mixed),
        np.where(seen, rest * (1 - share), rest),
        np.where(seen, next_one(zeros, ones), leaf),
        np.where(seen, np.exp(_HALF + kt - weighted), share),
    )


class Subtree:
    """The decision nodes below some contexts of `top` bytes: counts, block probabilities and weights at each depth.

    A node at the full depth is (decision, context); sorted by decision and context, the nodes below any shorter
    context lie together.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        symbol, context = keys & 0xFF, keys >> 8
        bits = np.arange(8)
        decision = ((1 << bits)[None, :] | (symbol[:, None] >> (8 - bits)[None, :])).ravel()
        self.bit = ((symbol[:, None] >> (7 - bits)[None, :]) & 1).ravel().astype(bool)
        full = (decision << (8 * depth)) | np.repeat(context, 8)
        self.nodes, self.of = np.unique(full, return_inverse=True)
        n = np.repeat(counts, 8)
        zeros = np.bincount(self.of, weights=np.where(self.bit, 0, n), minlength=len(self.nodes)).astype(np.int64)
        ones = np.bincount(self.of, weights=np.where(self.bit, n, 0), minlength=len(self.nodes)).astype(np.int64)
        self.level: dict[int, tuple] = {}
        ids, at, below = self.nodes, np.arange(len(self.nodes)), None
        for d in range(depth, top - 1, -1):
            if d < depth:
                ids = ids >> 8
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                number = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]]))
                zeros, ones, below = (np.add.reduceat(x, first) for x in (zeros, ones, below))
                ids, at = ids[first], number[at]
            kt = log_kt(zeros, ones)
            weighted = kt if below is None else np.logaddexp(_HALF + kt, _HALF + below)
            self.level[d] = (at, zeros, ones, kt, weighted, ids)
            below = weighted

    def roots(self) -> tuple:
        """Decision, context, zeros, ones and weighted log probability of the nodes at the top."""
        _, zeros, ones, _, weighted, ids = self.level[self.top]
        context = ids & ((1 << (8 * self.top)) - 1)
        return ids >> (8 * self.top), context, zeros, ones, weighted

    def log10_probabilities(self, mixed: np.ndarray, rest: np.ndarray, leaf: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of each key, from the state above the top of each node at the full depth (see `deeper`)."""
        state = mixed, rest, leaf, share
        for d in range(self.top, self.depth + 1):
            at, zeros, ones, kt, weighted, _ = self.level[d]
            state = deeper(state, *(x[at] for x in (zeros, ones, kt, weighted)))
        mixed, rest, leaf, _ = state
        one = (mixed + rest * leaf)[self.of]
        return np.log10(np.where(self.bit, one, 1 - one)).reshape(-1, 8).sum(axis=1)


def whole_branches(batches, limit: int = CHUNK):
    """Arrow tables of rows sorted by branch, each with all rows of the branches in it."""
    held, rows, most = [], 0, limit
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows > most:
            t = pa.Table.from_batches(held)
            branch = t.column("branch").to_numpy()
            cut = int(np.searchsorted(branch, branch[-1]))
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), len(t) - cut
            most = max(limit, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _roots(depth: int):
    """Nodes at the top of each branch."""

    def run(batches):
        for t in whole_branches(batches):
            found = Subtree(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth, TOP).roots()
            yield pa.record_batch([pa.array(x) for x in found], names=["decision", "context", "zeros", "ones", "weighted"])

    return run


def _node(t, below: str) -> tuple:
    """zeros, ones, log of the estimate's and of the weighted probability of nodes with what is summed below them."""
    zeros, ones = t.column("zeros").to_numpy(), t.column("ones").to_numpy()
    kt = log_kt(zeros, ones)
    return zeros, ones, kt, np.logaddexp(_HALF + kt, _HALF + t.column(below).to_numpy())


def _weighted(batches):
    for b in batches:
        yield pa.record_batch([*(b.column(c) for c in ("decision", "context", "zeros", "ones")), pa.array(_node(b, "below")[3])], names=["decision", "context", "zeros", "ones", "weighted"])


STATE = ["mixed", "rest", "leaf", "share"]


def _states(upper: tuple):
    """The state below each node of two bytes."""

    def run(batches):
        for b in batches:
            decision, context = b.column("decision").to_numpy(), b.column("context").to_numpy()
            state = deeper(tuple(x[context >> 8, decision] for x in upper), *_node(b, "below"))
            yield pa.record_batch([b.column("decision"), b.column("context"), *map(pa.array, state)], names=["decision", "context", *STATE])

    return run


def upper_levels(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the sums over subtrees by last byte and decision (at most 256 * 255 rows): what is mixed, the weight left,
    the last seen estimate and its share, for each last byte and decision, of depths 0 and 1."""
    zeros, ones, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for r in rows:
        zeros[r["last"], r["decision"]], ones[r["last"], r["decision"]], below[r["last"], r["decision"]] = r["zeros"], r["ones"], r["below"]
    kt = log_kt(zeros, ones)
    weighted = np.logaddexp(_HALF + kt, _HALF + below)
    zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
    kt0 = log_kt(zeros0, ones0)
    share0 = np.exp(_HALF + kt0 - np.logaddexp(_HALF + kt0, _HALF + weighted.sum(axis=0)))[None, :]
    leaf0 = next_one(zeros0, ones0)[None, :]
    seen = zeros + ones > 0
    mixed = np.where(seen, share0 * leaf0, 0.0)
    rest = np.where(seen, 1 - share0, 1.0)
    leaf = np.where(seen, next_one(zeros, ones), leaf0)
    share = np.where(seen, np.exp(_HALF + kt - weighted), share0)
    return mixed, rest, leaf, share


def _probabilities(depth: int):
    """log10 P(byte | context) of each run, from rows of branches: first the states above their nodes, then their runs."""

    def run(batches):
        for t in whole_branches(batches):
            runs = t.filter(pc.is_valid(t.column("n")))
            nodes = t.filter(pc.is_null(t.column("n"))).sort_by("key")
            keys = runs.column("key").to_numpy()
            tree = Subtree(keys, runs.column("n").to_numpy(), depth, TOP)
            above = nodes.column("state").combine_chunks().flatten()
            logs = tree.log10_probabilities(*(x.to_numpy()[tree.level[TOP][0]] for x in above))
            yield pa.record_batch([pa.array(keys), pa.array(logs)], names=["gram", "log10p"])

    return run


def gram_probabilities(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram and log10p of each run of bytes in texts (text, held_out), learnt from those not held out; depth is TOP or more."""
    counts = stored(texts.mapInArrow(_count_grams(depth), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    runs = counts.withColumn("branch", F.shiftright("gram", 8 * (depth - TOP + 1)))
    node = "decision long, context long, zeros long, ones long, weighted double"
    sums = [F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")]
    roots = stored(runs.repartition("branch").sortWithinPartitions("gram").mapInArrow(_roots(depth), node), "roots")
    pairs = stored(roots.groupBy("decision", F.shiftright("context", 8).alias("context")).agg(*sums), "pairs")
    single = pairs.mapInArrow(_weighted, node).groupBy("decision", F.shiftright("context", 8).alias("last")).agg(*sums)
    upper = upper_levels(single.collect())  # at most 256 * 255 rows
    states = pairs.mapInArrow(_states(upper), "decision long, context long, " + ", ".join(f"{c} double" for c in STATE))
    above = roots.select("decision", F.col("context").alias("branch"), F.shiftright("context", 8).alias("context")).join(states, ["decision", "context"])
    key = F.shiftleft("decision", 8 * TOP).bitwiseOR(F.col("branch"))
    rows = above.select("branch", key.alias("key"), F.lit(None).cast("long").alias("n"), F.struct(*STATE).alias("state"))
    rows = rows.unionByName(runs.select("branch", F.col("gram").alias("key"), "n"), allowMissingColumns=True)
    found = rows.repartition("branch").sortWithinPartitions("branch", F.col("n").isNotNull(), "key").mapInArrow(_probabilities(depth), "gram long, log10p double")
    return stored(found, "probabilities")


def _word_counts(batches):
    for b in blocks(batches):
        codes, words, _ = words_of(b.column("text"))
        if len(words):
            yield pa.record_batch([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: string, k: long>>"


def _scores(depth: int, model, hot, total: float, end_log: float, known_end: int):
    """Scores by the broadcast runs (None: left to a join), base scores of hot words, and the rare words of each text."""

    def run(batches):
        for b in blocks(batches):
            n = b.num_rows
            texts = b.column("text").fill_null("")
            score = np.zeros(n)
            if model is not None:
                key, lengths = grams(texts, depth)
                keys, logs = model.value
                unique, inverse = np.unique(key, return_inverse=True)
                at = np.searchsorted(keys, unique)
                sums = np.concatenate([[0.0], np.cumsum(logs[at][inverse], dtype=np.float64)])
                ends = np.cumsum(lengths)
                score = sums[ends] - sums[ends - lengths]
            codes, words, offsets = words_of(texts)
            counts = np.fromiter((hot.value.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
            logs = np.where(counts >= 0, np.log10((np.maximum(counts, 0) + 0.5) / total), 0.0)[codes]
            base, known = (np.concatenate([[0.0], np.cumsum(x)]) for x in (logs, (counts >= 0)[codes]))
            rare, many, starts = counts < 0, [], [0]
            for i in range(n):
                own = codes[offsets[i] : offsets[i + 1]]
                w, k = np.unique(own[rare[own]], return_counts=True)
                many.append((w, k))
                starts.append(starts[-1] + len(w))
            which = np.concatenate([w for w, _ in many]) if many else np.zeros(0, np.int64)
            items = pa.StructArray.from_arrays([words.cast(pa.string()).take(pa.array(which)), pa.array(np.concatenate([k for _, k in many]).astype(np.int64))], names=["word", "k"])
            yield pa.record_batch(
                [
                    b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(offsets) + 1),
                    pa.array((known[offsets[1:]] - known[offsets[:-1]]).astype(np.int64) + known_end), pa.array(base[offsets[1:]] - base[offsets[:-1]] + end_log),
                    pa.array(score), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    return run


def _rows_of_grams(depth: int):
    def run(batches):
        for b in blocks(batches):
            key, lengths = grams(b.column("text").fill_null(""), depth)
            ends = np.cumsum(lengths)
            for r, a, e in zip(b.column("row").to_pylist(), ends - lengths, ends, strict=True):
                k, n = np.unique(key[a:e], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(k), r)), pa.array(k), pa.array(n)], names=["row", "gram", "n"])

    return run


def score(docs: DataFrame, *, depth: int = DEPTH, most_grams: int = MOST_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """log10 probability of each text under the context tree learnt from the texts not held out, beside word counts.

    Held out are the rows whose crc32(doc_id as text) mod 5 is 1; a null doc_id is not. A text is its words (A-Z
    lower-cased, between ASCII white space) and an end; its bytes are scored as each word with one space, then a line
    feed. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words by their smoothed training
    counts) and score. Null and empty texts are an end alone. Repeated
    rows count and are scored each; with no training rows, estimates are those of empty counts; an empty table gives
    no rows; other columns are not looked at.
    """
    sc = docs.sparkSession.sparkContext
    d = renamed(docs, ["doc_id", "text"]).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    probabilities = gram_probabilities(d, depth)
    train = d.where("not held_out")
    counted = stored(train.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    words, kinds = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = train.count()
    tokens, kinds = words + texts, kinds + (texts > 0)
    total = tokens + 0.5 * (kinds + 1)
    end_log = float(np.log10((texts + 0.5) / total))
    top = counted.orderBy(F.desc("n"), "word").limit(hot_words).toArrow()  # hot_words rows
    hot = sc.broadcast(dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)))
    small = probabilities.count() <= most_grams
    model, d = None, d.withColumn("row", F.monotonically_increasing_id())
    if small:
        found = probabilities.sort("gram").toArrow()  # most_grams rows
        model = sc.broadcast((found["gram"].to_numpy(), found["log10p"].to_numpy()))
        del found
    else:
        d = stored(d, "rows")
    scored = stored(d.mapInArrow(_scores(depth, model, hot, total, end_log, int(texts > 0)), SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k")
    c = F.coalesce("n", F.lit(0))
    of_rare = rare.join(counted, "word", "left").select("row", F.when(c > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.log10((c + 0.5) / total)).alias("base_score"), F.lit(0.0).alias("score"))
    parts = scored.select("row", "n_known", "base_score", "score", "doc_id", "held_out", "n_tokens").unionByName(of_rare, allowMissingColumns=True)
    if not small:
        by_gram = d.mapInArrow(_rows_of_grams(depth), "row long, gram long, n long").join(probabilities, "gram")
        parts = parts.unionByName(by_gram.groupBy("row").agg(F.sum(F.col("n") * F.col("log10p")).alias("score")), allowMissingColumns=True)
    out = parts.groupBy("row").agg(*[F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens")], *[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
