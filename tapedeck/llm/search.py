"""Ranked lexical search of documents for many items at once: hierarchies over items and over documents are walked
together, and a pair of nodes whose bound can't change any item's best is left out with all that is below it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.llm.bytewords import classes, words_of
from tapedeck.llm.common import blocks, mix, renamed, stored, word_hashes

KINDS = classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Pairs of item and term in one block of items, about 30 bytes each where they are broadcast; each block is one search.
BLOCK_TERMS = 500_000
#: Documents of a tree, of its nodes by level, and items of the nodes that meet these.
TREE, DOC_NODES, ITEM_NODES = 1024, (1024, 128, 16, 1), (64, 16, 4, 1)
#: Terms of an item, repeats included, up to which sums of scores are exact in doubles (each is below 4e10).
MOST_EXACT = 200_000


def terms(texts: DataFrame, id: str) -> DataFrame:
    """id, term, q: how often each term stands in each text."""

    def count(batches):
        for block in blocks(batches):
            w = words_of(block.column("text"), KINDS)
            pairs, n = np.unique(w.text * max(1, len(w.distinct)) + w.codes, return_counts=True)
            text, code = np.divmod(pairs, max(1, len(w.distinct)))
            yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(text)), w.distinct.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], ["id", "term", "q"])

    return texts.select(F.col(id).alias("id"), "text").mapInArrow(count, "id long, term string, q long")


@dataclass
class Node:
    """Items of one node: their largest count of each term, and the nodes below."""

    items: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    below: list[Node] = field(default_factory=list)


@dataclass
class Items:
    """A block of items: ids, the terms of all, roots of the hierarchy and the weights of terms."""

    ids: np.ndarray
    words: pa.Array
    roots: list[Node]
    exact: type
    weights: np.ndarray | None = None
    mean: tuple[int, int] = (0, 1)


def _ordered(n: int, item: np.ndarray, term: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Items in an order in which those that share terms stand together: halves along the widest direction of a sketch."""
    sketch = np.zeros((n, 32))
    signs = mix(np.arange(len(np.unique(term)) and term.max() + 1, dtype=np.uint64) + np.uint64(1)) if len(term) else np.zeros(0, np.uint64)
    for j in range(32):
        bit = ((signs >> np.uint64(j)) & np.uint64(1)).astype(np.float64) * 2 - 1
        sketch[:, j] = np.bincount(item, weights=bit[term], minlength=n)
    parts, out = [np.arange(n)], []
    while parts:
        part = parts.pop()
        if len(part) <= 2:
            out.append(part)
            continue
        x = sketch[part] - sketch[part].mean(axis=0)
        direction = np.linalg.svd(x, full_matrices=False)[2][0] if len(part) < 20_000 else x[np.argmax((x * x).sum(axis=1))]
        half = part[np.argsort(x @ direction, kind="stable")]
        parts += [half[len(half) // 2 :], half[: len(half) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _tree(n: int, item: np.ndarray, term: np.ndarray, q: np.ndarray) -> list[Node]:
    """The roots of the hierarchy over items whose terms are given row by row."""
    place = np.empty(n, np.int64)
    order = _ordered(n, item, term, q)
    place[order] = np.arange(n)
    span = int(term.max()) + 1 if len(term) else 1
    roots: dict[int, Node] = {}
    above: dict[int, Node] = {}
    for size in ITEM_NODES:
        key, which = np.unique((place[item] // size) * span + term, return_inverse=True)
        most = np.zeros(len(key), np.int64)
        np.maximum.at(most, which, q)
        group, t = np.divmod(key, span)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        level = {}
        for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            g = int(group[a])
            level[g] = Node(order[g * size : (g + 1) * size], t[a:b], most[a:b])
        if above:
            for g, node in level.items():
                above[g * size // last].below.append(node)
        else:
            roots = level
        above, last = level, size
    return list(roots.values())


class Best:
    """The k best documents of each item so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores, self.ids, self.k = np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max), k
        self.floor = floor.copy()  # what the weakest of each item's k best reaches at least

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.floor[item]))
        if not len(good):
            return
        s, d = np.concatenate([self.scores[item], scores[good].astype(np.int64)]), np.concatenate([self.ids[item], ids[good]])
        order = np.lexsort((d, -s))[: self.k]
        self.scores[item], self.ids[item] = s[order], d[order]
        self.floor[item] = max(self.floor[item], self.scores[item, -1])

    def rows(self):
        item, j = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(self.ids[item, j]), pa.array(self.scores[item, j])], ["item", "doc_id", "score"])


class Documents:
    """A tree over some documents: per level, for each term that one of them has, the highest worth in each node."""

    def __init__(self, ids, doc, term, worth, n_terms: int, exact: type):
        here, column = np.unique(term, return_inverse=True)
        self.local = np.full(n_terms, -1, np.int64)
        self.local[here] = np.arange(len(here))
        leaf = np.zeros((len(here), len(ids)), exact)
        leaf[column, doc] = worth
        self.ids, self.levels = ids, []
        for size in DOC_NODES:
            starts = np.arange(0, len(ids), size)
            self.levels.append(leaf if size == 1 else np.maximum.reduceat(leaf, starts, axis=1))

    def bounds(self, node: Node, level: int, at: np.ndarray) -> np.ndarray:
        """The most that any item of the node can score in the documents of each of these nodes; at the last level and for one item, its scores."""
        rows = self.local[node.terms]
        known = rows >= 0
        high = self.levels[level]
        high = high[rows[known]] if len(at) == high.shape[1] else high[rows[known][:, None], at]
        return node.most[known].astype(high.dtype) @ high

    def search(self, node: Node, level: int, at: np.ndarray, best: Best) -> None:
        """Score what below this pair of nodes (`at`: of the documents' level) may still be among the best."""
        bound = self.bounds(node, level, at)
        if level == len(DOC_NODES) - 1:
            best.add(int(node.items[0]), bound, self.ids[at])
            return
        keep = at[(bound > 0) & (bound >= best.floor[node.items].min())]
        if not len(keep):
            return
        ratio = DOC_NODES[level] // DOC_NODES[level + 1]
        children = (keep[:, None] * ratio + np.arange(ratio)).ravel()
        children = children[children < self.levels[level + 1].shape[1]]
        for child in node.below:
            self.search(child, level + 1, children, best)

    def promising(self, items: Items, best: Best) -> None:
        """Score for each item only the documents of the lowest inner node with the highest bound."""
        level = len(DOC_NODES) - 2
        size = DOC_NODES[level]
        every = np.arange(self.levels[level].shape[1])
        stack = list(items.roots)
        while stack:
            node = stack.pop()
            stack += node.below
            if not node.below:
                top = int(np.argmax(self.bounds(node, level, every)))
                at = np.arange(top * size, min((top + 1) * size, len(self.ids)))
                best.add(int(node.items[0]), self.bounds(node, level + 1, at), self.ids[at])


def _trees(batches, items: Items):
    """Trees over the documents of a task: those whose heaviest term is the same stand together."""
    n, length = items.mean
    for batch in batches:
        counts = np.diff(batch.column("terms").offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), counts)
        term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        m = 25 + (75 * batch.column("n").to_numpy() * n) // length
        worth = items.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        heaviest = np.zeros(batch.num_rows, np.int64)
        if len(doc):
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            heaviest[doc[starts]] = np.maximum.reduceat(items.weights[term] * len(items.weights) + term, starts)
        order = np.lexsort((batch.column("n").to_numpy(), -heaviest))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids, by = batch.column("doc_id").to_numpy()[order], np.argsort(place[doc], kind="stable")
        doc, term, worth = place[doc][by], term[by], worth[by]
        for i in range(0, len(ids), TREE):
            a, b = np.searchsorted(doc, [i, i + TREE])
            if b > a:
                yield Documents(ids[i : i + TREE], doc[a:b] - i, term[a:b], worth[a:b], len(items.weights), items.exact)


def _search(vectors: DataFrame, items: Items, k: int, floor: np.ndarray, first: bool) -> DataFrame:
    """item (its number), doc_id, score: each task's k best; of the most promising nodes alone if `first`."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, floor))

    def run(batches):
        items, floor = shared.value
        best = Best(len(items.ids), k, floor)
        for tree in _trees(batches, items):
            if first:
                tree.promising(items, best)
            else:
                for root in items.roots:
                    tree.search(root, 0, np.zeros(1, np.int64), best)
        yield best.rows()

    found = vectors.mapInArrow(run, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _vectors(docs: DataFrame, words: pa.Array) -> DataFrame:
    """doc_id, n (all its terms), terms (numbers in `words`) and tfs, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        known = shared.value
        for block in blocks(batches):
            w = words_of(block.column("text"), KINDS)
            n = np.bincount(w.text, minlength=block.num_rows)
            number = pc.fill_null(pc.index_in(w.distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
            at = np.flatnonzero(number >= 0)
            pairs, tf = np.unique(w.text[at] * max(1, len(known)) + number[at], return_counts=True)
            text, term = np.divmod(pairs, max(1, len(known)))
            some = np.flatnonzero(n)
            offsets = pa.array(np.append(np.searchsorted(text, some), len(text)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(some)), pa.array(n[some]), *[pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _block(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    """The best documents of a block of items (rows: id, term, q)."""
    ids, item = np.unique(rows["id"].to_numpy(), return_inverse=True)
    coded = rows["term"].combine_chunks().cast(pa.large_string()).dictionary_encode()
    term, q = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["q"].to_numpy()
    exact = np.float64 if np.bincount(item, weights=q).max() <= MOST_EXACT else np.int64
    items = Items(ids, coded.dictionary, _tree(len(ids), item, term, q), exact)
    vectors = stored(_vectors(docs, items.words), "vectors")
    n, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()

    def held(batches):
        df = np.zeros(len(coded.dictionary), np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    frequency = vectors.select("terms").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(coded.dictionary), np.int64)
    df[frequency["term"].to_numpy()] = frequency["df"].to_numpy()
    items.weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    items.mean = (n, length)
    # what the kth best of the most promising documents scores is a floor for all others
    weakest = _search(vectors, items, k, np.zeros(len(ids), np.int64), True).where(F.col("rank") == k).select("item", "score").toArrow()
    floor = np.zeros(len(ids), np.int64)
    floor[weakest["item"].to_numpy()] = weakest["score"].to_numpy()
    names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids))), "item_id": pa.array(ids)}))
    return _search(vectors, items, k, floor, False).join(names, "item").select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank (from 1), doc_id, score, above 0 only.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term weighs floor(1000 * ln((2 * N
    + 2) / (2 * df + 1))), and a document scores the sum over the item's terms, repeats included, of weight * (10^9 * tf
    div (1000 * tf + 8 * m)), where m = 25 + 75 * n * N div L grows with its length n; N documents hold L terms. Equal
    scores go by doc_id. Null texts have no terms; rows without id are left out; repeated documents are ranked each;
    texts of one item_id are one item; empty tables give no rows; other columns are not looked at.
    """
    docs = renamed(docs, ["doc_id", "text"]).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = renamed(items, ["item_id", "text"]).where("item_id is not null").withColumn("item_id", F.col("item_id").cast("long")).distinct()
    sought = stored(terms(items, "item_id").groupBy("id", "term").agg(F.sum("q").alias("q")), "sought")
    parts = -(-sought.count() // BLOCK_TERMS)
    out = None
    for i in range(parts):
        rows = sought.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).toArrow().sort_by([("id", "ascending"), ("term", "ascending")])
        if rows.num_rows:
            found = stored(_block(docs, rows, k), "found")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
