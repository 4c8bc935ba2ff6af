import math
import random
import re
from collections import Counter

import numpy as np

from tapedeck.llm import search
from tests.llm.fixtures import SF, awkward, frame


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for i in {i for i, _ in items if i is not None}:
        q = Counter(t for j, text in set(items) if j == i for t in terms(text))
        scored = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(q[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            scored += [(-s, d)] if s > 0 else []
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def got(spark, docs, items, **how):
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as rank", "3 as doc_id")
    return {tuple(r) for r in search.best_documents(frame(spark, docs), items, **how).select("item_id", "rank", "doc_id", "score").collect()}


def some(seed, n, longest, words=300):
    r = random.Random(seed)
    return [(i, " ".join(f"w{int(words * r.random() ** 3)}" for _ in range(r.randint(1, longest)))) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    docs = [*some(1, 400, 60), *[(1000 + i, "W1 w2-w3, w299") for i in range(30)], *[(2000, f"{t} é É") if t else (2001, t) for _, t in awkward()]]
    items = [*some(2, 70, 30), (500, None), (501, ""), (502, "nowhere"), (503, "w299 w299 w3"), (503, "w299 w299 w3"), (504, "É"), (None, "w1"), (505, "w1 " * 3000)]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, k=3) == brute(docs, items, 3)
    monkeypatch.setattr(search, "BLOCK_TERMS", 500)
    assert got(spark, docs, items) == want


def test_sums_beyond_doubles(spark, monkeypatch):
    docs, items = some(3, 60, 40), some(4, 5, 30)
    monkeypatch.setattr(search, "MOST_EXACT", 0)
    assert got(spark, docs, items) == brute(docs, items)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    n, n_terms, n_items = 3000, 2000, 90
    # 30 topics of terms; documents of one stand together, items don't
    of_topic = n_terms // 30
    item = np.repeat(np.arange(n_items), 20)
    pairs = np.unique(item * n_terms + (item % 30) * of_topic + r.integers(0, of_topic, len(item)))
    item, term = np.divmod(pairs, n_terms)
    q = r.integers(1, 4, len(pairs))
    doc = np.repeat(np.arange(n), 30)
    doc = np.unique(doc * n_terms + (doc * 30 // n) * of_topic + (of_topic * r.random(len(doc)) ** 2).astype(int))
    doc, at = np.divmod(doc, n_terms)
    worth = r.integers(1, 1000, len(at)) * (at + 1)
    roots = search._tree(n_items, item, term, q)
    seen = sorted(int(i) for root in roots for i in root.items)
    assert seen == list(range(n_items))
    best = search.Best(n_items, 10, np.zeros(n_items, np.int64))
    scored = []
    for i in range(0, n, search.TREE):
        a, b = np.searchsorted(doc, [i, i + search.TREE])
        tree = search.Documents(np.arange(n)[i : i + search.TREE], doc[a:b] - i, at[a:b], worth[a:b], n_terms, np.float64)
        add = best.add
        best.add = lambda k, s, ids, add=add: (scored.append(len(s)), add(k, s, ids))[1]
        for root in roots:
            tree.search(root, 0, np.zeros(1, np.int64), best)
        best.add = add
    dense, queries = np.zeros((n, n_terms), np.int64), np.zeros((n_items, n_terms), np.int64)
    dense[doc, at], queries[item, term] = worth, q
    whole = queries @ dense.T
    for i in range(n_items):
        want = sorted((-s, d) for d, s in enumerate(whole[i]) if s > 0)[:10]
        assert [(-s, d) for s, d in zip(best.scores[i], best.ids[i], strict=True) if s > 0] == want
    assert sum(scored) < 0.2 * n * n_items


def test_empty_tables_and_given_tables(spark):
    assert got(spark, [], some(5, 3, 4)) == set()
    assert got(spark, some(5, 3, 4), []) == set()
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(spark, docs, items) == brute(docs, items)
