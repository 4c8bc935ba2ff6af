import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapedeck.llm import collocations, trie
from tapedeck.llm.bytewords import words_of
from tests.llm.fixtures import awkward, frame


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least, top=2000):
    """All phrases by plain counting: rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [x for x in f if x[0] == lang and len(x) > len(w) + 1 and f[x] >= a and f[x] >= least and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1))]
        if longer:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    return {(lang, i + 1, p.decode(), a, left, right, total, -score) for lang, x in out.items() for i, (score, _, p, a, left, right, total) in enumerate(sorted(x)[:top])}


def some_texts(seed=0, n=60):
    r = random.Random(seed)
    words = ["of", "The", "THE", "new", "york", "É", "été", "x" * 50, "a\x0bb", "日本", "in"]
    return [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", "\n", "!"]) for _ in range(r.randint(0, 80)))) for _ in range(n)]


def got(spark, rows, least, **how):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as word", "3 as h", "4 as a")
    return {tuple(r) for r in collocations.collocations(df, least=least, **how).collect()}


def test_against_brute_force(spark):
    rows = [*some_texts(), ("en", None), ("en", ""), (None, " \t\n"), ("de", "one"), ("en", "new york. new york, new york " * 30), *[("en", "in the new york in the")] * 5]
    for least, top in ((3, 2000), (8, 2000), (3, 4)):
        want = brute(rows, least, top)
        assert want and got(spark, rows, least, top=top) == want


def test_several_tries_and_flushes(spark, monkeypatch):
    rows = some_texts(1)
    want = brute(rows, 3)
    monkeypatch.setattr(collocations, "PER_TRIE", 20)
    monkeypatch.setattr(collocations, "HELD", 50)
    assert got(spark, rows, 3) == want


def test_texts_are_counted_in_one_pass_whatever_the_candidates(spark, monkeypatch):
    """The passes over the texts don't grow with the number of candidates, and the rows are the same."""
    rows = some_texts(3)
    passes, real = [], type(spark.range(0)).mapInArrow

    def counted(self, f, schema, *a, **b):
        if self.columns == ["lang", "text"]:
            passes.append(f)
        return real(self, f, schema, *a, **b)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    wanted, seen = brute(rows, 3), []
    for most in (10**6, 20):
        monkeypatch.setattr(collocations, "PER_TRIE", most)
        passes.clear()
        assert got(spark, rows, 3) == wanted
        seen.append(len(passes))
    assert seen[0] == seen[1]


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = some_texts(2)
    monkeypatch.setattr(collocations, "MAP_BITS", 6)
    assert got(spark, rows, 3) == brute(rows, 3)


def test_awkward_and_empty_tables(spark):
    docs = frame(spark, awkward())
    rows = [("en", t) for _, t in awkward()]
    assert {tuple(r) for r in collocations.collocations(docs, least=5).collect()} == brute(rows, 5)
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_trie_accepts_its_rows_only(seed):
    r = np.random.default_rng(seed)
    n_words = [3, 40, 500, 3000][seed]
    rows = {tuple(r.integers(0, n_words, k)) for k in r.integers(1, 6, 3000)} | {(0, i) for i in range(n_words)}
    made = np.full((len(rows), 5), -1, np.int64)
    for i, x in enumerate(sorted(rows)):
        made[i, : len(x)] = x
    t = trie.build(made, n_words)
    number = {x: i for i, x in enumerate(sorted(rows))}
    text = r.integers(-1, n_words, 4000)
    want = {(i, k, number[tuple(text[i : i + k])]) for i in range(4000) for k in range(1, 6) if i + k <= 4000 and tuple(text[i : i + k]) in number}
    at, states, found = np.arange(4000), np.zeros(4000, np.int64), set()
    for k in range(5):
        inside = at + k < 4000
        at, states = at[inside], states[inside]
        on, states = t.step(states, text[at + k])
        at = at[on]
        found |= {(int(i), k + 1, int(a)) for i, a in zip(at, t.accept[states], strict=True) if a >= 0}
    assert found == want


def test_words_of_slices():
    texts = pa.array(["a", "b c", None, "", "Dé.e", ".f", "g"])
    for a in (texts, pa.concat_arrays([pa.array(["skip me"]), texts]).slice(1)):
        w = words_of(a, collocations.KINDS)
        assert w.distinct.take(pa.array(w.codes)).to_pylist() == ["a", "b", "c", "dé", "e", "f", "g"]
        assert w.text.tolist() == [0, 1, 1, 4, 4, 5, 6]
        assert len(set(w.piece.tolist())) == 6 and w.piece[1] == w.piece[2]
