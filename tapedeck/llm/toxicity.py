"""Toxicity by noisy-channel deobfuscation: words are restored, then the restored text is scored.

A word that may be obfuscated (leetspeak inside it, letters set apart, letters repeated) becomes a lattice of
characters; Viterbi decoding finds the likeliest word under a character trigram model. The score comes from a lexicon
of words and word beginnings that labelled texts show to be toxic, and a logistic model of how much of it a text holds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import blocks, renamed, stored, words_of

#: Labelled rows that may be broadcast (ids and labels, 16 bytes each); more are joined by a shuffle.
MOST_IDS = 1_000_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: A lexicon entry stands in so many toxic labelled texts at least, and the lower bound of its share of them is so high.
LEAST_TEXTS, LEAST_SHARE, Z = 5, 0.5, 1.645

#: Characters that stand for letters (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "%": "x", "&": "e", "*": "aeiou", "€": "e", "£": "l", "¥": "y",
}
#: Costs, in natural logarithms, of a stand-in, of dropping a mark that only sets letters apart, of dropping one that
#: may stand for a letter, of dropping a letter written twice, and one written three times or more.
STAND_IN, APART, DROPPED, TWICE, REPEATED = 1.0, 0.5, 5.0, 3.0, 0.3
#: Cost of a word's end among letters set apart, beside that of the model.
ENDS = 1.0
DOUBTFUL = r"\p{L}[^\p{L}\p{M}]+\p{L}|[0-9@$!|+(*&%#][\p{L}]|[\p{L}][0-9@$!|+(*&%#]|aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz"
OUTER = r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$"


class CharacterModel:
    """Trigrams of characters within words, backing off to bigrams and single characters."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one = Counter(counts), Counter(), Counter()
        self.before, self.last = Counter(), Counter()
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.before[g[:2]] += n
            self.last[g[1]] += n
        self.all = sum(self.one.values())
        self.costs: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        if g not in self.costs:
            p = (self.one[c] + 0.5) / (self.all + 0.5 * (len(self.one) + 1))
            p = (self.two[b + c] + 2 * p) / (self.last[b] + 2)
            p = (self.three[g] + 2 * p) / (self.before[a + b] + 2)
            self.costs[g] = -math.log(p)
        return self.costs[g]

    def restore(self, word: str) -> str:
        """The likeliest word behind an observed one. States are the last two characters; each step takes one observed
        character as itself, as a letter that it stands for, or as nothing (between letters, or repeated)."""
        return self._decoded(word, apart=False)

    def restore_run(self, letters: str) -> list[str]:
        """The likeliest words behind letters set apart: between any two of them a word may end."""
        return self._decoded(letters, apart=True).split()

    def _decoded(self, seen: str, apart: bool) -> str:
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # costs, and readings as linked characters
        for i, c in enumerate(seen):
            if apart and i:
                ends = [(cost + self.cost(s[0], s[1], "$") + ENDS, s, out) for s, (cost, out) in best.items() if s != "^^"]
                cost, _, out = min(ends, key=lambda e: e[:2], default=(math.inf, "", None))
                if "^^" not in best or cost < best["^^"][0]:
                    best["^^"] = (cost, (out, " "))
            letter = c.isalpha()
            options = [(c, 0.0 if letter else 3.0)] + [(x, STAND_IN + (1.0 if len(LEET[c]) > 2 else 0.0)) for x in LEET.get(c, "")]
            if not letter:
                options.append(("", DROPPED if c in LEET else APART))
            elif i and seen[i - 1] == c:
                options.append(("", REPEATED if seen[i - 2 : i] == c * 2 or seen[i - 1 : i + 2] == c * 3 else TWICE))
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (cost, out) in best.items():
                for x, extra in options:
                    then = state[1] + x if x else state
                    total = cost + extra + (self.cost(state[0], state[1], x) if x else 0.0)
                    if then not in new or total < new[then][0]:
                        new[then] = (total, (out, x) if x else out)
            best = new  # pairs of characters that the last marks may stand for: a bounded number
        reading = min((cost + self.cost(s[0], s[1], "$"), s) for s, (cost, _) in best.items())[1]
        out, link = [], best[reading][1]
        while link:
            link, x = link
            out.append(x)
        return "".join(reversed(out))


class Restorer:
    """Restored forms of distinct words, remembered."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[str, str] = {}

    def one(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self.model.restore(word)
        return self.known[word]

    def run(self, letters: str) -> list[str]:
        """The words behind letters set apart."""
        if len(letters) > 64:
            return self.model.restore_run(letters)
        key = f"{letters} "  # no word holds a space
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = " ".join(self.model.restore_run(letters))
        return self.known[key].split()

    def words(self, words: pa.Array) -> list[str]:
        lower = pc.utf8_lower(words)
        doubtful = pc.match_substring_regex(pc.replace_substring_regex(lower, r"[.,;:?!\"]+$", ""), DOUBTFUL).to_numpy(zero_copy_only=False)
        out = pc.replace_substring_regex(lower, OUTER, "").to_pylist()
        raw = lower.to_pylist()
        for i in np.flatnonzero(doubtful):
            core = out[i]
            # what hangs at the ends of a plain word needs no decoding; without letters there is nothing to decode
            if core and not (core.isalpha() and not _doubled(core) and not _led_in(raw[i], core)):
                out[i] = self.one(raw[i].strip(".,;:?\"'"))
        return out


def _doubled(word: str) -> bool:
    return any(a == b for a, b in zip(word, word[1:], strict=False))


def _tripled(word: str) -> bool:
    return any(a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False))


def _led_in(raw: str, core: str) -> bool:
    """Whether a stand-in, not a run of one mark, touches the letters from outside."""
    before, _, after = raw.partition(core)
    first, last = after.rstrip(".,;:?!\"')"), before.lstrip("\"'(")
    return (len(first) == 1 and first in LEET) or (len(last) == 1 and last in LEET) or (len(first) > 1 and len(set(first)) > 1) or (len(last) > 1 and len(set(last)) > 1)


def spaced_runs(words: pa.Array, codes: np.ndarray, offsets: np.ndarray):
    """(text, letters) of each run of three or more words of one character, or of one letter among punctuation."""
    cores = pc.replace_substring_regex(words, OUTER, "")
    letters = pc.if_else(pc.equal(pc.utf8_length(words), 1), words, cores)
    single = ((pc.utf8_length(letters).to_numpy(zero_copy_only=False) == 1) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) <= 3))[codes]
    if not single.any():
        return
    names = pc.utf8_lower(letters).to_pylist()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= 3:
            text = int(np.searchsorted(offsets, a, side="right")) - 1
            while a < b:  # a run doesn't go on into the next text
                end = min(b, int(offsets[text + 1]))
                if end - a >= 3:
                    yield text, "".join(names[c] for c in codes[a:end])
                a, text = end, text + 1


def features(word: str) -> list[str]:
    return [f"{word}$", *[word[:n] for n in PREFIXES if len(word) >= n]] if len(word) > 2 else []


def _trigrams(batches):
    counts: Counter = Counter()
    for b in blocks(batches):
        codes, words, _ = words_of(b.column("text"))
        n = np.bincount(codes, minlength=len(words))
        for w, k in zip(pc.replace_substring_regex(pc.utf8_lower(words), OUTER, "").to_pylist(), n.tolist(), strict=True):
            if w.isalpha() and not _tripled(w):
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    counts[w[i : i + 3]] += k
    yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


def _counted(model: CharacterModel):
    def run(batches):
        restorer, n1, n0 = Restorer(model), Counter(), Counter()
        for b in blocks(batches):
            codes, words, offsets = words_of(b.column("text"))
            of = [features(w) for w in restorer.words(words)]
            more = {}
            for t, w in spaced_runs(words, codes, offsets):
                more.setdefault(t, []).extend(f for x in restorer.run(w) for f in features(x))
            for i, toxic in enumerate(b.column("toxic").to_pylist()):
                own = {f for c in np.unique(codes[offsets[i] : offsets[i + 1]]) for f in of[c]} | set(more.get(i, ()))
                (n1 if toxic else n0).update(own)
        names = list(n1.keys() | n0.keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([n1[x] for x in names], pa.int64()), pa.array([n0[x] for x in names], pa.int64())], names=["feature", "n1", "n0"])

    return run


def evidence(restorer: Restorer, lexicon: dict[str, float], texts: pa.Array) -> np.ndarray:
    """Of each text: the weights of its toxic words in sum, their number, and the number of words."""
    codes, words, offsets = words_of(texts)

    def weight(w: str) -> float:
        return max((lexicon.get(f, 0.0) for f in features(w)), default=0.0)

    weights = np.array([weight(w) for w in restorer.words(words)])[codes] if len(words) else np.zeros(0)
    sums, hits = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights > 0))
    out = np.stack([sums[offsets[1:]] - sums[offsets[:-1]], hits[offsets[1:]] - hits[offsets[:-1]], np.diff(offsets)], axis=1).astype(float)
    for t, w in spaced_runs(words, codes, offsets):
        for x in map(weight, restorer.run(w)):
            if x > 0:
                out[t, :2] += (x, 1)
    return out


def design(e: np.ndarray) -> np.ndarray:
    """What the logistic model sees: evidence, grown slowly, and how dense it is."""
    return np.stack([np.ones(len(e)), np.log1p(e[:, 0]), np.log1p(e[:, 1]), np.log1p(100 * e[:, 1] / np.maximum(e[:, 2], 1))], axis=1)


def _newton_sums(w: np.ndarray):
    """What a step of Newton's method sums over rows of evidence: one row for a task."""

    def run(batches):
        k = len(w)
        h, g = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            x = design(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "hits", "words")], axis=1))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h += x.T @ (x * (p * (1 - p))[:, None])
            g += x.T @ (b.column("toxic").to_numpy(zero_copy_only=False) - p)
        yield pa.record_batch([pa.array([[*h.ravel(), *g]], pa.list_(pa.float64()))], names=["sums"])

    return run


def fit_logistic(rows: DataFrame, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small penalty on all but the constant, over all rows (toxic, weight, hits, words); of each round
    the driver sees the sums of tasks, added in one order whichever task ends first."""
    k = design(np.zeros((1, 3))).shape[1]
    w, pen = np.zeros(k), np.diag([1e-6, *[ridge] * (k - 1)])
    for _ in range(rounds):
        parts = rows.mapInArrow(_newton_sums(w), "sums array<double>").collect()  # k * (k + 1) numbers a task
        h, g = np.split(np.sum(np.sort(np.array([r["sums"] for r in parts]), axis=0), axis=0), [k * k])
        step = np.linalg.solve(h.reshape(k, k) + pen, g - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    characters: CharacterModel
    lexicon: dict[str, float]
    weights: np.ndarray

    def scores(self, restorer: Restorer, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(evidence(restorer, self.lexicon, texts)) @ self.weights, -30, 30)))


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def _evidence_of(characters: CharacterModel, lexicon: dict[str, float]):
    def run(batches):
        restorer = Restorer(characters)
        for b in blocks(batches):
            e = evidence(restorer, lexicon, b.column("text"))
            yield pa.record_batch([b.column("toxic"), *[pa.array(e[:, i]) for i in range(3)]], names=["toxic", "weight", "hits", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows outside fold 1: fold 0 gives the lexicon, fold 2 the weights of the logistic model."""
    known = renamed(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 1)
    ids = stored(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    few = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    texts = renamed(docs, ["doc_id", "text"]).where("text is not null").join(few, "doc_id")
    sample = stored(texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min(fold(F.col("doc_id"))).alias("fold")), "labelled")
    grams = sample.mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    characters = CharacterModel({r["gram"]: r["n"] for r in grams})
    counted = sample.where("fold = 0").mapInArrow(_counted(characters), "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n, p = F.col("n1") + F.col("n0"), F.col("n1") / (F.col("n1") + F.col("n0"))
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    found = counted.where((F.col("n1") >= LEAST_TEXTS) & (low >= LEAST_SHARE)).collect()  # only features that are mostly toxic
    lexicon = {r["feature"]: math.log((r["n1"] + 0.5) / (r["n0"] + 0.5)) for r in found}
    rows = stored(sample.where("fold = 2").mapInArrow(_evidence_of(characters, lexicon), "toxic int, weight double, hits double, words double"), "evidence")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if 0 < totals["toxic"] < totals["n"]:
        weights = fit_logistic(rows)
    else:  # no labels, or of one kind
        p = (totals["toxic"] + 0.5) / (totals["n"] + 1)
        weights = np.array([math.log(p / (1 - p)), 0.0, 0.0, 0.0])
    return Model(characters, lexicon, weights)


def _scored(model: Model):
    def run(batches):
        restorer = Restorer(model.characters)
        for b in blocks(batches):
            s = model.scores(restorer, b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (fold 1, of which no label was learnt), score and predicted (score >= THRESHOLD) of each row.

    A score depends on the text alone. Null and empty texts get the score of a text without toxic words; rows are
    scored one by one, repeated or with a null id (held_out null) as others; an empty table gives no rows.
    """
    out = renamed(docs, ["doc_id", "text"]).mapInArrow(_scored(model), "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def _clean(model: Model):
    def run(batches):
        restorer = Restorer(model.characters)
        for b in blocks(batches):
            yield b.filter(pa.array(model.scores(restorer, b.column("text")) < THRESHOLD))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more; all columns stay."""
    return docs.mapInArrow(_clean(train(docs, labels)), docs.schema)
