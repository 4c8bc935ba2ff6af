"""Phrase collocations: candidates by level as in Apriori, counted by broadcast double-array tries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.llm import trie
from tapedeck.llm.bytewords import Words, classes, hashes, words_of
from tapedeck.llm.common import ODD, blocks, mix, renamed, stored

KINDS = classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
LONGEST = 5
#: A phrase's hash sets one of 2 ** MAP_BITS bits, however many phrases there are: what is broadcast to sift candidates
#: is always 8 MB. Wrong bits let a candidate too many through, never one too few.
MAP_BITS = 26
#: Spreads the 16 bits of an owner over those of a hash.
OWNER = 2654435761
#: Candidates in one broadcast trie (at most some 100 bytes each). More of them are dealt by their first two words to tries
#: of the tasks, of about a DEALT-th as many each; the texts are read once however many they are.
PER_TRIE, DEALT = 500_000, 8
#: Bytes of text that are cut into words at once.
BLOCK = 4 << 20
#: Hashes that a task holds before it hands on their counts.
HELD = 1_000_000
#: Candidates whose counts a task hands on as one row.
PART = 256
_N = pa.int64()


def _by_lang(batches):
    """(lang, words) of the blocks of some batches (lang, text)."""
    for block in blocks(batches, limit=BLOCK):
        langs = block.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, words_of(block.column("text").filter(pa.array(which == i)), KINDS)


def _runs(w: Words, n: int) -> np.ndarray:
    """Whether the n words from each word on are of one piece."""
    out = np.zeros(len(w.codes), bool)
    if len(out) >= n:
        out[: len(out) - n + 1] = w.piece[: len(out) - n + 1] == w.piece[n - 1 :]
    return out


def _hashes(lang: str, tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """48-bit hashes of the phrases of n words from the words `at` on (tokens: the words' hashes)."""
    out = np.full(len(at), hashes(pa.array([lang]))[0] + np.uint64(n), np.uint64)
    for j in range(n):
        out = out + tokens[at + j] * ODD[j]
    return mix(out) >> np.uint64(16)


def _owners(tokens: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word a number of 16 bits that hangs on its whole text."""
    if not len(text):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    return np.repeat(mix(np.add.reduceat(tokens, starts)) >> np.uint64(48), np.diff(np.append(starts, len(text))))


def _marked(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = found & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(found: DataFrame) -> np.ndarray:
    """The bits of the hashes (h): of fixed size, whatever their number."""
    slot = F.col("h").bitwiseAND((1 << MAP_BITS) - 1)
    bits = found.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << MAP_BITS) - 1}) & 63 as int))")).alias("b"))
    rows = bits.toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f: how often each word occurs."""

    def count(batches):
        for lang, w in _by_lang(batches):
            n = np.bincount(w.codes, minlength=len(w.distinct))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), w.distinct.cast(pa.string()), pa.array(n, _N)], ["lang", "word", "f"])

    return texts.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _likely(lang: str, w: Words, maps: list[np.ndarray], lengths: list[int]):
    """n, places, hashes and owners of the phrases all of whose shorter ones are marked: maps[0] has the frequent words, maps[1] pairs."""
    tokens = hashes(w.distinct)
    # the frequent words are hashed as phrases of one word
    known = _marked(maps[0], _hashes(lang, tokens, np.arange(len(tokens)), 1))[w.codes]
    tokens = tokens[w.codes]
    owners = _owners(tokens, w.text)
    ok = _runs(w, 2)
    ok[:-1] &= known[:-1] & known[1:]
    if len(maps) > 1:
        at = np.flatnonzero(ok)
        ok[at] = _marked(maps[1], _hashes(lang, tokens, at, 2))
    for n in lengths:
        # n - 1 pairs in a row: two pairs that meet are of one piece
        good = ok.copy()
        for j in range(1, n - 1):
            good[:-j] &= ok[j:]
            good[-j:] = False
        at = np.flatnonzero(good)
        yield n, at, _hashes(lang, tokens, at, n), owners[at]


def _sums(texts: DataFrame, maps: list, lengths: list[int], least: int) -> DataFrame:
    """h, owner: the hashes of likely phrases of these lengths that occur `least` times or more, and the least owner of their texts.

    Two phrases of one hash only let a candidate too many through."""
    shared, most = texts.sparkSession.sparkContext.broadcast(maps), HELD

    def summed(held):
        """Sums of rows (hash and owner in one number, count) by hash, with the least owner."""
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.diff(key >> np.uint64(16), prepend=~key[:1]))
        return key[starts], np.add.reduceat(n, starts) if len(starts) else n

    def of_block(key):
        key = np.sort(key)
        starts = np.flatnonzero(np.diff(key >> np.uint64(16), prepend=~key[:1]))
        return key[starts], np.diff(np.append(starts, len(key)))

    def count(batches):
        held, size = [], 0
        for lang, w in _by_lang(batches):
            for _, _, h, owner in _likely(lang, w, shared.value, lengths):
                held.append(of_block((h << np.uint64(16)) | owner))
                size += len(held[-1][0])
            if size > most:
                held = [summed(held)]
                if len(held[0][0]) > most // 2:
                    yield from rows(*held.pop())
                size = sum(len(x[0]) for x in held)
        if held:
            yield from rows(*summed(held))

    def rows(key, n):
        h, owner = (key >> np.uint64(16)).view(np.int64), (key & np.uint64(0xFFFF)).astype(np.int32)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (h, n.astype(np.int64), owner)], ["h", "n", "owner"])

    sums = texts.mapInArrow(count, "h long, n long, owner int").groupBy("h").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
    return sums.where(F.col("n") >= least).select("h", "owner")


def candidates(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, phrase (words joined by a space): of 2 to LONGEST words, all shorter ones in it frequent, and it too by its hash.

    Pairs of frequent words are summed by hash first, then longer runs of frequent pairs; a last pass gives the words of
    the hashes that are left, from the texts that own them. None that occurs `least` times is missed."""

    # hashed as the tasks hash words, so that a bit that is set there is set here
    def hashed(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            which, out = langs.indices.to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.uint64)
            tokens = hashes(b.column("word"))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(which == i)
                out[at] = _hashes(lang, tokens, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])

    known = _bitmap(words.select("lang", "word").mapInArrow(hashed, "h long"))
    pairs = stored(_sums(texts, [known], [2], least), "pairs")
    maps = [known, _bitmap(pairs)]
    kept = stored(pairs.unionByName(_sums(texts, maps, list(range(3, LONGEST + 1)), least)), "kept")
    owned = kept.select(F.col("h").bitwiseXOR(F.col("owner").cast("long") * OWNER).alias("h"))
    shared, most = texts.sparkSession.sparkContext.broadcast((maps, [_bitmap(kept), _bitmap(owned)])), HELD

    def spelt(batches):
        seen = np.zeros(0, np.uint64)
        for lang, w in _by_lang(batches):
            maps, wanted = shared.value
            fresh = []
            for n, at, h, owner in _likely(lang, w, maps, list(range(2, LONGEST + 1))):
                good = np.flatnonzero(_marked(wanted[0], h))
                good = good[_marked(wanted[1], h[good] ^ (owner[good] * np.uint64(OWNER)))]
                h, first = np.unique(h[good], return_index=True)
                new = np.flatnonzero(seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h) if len(seen) else np.arange(len(h))
                h, at = h[new], at[good][first[new]]
                fresh.append(h)
                parts = [w.distinct.take(pa.array(w.codes[at + j])) for j in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrase, pa.array(h.view(np.int64))], ["lang", "phrase", "h"])
            seen = np.sort(np.concatenate([seen, *fresh])) if len(seen) < most else seen

    # a few texts spell each phrase; one of each goes on
    return texts.mapInArrow(spelt, "lang string, phrase string, h long").distinct().join(kept, "h", "left_semi").select("lang", "phrase").distinct()


def _trie_of(found: pa.Table) -> tuple[pa.Array, trie.Trie]:
    """The words of a trie (the languages first among them) and the trie of lang, then words, of each candidate in order."""
    phrases = pc.split_pattern(found["phrase"].combine_chunks().cast(pa.large_string()), " ")
    flat, parent = pc.list_flatten(phrases), pc.list_parent_indices(phrases).to_numpy(zero_copy_only=False)
    langs = found["lang"].combine_chunks().cast(pa.large_string())
    marked = pc.binary_join_element_wise(langs, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))  # no word ends in a space
    coded = pa.concat_arrays([marked, flat]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.full((len(langs), LONGEST + 1), -1, np.int64)
    rows[:, 0] = codes[: len(langs)]
    starts = np.searchsorted(parent, np.arange(len(langs)))
    rows[parent, 1 + np.arange(len(parent)) - starts[parent]] = codes[len(langs) :]
    return coded.dictionary, trie.build(rows, len(coded.dictionary))


def _counted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a: all places of each candidate, from one trie. All positions of a block advance word by word at once."""
    spark = texts.sparkSession
    table = found.toArrow().sort_by([("lang", "ascending"), ("phrase", "ascending")])  # PER_TRIE rows and a few at most
    shared = spark.sparkContext.broadcast(_trie_of(table))

    def count(batches):
        words, t = shared.value
        n = np.zeros(t.n_rows, np.int64)
        for lang, w in _by_lang(batches):
            codes = pc.fill_null(pc.index_in(w.distinct, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
            root = pc.index_in(pa.scalar(f"{lang} ", pa.large_string()), value_set=words).as_py()
            at = np.arange(len(codes) if root is not None else 0)
            _, state = t.step(np.zeros(1, np.int64), np.array([-1 if root is None else root]))
            states = np.repeat(state, len(at)) if len(state) else at[:0]
            for j in range(LONGEST):
                inside = np.flatnonzero((at + j < len(codes)) & (w.piece[np.minimum(at + j, len(codes) - 1)] == w.piece[at])) if j else np.arange(len(at))
                at, states = at[inside], states[inside]
                on, states = t.step(states, codes[at + j])
                at = at[on]
                rows = t.accept[states]
                n += np.bincount(rows[rows >= 0], minlength=t.n_rows)
        parts = np.add.reduceat(n, np.arange(0, len(n), PART)).nonzero()[0] if len(n) else np.zeros(0, np.int64)
        padded = np.append(n, np.zeros(-len(n) % PART, np.int64)).reshape(-1, PART)
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(padded[some].ravel()), PART).cast(pa.list_(_N))], ["part", "counts"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").flatten().to_numpy().reshape(-1, PART), strict=True):
                sums[part] = sums.get(part, 0) + counts
        for part, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part * PART + at), pa.array(counts[at])], ["row", "a"])

    numbered = spark.createDataFrame(table.append_column("row", pa.array(np.arange(table.num_rows))))
    # the vectors of counts of all shards of the texts, added up part by part as they come in
    counts = texts.mapInArrow(count, "part long, counts array<long>").repartition("part").mapInArrow(summed, "row long, a long")
    return numbered.join(counts, "row").select("lang", "phrase", "a")


def _keyed(batches):
    """Of candidates (lang, phrase): key (the hash of the first two words), lang, phrase, n (0), h (the hash of all words)."""
    for b in batches:
        phrases = pc.split_pattern(b.column("phrase").cast(pa.large_string()), " ")
        length = pc.list_value_length(phrases).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = hashes(pc.list_flatten(phrases))
        starts = np.cumsum(length) - length
        langs = b.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        key, h = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = which == i
            key[own] = _hashes(lang, tokens, starts[own], 2)
            for n in range(2, LONGEST + 1):
                some = own & (length == n)
                h[some] = _hashes(lang, tokens, starts[some], n)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("lang"), b.column("phrase"), pa.array(np.zeros(b.num_rows, np.int64)), pa.array(h.view(np.int64))], ["key", "lang", "phrase", "n", "h"])


def _places(shared):
    """Of texts: at each place where a candidate may begin, the longest phrase that may be one, with its number of places (key, lang, phrase, n)."""
    most = HELD

    def summed(held):
        return pa.concat_tables(held).group_by(["key", "lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["key", "lang", "phrase", "n"])

    def run(batches):
        held = []
        for lang, w in _by_lang(batches):
            tokens, bits = hashes(w.distinct)[w.codes], shared.value
            at = np.flatnonzero(_runs(w, 2))
            key = _hashes(lang, tokens, at, 2)
            some = _marked(bits, key)
            at, key = at[some], key[some]
            longest = np.full(len(at), 2)
            for n in range(3, LONGEST + 1):
                inside = np.flatnonzero(_runs(w, n)[at])
                longest[inside[_marked(bits, _hashes(lang, tokens, at[inside], n))]] = n
            for n in range(2, LONGEST + 1):
                own = np.flatnonzero(longest == n)
                parts = [w.distinct.take(pa.array(w.codes[at[own] + j])) for j in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).dictionary_encode()
                which, first, count = np.unique(phrase.indices.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
                words = phrase.dictionary.take(pa.array(which)).cast(pa.string())
                held.append(pa.table([pa.array(key[own][first].view(np.int64)), pa.array([lang] * len(which), pa.string()), words, pa.array(count.astype(np.int64))], names=["key", "lang", "phrase", "n"]))
            if sum(t.num_rows for t in held) > most:
                held = [summed(held)]
                if held[0].num_rows > most // 2:
                    yield from held.pop().to_batches(max_chunksize=100_000)
        if held:
            yield from summed(held).to_batches(max_chunksize=100_000)

    return run


def _count_part(batches):
    """lang, phrase, a of a part of the candidates (rows whose n is 0; they come first), from the phrases at its places and one trie."""
    own, held, words, t, n = [], [], None, None, None

    def walk(table):
        phrases = pc.split_pattern(table["phrase"].combine_chunks().cast(pa.large_string()), " ")
        length = pc.list_value_length(phrases).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, many = np.cumsum(length) - length, table["n"].to_numpy()
        langs = pc.binary_join_element_wise(table["lang"].combine_chunks().cast(pa.large_string()), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        codes, root = (pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_flatten(phrases), langs))
        at, states = t.step(np.zeros(len(root), np.int64), root)
        for j in range(LONGEST):
            inside = np.flatnonzero(length[at] > j)
            at, states = at[inside], states[inside]
            on, states = t.step(states, codes[starts[at] + j])
            at = at[on]
            rows = t.accept[states]
            np.add.at(n, rows[rows >= 0], many[at[rows >= 0]])

    for b in batches:
        table = pa.Table.from_batches([b])
        fresh = int(np.searchsorted(b.column("n").to_numpy(), 0, side="right"))
        if fresh:
            own.append(table.slice(0, fresh))
        if fresh == b.num_rows or not own:
            continue
        if t is None:
            own = [pa.concat_tables(own).sort_by([("lang", "ascending"), ("phrase", "ascending")])]
            words, t = _trie_of(own[0])
            n = np.zeros(t.n_rows, np.int64)
        held.append(table.slice(fresh))
        if sum(x.num_rows for x in held) > HELD // 4:
            walk(pa.concat_tables(held))
            held = []
    if held:
        walk(pa.concat_tables(held))
    if t is not None:
        found = pa.table([own[0]["lang"].combine_chunks(), own[0]["phrase"].combine_chunks(), pa.array(n)], names=["lang", "phrase", "a"])
        yield from found.filter(pa.array(n > 0)).to_batches(max_chunksize=100_000)


def _dealt(texts: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """lang, phrase, a: all places of each candidate. Candidates and places meet by their first two words, in tries of the tasks."""
    spark = texts.sparkSession
    own = stored(found.mapInArrow(_keyed, "key long, lang string, phrase string, n long, h long"), "keyed")
    shared = spark.sparkContext.broadcast(_bitmap(own.select("h").unionByName(own.select(F.col("key").alias("h")))))
    places = texts.mapInArrow(_places(shared), "key long, lang string, phrase string, n long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number * DEALT // PER_TRIE))
    met = own.drop("h").unionByName(places).repartition(parts, "key").sortWithinPartitions("n")
    return met.mapInArrow(_count_part, "lang string, phrase string, a long")


def phrase_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a of candidates: from one broadcast trie, or from tries of the tasks if they are too many for it."""
    found = stored(found, "candidates")
    number = found.count()
    return stored(_counted(texts, found) if number <= PER_TRIE else _dealt(texts, found, number), "counted")


def collocations(docs: DataFrame, *, least: int = 100, top: int | None = 2000) -> DataFrame:
    """The phrases of 2 to LONGEST words of each language whose words go together most: lang, rank, phrase, a, l, r, n, score.

    Takes text and lang of docs (null text: empty, null lang: und). Texts are lower-cased (A-Z), cut into pieces at
    `.,;:!?` and line ends, and those into words at spaces and tabs. A phrase occurs `least` times or more (a). Its score
    is floor(1000 * a * n / (l * r)) for the cut into two parts (of l and r occurrences) where that is lowest, the first
    such; n counts the language's words. A phrase goes that always occurs inside a longer one. Ordered by score, a, phrase;
    the first `top` of each language, or all for None. Repeated rows count as often as they stand; empty tables give no
    rows; other columns are not looked at.
    """
    texts = renamed(docs, ["lang", "text"]).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    words = stored(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    phrases = stored(phrase_counts(texts, candidates(texts, frequent, least)).where(F.col("a") >= least), "phrases")
    counts = frequent.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))

    split = phrases.withColumn("w", F.split("phrase", " "))
    cut = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cut = cut.select("lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    cut = cut.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    product = (wide["a"] * wide["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    cut = cut.withColumn("score", F.call_function("div", product, (wide["l"] * wide["r"]).cast("decimal(38,0)")))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")

    places = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    inside = split.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(places)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = whole.withColumn("rank", rank)
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
