"""Packing of tokenised documents into sequences by best-fit decreasing.

Documents are cut into full windows and a rest. There are at most SEQUENCE different lengths, so the packing itself
needs only how many pieces have each length: a segment tree over remaining capacities finds the tightest open window,
and equal pieces are placed together. Its plan says, by length and rank, where each piece goes; pieces get their rank
in parallel.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapedeck.llm.common import blocks, renamed, stored

SEQUENCE = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens of byte-level BPE (a fixed value of the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct chunks whose ids a task remembers.
REMEMBERED = 300_000
PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

# Where a pre-token surely begins: at a space before a character that is surely no white space; between a letter and
# punctuation other than the apostrophe; around a lone line feed between such characters.
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = True
_FOLLOWS[0xC3:] = True
_FOLLOWS[0xE1:0xE4] = False
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_PUNCT = np.array([0x21 <= c < 0x7F and not chr(c).isalnum() and c != 0x27 for c in range(256)])


def safe_cuts(buf: np.ndarray) -> np.ndarray:
    """A mask of the bytes before which text can be cut without changing its ids."""
    cut = np.zeros(len(buf), bool)
    before, here = buf[:-1], buf[1:]
    cut[:-1] = (before == 0x20) & _FOLLOWS[here]
    cut[1:] |= (_LETTER[before] & _PUNCT[here]) | (_PUNCT[before] & _LETTER[here])
    lone = np.flatnonzero((buf[1:-1] == 0x0A) & _FOLLOWS[buf[:-2]] & _FOLLOWS[buf[2:]] & (buf[:-2] < 0x80)) + 1
    cut[lone] = True
    cut[lone + 1] = True
    return cut


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: its own if printable, else the next beyond 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoding(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, whose ids are the same and which takes a fraction of the time."""
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    base = [vocab[c] for c in letters]
    if max(base) > min(merged):
        raise ValueError(f"{path}: single bytes don't come before merges")
    ordinary = {*base, *merged}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i in ordinary}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts; each distinct chunk between safe cuts is encoded once and remembered."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        [self.feed] = self._ids("\n")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, "<u4"), 0
        self.begins = np.zeros(REMEMBERED * 2, np.int32)
        self.sizes = np.zeros(REMEMBERED * 2, np.int32)

    def _add(self, chunks: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(chunks), len(self.known)
        while k + n > len(self.sizes):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[k : k + n] = sizes
        self.begins[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(chunks, range(k, k + n), strict=True))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks: most of them many at a time, as lines, for a line feed's id then ends each."""
        lines, others = [], []
        for c in chunks:
            starts = _FOLLOWS[c[0]] or (c[0] == 0x20 and len(c) > 1 and _FOLLOWS[c[1]])
            (lines if starts and b"\n" not in c and not c.decode()[-1].isspace() else others).append(c)
        for i in range(0, len(lines), 4096):
            part = lines[i : i + 4096]
            ids = self._ids(b"\n".join([*part, b""]).decode())
            feeds = np.flatnonzero(ids == self.feed)
            self._add(part, np.diff(feeds, prepend=-1) - 1, ids[ids != self.feed])
        for c in others:
            ids = self._ids(c.decode())
            self._add([c], np.array([len(ids)]), ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last ends."""
        texts = texts.cast(pa.large_binary())
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data = b"".join(texts.to_pylist())
        if not data:
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        cut = np.ones(len(data) + 1, bool)
        cut[:-1] = safe_cuts(np.frombuffer(data, np.uint8))
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        self._learn([c for c in names if c not in self.known])
        own = np.fromiter((self.known[c] for c in names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[own]
        at = np.cumsum(n, dtype=np.int64)
        token_ends = np.concatenate([[0], at])
        step = np.repeat((self.begins[own] - (at - n)).astype(np.int64), n)
        step += np.arange(len(step))
        return self.flat[step], token_ends[np.searchsorted(cuts, ends)]


def _pieces(path: str, size: int):
    def run(batches):
        encoder = None
        for b in blocks(batches):
            encoder = encoder or Encoder(path)
            ids, ends = encoder.encode(b.column("text").fill_null(""))
            rows = []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                own = np.concatenate([ids[ends[i] : ends[i + 1]], np.zeros(1, "<u4")]).astype("<u4")
                for start in range(0, len(own), size):
                    piece = own[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=PIECES.names)

    return run


class Capacities:
    """A segment tree over remaining capacities 0 .. size: how many open windows have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += windows
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open window that is at least `least`."""
        i = least + self.leaves
        if self.tree[i]:
            return least
        while i > 1 and (i & 1 or not self.tree[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces: rows (length, first rank, end rank, first window, pieces a window takes, offset).

    Piece r of a row's length, first rank <= r < end rank, lies in window first + (r - first rank) // pieces, at
    offset + (r - first rank) % pieces * length.
    """
    tree, open_windows, opened, out = Capacities(size), {}, 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                fits = size // length
                first, windows, capacity = opened, -(-left // fits), size
                opened += windows
            else:
                # with no tighter window open, the same one stays the tightest until the next piece doesn't fit
                fits = capacity // length
                first, there = open_windows[capacity].pop()
                windows = min(there, -(-left // fits))
                if there > windows:
                    open_windows[capacity].append((first + windows, there - windows))
                tree.add(capacity, -windows)
            placed = min(left, windows * fits)
            out.append((length, rank, rank + placed, first, fits, size - capacity))
            full, last = divmod(placed, fits)
            for start, n, used in ((first, full, fits), (first + full, 1 if last else 0, last)):
                if n and (rest := capacity - used * length):
                    open_windows.setdefault(rest, []).append((start, n))
                    tree.add(rest, n)
            rank, left = rank + placed, left - placed
    return out


def pack(docs: DataFrame, *, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids (null: none) and id 0; longer ones are cut into full windows and a rest. Each id lies
    in one piece. Repeated rows are packed each; a null doc_id stays null; other columns are not looked at; an empty
    table gives no pieces.
    """
    spark: SparkSession = docs.sparkSession
    cut = renamed(docs, ["doc_id", "text"]).mapInArrow(_pieces(tokenizer or tokenizer_path(), size), PIECES)
    pieces = stored(cut, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    rows = plan(counts, size)
    salts = 16 + max(counts.values(), default=0) // 200_000
    ranked = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    group = Window.partitionBy("length", "salt")
    ranked = ranked.withColumn("r", F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.select("length", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).alias("salt")).groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    schema = "p_length long, lo long, hi long, first long, fits long, begin long"
    placed = ranked.join(F.broadcast(spark.createDataFrame(rows, schema)), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        *PIECES.names,
        (F.col("first") + F.expr("(rank - lo) div fits")).alias("sequence_id"),
        (F.col("begin") + F.pmod(F.col("rank") - F.col("lo"), F.col("fits")) * F.col("length")).alias("offset"),
    )
