import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tapedeck.llm import packing
from tests.llm.fixtures import SF, awkward, frame


def direct_ids(texts):
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def plain_bfd(lengths, size):
    """One piece at a time into the tightest window: remaining capacities at the end."""
    open_windows = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, c in enumerate(open_windows) if c >= n]
        if fit:
            i = min(fit, key=lambda i: open_windows[i])
            open_windows[i] -= n
        else:
            open_windows.append(size - n)
    return Counter(open_windows)


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for size, n in ((16, 40), (100, 300), (1024, 500)):
        for _ in range(20):
            lengths = [r.choice([size, r.randint(1, size), r.randint(1, 1 + size // 10)]) for _ in range(r.randint(0, n))]
            used, seen = defaultdict(int), defaultdict(list)
            for length, lo, hi, first, fits, begin in packing.plan(Counter(lengths), size):
                for k in range(lo, hi):
                    w, at = first + (k - lo) // fits, begin + (k - lo) % fits * length
                    used[w] += length
                    seen[w].append((at, length))
            assert Counter(size - u for u in used.values()) == plain_bfd(lengths, size)
            for spans in seen.values():
                at = 0
                for start, length in sorted(spans):
                    assert start == at
                    at += length
                assert at <= size


def check(spark, rows, df, size=1024):
    got = packing.pack(df, size=size).collect()
    ids = defaultdict(list)
    for (doc, _), x in zip(rows, direct_ids([t for _, t in rows]), strict=True):
        ids[doc].append(np.array(x, "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    spans = defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n
        assert at <= size
    return spans


def test_awkward_rows(spark):
    rows = awkward() + [(20, "a  b  c　 d <|endoftext|> it's\n\n x  \t y 12 345 …  end "), (21, "tab\t x \x1f y \x85 z é ü 中文 字   w")]
    check(spark, rows, frame(spark, rows))
    check(spark, rows, frame(spark, rows), size=64)


def test_small_table_with_little_padding(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    spans = check(spark, rows, df)
    total = sum(n for s in spans.values() for _, n in s)
    assert total > 0.99 * 1024 * len(spans)


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_chunked_ids_are_the_tokenizers_ids():
    import pyarrow as pa

    r = random.Random(8)
    bits = ["a", "Word", "'s", "'ll", "'", "\n", " ", "  ", "\t", "!!", ".", "-", "|", "9", "12", "é", "ß", "中", " ", " ", "😀", "don't", "<|endoftext|>", "\x1c", "\r\n", "_", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    encoder = packing.Encoder(packing.tokenizer_path())
    want = direct_ids(texts)
    for _ in range(2):  # the second time from memory
        ids, ends = encoder.encode(pa.array(texts))
        got = [[*ids[a:b].tolist(), 0] for a, b in zip(ends, ends[1:], strict=False)]
        assert got == want
