"""Words of Arrow text columns by classes of bytes: which bytes make words, which end a piece of text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, SPACE, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def classes(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte: bytes of neither argument, those of all other characters among them, make words."""
    out = np.full(256, WORD, np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


@dataclass
class Words:
    """The words of some texts in order, A-Z lower-cased: codes into `distinct`, the text of each and its piece (numbered over all texts)."""

    codes: np.ndarray
    distinct: pa.Array
    text: np.ndarray
    piece: np.ndarray


def words_of(texts: pa.Array, kinds: np.ndarray) -> Words:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends_at[0] : ends_at[-1]]
    bounds = ends_at - ends_at[0]
    kind = kinds[data]
    inside = kind == WORD
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    # where one text ends in a word and the next begins with one
    cuts = bounds[(bounds > 0) & (bounds < len(data)) & (np.diff(bounds, prepend=-1) > 0)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts, ends = (np.insert(e, np.searchsorted(e, cuts), cuts) for e in (edges[::2], edges[1::2]))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _LOWER[data[inside]]
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    breaks = np.cumsum(kind == BREAK, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, text, breaks + text.astype(np.int64))


#: For hashes: a random 64-bit number for each byte at each of 64 places.
_PLACES = np.random.default_rng(64).integers(0, 1 << 64, (64, 256), np.uint64)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: the sums of their bytes' numbers by place."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    of_byte = _PLACES[place & 63, data]
    if len(lengths) and lengths.max() > 64:
        of_byte = of_byte * (2 * (place >> 6) + 1).astype(np.uint64)
    out = np.zeros(len(words), np.uint64)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(of_byte, (offsets[:-1] - offsets[0])[some])
    return out
