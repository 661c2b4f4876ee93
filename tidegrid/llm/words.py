"""Cutting many texts into words at once: whole-array boundary detection on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of text that are cut at once; bounds the memory of a worker, not the result.
SLICE_BYTES = 4 << 20
_classes: dict[int, int] = {}


def char_class(c: int) -> int:
    """White space, letter, number or other, by the Unicode properties of one code point."""
    if c not in _classes:
        _classes[c] = _classify(chr(c))
    return _classes[c]


try:  # the newer tables, where they are installed
    import regex

    def _classify(s: str) -> int:
        return SPACE if regex.match(r"\s", s) else LETTER if regex.match(r"\p{L}", s) else NUMBER if regex.match(r"\p{N}", s) else OTHER

except ImportError:
    import unicodedata

    def _classify(s: str) -> int:
        kind = unicodedata.category(s)
        space = kind[0] == "Z" or 9 <= ord(s) <= 13 or ord(s) == 0x85
        return SPACE if space else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER


_ASCII = np.array([char_class(c) for c in range(128)] + [OTHER] * 128, dtype=np.uint8)


def decode_leads(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first byte of every character beyond ASCII, and the code points."""
    at = np.flatnonzero(b >= 0xC0)
    lead = b[at].astype(np.int64)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | (b[at[more] + k] & 0x3F)
    return at, code


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    k = _ASCII[b]
    at, code = decode_leads(b)
    if len(at):
        values, inverse = np.unique(code, return_inverse=True)
        kinds = np.array([char_class(int(v)) for v in values], dtype=np.uint8)[inverse]
        size = 1 + (b[at] >= 0xC0) + (b[at] >= 0xE0) + (b[at] >= 0xF0)
        for j in range(4):
            more = size > j
            k[at[more] + j] = kinds[more]
    return k


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Buffer]]:
    """(offsets, bytes, buffer) of stretches of texts, each of about ``limit`` bytes or one longer text; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        a, z = int(offsets[at]), int(offsets[to])
        yield offsets[at : to + 1] - a, raw[a:z], pa.py_buffer(raw[a:z])
        at = to


def run_starts(k: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a run of one class begins; a text always begins one."""
    begin = np.empty(len(k), dtype=bool)
    begin[:1] = True
    np.not_equal(k[1:], k[:-1], out=begin[1:])
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return begin


def gpt_word_starts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pre-split words of byte-level BPE begin.

    The words are those of the public pattern of contractions, letters, numbers and other signs, each with at most one
    blank before it, and of the remaining white space.
    """
    n = len(b)
    if not n:
        return np.zeros(0, dtype=np.int64)
    k = byte_classes(b)
    start = run_starts(k, offsets)
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    kind = k[runs]
    text_end = np.zeros(n + 1, dtype=bool)
    text_end[offsets] = True
    # white space before something else of the same text: its last character stands alone or goes to what follows
    white = (kind == SPACE) & ~text_end[ends]
    w_start, w_end = runs[white], ends[white]
    last = w_end - 1
    for _ in range(3):
        last = np.where((b[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    blank = b[last] == 0x20
    start[w_end[blank]] = False
    # contractions: an apostrophe that begins a word and is followed by certain letters
    quote = runs[(kind == OTHER) & (ends - runs == 1) & (b[runs] == 0x27)]
    quote = quote[(quote + 1 < n)]
    before = np.where(quote > 0, b[quote - 1], 0)
    quote = quote[~((before == 0x20) & ~text_end[quote]) & ~text_end[quote + 1]]
    if len(quote):
        end_of_run = ends[np.searchsorted(runs, quote + 1)]
        one = b[quote + 1]
        two = np.where(quote + 2 < end_of_run, b[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)), 1, 0)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(pair, 2, size)
        size = np.where(k[quote + 1] == LETTER, size, 0)
        hit = size > 0
        start[quote[hit] + 1] = False
        after = quote[hit] + 1 + size[hit]
        inside = after < end_of_run[hit]
        start[after[inside]] = True
    return np.flatnonzero(start)


def encode_words(starts: np.ndarray, n: int, buffer: pa.Buffer) -> pa.DictionaryArray:
    """The words that begin at ``starts`` as a dictionary array, without copying the text."""
    offsets = pa.py_buffer(np.append(starts, n).astype(np.int32))
    return pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, buffer]))
