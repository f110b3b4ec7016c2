"""Words of many texts at once: split and numbered by Arrow's kernels, hashed once a distinct word.

A word is a chunk between white space, in lower case (simple case mapping), and for
``trimmed`` words without the ``MARKS`` around it; a chunk of marks only stays as it is.
Numbers are 64-bit hashes, the same in every task.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Punctuation that is no part of the word it stands next to.
MARKS = string.punctuation + "«»“”„‟‘’‚‹›…–—―·•¡¿§¶†‡°′″"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 19)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashes(strings: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each string's bytes; 0 for the empty string only."""
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int32, n + 1, strings.offset * 4).astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)])))
    size = np.diff(offsets)
    h = mix((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + size.astype(np.uint64))
    return np.where(size == 0, _U(0), np.where(h == 0, _U(1), h))


def plain(strings: pa.StringArray, trimmed: bool) -> pa.StringArray:
    """The words that chunks stand for."""
    low = pc.utf8_lower(strings)
    if not trimmed:
        return low
    bare = pc.utf8_trim(low, MARKS)
    return pc.if_else(pc.equal(bare, ""), low, bare)


def coded(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(number of each chunk in the distinct ones, the distinct chunks, how many chunks each text has)."""
    chunks = pc.utf8_split_whitespace(texts)
    coded_ = chunks.flatten().dictionary_encode()
    numbers, sizes = coded_.indices.to_numpy(), chunks.value_lengths().to_numpy()
    empty = np.flatnonzero(pc.equal(coded_.dictionary, "").to_numpy(zero_copy_only=False)) if len(coded_.dictionary) else ()
    if len(empty):  # white space at an end gives an empty chunk
        on = numbers != empty[0]
        text = np.repeat(np.arange(len(sizes)), sizes)[on]
        numbers, sizes = numbers[on], np.bincount(text, minlength=len(sizes))
    return numbers, coded_.dictionary, sizes


def word_hashes(texts: pa.StringArray, trimmed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, how many words each text has)."""
    numbers, distinct, sizes = coded(texts)
    return hashes(plain(distinct, trimmed))[numbers], sizes


#: What a character outside a word's core is, by code point: white space parts words, marks are trimmed. What a byte is: the same, or where such a character may begin.
_MARK, _WHITE, _LEAD = 1, 2, 3
_KIND = np.zeros(1 << 16, np.uint8)
_KIND[[ord(c) for c in MARKS]] = _MARK
_KIND[[c for c in range(1 << 16) if chr(c).isspace()]] = _WHITE
_BYTE = np.where(np.arange(256) < 128, _KIND[:256], 0).astype(np.uint8)
_BYTE[[chr(c).encode()[0] for c in np.flatnonzero(_KIND) if c >= 128]] = _LEAD


def spans(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(hash of each trimmed word, number of its line among the lines of all texts, how many lines each text has).

    The words and hashes of ``word_hashes`` over the lines between \n, without a string for each chunk.
    """
    low = pc.utf8_lower(pc.binary_join_element_wise(texts, "", "\n"))  # each text ends with a \n
    offsets = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4).astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(low) else np.zeros(0, np.uint8)
    kind = _BYTE[data]
    at = np.flatnonzero(kind == _LEAD)
    long = data[at] >= 0xE0
    for first, more in ((at[~long], 1), (at[long], 2)):
        code = data[first].astype(np.int64) & (0x1F if more == 1 else 0x0F)
        for k in range(1, more + 1):
            code = code << 6 | data[first + k] & 0x3F
        for k in range(more + 1):
            kind[first + k] = _KIND[code]
    edges = np.flatnonzero(np.diff(kind != _WHITE, prepend=False))
    begin, end = edges[::2].copy(), edges[1::2].copy()
    marked = np.flatnonzero((kind[begin] == _MARK) | (kind[end - 1] == _MARK))
    if len(marked):
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False))
        first, last = edges[::2], edges[1::2]  # of runs without marks
        a, b = np.searchsorted(last, begin[marked], "right"), np.searchsorted(first, end[marked])
        marked, a, b = marked[a < b], a[a < b], b[a < b]
        begin[marked], end[marked] = first[a], last[b - 1]
    up, down = powers(max(len(data) + 1, 1 << 21))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    stops = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(stops, offsets - offsets[0]))
    return np.where(h == 0, _U(1), h), np.searchsorted(stops, begin), count


def split_words(text: str, trimmed: bool = True) -> list[str]:
    """The same words of a single text, one by one."""
    found = []
    for chunk in text.split():
        low = pc.utf8_lower(chunk).as_py() if not chunk.isascii() else chunk.lower()
        found.append((low.strip(MARKS) or low) if trimmed else low)
    return found
