"""Vectorised word and shingle hashing of one text's UTF-8 bytes (helpers that run inside tasks).

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; these bytes never occur inside a
multi-byte UTF-8 character, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_pows = np.ones(1, dtype=np.uint64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _pows
    if len(_pows) < n:
        p = np.full(max(n, 256), _MULT, dtype=np.uint64)
        p[0] = 1
        _pows = np.cumprod(p, dtype=np.uint64)
    return _pows


_APART = np.zeros(256, dtype=bool)  # every ASCII character but letters and digits
_APART[:128] = [not chr(c).isalnum() for c in range(128)]


def word_bounds(b: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte offsets of the words of ``b`` (uint8)."""
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~apart[b]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    at = np.arange(total)
    inner = at - np.repeat(first, sizes)
    v = _BYTE[b[inner + np.repeat(starts, sizes)]] * _powers(int(sizes.max()))[inner]
    return mix64(np.add.reduceat(v, first) + sizes.astype(np.uint64) * _BYTE[7])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words; with fewer than ``k`` words, of the whole
    sequence as one; without words, none."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = mix64(words[:n] + np.uint64(k))
    for j in range(1, k):
        h = mix64(h * _MULT + words[j:n + j])
    return h


def text_words(text: bytes | None) -> np.ndarray:
    """Word hashes of a text with A-Z lower-cased; null counts as empty."""
    b = np.frombuffer((text or b"").translate(LOWER), dtype=np.uint8)
    return word_hashes(b, *word_bounds(b))


def tokens(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of a text's words without case or ASCII punctuation."""
    b = np.frombuffer(_lowered(text or b""), dtype=np.uint8)
    starts, ends = word_bounds(b, _APART)
    return word_hashes(b, starts, ends), starts, ends


def _lowered(raw: bytes) -> bytes:
    if raw.isascii():
        return raw.lower()
    low = raw.decode("utf-8", "replace").lower().encode()
    return low if len(low) == len(raw) else raw.translate(LOWER)


def many_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`tokens` of several texts at once: hashes, starts and ends in the texts joined by line feeds, then where
    each text begins there and its first word (one more than there are texts)."""
    b = np.frombuffer(b"\n".join([_lowered(t) for t in texts]), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    starts, ends = word_bounds(b, _APART)
    return word_hashes(b, starts, ends), starts, ends, begins, np.searchsorted(starts, begins)


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut 0..len(sizes) into ranges of at most ``most`` in sum, or of one."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def code_points(text: bytes) -> np.ndarray:
    """Number of code points before every byte offset, 0 to len(text)."""
    b = np.frombuffer(text, dtype=np.uint8)
    return np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes (no decoding)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        return [None] * len(col)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a partition that is clustered by ``keys`` (sorted) into one table per key; only the
    rows of the key in hand are held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Like `by_key`, many keys at a time: (table, first row of each key).  About ``rows`` rows are held, or
    those of one key."""
    held: list[pa.RecordBatch] = []
    size, wait = 0, rows

    def cuts(t: pa.Table) -> np.ndarray:
        change = np.ones(t.num_rows, dtype=bool)
        change[1:] = False
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < wait:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        first = cuts(t)
        last = int(first[-1])
        if last:
            yield t.slice(0, last), first[:-1]
        held, size = t.slice(last).to_batches(), t.num_rows - last  # its last key may go on
        wait = max(rows, 2 * size)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cuts(t)
