"""Word-shingle sets of whole texts as 64-bit hashes, computed on Arrow buffers with numpy, a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: A longer text is hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 22

_rng = np.random.default_rng(20240611)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of data of about PIECE_BYTES that end after a blank: memory follows the longest word, not the longest text."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data):
            blank = np.flatnonzero(_SPACE[data[end : end + PIECE_BYTES]])
            if len(blank):
                end += int(blank[0]) + 1
                break
            end = min(len(data), end + PIECE_BYTES)
        yield at, end
        at = end


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z folded) and its document, for documents that begin at starts in data."""
    if len(data) <= PIECE_BYTES:
        return _words(data, starts)
    found = []
    for a, b in pieces(data):
        first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        last = int(np.searchsorted(starts, b))
        word, doc = _words(data[a:b], np.maximum(starts[first:last] - a, 0))
        found.append((word, doc + first))
    return np.concatenate([w for w, _ in found]), np.concatenate([d for _, d in found])


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[data]
    first = ~space
    after = np.concatenate([[True], space[:-1]])
    inner = starts[(starts > 0) & (starts < len(data))]
    after[inner] = True
    first &= after
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _power(len(data) + 1)
    value = _BYTE[_FOLD[data]] * up[: len(data)]
    value[space] = 0
    value[: at[0]] = 0
    sums = np.add.reduceat(value, at)
    ends = np.add.reduceat((~space).astype(np.int64), at)
    doc = np.searchsorted(starts, at, "right") - 1
    return mix64(sums * down[at] + ends.astype(np.uint64) * _PLACE[3]), doc


def sets(data: np.ndarray, starts: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by document and hash, and the document of each; fewer words than width are one shingle."""
    word, doc = words(data, starts)
    n = len(word)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = np.bincount(doc, minlength=len(starts))
    full = max(0, n - width + 1)
    sums = np.zeros(full, np.uint64)
    for k in range(width):
        sums += word[k : k + full] * _PLACE[k]
    same = doc[:full] == doc[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
    shingle, owner = mix64(sums[same]), doc[:full][same]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(doc, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            whole[more] += word[begin[more] + k] * _PLACE[4 + k % 4]
        shingle = np.concatenate([shingle, mix64(whole + np.uint64(0x5851F42D4C957F2D))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of its documents): runs of rows of about SLICE_BYTES; nulls are empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at:end] - offsets[at]
        at = end


def starts_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have elements, and where each one's begin; owner is sorted."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    return owner[begin], begin
