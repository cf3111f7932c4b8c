"""numpy kernels over Arrow text columns: words, word n-grams and character n-grams as 64-bit hashes.

Every kernel works on a *slice*: a run of whole documents whose UTF-8 bytes lie next to each other.
Slices are cut by bytes, not by rows, so memory is bounded by SLICE_BYTES or one single document.
A null text is the empty text here; callers that must tell them apart look at the Arrow validity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))

#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[ord("A") : ord("Z") + 1] = True
WORD[128:] = True

#: Bytes of tokens, which stand between white space.
INK = np.ones(256, dtype=bool)
INK[[9, 10, 12, 13, 32]] = False

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base ("p") or of its inverse ("i"), modulo 2^64. Those of very long texts are not kept."""
    have = _powers[kind]
    if len(have) < n:
        have = np.full(n if n > 2 * SLICE_BYTES else 1 << max(12, (n - 1).bit_length()), _P if kind == "p" else _P_INV, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lowered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same documents in lower case."""
    if not len(raw) or raw.max() < 128:
        return _ASCII_LOWER[raw], offsets
    low = raw.tobytes().decode("utf-8", "replace").lower().encode()
    if len(low) == len(raw):
        return np.frombuffer(low, np.uint8), offsets
    parts = [raw[a:b].tobytes().decode("utf-8", "replace").lower().encode() for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each maximal run of word bytes; runs end where documents do."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    flag = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | edge[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.searchsorted(offsets, s, side="right") - 1, s, e


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums c, so that span_hash() needs only two look-ups a span."""
    c = np.empty(len(raw) + 1, np.uint64)
    c[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("p", len(raw)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans: equal bytes have equal hashes, wherever they stand."""
    return mix((c[end] - c[start]) * _power("i", len(c))[start])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word, in order."""
    if lower:
        raw, offsets = lowered(raw, offsets)
    d, s, e = word_spans(raw, offsets)
    return d, span_hash(prefix_hashes(raw), s, e)


def hash_of(words: str) -> np.ndarray:
    """The word hashes of one text."""
    raw = np.frombuffer(words.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[1]


def ngram_hashes(d: np.ndarray, h: np.ndarray, n: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word n-gram; a document of 1 to n-1 words has one gram, of all its words."""
    if not len(h):
        return d, h
    m = len(h) - n + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g = mix(g * _P + h[k : k + m])
        whole = d[:m] == d[n - 1 :]
        gd, g = d[:m][whole], g[whole]
    else:
        gd, g = d[:0], h[:0]
    if n > 1:
        counts = np.bincount(d, minlength=docs)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            own = []
            for i in short:
                x = np.zeros(1, np.uint64)
                for k in range(counts[i]):
                    x = mix(x * _P + h[first[i] + k])
                own.append(x[0] ^ np.uint64(counts[i]))
            gd, g = np.concatenate([gd, short]), np.concatenate([g, np.array(own, np.uint64)])
    return gd, g


def distinct(d: np.ndarray, h: np.ndarray, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, cut to `bits` bits and sorted. Documents are numbered below 2^(64-bits)."""
    key = (d.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1)


def char_gram_positions(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start byte) of each n-byte window inside one document."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    d = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return d, first + np.arange(len(d))


def runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where each begins."""
    if not len(sorted_ids):
        return sorted_ids, np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_ids)) + 1])
    return sorted_ids[first], first


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over [offsets[i], offsets[i+1]), empty segments included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def token_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each document: its runs of bytes that are no white space."""
    flag = INK[raw]
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = flag[first]
    return segment_sum(start, offsets)
