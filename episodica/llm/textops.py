"""Vectorised work on the UTF-8 bytes of Arrow text columns: documents in pieces of bounded size, words, hashes.

A piece is a run of whole documents of about a megabyte, or a part of one longer document, so that the memory of a
task follows neither the batch nor the longest text.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying it; nulls are empty texts."""
    batch = pc.fill_null(batch, "").cast(pa.large_string())
    _, offsets, data = batch.buffers()
    at = np.frombuffer(offsets, np.int64)[batch.offset : batch.offset + len(batch) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def doc_ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents that together hold about `limit` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


MIX = U64(0x9E3779B97F4A7C15)
KEY = U64(0x5851F42D4C957F2D)
# A span of more bytes gets its hash from a keyed digest.
LONG = 1 << 12
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: the same for equal bytes wherever they stand.

    Eight bytes after eight are mixed in by a step that is one-to-one in the hash so far and in the block and not linear in either. Spans of one
    length up to eight bytes never collide; for others collisions are a matter of chance, whatever their structure."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    h = mixed_bits((ends - starts).astype(U64) * MIX + KEY)
    live = np.flatnonzero((ends > starts) & (ends - starts <= LONG))
    at = starts[live]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    while len(live):
        left = ends[live] - at
        block = windows[at].view(U64).ravel() & MASKS[np.minimum(left, 8)]
        h[live] = mixed_bits(h[live] * MIX ^ block)
        more = left > 8
        live, at = live[more], at[more] + 8
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=KEY.tobytes())
        h[k] = np.frombuffer(digest.digest(), U64)[0]
    return h


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of these lengths hold the same bytes."""
    owner, place = ragged(lengths)
    wrong = a[a_starts[owner] + place] != b[b_starts[owner] + place]
    return np.bincount(owner[wrong], minlength=len(lengths)) == 0


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words between white space; bounds: where documents begin, and the end."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = ~inside[:-1]
    edge |= first
    starts = np.flatnonzero(inside & edge[:-1])
    stop = np.empty(len(data), bool)
    stop[-1:] = True
    stop[:-1] = ~inside[1:]
    stop |= first[1:]
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within it) for every element of segments of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - before[owner]


def gather(blob: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The segments blob[offsets[w]:offsets[w + 1]] for w in which, one after another."""
    lengths = offsets[which + 1] - offsets[which]
    shift = np.repeat(offsets[which] - (np.cumsum(lengths) - lengths), lengths)
    return blob[shift + np.arange(len(shift))]


def text_parts(batch: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, bounds) for pieces of a text column, `limit` bytes where they are several documents; a document
    of several pieces is cut at white space and comes again with the next one."""
    data, offsets = flat(batch)
    for i, j in doc_ranges(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * PIECE or j > i + 1:
            yield i, data[a:b], offsets[i : j + 1] - a
            continue
        while a < b:
            cut = min(a + PIECE, b)
            while cut < b and not SPACE[data[cut]]:
                cut += 1
            yield i, data[a:cut], np.array([0, cut - a])
            a = cut


KEPT: dict[str, object] = {}


def kept(key: str, make):
    """What make() gives, kept for later tasks of this worker process until another key comes."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]
