"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary. A pre-token's 64-bit hash picks a bucket, the bucket's
displacement picks the one slot where a vocabulary entry of that hash can stand; the slot keeps that hash, so a
pre-token that is a whole vocabulary entry is resolved by two table reads, for a quarter of a megabyte of text at a time;
its bytes are compared with the entry's. Tier two: a miss is merged by a heap over linked bytes, lowest rank first, leftmost
first among equals. Misses are resolved once for each different pre-token of a piece, told apart by their bytes, with a
bounded memory per worker.

The vocabulary is a file of base64 byte strings and ranks; the file's path is a parameter, read on the driver, and the
tables (about a megabyte) go to the workers with the function. Pre-tokens follow the public pattern of these
vocabularies; they are cut by character class, vectorised.

Cases: null is the empty text: no ids, the empty byte string. Ids that the vocabulary doesn't have raise on decoding;
null ids decode to null. Long texts are cut where a pre-token surely ends, between an ASCII letter or digit and a single
space before another. Equal texts give equal ids.
"""

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from episodica.llm.common import struct_array
from episodica.llm.textops import U64, doc_ranges, equal_spans, flat, gather, kept, mixed_bits, ragged, span_hashes

KEYS_PER_BUCKET = 4
# Bytes of text that are encoded at a time; that takes many times their room.
PIECE = 1 << 18
# Misses that a worker remembers, in about fifty bytes each.
REMEMBERED = 1 << 20
SPACES, LETTERS, NUMBERS, OTHER = range(4)
# Fixed values of the public pattern: what follows an apostrophe in a contraction.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The pattern's class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c, pattern in ((LETTERS, r"\p{L}"), (NUMBERS, r"\p{N}"), (SPACES, r"\s")):
        match = regex.compile(pattern).match
        table[[i for i in range(0x110000) if match(chr(i))]] = c
    return table


def pretoken_starts(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin; they cover all bytes. bounds: where documents begin, and the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = table[cp]
    n = len(cp)
    new = np.zeros(n + 1, bool)
    new[np.searchsorted(at, bounds)] = True
    new[0] = new[n] = True
    start = new.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # A run of white space gives its last character away if a word follows in the document.
    last = np.flatnonzero((kind == SPACES) & start[1:] & ~new[1:])
    joined = cp[last] == 32
    start[last] = True
    start[last[joined] + 1] = False
    # Contractions: an apostrophe that begins a pre-token by itself takes its ending from the letters after it.
    mark = np.flatnonzero((cp == 39) & start[:n])
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTERS) & ~new[mark + 1]]
    size = np.zeros(len(mark), np.int64)
    for ending in ENDINGS:
        fits = size == 0
        for k, c in enumerate(ending, 1):
            where = np.minimum(mark + k, n - 1)
            fits &= (mark + k < n) & (cp[where] == ord(c))
            if k > 1:
                fits &= ~new[where]
        size[fits] = len(ending) + 1
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    after = mark + size
    inside = (after < n) & ~new[np.minimum(after, n)]
    after = after[inside]
    start[after[kind[after] == LETTERS]] = True
    return at[start[:n]]


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a pre-token: pairs of neighbours are merged by a heap over linked bytes.

    after[i] is where the part that begins at i ends, 0 once the part is merged away; before[i] is where the part that
    ends at i begins. A heap entry is out of date if the part it would make no longer consists of two parts."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    # Entries are rank, begin and end in one integer, which compares as the three do.
    bits = n.bit_length()
    low = (1 << bits) - 1
    get, heap = ranks.get, []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r << bits | i) << bits | i + 2)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        end, i = entry & low, entry >> bits & low
        mid = after[i]
        if not 0 < mid < n or after[mid] != end:
            continue
        after[mid] = 0
        after[i] = end
        before[end] = i
        if end < n:
            stop = after[end]
            r = get(piece[i:stop]) if stop - i <= longest else None
            if r is not None:
                push(heap, (r << bits | i) << bits | stop)
        p = before[i]
        if p >= 0:
            r = get(piece[p:end]) if end - p <= longest else None
            if r is not None:
                push(heap, (r << bits | p) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """The rank file and its minimal perfect hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(t) for t, _ in pairs]
        ids = np.array([int(r) for _, r in pairs])
        self.n_ids = int(ids.max()) + 1
        by_id = [b""] * self.n_ids
        for t, i in zip(tokens, ids.tolist()):
            by_id[i] = t
        self.offsets = np.cumsum([0, *map(len, by_id)])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.name = hashlib.sha1(self.blob.tobytes() + self.offsets.tobytes()).hexdigest()
        self.known = np.zeros(self.n_ids, bool)
        self.known[ids] = True
        ends = np.cumsum([len(t) for t in tokens])
        joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.build(span_hashes(joined, ends - [len(t) for t in tokens], ends), ids)

    def build(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Hash and displace, largest buckets first; a bucket of one key names its slot outright."""
        n = len(keys)
        self.n_buckets = -(-n // KEYS_PER_BUCKET)
        bucket = (keys % U64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        free = np.ones(n, bool)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.slot_key, self.slot_id = np.zeros(n, U64), np.zeros(n, np.int32)
        sizes = np.diff(first)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if len(own) > 1:
                d = 1
                while True:
                    tries = np.arange(d, d + 128, dtype=U64)
                    slots = (mixed_bits(keys[own][None, :] ^ (tries[:, None] * U64(0x9E3779B97F4A7C15))) % U64(n)).astype(np.int64)
                    ordered = np.sort(slots, axis=1)
                    good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if good.any():
                        k = int(np.argmax(good))
                        self.shift[b], place = d + k, slots[k]
                        break
                    d += 128
            elif len(own):
                place = np.array([self.next_free(free)])
                self.shift[b] = -1 - place[0]
            else:
                continue
            free[place] = False
            self.slot_key[place], self.slot_id[place] = keys[own], ids[own]

    def next_free(self, free: np.ndarray) -> int:
        at = getattr(self, "cursor", 0)
        while not free[at]:
            at += 1
        self.cursor = at
        return at

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of the spans that are whole vocabulary entries, -1 for the others; keys are their hashes. An entry of the same hash counts only
        if its bytes are the same."""
        shift = self.shift[(keys % U64(self.n_buckets)).astype(np.int64)]
        n = len(self.slot_key)
        moved = mixed_bits(keys ^ (shift.astype(U64) * U64(0x9E3779B97F4A7C15))) % U64(n)
        slot = np.where(shift < 0, -1 - shift, moved.astype(np.int64))
        ids = self.slot_id[slot]
        same = (self.slot_key[slot] == keys) & (self.offsets[ids + 1] - self.offsets[ids] == ends - starts)
        at = np.flatnonzero(same)
        same[at] = equal_spans(self.blob, self.offsets[ids[at]], data, starts[at], (ends - starts)[at])
        return np.where(same, ids, -1)


def different(keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each content, which of these each span has): by hash, then by length and bytes; what only shares a hash goes round again."""
    examples, owner, left, n = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        _, first, mine = np.unique(keys[left], return_index=True, return_inverse=True)
        model = left[first][mine]
        same = lengths[left] == lengths[model]
        at = np.flatnonzero(same)
        same[at] = equal_spans(data, starts[left[at]], data, starts[model[at]], lengths[left[at]])
        owner[left[same]] = n + mine[same]
        examples.append(left[first])
        n, left = n + len(first), left[~same]
    return np.concatenate(examples), owner


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memory:
    """Misses and their ids in flat arrays, found by open addressing; a found entry's bytes are compared. It starts anew when it is full."""

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << (2 * most - 1).bit_length()) - 1
        self.forget()

    def forget(self) -> None:
        self.n = 0
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.zeros(self.most, U64)
        self.at, self.ids_at = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int64)
        self.blob, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int32)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entries of spans, -1 where there is none."""
        out, live = np.full(len(keys), -1), np.arange(len(keys))
        pos = (keys & U64(self.mask)).astype(np.int64)
        while len(live):
            entry = self.slots[pos[live]]
            live, entry = live[entry >= 0], entry[entry >= 0]
            same = (self.keys[entry] == keys[live]) & (self.at[entry + 1] - self.at[entry] == lengths[live])
            at = np.flatnonzero(same)
            same[at] = equal_spans(self.blob, self.at[entry[at]], data, starts[live[at]], lengths[live[at]])
            out[live[same]] = entry[same]
            live = live[~same]
            pos[live] = (pos[live] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers spans that differ from each other and from all entries."""
        if self.n + len(keys) > self.most:
            self.forget()
            if len(keys) > self.most:
                return
        a, b = self.n, self.n + len(keys)
        self.keys[a:b] = keys
        self.at[a + 1 : b + 1] = self.at[a] + np.cumsum(lengths)
        self.ids_at[a + 1 : b + 1] = self.ids_at[a] + np.cumsum(sizes)
        owner, place = ragged(lengths)
        self.blob = put(self.blob, self.at[a], data[starts[owner] + place])
        self.ids = put(self.ids, self.ids_at[a], ids)
        self.n = b
        pos, left = (keys & U64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.slots[pos[left]] < 0]
            _, first = np.unique(pos[free], return_index=True)
            self.slots[pos[free[first]]] = a + free[first]
            left = left[self.slots[pos[left]] != a + left]
            pos[left] = (pos[left] + 1) & self.mask


def put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """held with values from `at` on, in a larger array if need be."""
    if at + len(values) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held), len(values)), held.dtype)])
    held[at : at + len(values)] = values
    return held


class Codec:
    """A worker's encoder: the shared vocabulary, and what it remembers of misses."""

    def __init__(self, vocab: Vocabulary, table: np.ndarray):
        self.vocab, self.table = vocab, table
        raw, off = vocab.blob.tobytes(), vocab.offsets.tolist()
        self.ranks = {raw[off[i] : off[i + 1]]: i for i in np.flatnonzero(vocab.known).tolist()}
        self.longest = max(map(len, self.ranks))
        self.memory = Memory(REMEMBERED)
        digits = [f"{i},".encode() for i in range(vocab.n_ids)]
        self.digit_blob = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_offsets = np.cumsum([0, *map(len, digits)])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each document's ids begin, and the end) of the documents between bounds."""
        starts = pretoken_starts(data, bounds, self.table)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        ids = self.vocab.find(keys, data, starts, ends)
        first = np.searchsorted(starts, bounds)
        miss = np.flatnonzero(ids < 0)
        if not len(miss):
            return ids.astype(np.int32), first
        lengths = ends - starts
        example, owner = different(keys[miss], data, starts[miss], lengths[miss])
        own_key, own_start, own_length = keys[miss[example]], starts[miss[example]], lengths[miss[example]]
        entry = self.memory.find(own_key, data, own_start, own_length)
        new = np.flatnonzero(entry < 0)
        raw = data.tobytes()
        made = [merge(raw[a : a + n], self.ranks, self.longest) for a, n in zip(own_start[new].tolist(), own_length[new].tolist())]
        made_at = np.cumsum([0, *map(len, made)])
        made = np.array([i for x in made for i in x], np.int32)
        # Where the ids of each different miss stand: in the memory, or among those just made.
        begins, counts = self.memory.ids_at[entry], self.memory.ids_at[entry + 1] - self.memory.ids_at[entry]
        begins[new], counts[new] = made_at[:-1], np.diff(made_at)
        size = np.ones(len(ids), np.int64)
        size[miss] = counts[owner]
        place = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(place[-1], np.int32)
        hit = ids >= 0
        out[place[:-1][hit]] = ids[hit]
        fresh = (entry < 0)[owner]
        for some, source in ((miss[~fresh], self.memory.ids), (miss[fresh], made)):
            whose = owner[~fresh] if source is self.memory.ids else owner[fresh]
            k, n = ragged(counts[whose])
            out[place[some][k] + n] = source[begins[whose][k] + n]
        keep = own_length[new] < 64
        kept_ids = made if keep.all() else gather(made, made_at, np.flatnonzero(keep))
        new = new[keep]
        self.memory.add(own_key[new], data, own_start[new], own_length[new], kept_ids, counts[new])
        return out, place[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.vocab.n_ids or not self.vocab.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.vocab.blob, self.vocab.offsets, ids)

    def parts(self, batch: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(first document, ids, bounds, whether the last document goes on) for pieces of a text column, in order."""
        data, offsets = flat(batch)
        for i, j in doc_ranges(offsets, PIECE):
            a, b = int(offsets[i]), int(offsets[j])
            cuts = [a]
            while j == i + 1 and b - cuts[-1] > 2 * PIECE:
                at = safe_cut(data, cuts[-1] + PIECE, b)
                if at is None:
                    break
                cuts.append(at)
            for k, x in enumerate(cuts):
                y = cuts[k + 1] if k + 1 < len(cuts) else b
                inner = offsets[i : j + 1] - a if len(cuts) == 1 else np.array([0, y - x])
                yield i, *self.encode(data[x:y], inner), k + 1 < len(cuts)


def codec_of(vocab: Vocabulary, table: np.ndarray) -> Codec:
    """This worker process's encoder."""
    return kept(vocab.name, lambda: Codec(vocab, table))


def safe_cut(data: np.ndarray, start: int, end: int) -> int | None:
    """The first place from start where a pre-token surely begins."""
    step = PIECE
    while start < end - 2:
        part = data[start : min(end, start + step + 2)]
        plain = ((part | 32) >= 97) & ((part | 32) <= 122)
        at = np.flatnonzero(plain[:-2] & (part[1:-1] == 32) & plain[2:])
        if len(at):
            return start + int(at[0]) + 1
        start += step
    return None


IDS = pa.list_(pa.int32())
DIGEST = pa.struct(
    [("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def shared(spark: SparkSession, path: str):
    """The vocabulary's tables for all workers: of fixed size, whatever the corpus."""
    return spark.sparkContext.broadcast((vocabulary(path), classes()))


CHECKED = pa.struct([("ids", IDS), ("decoded_sha256", pa.string())])


def checked(codec: Codec, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """CHECKED for text columns, given out piece by piece: what a worker holds follows neither the batch nor its ids."""
    # What there is so far of a document that goes on.
    pieces, size, held = [], 0, None
    for batch in batches:
        for _, ids, bounds, goes_on in codec.parts(batch):
            pieces.append(ids)
            plain = memoryview(codec.decode(ids).tobytes())
            at = np.concatenate([[0], np.cumsum(np.diff(codec.vocab.offsets)[ids])])[bounds].tolist()
            digests = []
            for a, b in zip(at, at[1:]):
                held = held or hashlib.sha256()
                held.update(plain[a:b])
                if not goes_on:
                    digests.append(held.hexdigest())
                    held = None
            if goes_on:
                size += len(ids)
                continue
            lists = pa.ListArray.from_arrays(np.append(0, size + bounds[1:]).astype(np.int32), np.concatenate(pieces))
            yield pa.StructArray.from_arrays([lists, pa.array(digests, pa.string())], fields=list(CHECKED))
            pieces, size = [], 0


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int> of the ids of each text."""
    return encode_and_check(spark, text, path)["ids"]


def encode_and_check(spark: SparkSession, text: Column, path: str) -> Column:
    """A struct of the ids of each text and the digest of the bytes that they decode to, from one pass."""
    tables = shared(spark, path)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return checked(codec_of(*tables.value), batches)

    return F.arrow_udf(encoded, from_arrow_type(CHECKED))(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The bytes that each id list stands for."""
    tables = shared(spark, path)

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(*tables.value)
        for batch in batches:
            rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch]
            yield pa.array([None if r is None else codec.decode(r).tobytes() for r in rows], pa.binary())

    return F.arrow_udf(decoded, "binary")(ids)


def round_trip(spark: SparkSession, text: Column, path: str) -> Column:
    """Digests of the ids of each text and of the bytes they decode to, without sending either back."""
    tables = shared(spark, path)

    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(*tables.value)
        for batch in batches:
            rows, open_doc = [], None
            for _, ids, bounds, goes_on in codec.parts(batch):
                digits = gather(codec.digit_blob, codec.digit_offsets, ids)
                digit_at = np.concatenate([[0], np.cumsum(np.diff(codec.digit_offsets)[ids])])[bounds].tolist()
                plain = codec.decode(ids)
                plain_at = np.concatenate([[0], np.cumsum(np.diff(codec.vocab.offsets)[ids])])[bounds].tolist()
                digits, plain, b = memoryview(digits.tobytes()), memoryview(plain.tobytes()), bounds.tolist()
                for k in range(len(b) - 1):
                    n, size, of_ids, of_text = open_doc or (0, 0, hashlib.sha256(), hashlib.sha256())
                    some = b[k + 1] > b[k]
                    if n and some:
                        of_ids.update(b",")
                    of_ids.update(digits[digit_at[k] : digit_at[k + 1] - some])
                    of_text.update(plain[plain_at[k] : plain_at[k + 1]])
                    open_doc = n + b[k + 1] - b[k], size + plain_at[k + 1] - plain_at[k], of_ids, of_text
                    if not goes_on:
                        rows.append((*open_doc[:2], of_ids.hexdigest(), of_text.hexdigest()))
                        open_doc = None
            yield struct_array(rows, DIGEST)

    return F.arrow_udf(digested, from_arrow_type(DIGEST))(text)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256) for every row."""
    found = round_trip(docs.sparkSession, F.col(text_col), path)
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("_t")).select("doc_id", "_t.*")
