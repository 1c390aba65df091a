"""Media columns: ISO base media files (nested boxes, sample tables) as a binary column.

`mux` stores a payload of fixed-size samples in a container; `probe` walks the boxes of any container of this family,
decodes its sample tables and gives codec, duration and the byte ranges of the key frames. Only box headers and sample
tables are read; payloads are skipped by their length. Both run per Arrow batch; a container is never larger than the
row it comes from plus its tables.

Cases: a null or empty text is stored as one sample of padding; equal texts give equal containers; a truncated or
foreign file gives null fields and `error`, and so does one whose boxes nest deeper than MOST_DEPTH or whose tables speak of
more than the file holds; 64-bit box sizes and chunk offsets, files whose index comes last, fixed and listed sample sizes,
tracks without a sync table (every sample is a key frame), several tracks and movie fragments are understood. Other columns and their
names don't matter; rows may repeat; an empty table gives no rows.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from episodica.llm.common import fresh_name, struct_array

SAMPLE_BYTES = 576
PADDING = b"\xff"
TIMESCALE = 8000
SAMPLE_TICKS = 160
SAMPLES_PER_CHUNK = 16
KEY_EVERY = 8
# Containers in containers, many more than the format has.
MOST_DEPTH = 64
# Fixed values of the file format: boxes that hold boxes, and the identity matrix of headers.
CONTAINERS = (b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta")
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

RANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
TOLD = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", RANGES)]
# What the first track says, the number of boxes, what all tracks say, and what is wrong.
PROBE = pa.struct([*TOLD, ("n_boxes", pa.int32()), ("tracks", pa.list_(pa.struct(TOLD))), ("error", pa.string())])
DIGEST = pa.struct(
    [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: bytes) -> bytes:
    """The payload: bytes 255 are appended up to a positive multiple of the sample size."""
    return text + PADDING * (max(1, -(-len(text) // SAMPLE_BYTES)) * SAMPLE_BYTES - len(text))


def mux_bytes(payload: bytes) -> bytes:
    """A container with one track of raw 8-bit samples; the index stands before the payload."""
    n, rest = divmod(len(payload), SAMPLE_BYTES)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the sample size")
    ticks = n * SAMPLE_TICKS
    chunks = -(-n // SAMPLES_PER_CHUNK)
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    runs += [(chunks, last, 1)] if chunks == 1 or last != SAMPLES_PER_CHUNK else []
    keys = range(1, n + 1, KEY_EVERY)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    places = np.arange(chunks, dtype=np.int64) * (SAMPLES_PER_CHUNK * SAMPLE_BYTES)

    def index(start: int, wide: bool) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE_TICKS)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), (places + start).astype(">u8" if wide else ">u4").tobytes()),
        )
        refs = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
            box(b"minf", full(b"smhd", bytes(4)), refs, table),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        movie = struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100)
        return box(b"moov", full(b"mvhd", movie, MATRIX, bytes(24), struct.pack(">I", 2), version=1), box(b"trak", track, media))

    wide = len(payload) + (1 << 20) + 12 * n >= 1 << 32
    body = 16 if len(payload) + 8 >= 1 << 32 else 8
    start = len(head) + len(index(0, wide)) + body
    return b"".join((head, index(start, wide), box(b"mdat", payload)))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, body start, body end) of every box, parents first; bodies other than containers are not looked into."""
    # Where to go on, and the ends and kinds of the containers around.
    ends, path = [end], []
    while ends:
        if start + 8 > ends[-1]:
            start = ends.pop()
            if path:
                path.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > ends[-1]:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            body += 8
        elif size == 0:
            size = ends[-1] - start
        if size < body - start or start + size > ends[-1]:
            raise ValueError("a box ends outside its parent")
        yield (*path, kind), start, body, start + size
        if kind in CONTAINERS:
            if len(path) == MOST_DEPTH:
                raise ValueError("boxes nest too deep")
            path.append(kind)
            ends.append(start + size)
            start = body
        else:
            start += size


@dataclass
class Track:
    """The decoded sample tables of a track, its fragments' samples included."""

    number: int
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    starts: np.ndarray
    ticks: np.ndarray
    keys: np.ndarray


def numbers(data: memoryview, at: int, n: int, kind: str, end: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if at + n * width > end:
        raise ValueError("a table ends outside its box")
    return np.frombuffer(data, dtype=kind, count=n, offset=at).astype(np.int64)


def read_track(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> Track:
    def at(kind: bytes) -> tuple[int, int]:
        if kind not in tables:
            raise ValueError(f"no {kind.decode('latin-1')} box")
        return tables[kind]

    def count(kind: bytes, skip: int = 4) -> tuple[int, int, int]:
        a, end = at(kind)
        return *struct.unpack_from(">I", data, a + skip), a + skip + 4, end

    number = 0
    if b"tkhd" in tables:
        a, _ = tables[b"tkhd"]
        (number,) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
    a, _ = at(b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = at(b"stsd")
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    n, a, end = count(b"stsz", 8)
    (each,) = struct.unpack_from(">I", data, a - 8)
    # Counts are held against the bytes that they speak of before anything is made of their size.
    if each and n * each > len(data):
        raise ValueError("more samples than the file holds")
    sizes = np.full(n, each, np.int64) if each else numbers(data, a, n, ">u4", end)
    wide = b"co64" in tables
    chunks, a, end = count(b"co64" if wide else b"stco")
    places = numbers(data, a, chunks, ">u8" if wide else ">u4", end)
    runs, a, end = count(b"stsc")
    run = numbers(data, a, 3 * runs, ">u4", end).reshape(-1, 3)
    opens = np.append(run[:, 0], chunks + 1)
    if (np.diff(opens) < 0).any() or opens[0] != 1 or int((run[:, 1] * np.diff(opens)).sum()) != n:
        raise ValueError("the sample tables disagree")
    per_chunk = np.repeat(run[:, 1], np.diff(opens))
    chunk = np.repeat(np.arange(chunks), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    starts = places[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
    spans, a, end = count(b"stts")
    span = numbers(data, a, 2 * spans, ">u4", end).reshape(-1, 2)
    if int(span[:, 0].sum()) != n:
        raise ValueError("the sample tables disagree")
    ticks = np.repeat(span[:, 1], span[:, 0])
    keys = np.arange(n)
    if b"stss" in tables:
        k, a, end = count(b"stss")
        keys = numbers(data, a, k, ">u4", end) - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a key frame is no sample")
    return Track(number, codec, timescale, duration, sizes, starts, ticks, keys)


# Fixed values of the file format: flags of fragment headers and runs, and the bit of a sample that no decoding begins at.
BASE, DURATION, SIZE, FLAGS = 0x1, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_A_KEY = 0x10000


class Fragment:
    """A track's part of a movie fragment: where its runs begin, and what its samples have by default."""

    def __init__(self, data: memoryview, at: int, movie_at: int, defaults: dict[int, tuple[int, int, int]]):
        flags, self.number = struct.unpack_from(">II", data, at)
        at += 8
        self.next = movie_at
        if flags & BASE:
            (self.next,) = struct.unpack_from(">Q", data, at)
            at += 8
        self.base = self.next
        at += 4 * bool(flags & 0x2)
        values = list(defaults.get(self.number, (0, 0, 0)))
        for k, bit in enumerate((DURATION, SIZE, FLAGS)):
            if flags & bit:
                (values[k],) = struct.unpack_from(">I", data, at)
                at += 4
        self.duration, self.size, self.flags = values

    def run(self, data: memoryview, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, starts, ticks, which are key frames) of a run of samples."""
        flags, n = struct.unpack_from(">II", data, at)
        flags, at = flags & 0xFFFFFF, at + 8
        if flags & RUN_OFFSET:
            self.next = self.base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & RUN_FIRST:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        listed = [bit for bit in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & bit]
        # Samples without any field of their own must at least have bytes.
        if n * (4 * len(listed) or max(self.size, 1)) > len(data):
            raise ValueError("more samples than the file holds")
        fields = numbers(data, at, n * len(listed), ">u4", end).reshape(n, len(listed)) if listed else np.zeros((n, 0), np.int64)

        def values(bit: int, default: int) -> np.ndarray:
            return fields[:, listed.index(bit)].copy() if bit in listed else np.full(n, default, np.int64)

        ticks, sizes, marks = values(RUN_DURATION, self.duration), values(RUN_SIZE, self.size), values(RUN_FLAGS, self.flags)
        if first is not None and n:
            marks[0] = first
        starts = self.next + np.cumsum(sizes) - sizes
        self.next += int(sizes.sum())
        return sizes, starts, ticks, marks & NOT_A_KEY == 0


def probe_tracks(data: bytes) -> tuple[list[Track], int, str | None]:
    """All tracks in their order, the number of boxes and what is wrong with the file, if anything."""
    view, tables, n = memoryview(data), [], 0
    defaults: dict[int, tuple[int, int, int]] = {}
    movie_at, fragment = 0, None
    runs: dict[int, list] = {}
    try:
        for path, start, body, end in boxes(view, 0, len(view)):
            n += 1
            kind = path[-1]
            if kind == b"trak":
                tables.append({})
            elif b"trak" in path:
                tables[-1].setdefault(kind, (body, end))
            elif kind == b"trex":
                number, _, *values = struct.unpack_from(">5I", view, body + 4)
                defaults[number] = tuple(values)
            elif kind == b"moof":
                movie_at = start
            elif kind == b"traf":
                fragment = None
            elif kind == b"tfhd":
                fragment = Fragment(view, body, movie_at, defaults)
            elif kind == b"trun":
                if fragment is None:
                    raise ValueError("a run of samples without its header")
                runs.setdefault(fragment.number, []).append(fragment.run(view, body, end))
        tracks = [read_track(view, t) for t in tables]
        if not tracks:
            raise ValueError("no trak box")
        for number, found in runs.items():
            track = next((t for t in tracks if t.number == number), None)
            if track is None:
                raise ValueError("a fragment of no track")
            sizes, starts, ticks, key = (np.concatenate(c) for c in zip(*found))
            track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(key)])
            track.sizes, track.starts = np.concatenate([track.sizes, sizes]), np.concatenate([track.starts, starts])
            track.ticks = np.concatenate([track.ticks, ticks])
            track.duration = max(track.duration, int(track.ticks.sum()))
        if any(len(t.sizes) and (t.starts.min() < 0 or (t.starts + t.sizes).max() > len(data)) for t in tracks):
            raise ValueError("a sample lies outside the file")
        return tracks, n, None
    except (ValueError, IndexError, struct.error) as e:
        return [], n, str(e)


def probe_bytes(data: bytes) -> tuple[Track | None, int, str | None]:
    """The first track, the number of boxes and what is wrong with the file, if anything."""
    tracks, n, error = probe_tracks(data)
    return (tracks[0] if tracks else None), n, error


def payload_of(data: bytes, track: Track) -> bytes:
    """The samples in their order, as stored; runs of neighbours are read as one."""
    if not len(track.sizes):
        return b""
    ends = track.starts + track.sizes
    breaks = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    view = memoryview(data)
    a, b = np.append(0, breaks), np.append(breaks, len(ends)) - 1
    return b"".join(view[x:y] for x, y in zip(track.starts[a].tolist(), ends[b].tolist()))


def feature_of(track: Track, n_boxes: int) -> str:
    """Codec, duration, samples and key-frame byte ranges in one line."""
    keys = ",".join(f"{track.starts[k]}+{track.sizes[k]}" for k in track.keys.tolist())
    return f"{track.codec.strip()};{track.duration}/{track.timescale};{len(track.sizes)};{n_boxes};{keys}"


def mux(text: Column) -> Column:
    """The container of each text."""

    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([mux_bytes(padded((x.as_py() or "").encode())) for x in batch], pa.binary())

    return F.arrow_udf(stored, "binary")(text)


def with_media(docs: DataFrame, name: str = "media", text_col: str = "text") -> DataFrame:
    """docs with the container of each text in a binary column; underscores are added to a name that is taken."""
    return docs.withColumn(fresh_name(docs, name), mux(F.col(text_col)))


def told(track: Track) -> dict:
    ranges = [{"start": int(track.starts[k]), "length": int(track.sizes[k])} for k in track.keys.tolist()]
    return {"codec": track.codec.strip(), "timescale": track.timescale, "duration": track.duration, "n_samples": len(track.sizes), "keyframes": ranges}


def probe_row(data: bytes | None) -> dict:
    tracks, n, error = probe_tracks(data) if data is not None else ([], 0, "no file")
    if error:
        return {"n_boxes": n, "error": error}
    return told(tracks[0]) | {"n_boxes": n, "tracks": [told(t) for t in tracks]}


def probe(media: Column) -> Column:
    """What the boxes of each container say."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([probe_row(x.as_py()) for x in batch], PROBE)

    return F.arrow_udf(read, from_arrow_type(PROBE))(media)


def digest_of(text: bytes) -> tuple:
    media = mux_bytes(padded(text))
    track, n_boxes, error = probe_bytes(media)
    if error:
        raise ValueError(error)
    stored = payload_of(media, track)
    return (len(text), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:]), len(media),
            hashlib.sha256(media).hexdigest(), feature_of(track, n_boxes))


def media_digest(text: Column) -> Column:
    """Stores each text, reads the stored file back through its tables and digests both."""

    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield struct_array([digest_of((x.as_py() or "").encode()) for x in batch], DIGEST)

    return F.arrow_udf(digested, from_arrow_type(DIGEST))(text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id and the digest columns) for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), media_digest(F.col(text_col)).alias("_m")).select("doc_id", "_m.*")
