"""Rules, media, packing, tokens: each against a plain version of itself."""

import base64
import hashlib
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from episodica.llm import bpe, jaccard, media, packing, rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_counts(text):
    text = text or ""
    w, at, covered = WORD.findall(text), {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(spark, odd, sf):
    docs = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    texts = [r.text for r in docs.collect()]
    got = rules.statistics(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(map(plain_counts, texts))


def test_rules_are_learned(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        w = 100
        rows.append((i, w, 500, 80 + rng.randrange(20) if bad else rng.randrange(5), 0, 0, 90, 10, 600, rng.randrange(40), 10, 3, 0 if bad else 1))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_chars", "n_upper", "n_marks", "n_digits", "label"]
    stats = spark.createDataFrame(rows, names)
    learned = rules.learn(stats)
    assert len(learned.rules) == 1 and "symbols_per_word >" in str(learned.rules[0])
    wrong = rules.judged(stats, learned).filter(F.col("kept") != (F.col("label") == 1)).count()
    assert wrong == 0
    assert rules.learn(stats.filter("label = 1")).rules == () and rules.learn(stats.limit(0)).rules == ()


def test_media_round_trip(odd):
    for doc, row in zip(odd.select("text").collect(), media.digests(odd).collect()):
        data = (doc.text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (row.n_bytes, row.payload_bytes) == (len(data), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.mux_bytes(payload)
        assert row.media_bytes == len(stored) and row.media_sha256 == hashlib.sha256(stored).hexdigest()


def test_probe(spark, odd):
    files = media.with_media(odd.select("doc_id", "text")).select("text", "media", media.probe(F.col("media")).alias("p"))
    for r in files.collect():
        n = max(1, -(-len((r.text or "").encode()) // 576))
        assert (r.p.codec, r.p.timescale, r.p.duration, r.p.n_samples, r.p.error) == ("raw", 8000, 160 * n, n, None)
        assert len(r.p.keyframes) == -(-n // 8) and all(k.length == 576 for k in r.p.keyframes)
        payload = b"".join(r.media[k.start : k.start + k.length] for k in r.p.keyframes)
        want = media.padded((r.text or "").encode())
        assert payload == b"".join(want[i : i + 576] for i in range(0, len(want), 8 * 576))
    broken = spark.createDataFrame([(b"",), (b"\0\0\0\x09junk",), (None,), (media.mux_bytes(b"a" * 576)[:200],)], "media binary")
    assert all(r.p.codec is None and r.p.error for r in broken.select(media.probe(F.col("media")).alias("p")).collect())


def test_probe_other_layouts():
    """An index after the payload, listed sample sizes, 64-bit offsets, no sync table."""
    sizes, samples = [3, 5, 2], b"abcdefghij"
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(samples)) + samples
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))),
        media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 20)),
        media.full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)),
        media.full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)),
        media.full(b"co64", struct.pack(">IQ", 1, 16)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 40))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    track, _, error = media.probe_bytes(mdat + moov)
    assert error is None and track.codec == "mp4a" and (track.timescale, track.duration) == (100, 40)
    assert track.starts.tolist() == [16, 19, 24] and track.keys.tolist() == [0, 1, 2] and track.ticks.tolist() == [10, 10, 20]
    assert media.payload_of(mdat + moov, track) == samples


def movie_track(number, stbl):
    mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 0))
    tkhd = media.full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, media.box(b"minf", stbl)))


def no_samples(codec):
    return media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(28))), media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)),
        media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4)),
    )


def test_probe_fragments_and_two_tracks():
    """Samples of two tracks in two fragments: defaults of the movie, of the fragment and of the run, key flags, runs that follow each other."""
    trex = [media.full(b"trex", struct.pack(">5I", n, 1, 10, 4, media.NOT_A_KEY)) for n in (1, 2)]
    moov = media.box(b"moov", movie_track(1, no_samples(b"avc1")), movie_track(2, no_samples(b"mp4a")), media.box(b"mvex", *trex))

    def fragment(at, payload):
        def moof(offset):
            one = media.box(
                b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000),
                media.full(b"trun", struct.pack(">IiI", 2, offset, 0), flags=media.RUN_OFFSET | media.RUN_FIRST),
                media.full(b"trun", struct.pack(">I4I", 2, 5, 0, 1, media.NOT_A_KEY), flags=media.RUN_SIZE | media.RUN_FLAGS),
            )
            two = media.box(b"traf", media.full(b"tfhd", struct.pack(">III", 2, 7, 0), flags=media.DURATION | media.FLAGS | 0x20000),
                            media.full(b"trun", struct.pack(">Ii", 1, offset + 14), flags=media.RUN_OFFSET))
            return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), one, two)

        size = len(moof(0))
        return moof(size + 8) + media.box(b"mdat", payload), at + size + 8

    first, a = fragment(len(moov), b"aaaabbbbcccccdeeee")
    second, b = fragment(len(moov) + len(first), b"AAAABBBBCCCCCDEEEE")
    data = moov + first + second
    tracks, _, error = media.probe_tracks(data)
    assert error is None and [t.codec for t in tracks] == ["avc1", "mp4a"]
    video, sound = tracks
    assert media.payload_of(data, video) == b"aaaabbbbcccccdAAAABBBBCCCCCD" and media.payload_of(data, sound) == b"eeeeEEEE"
    assert video.sizes.tolist() == [4, 4, 5, 1] * 2 and video.keys.tolist() == [0, 2, 4, 6] and video.starts.tolist()[::4] == [a, b]
    assert sound.keys.tolist() == [0, 1] and (video.duration, sound.duration) == (80, 14)
    row = media.probe_row(data)
    assert row["codec"] == "avc1" and [t["n_samples"] for t in row["tracks"]] == [8, 2]


@pytest.mark.parametrize(
    "data",
    [
        b"".join(struct.pack(">I4s", 8 * (3000 - k), b"moov") for k in range(3000)),
        media.box(b"moov", movie_track(1, media.box(b"stbl", no_samples(b"x   ")[8:].replace(media.full(b"stsz", bytes(8)), media.full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)))))),
        media.box(b"moov", movie_track(1, media.box(b"stbl", no_samples(b"x   ")[8:].replace(media.full(b"stts", bytes(4)), media.full(b"stts", struct.pack(">III", 1, 0xFFFFFFFF, 1)))))),
        media.box(b"moov", movie_track(1, media.box(b"stbl", no_samples(b"x   ")[8:].replace(media.full(b"stsc", bytes(4)), media.full(b"stsc", struct.pack(">I", 0xFFFFFFFF)))))),
        media.box(b"moov", movie_track(1, media.box(b"stbl", no_samples(b"x   ")[8:].replace(media.full(b"stsc", bytes(4)) , media.full(b"stsc", struct.pack(">IIII", 1, 1, 0xFFFFFFFF, 1))).replace(media.full(b"stco", bytes(4)), media.full(b"stco", struct.pack(">II", 1, 0)))))),
        media.box(b"moov", movie_track(1, no_samples(b"x   "))) + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1)), media.full(b"trun", struct.pack(">I", 0xFFFFFFFF)))),
        media.box(b"moov", movie_track(1, no_samples(b"x   "))) + media.box(b"moof", media.box(b"traf", media.full(b"trun", struct.pack(">I", 1)))),
        b"\0" * 64,
    ],
)
def test_probe_survives(data):
    """Deep nesting, counts of 2^32 - 1 in every table, runs without a header: an error, no crash and no large allocation."""
    tracks, _, error = media.probe_tracks(data)
    assert tracks == [] and error


def test_media_column_takes_a_free_name(frame):
    docs = frame([(1, "x")]).withColumn("media", F.lit("mine"))
    assert media.with_media(docs).first()["media"] == "mine" and media.with_media(docs).columns[-1] == "media_"


def test_codec_like_the_library(reference):
    codec = bpe.Codec(bpe.vocabulary(PATH), bpe.classes())
    rng = random.Random(2)
    letters = "  \n\t'stremvldSTREmvABC,.!?129aZéß漢　 \x1c\x85²½’\r🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["it's we'll I'd they've x'rex 'sx ' s'", "z" * 5000, "ab c " * 3000, "", " ", "'s"]
    out = [[] for _ in texts]
    for i, ids, bounds, _ in codec.parts(pa.array(texts)):
        for k in range(len(bounds) - 1):
            out[i + k] += ids[bounds[k] : bounds[k + 1]].tolist()
    assert out == [reference.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    v = bpe.vocabulary(PATH)
    assert len(v.slot_key) == int(v.known.sum()) and len(set(v.slot_id.tolist())) == len(v.slot_id)


def test_codec_in_pieces(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 64)
    text = "some words and, others; it's 12 o'clock  now \n" * 40
    got = np.concatenate([ids for _, ids, _, _ in bpe.Codec(bpe.vocabulary(PATH), bpe.classes()).parts(pa.array([text]))])
    assert got.tolist() == reference.encode_ordinary(text)


def test_checked_piece_by_piece(reference):
    """A batch of texts comes out in parts of about a piece, long documents whole; a worker holds little besides."""
    word = "some words and, others; it's 12 o'clock now \n"
    texts = [word * k for k in (1, 2, 2000, 0, 3)] * 30 + [word * 30_000, "", word] + [word * 50] * 300
    batches = [pa.array(texts[:40] + [None]), pa.array([], pa.string()), pa.array(texts[40:])]
    codec = bpe.Codec(bpe.vocabulary(PATH), bpe.classes())
    tracemalloc.start()
    longest = max(len(part.field("ids").values) for part in bpe.checked(codec, iter([pa.array([word * 50] * 3000)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [r for part in bpe.checked(codec, iter(batches)) for r in part.to_pylist()]
    ids = {t: reference.encode_ordinary(t) for t in {*texts}}
    want = [*texts[:40], "", *texts[40:]]
    assert [r["ids"] for r in got] == [ids[t] for t in want]
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in want]
    assert longest <= bpe.PIECE and most < 50e6


def test_encode_and_decode(spark, odd, reference):
    rows = odd.select("text", bpe.encode(spark, F.col("text"), PATH).alias("ids"))
    rows = rows.withColumn("back", bpe.decode(spark, F.col("ids"), PATH)).collect()
    for r, d in zip(rows, bpe.digests(odd, PATH).collect()):
        want = reference.encode_ordinary(r.text or "")
        assert list(r.ids) == want and bytes(r.back) == (r.text or "").encode()
        assert d.n_tokens == len(want) and d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        size = rng.randrange(5, 40)
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(60))]
        rows, room = packing.best_fit_decreasing(lengths, size), []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(size - n)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[k] for k in r) for r in rows) == sorted(room)


def test_packing_is_lossless(odd, reference):
    size = 64
    rows = packing.pack(odd, PATH, size=size, window=500, group_bytes=10_000).collect()
    found = {}
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, np.int32)
        assert len(ids) == len(places) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    want = {}
    for d in odd.collect():
        ids = reference.encode_ordinary(d.text or "")
        want.setdefault(d.doc_id, []).extend((s, ids[s : s + size]) for s in range(0, len(ids), size))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items() if v}


def thue_morse(n, swapped=False):
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_words_are_told_apart(frame, reference, n):
    """Two words on which polynomial hashes collide, in one piece and both orders: tokens and near copies keep them apart."""
    words = [thue_morse(n), thue_morse(n, True)]
    for order in (words, words[::-1]):
        docs = frame(list(enumerate(order)))
        got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
        for k, text in enumerate(order):
            ids = reference.encode_ordinary(text)
            assert got[k].n_tokens == len(ids) and got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {(r.doc_id, r.component_id) for r in jaccard.clusters(frame(list(enumerate(words)))).collect()} == {(0, 0), (1, 1)}


def test_equal_hashes_of_different_bytes():
    """With one hash for everything, misses, vocabulary entries and the memory still tell bytes apart."""
    data = np.frombuffer(b"abcabdabcxyab", np.uint8)
    starts, lengths = np.array([0, 3, 6, 9, 11]), np.array([3, 3, 3, 2, 2])
    keys = np.zeros(5, np.uint64)
    example, owner = bpe.different(keys, data, starts, lengths)
    assert sorted(example.tolist()) == [0, 1, 3, 4] and example[owner].tolist() == [0, 1, 0, 3, 4]
    memory = bpe.Memory(16)
    memory.add(keys[:2], data, starts[:2], lengths[:2], np.array([1, 2, 3], np.int32), np.array([1, 2]))
    assert memory.find(keys, data, starts, lengths).tolist() == [0, 1, 0, -1, -1]
    memory.add(keys[3:], data, starts[3:], lengths[3:], np.array([4, 5], np.int32), np.array([1, 1]))
    assert memory.find(keys, data, starts, lengths).tolist() == [0, 1, 0, 2, 3]
