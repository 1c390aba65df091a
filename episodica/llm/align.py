"""Two tokenizers side by side: groups of tokens that end at the same bytes, and how often ids are linked.

A text is encoded by a byte-level BPE (A, `tokenizers`, with a space before the text) and a sentencepiece model (B,
which adds that space itself). A's character offsets and B's spans are coarse cuts: where a token of each ends a
character, both end at one byte. Tokens that end inside a character (a multibyte character in several tokens of A,
byte-fallback tokens of B) have no end in these spans; only for them the decoded bytes decide, as for words of ASCII
alone, whose spans would say the same. Every token's span is held against
its decoded bytes; should a library's spans disagree with them, the decoded bytes decide for that text alone.

No token of either vocabulary reaches over a space behind a word (checked when they are loaded; texts stay whole for others), so both end there:
texts are aligned word by word, and each different word once while a worker remembers it. A full memory keeps the words used most; new
words go to A one behind another, as in a text.

Counts: a link of ids (a, b) counts once for each document that holds it. Documents are taken in chunks of bounded size,
each of which lists its different id pairs once with the number of its documents; only these lists are shuffled, added up
and joined back, so that the commonest pair has one row a chunk, not one a document.

The tokenizer files are read on the driver, their paths are parameters; their content (a few megabytes, whatever the
corpus) goes to the workers.

Cases: null and empty texts, and texts that A's or B's tokens don't spell (white space that B can't tell from U+2581), have no tokens:
zeros and an empty groups_sha256. Rows with equal ids or texts count as documents of their own; null ids stay; other
columns are not read; an empty table gives no rows. Texts are encoded whole. In a group of very many tokens ids are
counted before they are paired.
"""

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut
from episodica.llm.textops import doc_ranges, flat, gather, kept, ragged

# Bytes of text in a chunk, and in a piece that is worked on at once.
CHUNK = 16 << 20
PIECE = 1 << 20
# Pairs of ids made at once; a group of more token pairs than DENSE has its ids counted first.
PAIRS = 1 << 22
DENSE = 64
# Words that a worker remembers, and that it aligns at once.
REMEMBERED = 1 << 18
WORDS = 1 << 14
# Before a space behind a letter, a digit or a printable ASCII sign; a space that ends the text stays with its word, as B makes no token of an
# empty text and a word's own first space is B's to add.
CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?= .)", re.DOTALL)
# What a word ends with that another one may stand behind.
CLOSED = re.compile(r"[\w!-/:-@\[-`{-~]")
# Uses that keep a word when a worker forgets.
USED = 2


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def bytes_of_a(tokenizer) -> list[bytes]:
    alphabet = byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in alphabet for c in token)
        out[i] = bytes(alphabet[c] for c in token) if known else token.encode()
    return out


def bytes_of_b(model) -> list[bytes]:
    def one(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [one(i) for i in range(model.get_piece_size())]


def blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


class Aligner:
    """A worker's two tokenizers, the bytes of their tokens, and the words it has aligned."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes, self.a_at = blob(bytes_of_a(self.a))
        self.b_bytes, self.b_at = blob(bytes_of_b(self.b))
        self.n_b = len(self.b_at) - 1
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(self.n_b)])
        self.digits, self.digits_at = blob([b"%d," % i for i in range(max(len(self.a_at), len(self.b_at)))])
        a = json.loads(a_json)
        self.cuts_words = words_are_apart(a, self.b)
        # A encodes words one behind another as it does each alone, unless a token that isn't plain text could reach over their bounds.
        self.joins_words = self.cuts_words and all(t.get("special") for t in a.get("added_tokens") or [])
        self.known: dict[str, int] = {}
        self.numbers, self.uses = Rows(np.int64, 5), Rows(np.int64, 1)
        self.written, self.codes, self.links = Segments(np.uint8), Segments(np.int64), Segments(np.int64)

    def forget(self) -> None:
        """Keeps the words used most, half of what may be remembered at most; older uses count half each time."""
        uses, sizes, least = self.uses.data[: self.uses.size, 0], np.diff(self.written.at.data[: self.written.at.size, 0]), USED
        while True:
            keep = uses >= least
            if 2 * np.count_nonzero(keep) <= REMEMBERED and 2 * int(sizes[keep].sum()) <= CHUNK:
                break
            least *= 2
        kept_words = (w for w, k in zip(self.known, keep.tolist()) if k)
        self.known = {w: k for k, w in enumerate(kept_words)}
        self.numbers, self.uses = self.numbers.only(keep), self.uses.only(keep)
        self.uses.data >>= 1
        self.written, self.codes, self.links = self.written.only(keep), self.codes.only(keep), self.links.only(keep)

    def tokens_of_a(self, words: list[str], plain: bool):
        """(tokens a word, ids, character offsets in the word unless plain) of A: words are encoded one behind another where nothing reaches over
        their bounds, else alone."""
        encode = self.a.encode_batch_fast if plain else self.a.encode_batch
        if self.joins_words and all(CLOSED.match(w, len(w) - 1) for w in words):
            one = encode(["".join(words)], add_special_tokens=False)[0]
            ids = np.array(one.ids, np.int64)
            sizes = [*map(len, words)] if plain else [len(w.encode()) for w in words]
            ends, stops = np.cumsum(self.a_at[ids + 1] - self.a_at[ids]), np.cumsum(sizes)
            last = np.searchsorted(ends, stops)
            # Only if a token ends where each word does.
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all():
                n_a = np.diff(last, prepend=-1)
                if plain:
                    return n_a, ids, None
                first = np.cumsum([0, *map(len, words[:-1])])
                return n_a, ids, np.array(one.offsets, np.int64) - np.repeat(first, n_a)[:, None]
        ones = encode(words, add_special_tokens=False)
        offsets = None if plain else np.array([c for x in ones for o in x.offsets for c in o], np.int64).reshape(-1, 2)
        return *numbers_of([x.ids for x in ones]), offsets

    def tokens(self, words: list[str], plain: bool):
        """(tokens a word, ids, character offsets) of A and (tokens a word, ids, ends of spans) of B. In plain words, of ASCII only, characters are
        bytes: there offsets and spans are what the ids' bytes say, and aren't asked for."""
        rest = [w[1:] for w in words]
        n_a, flat_a, offsets = self.tokens_of_a(words, plain)
        if plain:
            n_b, flat_b = numbers_of(self.b.encode(rest, return_type=int, num_threads=1))
            stop = None
        else:
            protos = self.b.encode(rest, return_type="proto", num_threads=1)
            n_b, flat_b = numbers_of([[p.id for p in x.pieces] for x in protos])
            stop = np.array([p.end for x in protos for p in x.pieces], np.int64)
        return n_a, flat_a, offsets, n_b, flat_b, stop

    def spelt(self, words: list[str], plain: bool):
        """Tokens of the words that both tokenizers spell: (which words, then of A and of B: tokens a word, ids, ends, which of them are inside a
        character); ends count bytes through all these words."""
        n_a, a, offsets, n_b, b, stop = self.tokens(words, plain)
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        chars = np.cumsum([0, *map(len, words)])
        word_a, word_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        starts = char_at[chars]
        size, ok = np.diff(starts), np.ones(len(words), bool)
        for tokens, word, at in ((a, word_a, self.a_at), (b, word_b, self.b_at)):
            ok &= np.bincount(word, at[tokens + 1] - at[tokens], len(words)) == size
        for tokens, word, at, told in ((a, word_a, self.a_at, self.a_bytes), (b, word_b, self.b_at, self.b_bytes)):
            some = np.flatnonzero(ok)
            owner = np.repeat(some, size[some])
            wrong = gather(told, at, tokens[ok[word]]) != gather(raw, starts, some)
            ok &= np.bincount(owner, wrong, len(words)) == 0
        if plain:
            inside_a, inside_b, coarse_a, coarse_b = np.zeros(len(a), bool), np.zeros(len(b), bool), None, None
        else:
            # A token ends a character if the next one of the word begins after it; B's byte tokens but a character's last have empty spans.
            inside_a = np.zeros(len(a), bool)
            inside_a[:-1] = (offsets[1:, 0] < offsets[:-1, 1]) & (word_a[1:] == word_a[:-1])
            before = np.where(np.diff(word_b, prepend=-1) != 0, 0, np.append(0, stop[:-1]))
            inside_b = self.b_is_byte[b] & (stop == before)
            coarse_a = char_at[np.minimum(chars[word_a] + offsets[:, 1], len(char_at) - 1)]
            coarse_b = starts[word_b] + stop + 1
        moved = starts[:-1] - (np.cumsum(size * ok) - size * ok)
        out = []
        for tokens, word, at, inside, coarse in ((a, word_a, self.a_at, inside_a, coarse_a), (b, word_b, self.b_at, inside_b, coarse_b)):
            keep = ok[word]
            tokens, word, inside = tokens[keep], word[keep], inside[keep]
            ends = np.cumsum(at[tokens + 1] - at[tokens])
            if coarse is not None:
                coarse = coarse[keep] - moved[word]
                odd = np.zeros(len(words), bool)
                odd[word[~inside & (coarse != ends)]] = True
                inside |= odd[word]
                ends = np.where(inside, ends, coarse)
            out += [np.bincount(word, minlength=len(words))[ok], tokens, ends, inside]
        return np.flatnonzero(ok), *out

    def learn(self, words: list[str], plain: bool) -> None:
        """Aligns words: (spelt, n_a, n_b, n_groups, n_links), the groups as written, and the different id pairs with their links."""
        own, n_a, a, a_end, inside_a, n_b, b, b_end, inside_b = self.spelt(words, plain)
        numbers = np.zeros((len(words), 5), np.int64)
        sizes, pair_sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        written, code, links = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(own):
            cuts = np.intersect1d(a_end[~inside_a], b_end[~inside_b], assume_unique=True)
            # Where spans say nothing on either side the decoded ends decide.
            if inside_a.any() or inside_b.any():
                fine = np.intersect1d(a_end[inside_a], b_end, assume_unique=True), np.intersect1d(a_end, b_end[inside_b], assume_unique=True)
                cuts = np.sort(np.concatenate([cuts, *fine]))
                cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
            group_a, group_b = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
            per_a, per_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
            last = np.searchsorted(cuts, a_end[np.cumsum(n_a) - 1])
            n_groups = np.diff(last + 1, prepend=0)
            n_links = np.add.reduceat(per_a * per_b, last + 1 - n_groups)
            numbers[own] = np.stack([np.ones(len(own), np.int64), n_a, n_b, n_groups, n_links], axis=1)
            written, ends = self.said(a, b, per_a, per_b)
            sizes[own] = np.diff(ends[last], prepend=0)
            word, code, links = self.pairs(np.repeat(own, n_groups), a, group_a, per_a, b, group_b, per_b)
            pair_sizes = np.bincount(word, minlength=len(words))
        first = len(self.known)
        self.known.update((w, first + k) for k, w in enumerate(words))
        self.numbers.add(numbers)
        self.uses.add(np.zeros((len(words), 1), np.int64))
        self.written.add(written, sizes)
        self.codes.add(code, pair_sizes)
        self.links.add(links, pair_sizes)

    def aligned(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, groups_sha256) a text; then the different (text, id pair) with their numbers of links)."""
        if len(self.known) > REMEMBERED or self.written.size > CHUNK:
            self.forget()
        words = [(CUT.split(" " + t) if self.cuts_words else [" " + t]) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.known]
        # Words that can't have another one behind them are few, and learnt apart.
        parts: dict[tuple[bool, bool], list[str]] = {}
        for w in new:
            parts.setdefault((w.isascii(), CLOSED.match(w, len(w) - 1) is not None), []).append(w)
        for (plain, _), some in parts.items():
            for k in range(0, len(some), WORDS):
                self.learn(some[k : k + WORDS], plain)
        sizes = np.array([len(w) for w in words])
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        self.uses.data[: self.uses.size, 0] += np.bincount(which, minlength=self.uses.size)
        doc, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
        numbers = self.numbers.take(which)
        # A text of which one word isn't spelt has no tokens.
        spelt = np.bincount(doc, numbers[:, 0] == 0, len(texts)) == 0
        keep = spelt[doc]
        which, doc, numbers = which[keep], doc[keep], numbers[keep]
        totals = np.zeros((len(texts), 4), np.int64)
        np.add.at(totals, doc, numbers[:, 1:])
        view = memoryview(self.written.take(which).tobytes())
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, self.written.lengths(which), len(texts)).astype(np.int64))]).tolist()
        rows = []
        for t, (x, y) in zip(totals.tolist(), zip(ends, ends[1:])):
            rows.append((*t, hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else ""))
        owner = np.repeat(doc, self.codes.lengths(which))
        return rows, *counted(owner, self.codes.take(which), self.links.take(which))

    def said(self, a, b, per_a, per_b) -> tuple[np.ndarray, np.ndarray]:
        """The groups as a1,a2|b1;a3|b2,b3; each with its end, and where they end."""
        first = np.cumsum(per_a + per_b) - per_a - per_b
        ids = np.empty(len(a) + len(b), np.int64)
        g, k = ragged(per_a)
        ids[first[g] + k] = a
        g, k = ragged(per_b)
        ids[first[g] + per_a[g] + k] = b
        written = gather(self.digits, self.digits_at, ids)
        stop = np.cumsum(self.digits_at[ids + 1] - self.digits_at[ids])
        written[stop[first + per_a - 1] - 1] = ord("|")
        ends = stop[first + per_a + per_b - 1]
        written[ends - 1] = ord(";")
        return written, ends

    def pairs(self, owner, a, group_a, per_a, b, group_b, per_b):
        """(owner, id pair, links) for the different id pairs of each owner of groups."""
        made = []
        dense = per_a * per_b > DENSE
        first_b = np.cumsum(per_b) - per_b
        plain = ~dense[group_a]
        left, g = a[plain], group_a[plain]
        row, k = ragged(per_b[g])
        made.append(counted(owner[g[row]], left[row] * self.n_b + b[first_b[g[row]] + k], np.ones(len(row), np.int64)))
        for g in np.flatnonzero(dense).tolist():
            x, nx = np.unique(a[group_a == g], return_counts=True)
            y, ny = np.unique(b[group_b == g], return_counts=True)
            step = max(1, PAIRS // len(y))
            for i in range(0, len(x), step):
                code = (x[i : i + step, None] * self.n_b + y).ravel()
                made.append((np.full(len(code), owner[g]), code, (nx[i : i + step, None] * ny).ravel()))
        return counted(*(np.concatenate(c) for c in zip(*made))) if len(made) > 1 else made[0]


def words_are_apart(a: dict, b) -> bool:
    """Whether no token of either vocabulary can reach over a space behind a word: A cuts by its pattern before it merges, and no piece of B
    has a space behind anything else."""
    split = a.get("pre_tokenizer") or {}
    by_pattern = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not a.get("normalizer")
    return by_pattern and not any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(b.get_piece_size()))


def numbers_of(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all numbers) of lists."""
    return np.array([*map(len, lists)], np.int64), np.fromiter(chain.from_iterable(lists), np.int64)


class Rows:
    """Rows of numbers that grow."""

    def __init__(self, kind, width: int):
        self.data, self.size = np.zeros((1024, width), kind), 0

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros((max(len(self.data), len(rows)), self.data.shape[1]), self.data.dtype)])
        self.data[self.size : self.size + len(rows)] = rows
        self.size += len(rows)

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.data[which]

    def only(self, keep: np.ndarray) -> "Rows":
        rows = Rows(self.data.dtype, self.data.shape[1])
        rows.add(self.data[: self.size][keep])
        return rows


class Segments:
    """Ragged rows that grow: one flat array and where rows begin."""

    def __init__(self, kind):
        self.flat, self.at = Rows(kind, 1), Rows(np.int64, 1)
        self.at.add(np.zeros((1, 1), np.int64))

    @property
    def size(self) -> int:
        return self.flat.size

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.at.add((self.flat.size + np.cumsum(lengths))[:, None])
        self.flat.add(values[:, None])

    def lengths(self, which: np.ndarray) -> np.ndarray:
        at = self.at.data[:, 0]
        return at[which + 1] - at[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        return gather(self.flat.data[:, 0], self.at.data[:, 0], which)

    def only(self, keep: np.ndarray) -> "Segments":
        lengths, some = np.diff(self.at.data[: self.at.size, 0]), Segments(self.flat.data.dtype)
        some.add(self.flat.data[: self.size, 0][np.repeat(keep, lengths)], lengths[keep])
        return some


def counted(doc: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (doc, code), in order, with the sums of n."""
    if not len(doc):
        return doc, code, n
    width = int(code.max()).bit_length()
    # One key for both where 63 bits hold it.
    one_key = width + int(doc.max()).bit_length() < 64
    order = np.argsort(doc << width | code) if one_key else np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(first)
    return doc[at], code[at], np.add.reduceat(n[order], at)


@lru_cache(maxsize=4)
def contents(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return f.read(), g.read()


PER_TEXT = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
# Rows of texts (pairs as places in the chunk's list, and their links) and rows of a chunk's list (code, n_docs).
CHUNKED = "chunk long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, links binary, code long, n_docs long"
DIGEST = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def in_chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Texts and id pairs of chunks of documents, see CHUNKED."""
    files = docs.sparkSession.sparkContext.broadcast(contents(a_path, b_path))
    key = hashlib.sha1(repr((a_path, b_path)).encode()).hexdigest()

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(key, lambda: Aligner(*files.value))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            _, offsets = flat(texts)
            for i, j in doc_ranges(offsets, CHUNK):
                number += 1
                rows, doc, code, links = [], [], [], []
                for x, y in doc_ranges(offsets[i : j + 1], PIECE):
                    some = aligner.aligned(texts.slice(i + x, y - x).to_pylist())
                    for one, new in zip((rows, doc, code, links), (some[0], some[1] + x, *some[2:])):
                        one.extend(new) if one is rows else one.append(new)
                doc, code, links = (np.concatenate(c) for c in (doc, code, links))
                listed, place, n_docs = np.unique(code, return_inverse=True, return_counts=True)
                at = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                place, links = place.astype(np.uint32), links.astype(np.uint64)
                binary = [pa.array([c[p:q].tobytes() for p, q in zip(at, at[1:])], pa.binary()) for c in (place, links)]
                per_text = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), PER_TEXT)]
                yield rows_of(j - i, [pa.array(np.full(j - i, number)), ids.slice(i, j - i), *per_text, *binary, None, None], ids.type)
                for k in range(0, len(listed), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    n = len(listed[part])
                    yield rows_of(n, [pa.array(np.full(n, number)), *[None] * 8, pa.array(listed[part]), pa.array(n_docs[part])], ids.type)

    def rows_of(n: int, columns: list, id_type) -> pa.RecordBatch:
        types = [pa.int64(), id_type, *[t for _, t in PER_TEXT], pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["chunk", "doc_id", *[c for c, _ in PER_TEXT], "places", "links", "code", "n_docs"]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, types)], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(chunked, CHUNKED.format(id=id_type(docs, id_col)))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def link_counts(lists: DataFrame, n_b: int) -> DataFrame:
    """(code, n_docs, best): documents that link the ids of each code, and whether no other partner of its A id has more."""
    counts = lists.groupBy("code").agg(F.sum("n_docs").alias("n_docs"))
    # One row an A id: the vocabulary's size bounds it.
    most = counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("n_docs").alias("most"))
    found = counts.withColumn("a", F.expr(f"code div {n_b}")).join(F.broadcast(most), "a")
    return found.select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): the linked ids of two vocabularies, as a translation table."""
    n_b = vocabulary_size(b_path)
    rows = cut(in_chunks(docs, a_path, b_path, id_col, text_col).filter("code is not null").select("code", "n_docs"), "links")
    return link_counts(rows, n_b).select(F.expr(f"code div {n_b}").alias("a"), (F.col("code") % n_b).alias("b"), "n_docs", "best")


@lru_cache(maxsize=4)
def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    rows = cut(in_chunks(docs, a_path, b_path, id_col, text_col), "chunks")
    lists = rows.filter("code is not null").select("chunk", "code", "n_docs")
    counts = link_counts(lists.select("code", "n_docs"), vocabulary_size(b_path))
    back = lists.select(F.col("chunk").alias("home"), "code").join(counts, "code")
    texts = rows.filter("code is null").drop("code", "n_docs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def added(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["code"].to_numpy())
        n_docs = pairs["n_docs"].to_numpy()[order]
        best = pairs["best"].to_numpy()[order]
        n_best, total = [], []
        for place, n in zip(texts["places"], texts["links"]):
            place, n = np.frombuffer(place.as_buffer(), np.uint32), np.frombuffer(n.as_buffer(), np.uint64).astype(np.int64)
            n_best.append(int(n[best[place]].sum()))
            total.append(int((n * n_docs[place]).sum()))
        more = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([more.get(c) if c in more else texts[c] for c in names], names)

    both = texts.groupBy("chunk").cogroup(back.groupBy("home"))
    return both.applyInArrow(added, DIGEST.format(id=id_type(docs, id_col)))


