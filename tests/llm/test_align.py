"""The alignment of two tokenizers beside a plain restatement with the two libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodica.llm import align, queries

A, B = public_tokenizers.path(queries.A_FILE), public_tokenizers.path(queries.B_FILE)


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, one token and one pair at a time."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes = align.bytes_of_a(a)

    def b_token(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    groups = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        one, other = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in one) != raw or b"".join(map(b_token, other)) != raw:
            groups.append(None)
            continue
        found, x, y, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(one) or j < len(other):
            if at_a <= at_b and i < len(one):
                x.append(one[i])
                at_a += len(a_bytes[one[i]])
                i += 1
            else:
                y.append(other[j])
                at_b += len(b_token(other[j]))
                j += 1
            if at_a == at_b:
                found.append((x, y))
                x, y = [], []
        groups.append(found)
    per_doc = [Counter((x, y) for one, other in g or [] for x in one for y in other) for g in groups]
    docs = Counter(pair for c in per_doc for pair in c)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for g, c in zip(groups, per_doc):
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for pair, n in c.items() if docs[pair] == most[pair[0]])
        total = sum(n * docs[pair] for pair, n in c.items())
        sizes = sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values())
        out.append((*sizes, best, total, hashlib.sha256(said.encode()).hexdigest()))
    return out


TEXTS = [
    None, "", " ", "one", "one", "  two  spaces\n\ttabs \r\n", "naïve café 漢字🙂🙂 ½ İstanbul x　y", "▁ underlined ▁", "<|endoftext|> <s></s> <unk> <0x41>",
    "👩‍👩‍👧‍👦 ꙮ 𐍈 ﷽ é", "x" * 5000, "ab" * 3001 + " 漢" * 700, " ".join(f"w{i % 97} Ünï{i % 13}" for i in range(4000)), "\x00\x01﻿", "a" * 64 + "🙂" * 64,
]


def rows_of(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r.doc_id is not None, r.doc_id or 0, *[r[c] for c in names]) for r in df.collect())


def test_equals_the_plain_version(frame, odd):
    docs = frame(list(enumerate(TEXTS))).unionByName(odd)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((d is not None, d or 0, *row) for (d, _), row in zip(texts, plain([t for _, t in texts])))
    extra = docs.withColumn("text_", F.lit(1)).withColumn("n_a", F.lit("mine")).withColumn("chunk", F.lit(None))
    assert rows_of(align.digests(extra, A, B)) == want


@pytest.mark.parametrize("chunk,piece", [(1, 1), (3000, 700)])
def test_chunks_do_not_matter(frame, odd, monkeypatch, chunk, piece):
    docs = frame(list(enumerate(TEXTS))).unionByName(odd)
    want = rows_of(align.digests(docs, A, B))
    monkeypatch.setattr(align, "doc_ranges", lambda offsets, limit: align_ranges(offsets, chunk if limit == align.CHUNK else piece))
    assert rows_of(align.digests(docs.repartition(5), A, B)) == want


from episodica.llm.textops import doc_ranges as align_ranges  # noqa: E402


def test_dense_groups():
    """A group of many tokens on both sides, as two tokenizers give that never end together."""
    import numpy as np

    one = align.Aligner(*align.contents(A, B))
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 7, 90)
    per_a, per_b = np.array([150, 50]), np.array([80, 10])
    group_a, group_b = np.repeat([0, 1], per_a), np.repeat([0, 1], per_b)
    doc, code, n = one.pairs(np.array([4, 4]), a, group_a, per_a, b, group_b, per_b)
    want = Counter(int(x) * one.n_b + int(y) for g in (0, 1) for x in a[group_a == g] for y in b[group_b == g])
    assert dict(zip(code.tolist(), n.tolist())) == want and set(doc.tolist()) == {4}


def test_texts_that_end_in_a_space(frame):
    texts = ["word ", "two words ", "a  ", " ", " a ", "é ", "9 \n ", "漢 ", "end.", "x \x85", "word\n "]
    docs = frame(list(enumerate(texts)))
    assert rows_of(align.digests(docs, A, B)) == [(True, d, *row) for d, row in enumerate(plain(texts))]
    assert all(r.n_a > 0 for r in align.digests(docs.filter("doc_id < 3"), A, B).collect())


def test_used_words_stay_known(monkeypatch):
    """A worker whose memory is full forgets the words it met once, and aligns the others only once."""
    monkeypatch.setattr(align, "REMEMBERED", 40)
    one = align.Aligner(*align.contents(A, B))
    learnt, learn = Counter(), one.learn
    monkeypatch.setattr(one, "learn", lambda words, plain: (learnt.update(words), learn(words, plain)))
    texts = ["the house, the größe. the house " + " ".join(f"n{k}x{i}é" for i in range(30)) for k in range(6)] + TEXTS[1:]
    rows = [one.aligned([t])[0][0] for t in texts]
    assert rows == [(*r[:4], r[6]) for r in plain(texts)]
    assert learnt[" the"] == learnt[" house"] == 1 and len(one.known) < 100 + 4000


def test_words_are_encoded_together():
    """Words of a batch go to A as one text, and come back as each alone."""
    one = align.Aligner(*align.contents(A, B))
    for words, is_plain in (([" the", " house,", " it's", " 12.5", " \nnew", " (x)"], True), ([" größe", " 漢字,", " \n½", " naïve."], False)):
        sent, encode = [], one.a
        calls = {n: getattr(encode, n) for n in ("encode_batch", "encode_batch_fast")}
        one.a = type("Seen", (), {n: staticmethod(lambda w, _f=f, **k: (sent.append(len(w)), _f(w, **k))[1]) for n, f in calls.items()})
        n_a, ids, offsets = one.tokens_of_a(words, is_plain)
        one.a = encode
        alone = encode.encode_batch(words, add_special_tokens=False)
        assert sent == [1] and n_a.tolist() == [len(x.ids) for x in alone] and ids.tolist() == [i for x in alone for i in x.ids]
        assert is_plain or offsets.tolist() == [list(o) for x in alone for o in x.offsets]


def test_links_and_empty_table(frame):
    docs = frame([(1, "the house"), (2, "the house"), (3, None)])
    found = align.links(docs, A, B).collect()
    assert found and all(r.n_docs == 2 and r.best for r in found)
    assert align.digests(docs.limit(0), A, B).count() == 0 and align.links(docs.limit(0), A, B).count() == 0


def test_query(spark, sf):
    got = queries.QUERIES["op12_token_alignment"](spark, sf)
    texts = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    assert rows_of(got) == sorted((True, d, *row) for (d, _), row in zip(texts, plain([t for _, t in texts])))
