"""Shards, mixes, near copies, private data, classifiers and the pipeline, on small tables with odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from episodica.llm import jaccard, mixing, pii, quality, queries, sharding, toxicity
from episodica.llm.labelled import fold

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("limit", [1, 700, 40_000, 1 << 30])
def test_shards_fit(odd, limit):
    rows = sharding.plan_shards(odd, limit).collect()
    assert len(rows) == odd.count()
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r.bytes
    for r in rows:
        if r.bytes > limit:
            assert r.shard.endswith(":big") and r.shard_bytes == r.bytes
        else:
            assert held[r.shard] == r.shard_bytes <= limit


def test_only_oversized_buckets_split(frame):
    rows = sharding.plan_shards(frame([(i, "x" * 100) for i in range(500)]), 3000).collect()
    bucket = {(r.bits, r.h >> (60 - r.bits)): r.shard_bytes for r in rows}
    for bits, b in bucket:
        if bits:
            inside = sum(r.bytes for r in rows if r.h >> (60 - bits + 1) == b >> 1)
            assert inside > 3000


def test_copies_of_a_row_are_sliced(frame):
    rows = sharding.plan_shards(frame([(1, "x" * 100)] * 50), 1000).collect()
    assert len({r.shard for r in rows}) == 5 and all(r.shard_bytes == 1000 for r in rows)


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 40_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_targets_fill_up(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 40), (None, 0), (None, 950)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized, mixing.Curriculum()).collect()}
    # a and c are capped at 30 and 120; b (weight 2) and null (weight 1) share the rest.
    assert got["a"] == 30 and got["c"] == 120
    assert got["b"] == pytest.approx(1850 * 2 / 3) and got[None] == pytest.approx(1850 / 3)


def test_mix(frame, odd):
    docs = frame([(i, "w " * (i % 17), f"s{i % 4}") for i in range(800)]).unionByName(odd)
    plan = mixing.plan_mix(docs).collect()
    assert sum(r.n_rows for r in plan) == docs.count()
    taken, sizes, target, most = Counter(), Counter(), {}, defaultdict(int)
    for r in plan:
        assert r.copies == len(r.positions) <= 3 and all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.copies * r.size * r.n_rows
        sizes[r.source] += r.size * r.n_rows
        target[r.source], most[r.source] = r.target, max(most[r.source], r.size * r.n_rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] and target[s] <= 3 * sizes[s] + 1e-6
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    out = mixing.mixed(docs.withColumn("position", F.lit("mine")))
    rows = out.collect()
    assert len(rows) == sum(r.copies * r.n_rows for r in plan) and {r.position for r in rows} == {"mine"}
    assert [r.position_ for r in rows] == sorted(r.position_ for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_blocks_do_not_matter(frame, monkeypatch):
    docs = frame([(i, "w " * (i % 7 + 1), "s") for i in range(300)])
    want = {(r.doc_id, tuple(r.positions)) for r in mixing.plan_mix(docs).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 10)
    assert {(r.doc_id, tuple(r.positions)) for r in mixing.plan_mix(docs).collect()} == want


def test_demand_time(spark):
    """Positions follow the schedule: the share of tokens before time t is the integral up to t."""
    shape = ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0))
    t = [r[0] for r in spark.range(101).select(mixing.demand_time(F.col("id") / 100.0, shape)).collect()]
    total = 0.25 + 0.625
    for k, x in enumerate(t):
        area = 0.5 * x if x <= 0.5 else 0.25 + 0.5 * (x - 0.5) + 1.5 * (x - 0.5) ** 2
        assert area / total == pytest.approx(k / 100, abs=1e-9)


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    ids = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        ids[group[k]].append(doc)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in ids.items()}
    return sorted(((d, len(sets[k]), least[group[k]] if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def near_copies():
    import random

    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([7, 40, 120, 300]))]
        for _ in range(rng.choice([2, 3, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                own[rng.randrange(len(own))] = f"r{rng.random()}"
            rows.append(own)
    rows += [[f"u{k}x{i}" for i in range(80)] + passage for k in range(50)]
    return [(1000 - k, " ".join(w).upper() if k % 3 == 0 else "  ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("pairs_per_entry", [0, 4])
def test_components_like_brute_force(frame, odd, monkeypatch, pairs_per_entry):
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", pairs_per_entry)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 7)
    docs = frame(near_copies()).unionByName(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard.clusters(docs).collect()), key=str) == plain_components(rows)


def test_large_sets_meet_in_few_rows(spark, frame):
    """Pairs of large sets a little too unlike to link: the token join gives out a few rows a pair, not one for each token they share."""
    import random

    rng = random.Random(9)
    base = [f"b{i}" for i in range(1500)]
    rows = []
    for k in range(12):
        own = list(base)
        for i in rng.sample(range(1500), 34):
            own[i] = f"r{k}x{i}"
        rows.append((k, " ".join(own)))
    docs = frame(rows)
    assert sorted(map(tuple, jaccard.clusters(docs).collect()), key=str) == plain_components(rows)
    sets = docs.select(F.xxhash64("text").alias("text_hash"), jaccard.sketch(F.col("text")).alias("s")).select("text_hash", "s.*")
    entries = jaccard.cut(jaccard.prefix_entries(sets), "entries")
    found = jaccard.candidates(jaccard.with_component(entries, None), sets.select("node", "parity"))
    n_pairs = len(found.collect())
    joins, left = [], [found._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        left += inner + [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName() and "array_intersect" in node.toString():
            joins.append(node.metrics().apply("numOutputRows").value())
    assert n_pairs >= 50 and len(joins) == 1 and joins[0] <= 12 * n_pairs, (n_pairs, joins)


def test_one_of_each(frame, odd):
    docs = frame(near_copies()).unionByName(odd).withColumn("row_key", F.lit(1))
    rows = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    kept = jaccard.without_near_copies(docs)
    groups = {c for d, n, c in rows if n}
    assert kept.columns == docs.columns and kept.count() == len(groups) + sum(not n for _, n, _ in rows)
    assert jaccard.clusters(docs.limit(0)).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        odd, even = d[-1::-2], d[-2::-2]
        return 16 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_base_spans(spark, frame, odd):
    import random

    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@mail.example.com", "..d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "5500005555555559", "79927398713", " ", "-", "5", "+1 (269) 555-3296", "+49 30 1234", "é🙂", "+", "word", "00012.3.4.5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts += ["a@b" + ".c" * 30_000, "1" * 100_000, "1 2-3" * 20_000, "a" * 200_000, "+1" + " " * 100_000, "a.b" * 30_000 + "@c.d"]
    docs = frame(list(enumerate(texts, 100))).unionByName(odd)
    got = docs.select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
    for r in got:
        for kind, pattern in PLAIN.items():
            t = r.text or ""
            if kind == "email" and len(t) > 50_000 and "@" not in t:
                want = []
            elif kind == "ip" and "." not in t:
                want = []
            else:
                want = [(m.start(), m.end()) for m in re.finditer(pattern, t) if accepted(kind, m.group())]
            assert [(s.start, s.end) for s in r.b[kind]] == want, (kind, t[:80])


def test_revealing_terms(frame):
    """A name that stands near one address in several texts is replaced everywhere; common words are not."""
    rows = [(i, f"some text {i} by Zebulon Quirk jo.{'doe'}@x.org about matter number {i}k{i * i}") for i in range(6)]
    rows += [(100 + i, f"some text about matter number {i} by others") for i in range(60)] + [(200, "Zebulon wrote this"), (201, None), (202, "")]
    rows += [(300 + i, "The one copy with lonely words a.b@c.de") for i in range(20)]
    docs = frame(rows).withColumn("pii_key", F.lit("mine"))
    terms = {r.term: r.label for r in pii.revealing_terms(docs).collect()}
    assert set(terms) == {"zebulon", "quirk"} and terms["quirk"] == "" and terms["zebulon"] == "[EMAIL DETAIL]"
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert out[200].text == "[EMAIL DETAIL] wrote this" and out[3].text == "some text 3 by [EMAIL DETAIL]  [EMAIL] about matter number 3k9"
    assert out[300].text == "The one copy with lonely words [EMAIL]" and out[201].text is None and out[100].pii_key == "mine"
    spans = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert spans[200].spans == "term:0:7" and spans[200].n_email == 0 and spans[100].spans == ""
    assert pii.digest(docs.limit(0)).count() == 0


def test_copies_change_no_evidence(frame):
    """Copies of one text with a name neither hide the name nor make the words of that text revealing."""
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(12))} Zebulon jo.{'doe'}@x.org") for i in range(3)]
    rows += [(100 + i, f"some text about matter number {i} by others") for i in range(200)]
    once = {r.term: r.label for r in pii.revealing_terms(frame(rows)).collect()}
    docs = frame(rows + [(1000 + i, rows[0][1]) for i in range(100)])
    assert once == {"zebulon": ""} == {r.term: r.label for r in pii.revealing_terms(docs).collect()}
    assert pii.sanitised(docs).filter(F.lower("text").contains("zebulon")).count() == 0


def test_terms_of_whole_texts(frame):
    """A heading far above an address, a user name with digits and a name of two letters, in two texts of many; near copies are no evidence."""
    far = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(2)]
    rows = [(i, f"Zebulon Qi\n{far[i]} jo.{'doe'}@x.org {far[i][::-1]} user zq77, quirk8.8.4.4") for i in range(2)]
    near = [" ".join(f"n{k}" for k in range(100)) + f" ab.{'cd'}@y.org " + " ".join(f"m{k}" for k in range(100)) for _ in range(2)]
    rows += [(10 + i, t + f" end {i}") for i, t in enumerate(near)] + [(100 + i, f"some text about matter number {i} by others") for i in range(2000)]
    terms = {r.term for r in pii.revealing_terms(frame(rows)).collect()}
    assert terms == {"zebulon", "qi", "user", "zq77", "quirk"}
    out = {r.doc_id: r.text for r in pii.sanitised(frame(rows)).filter("doc_id < 100").collect()}
    assert not any(t in out[0].lower() for t in terms) and "[IP]" in out[1] and "n5" in out[10]


def graded(spark, docs, labels, learn, train, score, label):
    model = train(docs, labels, learn)
    return docs.select("doc_id", score(F.col("text"), model).alias("score")).join(labels, "doc_id").select("doc_id", "score", label)


def test_quality_on_held_out(spark, odd, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    part = fold(F.col("doc_id"), 3)
    rows = graded(spark, docs, labels, part != 1, quality.train, quality.score, "quality").filter(part == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    model = quality.train(docs, labels, part != 1)
    scores = [(r.text, r.score) for r in quality.scored(odd, model).collect()]
    assert all(0 <= s <= 1 for _, s in scores) and len({s for t, s in scores if t in (None, "")}) == 1
    none = quality.train(docs, labels.limit(0), part != 1)
    assert {r.score for r in quality.scored(odd, none).collect()} == {0.5}
    assert quality.scored(odd.limit(0), model).count() == 0


def test_bags_come_in_runs():
    """Runs of documents hold their passages as one batch does; a document of several pieces stays one bag."""
    rng = np.random.default_rng(4)
    words = np.array(["river", "old!", "Stone", "12", "bridge,"])
    texts = [" ".join(words[rng.integers(0, 5, n)]) for n in (0, 1, 64, 65, 20_000, 3, 90_000, 500, 0)] * 2 + ["stone bridge " * 250_000, None, "end"]
    runs = list(quality.bags(pa.array(texts)))
    whole = list(quality.bags(pa.array(texts), 1 << 20))
    assert len(runs) > len(whole) > 2
    assert sum(len(first) - 1 for _, first in runs) == sum(len(first) - 1 for _, first in whole) == len(texts)
    assert np.array_equal(np.concatenate([x for x, _ in runs]), np.concatenate([x for x, _ in whole]))
    assert [d for _, f in runs for d in np.diff(f).tolist()] == [d for _, f in whole for d in np.diff(f).tolist()]
    (alone, _), (beside, _) = (next(quality.bags(pa.array(t, pa.string()))) for t in ([None], ["", "a word"]))
    assert np.array_equal(alone[0], beside[0])


def test_subsequence_kernel():
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(t)), 3):
                if all(s[x] == t[y] for x, y in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    words = [b"idiot", b"i-d-i-o-t", b"lower", b"the", b"idle"]
    codes = toxicity.matrix(words, 12)
    other = codes.copy()
    other[other < 0] = -2
    got = toxicity.kernel(codes, other)
    for a, s in enumerate(words):
        assert toxicity.own_kernel(codes)[a] == pytest.approx(plain(s, s), rel=1e-5)
        for b, t in enumerate(words):
            assert got[a, b] == pytest.approx(plain(s, t), rel=1e-5, abs=1e-7)


def test_toxicity(spark, frame, odd):
    calm = ["the", "quiet", "river", "runs", "under", "old", "stone", "bridges", "while", "people", "watch"]
    rows, marks = [], []
    for i in range(240):
        words = [calm[(i * 7 + k * k) % len(calm)] + ("s" if k % 5 == i % 5 else "") for k in range(12)]
        if i % 4 == 0:
            words[i % 12] = ["dimwit", "numskull"][i // 4 % 2]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs = frame(rows)
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    seen = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert all((seen[i] >= 0.5) == (t == 1) for i, t in marks)
    new = frame([(1, "you d-i-m-w-i-t there"), (2, "such a Nummskull!"), (3, "the quiet rivers"), (4, "d i m w i t"), (5, "")])
    got = {r.doc_id: r.s for r in new.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[4] > 0.5 and got[3] < 0.5 and got[5] < 0.5
    assert all(0 <= r.s <= 1 for r in odd.select(toxicity.score(F.col("text"), model).alias("s")).collect())
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).weights is None


def test_insults_quoted_in_clean_documents(spark, frame):
    """Every insult stands in one clean-labelled document too; it stays an insult."""
    calm = ["the", "quiet", "river", "runs", "under", "old", "stone", "bridges", "while", "people", "watch"]
    rows, marks = [], []
    for i in range(240):
        words = [calm[(i * 7 + k * k) % len(calm)] + ("s" if k % 5 == i % 5 else "") for k in range(12)]
        if i % 4 == 0 or i in (1, 2):
            words[i % 12] = ["dimwit", "numskull"][i // 4 % 2 if i % 4 == 0 else i - 1]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    model = toxicity.train(frame(rows), spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    new = frame([(1, "you dimwit there"), (2, "such a Numskull!"), (3, "the quiet rivers"), (4, "d-i-m-w-i-t")])
    got = {r.doc_id: r.s for r in new.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[4] > 0.5 and got[3] < 0.5


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        seen.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert seen[0] >= seen[1] >= seen[2] == seen[3] and seen[4] == seen[5] > 0


def test_pipeline_stages_like_plain_ones(spark, frame):
    """The stages after the classifier, row by row: one document of each plain component, addresses replaced and nothing else, as many copies as
    the source's target asks for, tiktoken's ids."""
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    # Long numbers in the words would be read as cards.
    letters = str.maketrans("0123456789.", "abcdefghijk")
    rows = [(d, re.sub(r"r0\.\d+", lambda m: m.group().translate(letters), t.lower()), f"s{d % 3}") for d, t in near_copies()[:120]]
    rows += [(5000 + k, f"write to person{k}@mail{k}.org about {k} things", "s1") for k in range(4)] + [(6000, None, "s0"), (6001, "", None), (6002, "naïve 漢字 🙂", "s2")]
    docs = frame(rows)
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["near_copies"](spark, docs, "").cache()
    first = {}
    for d, n, c in plain_components([(r[0], r[1]) for r in rows]):
        if n:
            first[c] = min(d, first.get(c, d))
    want = {d: t for d, t, _ in rows if d in first.values() or not (t or "").split()}
    assert {r.doc_id: r.text for r in kept.collect()} == want and kept.count() == len(want) and kept.columns == docs.columns
    clean = steps["private_data"](spark, kept, "").cache()
    for r in clean.collect():
        text = want[r.doc_id]
        text = text if text is None else re.sub(PLAIN["email"], "[EMAIL]", text)
        assert r.text == text and (text is None or r.n_chars == len(text))
    mixed = steps["mix"](spark, clean, "").cache()
    copies, sizes, source = Counter(r.doc_id for r in mixed.collect()), {}, {}
    for r in clean.collect():
        sizes[r.doc_id], source[r.doc_id] = len(WORD.findall(r.text or "")), r.source
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s))
    total = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > 3 * total[s]}
        target.update({s: 3 * total[s] for s in over} if over else {s: weight[s] * share for s in left})
        left -= over if over else left
    for s in names:
        taken = sum(copies[d] * n for d, n in sizes.items() if source[d] == s)
        assert abs(taken - target[s]) <= max(n for d, n in sizes.items() if source[d] == s) and max(copies[d] for d in sizes if source[d] == s) <= 3
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    out = steps["tokens"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in out) == copies
    for r in out:
        assert list(r.ids) == plain.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_every_operator_is_registered():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)} and set(corpus_pipeline.QUERIES) == {"pipeline"}
