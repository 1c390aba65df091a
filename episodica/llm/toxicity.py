"""Toxicity: a support vector machine on a string subsequence kernel, with Nyström landmarks.

The kernel compares strings by the subsequences of three bytes they share, each weighted by DECAY to the power of the
length it spans in both, so that gaps and inserted characters weaken a likeness without ending it. Landmarks are short
strings: those that mark toxic documents in the labelled statistics, and frequent words of clean ones. A unit (a word
without surrounding punctuation, a run of single letters written apart, a part of a very long word) is mapped to its
normalised kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix; a linear SVM
with squared hinge decides on that. It learns from the words of labelled sentences and from variants of the toxic ones
with characters put in between. A word with a telling string counts as toxic by its share of toxic documents, and as
clean by the rest, so that a clean document that quotes an insult, or a wrong label, takes little from it. A text is as toxic as its worst unit, made a probability by logistic calibration.

Bounds: learning takes at most PER_CLASS labelled documents of a class and MOST_WORDS of their words.

Cases: null, empty or wordless texts have no unit and get the lowest score; without both classes, or without any telling
string, every score is 0; repeated rows get equal scores; texts are read whole, a megabyte at a time.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import text_of, words
from episodica.llm.labelled import learning_sample, with_text
from episodica.llm.textops import LOWER, kept, ragged, span_hashes, text_parts, word_spans

ORDER, DECAY = 3, 0.75
LONGEST, LANDMARK = 24, 12
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 28, 16
PER_CLASS = 4000
MOST_WORDS = 12_000
TELLING = 18.0
REMEMBERED = 1 << 18
# Bytes that may stand within a unit's edges: letters, digits and all of other scripts.
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[97:123] = SOLID[128:] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True


def matrix(units: list[bytes], width: int) -> np.ndarray:
    """Units as rows of byte codes; beyond a unit's end codes match nothing."""
    out = np.full((len(units), width), -1, np.int16)
    for i, u in enumerate(units):
        out[i, : len(u)] = np.frombuffer(u, np.uint8)
    return out


def subsequences(same: np.ndarray) -> np.ndarray:
    """Kernel values from matches: [i, j, ...] is DECAY ** 2 where byte i of one string is byte j of the other.

    Each round sums, for every match, what ends before it in both strings, weakened by the way to it."""
    part = same
    for _ in range(ORDER - 1):
        row = np.zeros_like(part)
        for j in range(1, part.shape[1]):
            np.multiply(row[:, j - 1], np.float32(DECAY), out=row[:, j])
            row[:, j] += part[:, j - 1]
        both = np.zeros_like(part)
        for i in range(1, part.shape[0]):
            np.multiply(both[i - 1], np.float32(DECAY), out=both[i])
            both[i] += row[i - 1]
        both *= same
        part = both
    return part.sum(axis=(0, 1))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernel of every row of a with every row of b (byte codes, -1 and -2 for none)."""
    same = (a.T[:, None, :, None] == b.T[None, :, None, :]).astype(np.float32)
    same *= np.float32(DECAY**2)
    return subsequences(same)


def own_kernel(a: np.ndarray) -> np.ndarray:
    """Each row's kernel with itself."""
    t = a.T
    return subsequences(((t[:, None] == t[None]) & (t[None] >= 0)).astype(np.float32) * np.float32(DECAY**2))


@dataclass
class Model:
    """Landmarks, the map to features, the SVM and its calibration; `weights` is None where nothing was learned."""

    landmarks: np.ndarray | None = None
    norms: np.ndarray | None = None
    whiten: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = -1.0
    slope: float = 1.0
    shift: float = 0.0
    sized: list | None = None

    def name(self) -> str:
        parts = (self.landmarks, self.whiten, self.weights, np.array(self.bias))
        return hashlib.sha1(b"".join(p.tobytes() for p in parts)).hexdigest()

    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(their numbers, codes) of the landmarks of about one length."""
        if self.sized is None:
            size = (self.landmarks >= 0).sum(axis=1)
            edges = [(0, 3), (3, 5), (5, 8), (8, LANDMARK)]
            own = [np.flatnonzero((size > lo) & (size <= hi)) for lo, hi in edges]
            self.sized = [(k, self.landmarks[k, : size[k].max()]) for k in own if len(k)]
        return self.sized

    def likeness(self, units: list[bytes]) -> np.ndarray:
        """Normalised kernel values with the landmarks, units in blocks of about one length."""
        out = np.zeros((len(units), len(self.norms)), np.float32)
        order = sorted((k for k in range(len(units)) if len(units[k]) >= ORDER), key=lambda k: len(units[k]))
        at = 0
        while at < len(order):
            own = order[at : at + 256]
            codes = matrix([units[k] for k in own], len(units[own[-1]]))
            norm = np.sqrt(np.maximum(own_kernel(codes), 1e-12))
            for k, marks in self.blocks():
                out[np.ix_(own, k)] = kernel(codes, marks) / norm[:, None] / self.norms[None, k]
            at += len(own)
        return out

    def decide(self, units: list[bytes]) -> np.ndarray:
        return self.likeness(units) @ (self.whiten @ self.weights) + self.bias


def edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without the punctuation around them; nothing is left of a word of punctuation."""
    solid = SOLID[data]
    after = np.where(solid, np.arange(len(data)), len(data))
    after = np.minimum.accumulate(after[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, np.arange(len(data)), -1))
    a, b = after[starts], before[ends - 1] + 1
    return np.minimum(a, ends), np.maximum(b, np.minimum(a, ends))


def units_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """(starts, ends, document) of the units in lower-case bytes, and (document, unit) of letters written apart."""
    starts, ends, doc = word_spans(data, bounds)
    if not len(starts):
        return starts, ends, doc, []
    single = (ends - starts == 1) & LETTER[data[starts]]
    apart = []
    if single.any():
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= ORDER:
                cut = [a, *(np.flatnonzero(np.diff(doc[a:b])) + a + 1).tolist(), b]
                for x, y in zip(cut, cut[1:]):
                    for z in range(x, y, LONGEST // 2):
                        apart.append((int(doc[x]), data[starts[z : min(y, z + LONGEST)]].tobytes()))
    starts, ends = edges(data, starts, ends)
    long = ends - starts > LONGEST
    if long.any():
        # Overlapping parts of very long words.
        n = -(-(ends[long] - starts[long]) // (LONGEST // 2))
        owner, k = ragged(n)
        a = starts[long][owner] + k * (LONGEST // 2)
        b = np.minimum(a + LONGEST, ends[long][owner])
        d = np.concatenate([doc[~long], doc[long][owner]])
        starts, ends = np.concatenate([starts[~long], a]), np.concatenate([ends[~long], b])
        order = np.argsort(d, kind="stable")
        starts, ends, doc = starts[order], ends[order], d[order]
    keep = ends - starts >= ORDER
    return starts[keep], ends[keep], doc[keep], apart


class Scorer:
    """A worker's scorer, which remembers the decision on every unit it has met lately."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def worst(self, batch: pa.Array) -> np.ndarray:
        """The highest decision on a unit of each text; -inf without units."""
        out = np.full(len(batch), -np.inf)
        for i, data, bounds in text_parts(batch):
            data = LOWER[data]
            starts, ends, doc, apart = units_of(data, bounds)
            if len(starts):
                keys, example, owner = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                value = self.values(data, keys.tolist(), starts[example].tolist(), ends[example].tolist())
                np.maximum.at(out, doc + i, value[owner])
            if apart:
                np.maximum.at(out, np.array([d for d, _ in apart]) + i, self.model.decide([u for _, u in apart]))
        return out

    def values(self, data: np.ndarray, keys: list[int], starts: list[int], ends: list[int]) -> np.ndarray:
        found = [self.young.get(k) for k in keys]
        missing = []
        for i, v in enumerate(found):
            if v is None:
                v = self.old.get(keys[i])
                if v is None:
                    missing.append(i)
                else:
                    found[i] = self.young[keys[i]] = v
        if missing:
            raw = data.tobytes()
            decided = self.model.decide([raw[starts[i] : ends[i]] for i in missing]).tolist()
            for i, v in zip(missing, decided):
                found[i] = self.young[keys[i]] = v
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return np.array(found, float)


def likelihood_ratio(hits: Column, others: Column, n_hits: int, n_others: int) -> Column:
    """Twice the log likelihood ratio that a string belongs to one class more than chance would have it."""

    def part(seen: Column, n: int) -> Column:
        mean = (hits + others) * F.lit(n / (n_hits + n_others))
        return F.when(seen > 0, seen * F.log(seen / mean)).otherwise(0.0)

    more = hits * n_others > others * n_hits
    return F.when(more, 2 * (part(hits, n_hits) + part(others, n_others))).otherwise(0.0)


def word_statistics(sample: DataFrame) -> DataFrame:
    """(word, hits, others): in how many toxic and clean sampled documents each lower-case unit stands."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = sample.select("label", F.explode(F.array_distinct(words(text_of(lower)))).alias("word"))
    bare = F.regexp_replace("word", r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$", "")
    each = each.withColumn("word", bare).filter(F.length("word").between(ORDER, LONGEST))
    return each.groupBy("word").agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("others"))


def telling_strings(stats: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(gram, hits, others, ratio): words and their parts of five and six characters that mark toxic documents."""

    def of_size(n: int) -> Column:
        last = F.length("word") - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(n)))

    parts = F.concat(F.array("word"), of_size(5), of_size(6))
    grams = stats.select("hits", "others", F.explode(F.array_distinct(parts)).alias("gram"))
    grams = grams.groupBy("gram").agg(F.sum("hits").alias("hits"), F.sum("others").alias("others"))
    ratio = likelihood_ratio(F.col("hits").cast("double"), F.col("others").cast("double"), n_toxic, n_clean)
    pure = F.col("hits") * n_clean >= 20 * F.col("others") * n_toxic
    return grams.withColumn("ratio", ratio).filter((F.col("ratio") >= TELLING) & (F.col("hits") >= 3) & pure)


def variants(unit: bytes) -> list[bytes]:
    """A toxic unit with characters put in."""
    half = len(unit) // 2
    return [b"-".join(unit[k : k + 1] for k in range(len(unit)))[:LONGEST], unit[:half] + b"." + unit[half:], unit[:1] + b"*" + unit[1:],
            unit[:half] + unit[half - 1 : half] + unit[half:]]


def diverse(candidates: list[bytes], n: int, most: float) -> list[bytes]:
    """The first n candidates that are not too like an earlier one."""
    chosen: list[bytes] = []
    for c in candidates:
        if len(chosen) == n:
            break
        codes = matrix([*chosen, c], max(map(len, [*chosen, c])))
        if chosen:
            other = np.where(codes < 0, -2, codes)
            norm = np.sqrt(np.maximum(own_kernel(codes), 1e-12))
            if (kernel(codes[-1:], other[:-1])[0] / norm[:-1] / norm[-1]).max() > most:
                continue
        chosen.append(c)
    return chosen


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xa = x[inside] * weight[inside, None]
        w_new = np.linalg.solve(xa.T @ x[inside] + np.diag(ridge), xa.T @ y[inside])
        if np.allclose(w, w_new, atol=1e-9):
            break
        w = w_new
    return w


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the calibration. The rarer class weighs more by the root of the imbalance; a small penalty keeps
    the slope off infinity."""
    share = np.where(y == 1, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    share /= share.sum()
    w, x = np.array([1.0, 0.0]), np.column_stack([f, np.ones(len(f))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-6])
        step = np.linalg.solve(h, x.T @ (share * (p - y)) + np.array([1e-4, 1e-6]) * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learns from documents whose labels pass `learn`, a condition on labels."""
    sample = with_text(docs, learning_sample(labels, label, learn, per_class), id_col, text_col)
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    stats = word_statistics(sample).persist()
    telling = telling_strings(stats, n_toxic, n_clean).orderBy(F.desc("ratio"), F.length("gram"), "gram").limit(400).collect()
    whole = [r for r in telling if not any(r["gram"] in o["gram"] and r is not o and o["hits"] >= 0.7 * r["hits"] for o in telling)]
    marks = [r["gram"].encode() for r in whole]
    toxic = diverse([m for m in marks if len(m) <= LANDMARK], TOXIC_LANDMARKS, 0.6)
    clean = stats.filter("hits + others >= 2 AND others > 0").select("word", "others", "hits")
    frequent = [r[0].encode() for r in clean.orderBy(F.desc("others"), "word").limit(MOST_WORDS // 2).collect()]
    rare = [r[0].encode() for r in stats.filter("others > 0").orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS // 2).collect()]
    has = F.col("word").rlike("|".join(rf"\Q{r['gram']}\E" for r in telling if "\\E" not in r["gram"]) or "$^")
    # Of a word with a telling string, which counts as one toxic hit more; of other words nothing is toxic.
    share = (F.col("hits") + 1) / (F.col("hits") + 1 + F.col("others") * (n_toxic / n_clean))
    stats_has = stats.filter(has).withColumn("share", share) if telling else stats.limit(0).withColumn("share", share)
    best = stats_has.filter("hits > 0").select("word", "hits", "share").orderBy(F.desc(F.col("hits") * F.col("share")), "word")
    positive = [(r[0].encode(), r[1], r[2]) for r in best.limit(MOST_WORDS // 4).collect()]
    positive = [(u, n, p) for u, n, p in positive if ORDER <= len(u) <= LONGEST]
    negative = [u for u in dict.fromkeys(frequent + rare) if ORDER <= len(u) <= LONGEST]
    if not toxic or not positive or not negative:
        return Model()
    chosen = toxic + diverse([u for u in frequent if ORDER <= len(u) <= LANDMARK], CLEAN_LANDMARKS, 0.6)
    codes = matrix(chosen, LANDMARK)
    norms = np.sqrt(own_kernel(codes))
    landmarks = np.where(codes < 0, -2, codes).astype(np.int16)
    gram = kernel(codes, landmarks) / norms[:, None] / norms[None, :]
    values, vectors = np.linalg.eigh(gram.astype(float))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    model = Model(landmarks, norms, whiten)
    made = [(v, n / 4, p) for u, n, p in positive for v in variants(u)]
    marked = [u for u, _, _ in positive + made]
    counts = np.array([np.sqrt(n) * p for _, n, p in positive + made])
    mixed = {r[0].encode(): r[1] for r in stats_has.filter("others > 0").select("word", "share").orderBy(F.desc("share"), "word").limit(MOST_WORDS).collect()}
    x_marked = model.likeness(marked) @ whiten
    for again in (True, False):
        x = np.concatenate([x_marked, model.likeness(negative) @ whiten])
        y = np.concatenate([np.ones(len(marked)), -np.ones(len(negative))])
        clean_share = np.array([1 - mixed.get(u, 0.0) for u in negative])
        w = svm(x, y, np.concatenate([counts / counts.sum(), clean_share * 2 / clean_share.sum()]))
        model.weights, model.bias = w[:-1], float(w[-1])
        if again:
            # The clean words that this machine finds most toxic teach the next one, but not those that rather are toxic.
            worst = stats.filter("others > 0").filter(~has | (share < 0.5)).select("word", decision(F.col("word"), model).alias("f"))
            worst = worst.filter("f > -0.8").orderBy(F.desc("f"), "word").limit(MOST_WORDS // 2).collect()
            negative = list(dict.fromkeys([r[0].encode() for r in worst] + negative))
    stats.unpersist()
    rows = sample.select("label", decision(F.col("text"), model).alias("f")).toArrow()
    f, truth = rows["f"].to_numpy(), rows["label"].to_numpy().astype(float)
    order = np.lexsort((truth, f))
    model.slope, model.shift = logistic(np.maximum(f[order], -3.0), truth[order])
    return model


def decision(text: Column, model: Model) -> Column:
    """The SVM's decision on the worst unit of each text; -inf without units."""

    def decided(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept(model.name(), lambda: Scorer(model))
        for batch in batches:
            yield pa.array(scorer.worst(batch))

    return F.arrow_udf(decided, "double")(text)


def score(text: Column, model: Model) -> Column:
    """The probability that each text is toxic."""
    if model.weights is None:
        return F.when(F.lit(True) | text.isNull(), F.lit(0.0))
    bounded = F.greatest(decision(text, model), F.lit(-3.0))
    return F.round(1 / (1 + F.exp(-(bounded * model.slope + model.shift))), 9)
