"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (statistics of its bytes and words, then one
learned layer); gated attention, tanh times sigmoid, gives each passage a weight; the document's score is a logistic
function of the weighted passage representation. Only documents carry labels; what matters within them is learned.
The model is fitted on the driver with at most `PER_CLASS` documents of each class, scoring runs in Arrow batches.

Cases: a null or empty text, or one without words, is one empty passage and gets the score of that; with labels of one
class or none the score is the share of that class, 0.5 without any; repeated rows get equal scores; long texts are
encoded piece by piece, passages do not cross pieces of a megabyte; other columns pass through `scored` untouched.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import fresh_name
from episodica.llm.labelled import learning_sample, with_text
from episodica.llm.textops import LOWER, span_hashes, text_parts, word_spans

PASSAGE_WORDS = 64
# Bytes of texts whose passages are encoded and scored together.
PIECE = 1 << 18
PER_CLASS = 3000
HIDDEN, GATE = 24, 12
MARKS = b"!?.,|*$%&#<>-\n"
CLASS_OF = np.zeros(256, np.int64)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58], CLASS_OF[128:], CLASS_OF[[9, 11, 12, 13, 32]] = 1, 2, 3, 4, 5
for _k, _b in enumerate(MARKS):
    CLASS_OF[_b] = 6 + _k
N_CLASSES = 6 + len(MARKS)
N_FEATURES = N_CLASSES + 5


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of the passages of some documents; every document has at least one."""
    starts, ends, doc = word_spans(data, bounds)
    n_docs = len(bounds) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    own = np.maximum(1, -(-np.diff(first) // PASSAGE_WORDS))
    before = np.cumsum(own) - own
    x = np.zeros((int(own.sum()), N_FEATURES), np.float32)
    x[:, N_CLASSES + 4] = 1
    if len(starts):
        at = np.arange(len(starts)) - first[doc]
        where = before[doc] + at // PASSAGE_WORDS
        n = len(x)
        opens = np.flatnonzero(np.diff(where, prepend=-1))
        a, b = starts[opens], ends[np.append(opens[1:], len(starts)) - 1]
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, a, where[opens] + 1)
        np.add.at(edge, b, -(where[opens] + 1))
        of_byte = np.cumsum(edge[:-1]) - 1
        inside = of_byte >= 0
        counts = np.bincount(of_byte[inside] * N_CLASSES + CLASS_OF[data[inside]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        total = np.maximum(counts.sum(axis=1), 1)
        words = np.bincount(where, minlength=n)
        x[:, :N_CLASSES] = np.sqrt(counts / total[:, None])
        keys = span_hashes(LOWER[data], starts, ends)
        order = np.lexsort((keys, where))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (where[order][1:] != where[order][:-1])
        distinct = np.bincount(where[order][new], minlength=n)
        twice = np.zeros(len(keys), bool)
        twice[1:] = (keys[1:] == keys[:-1]) & (where[1:] == where[:-1])
        full = np.maximum(words, 1)
        x[:, N_CLASSES] = np.log1p(words)
        x[:, N_CLASSES + 1] = np.bincount(where, ends - starts, minlength=n) / full / 8
        x[:, N_CLASSES + 2] = distinct / full
        x[:, N_CLASSES + 3] = np.bincount(where[twice], minlength=n) / full
    return x, np.repeat(np.arange(n_docs), own)


def bags(batch: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, first passage of each document) of runs of documents of a text column; a run has about `limit` bytes or is one document."""
    held: list[np.ndarray] = []
    begun = 0
    for i, data, bounds in text_parts(batch, limit):
        if held and i != begun:
            yield one_bag(held)
            held = []
        x, doc = passages(data, bounds)
        if len(bounds) == 2:
            held.append(x)
            begun = i
        else:
            yield x, np.searchsorted(doc, np.arange(len(bounds)))
    if held:
        yield one_bag(held)


def one_bag(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate(parts)
    return x, np.array([0, len(x)])


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Model:
    """Weights of the network; `constant` stands for it where there is nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.weights
        starts, sizes = first[:-1], np.diff(first)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return sigmoid(z @ w["c"] + w["d"]), {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "sizes": sizes, "starts": starts}

    def gradients(self, y: np.ndarray, p: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        w, n = self.weights, len(y)
        out = (p - y) / n
        dz = out[:, None] * w["c"]
        of_bag = np.repeat(dz, s["sizes"], axis=0)
        da = (of_bag * s["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(s["attention"] * da, s["starts"]), s["sizes"])
        de = s["attention"] * (da - mean)
        gate = de[:, None] * w["a"]
        dt, dg = gate * s["g"] * (1 - s["t"] ** 2), gate * s["t"] * s["g"] * (1 - s["g"])
        dh = of_bag * s["attention"][:, None] + dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - s["h"] ** 2)
        return {"W": s["x"].T @ dx, "b": dx.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg,
                "a": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ out, "d": out.sum()}


def fit(sets: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over mini-batches of bags, in a fixed order."""
    x = np.concatenate(sets) if sets else np.zeros((1, N_FEATURES), np.float32)
    rng = np.random.default_rng(7)
    shapes = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    model = Model(x.mean(axis=0), x.std(axis=0) + 0.05, weights)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    first_moment, second_moment = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(sets[k]) for k in own])])
            p, state = model.forward(np.concatenate([sets[k] for k in own]), first)
            y = labels[own]
            p = y + (p - y) * share[own]
            step += 1
            for k, g in model.gradients(y, p, state).items():
                g = g + decay * weights[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
                speed = first_moment[k] / (1 - 0.9**step) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
                weights[k] = weights[k] - rate * speed
    return model


def encode_bags(text: Column) -> Column:
    """The passages of each text as one flat array of float features."""

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for x, first in bags(batch):
                yield pa.ListArray.from_arrays((first * N_FEATURES).astype(np.int32), x.ravel())

    return F.arrow_udf(encoded, "array<float>")(text)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits the model on documents whose labels pass `learn`, a condition on labels."""
    sample = with_text(docs, learning_sample(labels, label, learn, per_class), id_col, text_col)
    rows = sample.select("label", encode_bags(F.col("text")).alias("x")).toArrow()
    sets = [np.array(r.values.to_numpy(), np.float32).reshape(-1, N_FEATURES) for r in rows["x"].combine_chunks()] if rows.num_rows else []
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k].tobytes()))
    return fit([sets[k] for k in order], rows["label"].to_numpy()[order].astype(float))


def score(text: Column, model: Model) -> Column:
    """The probability of the better class for each text."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if model.constant is not None or not len(batch):
                yield pa.array(np.full(len(batch), model.constant or 0.0))
                continue
            for x, first in bags(batch):
                yield pa.array(np.round(model.forward(x, first)[0].astype(np.float64), 9))

    return F.arrow_udf(scores, "double")(text)


def scored(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    return docs.withColumn(fresh_name(docs, name), score(F.col(text_col), model))
