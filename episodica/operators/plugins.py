"""Extension points: writers, reward signals, reward processors, batch policies."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions import vectors as V
from episodica.operators.stats import STAT_WRITERS
from episodica.plans.folds import python_partitions
from episodica.plans.ordered import prefix

REWARD_SIGNALS: dict[str, Callable[..., Column]] = {}


def register_writer(name: str, writer: Callable[[DataFrame], None]) -> None:
    STAT_WRITERS[name] = writer


def register_signal(name: str, build: Callable[..., Column]) -> None:
    REWARD_SIGNALS[name] = build


def parquet_writer(path: str) -> Callable[[DataFrame], None]:
    return lambda df: df.write.mode("append").parquet(path)


register_signal("extrinsic", lambda: F.col("reward"))
register_signal("curiosity", lambda predicted="predicted", actual="actual", strength=None: V.curiosity_reward(predicted, actual, strength))
register_signal("rnd", lambda predicted="predicted", target="actual": V.novelty_reward(predicted, target))
register_signal("gail", lambda estimate="estimate": V.imitation_reward(estimate))


def evaluate_signals(df: DataFrame, signals: dict[str, dict], keys: list[str]) -> DataFrame:
    """Long form (keys, signal, reward): each named signal times its strength."""
    rows = []
    for name, args in signals.items():
        args = dict(args)
        strength = float(args.pop("weight", 1.0))
        rows.append(F.struct(F.lit(name).alias("signal"), (REWARD_SIGNALS[name](**args) * strength).alias("reward")))
    return df.select(*keys, F.inline(F.array(*rows)))


def reward_processor(fn: Callable[[np.ndarray], float]) -> Callable[[str], Column]:
    """A user's reduction of a list of returns to one number, as an aggregate over bounded groups
    (a trajectory, a return buffer). The lists of many groups travel in one Arrow batch. For other groups see `processed`."""

    @F.pandas_udf("double")
    def reduce(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: float(fn(np.asarray(v))))

    return lambda c: reduce(F.collect_list(c))


@dataclass(frozen=True)
class Processor:
    """A user's reduction of any number of returns, in parts: a state of numbers is updated with the values of a part, states are merged in any
    order, and the last one is turned into the result."""

    start: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]


def processed(df: DataFrame, keys: list[str], value: str, processor: Processor) -> DataFrame:
    """(keys, value) by a Processor, for groups of any size: every Arrow batch reduces what it holds of a group to one state, and only states meet."""
    p = processor
    schema = T.StructType([df.schema[c] for c in keys])
    partial = T.StructType(list(schema.fields)).add("_state", T.ArrayType(T.DoubleType()))

    def parts(batches):
        for pdf in batches:
            rows = [(*k, p.update(p.start(), v.to_numpy()).tolist()) for k, v in pdf.groupby(keys, dropna=False, sort=False)[value]]
            yield pd.DataFrame(rows, columns=partial.fieldNames())

    def whole(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for *k, part in pdf.itertuples(index=False, name=None):
                if k != key:
                    if key is not None:
                        out.append((*key, float(p.finish(state))))
                    key, state = k, p.start()
                state = p.merge(state, np.asarray(part))
            yield pd.DataFrame(out, columns=[*keys, value])
        if key is not None:
            yield pd.DataFrame([(*key, float(p.finish(state)))], columns=[*keys, value])

    states = python_partitions(df.select(*keys, value).mapInPandas(parts, partial), keys).sortWithinPartitions(*keys)
    return states.mapInPandas(whole, T.StructType(list(schema.fields)).add(value, "double"))


# --- batch policies --------------------------------------------------------------------------


def score_policy(
    df: DataFrame,
    layers: list[tuple[np.ndarray, np.ndarray]] | Callable[[], list[tuple[np.ndarray, np.ndarray]]],
    obs: str,
    keep: list[str],
    activate: Callable[[np.ndarray], np.ndarray] = np.tanh,
) -> DataFrame:
    """Dense forward pass per Arrow batch: `logits` and the greedy `action` for each row.

    `layers` are the weights, or a function that reads them: every task then calls it once, so that a large policy
    stays in its file and never passes through the driver."""
    shared = None if callable(layers) else df.sparkSession.sparkContext.broadcast(layers)
    schema = T.StructType([df.schema[c] for c in keep]).add("logits", T.ArrayType(T.DoubleType())).add("action", "long")

    def run(batches):
        weights = layers() if shared is None else shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[obs].to_numpy()).astype(np.float64)
            for n, (w, b) in enumerate(weights):
                x = x @ w + b
                if n < len(weights) - 1:
                    x = activate(x)
            out = pdf[keep].copy()
            out["logits"] = list(x)
            out["action"] = x.argmax(axis=1)
            yield out

    return df.select(*dict.fromkeys([*keep, obs])).mapInPandas(run, schema)


def score_recurrent(df: DataFrame, keys: list[str], order: str, obs: str, memory: int, cell: Callable, keep: list[str], width: int | None = None) -> DataFrame:
    """A policy with memory along each agent's order, for many agents in lockstep.

    `cell(observations, memories) -> (actions, memories)` takes one row an agent: the n-th steps of all agents of a task come together, and
    what a network does with them is one product of matrices. A task holds one row of memory for each of its agents."""
    cols = list(dict.fromkeys([*keys, order, obs, *keep]))
    out_cols = list(dict.fromkeys([*keys, order, *keep]))
    schema = T.StructType([df.schema[c] for c in out_cols]).add("action", "long")
    numbered = prefix(df.select(*cols), keys, order, {"_step": F.lit(1)}, inclusive=False, width=width)
    laid_out = python_partitions(numbered, keys).sortWithinPartitions("_step", *keys)

    def run(batches):
        places: dict[tuple, int] = {}
        held = np.zeros((1024, memory))
        for pdf in batches:
            if not len(pdf):
                continue
            steps = pdf["_step"].to_numpy()
            cuts = [0, *(np.flatnonzero(steps[1:] != steps[:-1]) + 1).tolist(), len(pdf)]
            who = np.array([places.setdefault(k, len(places)) for k in zip(*(pdf[c] for c in keys))])
            while len(places) > len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            x, actions = np.stack(pdf[obs].to_numpy()).astype(np.float64), np.empty(len(pdf), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                actions[a:b], held[who[a:b]] = cell(x[a:b], held[who[a:b]])
            out = pdf[out_cols].copy()
            out["action"] = actions
            yield out

    return laid_out.mapInPandas(run, schema)
