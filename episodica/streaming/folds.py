"""Curricula and ratings kept up to date on streams, by the batch operators' own step functions."""

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from episodica.operators.selfplay import (
    INITIAL_RATING,
    LESSON_SCHEMA,
    Curriculum,
    buffer_size,
    ladder_step,
    lesson_state,
    lesson_step,
    rating_step,
)


def _sorted(rows, by="seq"):
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class LessonKeeper(StatefulProcessor):
    def __init__(self, curriculum: Curriculum):
        self.curriculum = curriculum

    def init(self, handle):
        self.saved = handle.getValueState("lessons", "state string")

    def handleInputRows(self, key, rows, timerValues):
        state = lesson_state(self.curriculum)
        if self.saved.exists():
            state.update(json.loads(self.saved.get()[0]))
            state["returns"] = {
                b: deque(x, maxlen=buffer_size(self.curriculum, b)) for b, x in state["returns"].items()
            }
        out = []
        for row in _sorted(rows).itertuples(index=False):
            moved = lesson_step(self.curriculum, state, row.behavior, row.progress, row.episode_return)
            out.extend((row.run, row.seq, *m) for m in moved)
        self.saved.update((json.dumps({**state, "returns": {b: list(x) for b, x in state["returns"].items()}}),))
        yield pd.DataFrame(out, columns=["run", "seq", "param", "lesson", "must_reset"])

    def close(self):
        pass


def stream_lessons(evals: DataFrame, curriculum: Curriculum) -> DataFrame:
    cols = evals.select("run", "seq", "behavior", "progress", "episode_return")
    return cols.groupBy("run").transformWithStateInPandas(LessonKeeper(curriculum), LESSON_SCHEMA, "Append", "None")


class RatingKeeper(StatefulProcessor):
    def __init__(self, k: float, initial: float):
        self.k, self.initial = k, initial

    def init(self, handle):
        self.ratings = handle.getMapState("ratings", "slot int", "rating double")

    def handleInputRows(self, key, rows, timerValues):
        ratings = {k[0]: v[0] for k, v in self.ratings.iterator()} if self.ratings.exists() else {}
        out = []
        for row in _sorted(rows).itertuples(index=False):
            reward = row.final_reward + row.final_group_reward
            change = rating_step(ratings, row.slot, row.opponent_slot, reward, self.k, self.initial)
            out.append((row.league, row.seq, row.slot, row.opponent_slot, change, ratings[row.slot], ratings[row.opponent_slot]))
        for slot, rating in ratings.items():
            self.ratings.updateValue((int(slot),), (float(rating),))
        yield pd.DataFrame(
            out, columns=["league", "seq", "slot", "opponent_slot", "change", "rating", "opponent_rating"]
        )

    def close(self):
        pass


def stream_elo(matches: DataFrame, k: float = 1.0, initial: float = INITIAL_RATING) -> DataFrame:
    cols = matches.select("league", "seq", "slot", "opponent_slot", "final_reward", "final_group_reward")
    league = dict(cols.dtypes)["league"]
    schema = (
        f"league {league}, seq long, slot int, opponent_slot int, change double, rating double, opponent_rating double"
    )
    return cols.groupBy("league").transformWithStateInPandas(RatingKeeper(k, initial), schema, "Append", "None")


class LadderKeeper(StatefulProcessor):
    """Ratings by the rules of `operators.selfplay.ladder`; a league's state is one number for each slot."""

    def __init__(self, window: int, k: float, initial: float):
        self.window, self.k, self.initial = window, k, initial

    def init(self, handle):
        self.saved = handle.getValueState("ladder", "state string")

    def handleInputRows(self, key, rows, timerValues):
        state = {}
        if self.saved.exists():
            state = json.loads(self.saved.get()[0])
            for s in state.values():
                s["slots"] = {int(n): x for n, x in s["slots"].items()}
        out = []
        for row in _sorted(rows).itertuples(index=False):
            args = ("", row.snapshots, "", row.snapshots, row.slot, row.final_reward + row.final_group_reward)
            out.append((row.league, row.seq, row.slot, *ladder_step(state, *args, self.window, self.k, self.initial)))
        self.saved.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["league", "seq", "slot", "change", "rating", "opponent_rating"])

    def close(self):
        pass


def stream_ladder(results: DataFrame, window: int, k: float = 1.0, initial: float = INITIAL_RATING) -> DataFrame:
    """Rating history on a stream of rated results: league, seq, snapshots, slot, final_reward, final_group_reward."""
    cols = results.select("league", "seq", "snapshots", "slot", "final_reward", "final_group_reward")
    schema = f"league {dict(cols.dtypes)['league']}, seq long, slot long, change double, rating double, opponent_rating double"
    return cols.groupBy("league").transformWithStateInPandas(LadderKeeper(window, k, initial), schema, "Append", "None")
