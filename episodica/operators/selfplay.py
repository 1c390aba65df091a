"""Curricula, ratings, opponents and learning teams: the ordered folds over reduced rows.

Each fold is one small `step(state, row)`; batch plans and streams call the same one.
"""

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.names import behavior_name, behavior_team
from episodica.plans.clocks import Limits, two_clocks
from episodica.plans.folds import ordered_fold, python_partitions
from episodica.plans.lineage import cut
from episodica.plans.ordered import block_of, block_width, total_order

# Initial rating, scale of the expected score, weight of the old smoothed measure.
INITIAL_RATING = 1200.0
RATING_SCALE = 400.0
OLD_WEIGHT = 0.25


# --- curriculum ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lesson:
    """When a parameter leaves this lesson. The last lesson of a curriculum has no rule."""

    behavior: str | None = None
    measure: str = "reward"
    threshold: float = 0.0
    min_lesson_length: int = 0
    signal_smoothing: bool = True
    require_reset: bool = False
    name: str = ""

    def __post_init__(self):
        if self.measure not in ("reward", "progress"):
            raise ValueError(f"unknown measure {self.measure}")
        if self.behavior and self.measure == "progress" and not 0.0 <= self.threshold <= 1.0:
            raise ValueError("a progress threshold lies between 0 and 1")


Curriculum = dict[str, list[Lesson]]


def buffer_size(curriculum: Curriculum, behavior: str) -> int:
    """Returns a behaviour has to remember: the longest minimum lesson that looks at it."""
    asked = [x.min_lesson_length for ls in curriculum.values() for x in ls if x.behavior == behavior]
    return max([1, *asked])


def lesson_state(curriculum: Curriculum) -> dict:
    return {
        "lesson": dict.fromkeys(curriculum, 0),
        "smooth": dict.fromkeys(curriculum, 0.0),
        "progress": {},
        "returns": {},
    }


def lesson_step(curriculum: Curriculum, state: dict, behavior: str, progress: float, new_return) -> list[tuple]:
    """One evaluation. Returns (param, new lesson, must reset) for every parameter that moved on.

    Any move clears all remembered returns.
    """
    state["progress"][behavior] = progress
    buf = state["returns"].setdefault(behavior, deque(maxlen=buffer_size(curriculum, behavior)))
    if new_return is not None and new_return == new_return:
        buf.append(float(new_return))
    moved = []
    for param, lessons in curriculum.items():
        at = state["lesson"][param]
        rule = lessons[at]
        if rule.behavior is None or at + 1 >= len(lessons) or rule.behavior not in state["progress"]:
            continue
        seen = state["returns"].get(rule.behavior, ())
        if len(seen) < rule.min_lesson_length:
            continue
        if rule.measure == "progress":
            passed = state["progress"][rule.behavior] > rule.threshold
        elif not seen:
            continue
        else:
            value = sum(seen) / len(seen)
            if rule.signal_smoothing:
                value = OLD_WEIGHT * state["smooth"][param] + (1 - OLD_WEIGHT) * value
                state["smooth"][param] = value
            passed = value > rule.threshold
        if passed:
            state["lesson"][param] = at + 1
            moved.append((param, at + 1, rule.require_reset))
    if moved:
        for b in state["returns"].values():
            b.clear()
    return moved


LESSON_SCHEMA = "run string, seq long, param string, lesson int, must_reset boolean"


def lesson_progress(evals: DataFrame, curriculum: Curriculum) -> DataFrame:
    """Lesson changes per run. Columns in: run, seq, behavior, progress, episode_return (may be null).

    All parameters of a run share its return buffers, so the run is the key of the fold.
    """
    cols = evals.select("run", "seq", "behavior", "progress", "episode_return")

    def step(state, row):
        moved = lesson_step(curriculum, state, row.behavior, row.progress, row.episode_return)
        return [(row.run, row.seq, *m) for m in moved]

    return ordered_fold(cols, ["run"], ["seq"], lambda: lesson_state(curriculum), step, LESSON_SCHEMA)


# --- ratings ---------------------------------------------------------------------------------


def rating_step(ratings: dict, player, opponent, reward: float, k: float = 1.0, initial: float = INITIAL_RATING):
    """Symmetric update of two ratings; the sign of the final reward decides. Returns the change."""
    a, b = ratings.get(player, initial), ratings.get(opponent, initial)
    result = 1.0 if reward > 0 else 0.0 if reward < 0 else 0.5
    expected = 1.0 / (1.0 + 10.0 ** ((b - a) / RATING_SCALE))
    change = k * (result - expected)
    ratings[player], ratings[opponent] = a + change, b - change
    return change


def elo(matches: DataFrame, k: float = 1.0, initial: float = INITIAL_RATING) -> DataFrame:
    """Rating history. Columns in: league, seq, slot, opponent_slot, final_reward, final_group_reward.

    Ratings feed back into later matches, so a league is sequential by definition; it streams in
    sorted batches and holds one number per slot.
    """
    cols = matches.select("league", "seq", "slot", "opponent_slot", "final_reward", "final_group_reward")

    def step(ratings, row):
        change = rating_step(
            ratings, row.slot, row.opponent_slot, row.final_reward + row.final_group_reward, k, initial
        )
        return [(row.league, row.seq, row.slot, row.opponent_slot, change, ratings[row.slot], ratings[row.opponent_slot])]

    kinds = dict(cols.dtypes)
    schema = (
        f"league {kinds['league']}, seq {kinds['seq']}, slot {kinds['slot']}, opponent_slot {kinds['slot']}, "
        "change double, rating double, opponent_rating double"
    )
    return ordered_fold(cols, ["league"], ["seq"], dict, step, schema)


# --- opponents and teams ---------------------------------------------------------------------


@dataclass(frozen=True)
class SelfPlay:
    """When snapshots are saved, opponents swapped and the learning team changed, in steps."""

    save_steps: int
    swap_steps: int
    team_change: int
    window: int = 10
    latest_ratio: float = 0.5
    teams: int = 2


def self_play_schedule(
    traj: DataFrame, plan: SelfPlay, keys: list[str] | None = None, width: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """What holds while each trajectory is taken in, and both clocks after it.

    Only the learning team's steps move the learning clock, on which snapshots are saved and the learning team
    changes; the other teams' steps move the ghost clock. Opponents are swapped when the team changes or more than
    `swap_steps` have passed on the ghost clock since the last swap, and stay until the next. Adds learning_team,
    round (team changes so far), swap (swaps so far), saved (snapshots when that swap was made), snapshots (now),
    learning_step, ghost_step. A long key's order is cut into blocks of `width` arrivals, see `plans.clocks`. Columns to `keep` are handed through.
    """
    keys = keys or ["name"]
    limits = Limits(plan.teams, plan.team_change, plan.save_steps, plan.swap_steps)
    return two_clocks(traj, keys, total_order(traj, keys, "arrival"), limits, width, keep)


def drawn_opponents(schedule: DataFrame, plan: SelfPlay, draw: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """Adds opponents, plays_latest, slot and snapshot.

    opponents has (team, plays_latest, slot, snapshot) for each team that doesn't learn, in the order of teams: the latest policy (-1)
    or a saved slot, drawn for itself at each swap. `draw` gives two uniform numbers for a team; they must depend on the key, the swap and
    the team only. The last team's draw is the one that counts for ratings, as plays_latest, slot and snapshot. Before the first swap the latest policy
    plays. Snapshot n sits in slot n mod window, so the snapshot a slot held at the swap follows by arithmetic."""

    def one(team: Column) -> Column:
        u_latest, u_slot = draw(team)
        latest = (F.col("swap") == 0) | (u_latest >= F.lit(1.0 - plan.latest_ratio))
        slot = F.floor(u_slot * F.least(F.col("saved"), F.lit(plan.window))).cast("long")
        newest = F.col("saved") - 1
        held = newest - F.pmod(newest - slot, F.lit(plan.window))
        minus = F.lit(-1).cast("long")
        return F.struct(
            team.alias("team"), latest.alias("plays_latest"), F.when(latest, minus).otherwise(slot).alias("slot"),
            F.when(latest, minus).otherwise(held).alias("snapshot"),
        )

    teams = F.array(*[F.when(F.col("learning_team") != t, one(F.lit(t).cast("long"))) for t in range(plan.teams)])
    out = schedule.withColumn("opponents", F.array_compact(teams))
    last = F.element_at("opponents", -1)
    return out.withColumns({c: last[c] for c in ("plays_latest", "slot", "snapshot")})


def learning_team_only(schedule: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The learning team's trajectories, and the steps of both clocks in each round."""
    mine = F.col("team") == F.col("learning_team")
    ghosts = schedule.groupBy(*(keys or ["name"]), "round").agg(
        F.sum(F.when(mine, F.col("length")).otherwise(0)).alias("learning_steps"),
        F.sum(F.when(mine, 0).otherwise(F.col("length"))).alias("ghost_steps"),
    )
    return schedule.filter(mine), ghosts


def rated(traj: DataFrame) -> DataFrame:
    """The trajectories that count for ratings: of the learning team, ended with all group mates, not interrupted."""
    ended = F.col("done") & ~F.col("interrupted")
    if "group_done" in traj.columns:
        ended &= F.col("group_done")
    return traj.filter(ended & (F.col("team") == F.col("learning_team")))


def ladder(results: DataFrame, window: int, order: list[str], k: float = 1.0, initial: float = INITIAL_RATING) -> DataFrame:
    """Rating history of learning policies and their snapshots.

    Columns in: league, the order, snapshots (the policy's, taken before the result), slot (opponent's, -1 its latest policy),
    final_reward; final_group_reward is added to it where there is one. A snapshot starts with the rating that the policy has when it is
    taken. Where teams have trainers of their own (asymmetric games), trainer, opponent_trainer and opponent_snapshots name the learner, who
    it met and how many snapshots that one had: its slots are its own trainer's. Without them a policy meets its own past, and wins nothing
    from itself. A league is one fold over its rated results, with one number for each slot.
    """
    asymmetric = "opponent_trainer" in results.columns
    names = ["league", *order, "snapshots", "slot", "final_reward"]
    names += [c for c in ("final_group_reward", "trainer", "opponent_trainer", "opponent_snapshots") if c in results.columns]
    cols = results.select(*names)
    group = "final_group_reward" in names

    def step(state, row):
        final = row.final_reward + (row.final_group_reward if group else 0.0)
        mine = row.trainer if asymmetric else ""
        other = (row.opponent_trainer, row.opponent_snapshots) if asymmetric else ("", row.snapshots)
        return [(*row, *ladder_step(state, mine, row.snapshots, *other, row.slot, final, window, k, initial))]

    schema = T.StructType([cols.schema[c] for c in cols.columns])
    for c in ("change", "rating", "opponent_rating"):
        schema = schema.add(c, "double")
    return ordered_fold(cols, ["league"], order, dict, step, schema)


def ladder_step(
    state: dict, trainer: str, snapshots: int, opponent: str, opponent_snapshots: int, slot: int, final: float, window: int, k: float, initial: float
) -> tuple[float, float, float]:
    """One rated result: (change, the learner's rating, its opponent's). state holds own, slots (by number) and taken of each trainer."""

    def taken(name, n_taken):
        s = state.setdefault(name, {"own": initial, "slots": {}, "taken": 0})
        # Only the last `window` of snapshots that were missed are still in their slots.
        for n in range(max(s["taken"], n_taken - window), n_taken):
            s["slots"][n % window] = s["own"]
        s["taken"] = max(s["taken"], n_taken)
        return s

    mine, other = taken(trainer, int(snapshots)), taken(opponent, int(opponent_snapshots))
    slot = int(slot)
    rating = other["own"] if slot < 0 else other["slots"].get(slot, initial)
    result = 1.0 if final > 0 else 0.0 if final < 0 else 0.5
    change = k * (result - 1.0 / (1.0 + 10.0 ** ((rating - mine["own"]) / RATING_SCALE)))
    if slot >= 0:
        mine["own"] += change
        other["slots"][slot] = rating - change
    elif other is not mine:
        mine["own"] += change
        other["own"] -= change
    return change, mine["own"], other["own"] if slot < 0 else other["slots"][slot]


def named_teams(traj: DataFrame) -> DataFrame:
    return traj.withColumn("name", behavior_name("behavior_id")).withColumn("team", behavior_team("behavior_id"))


# --- path thinning ---------------------------------------------------------------------------


def kept_points(xy: np.ndarray, at: np.ndarray | None, gap: float) -> list[int]:
    """Rows of a path that are kept after a point kept before, if any: each is the first one at least `gap` from the last one kept."""
    out, i, n = [], 0, len(xy)
    if at is None and n:
        out, at, i = [0], xy[0], 1
    span = 8
    while i < n:
        far = ((xy[i : i + span] - at) ** 2).sum(axis=1) >= gap * gap
        j = int(far.argmax())
        if far[j]:
            out.append(i + j)
            at, i, span = xy[i + j], i + j + 1, 8
        else:
            i, span = i + span, min(2 * span, 1 << 14)
    return out


# Blocks of a path up to this long are thinned side by side, one point of each at a time.
SHORT = 64


def kept_rows(xy: np.ndarray, starts: np.ndarray, entries: list, gap: float) -> np.ndarray:
    """Which rows of consecutive blocks are kept; entries holds the point kept before each block, or None where a path begins."""
    sizes = np.diff(np.append(starts, len(xy)))
    keep = np.zeros(len(xy), bool)
    begun = np.array([e is not None for e in entries], bool)
    for b in np.flatnonzero(sizes > SHORT).tolist():
        rows = xy[starts[b] : starts[b] + sizes[b]]
        keep[starts[b] + np.array(kept_points(rows, np.asarray(entries[b], float) if begun[b] else None, gap), np.int64)] = True
    short = np.flatnonzero(sizes <= SHORT)
    short = short[np.argsort(-sizes[short], kind="stable")]
    first, sizes, begun = starts[short], sizes[short], begun[short]
    at = xy[first].copy()
    if begun.any():
        at[begun] = np.array([entries[b] for b in short[begun].tolist()], float)
    keep[first[~begun]] = True
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -k, "left"))
        rows = first[:live] + k
        far = ((xy[rows] - at[:live]) ** 2).sum(axis=1) >= gap * gap
        if k == 0:
            far &= begun[:live]
        keep[rows[far]] = True
        at[:live][far] = xy[rows[far]]
    return keep


def whole_runs(batches, bk: list[str]):
    """(rows, where blocks start) of a sorted stream, in frames of whole blocks."""

    def changes(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in bk:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def joined(parts: list[pd.DataFrame]):
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        return pdf, changes(pdf)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        starts = changes(pdf)
        same = bool(held) and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in bk)
        if held and not same:
            yield joined(held)
            held = []
        last = int(starts[-1])
        if last:
            yield joined([*held, pdf.iloc[:last]])
            held = []
        held.append(pdf.iloc[last:])
    if held:
        yield joined(held)


def path_points(positions: DataFrame, keys: list[str], order: str, coords: list[str], gap: float = 0.5, width: int | None = None) -> DataFrame:
    """Keep a position when it lies at least `gap` from the last one kept (the first is kept).

    A path is cut into blocks of its order. Each block is thinned as if it began the path; then again and again, all blocks side by side, from the point that the
    blocks before it kept last by then, until no block's last point changes. A round settles at least one more block of a path, and as paths that begin at
    different points soon keep the same ones, nearly all at once. Paths of one block need no round."""
    bk = [*keys, "_b"]
    rows = positions.select(*keys, order, *coords).withColumn("_b", block_of(order, block_width(positions, width)))
    for c in bk:
        rows = rows.filter(F.col(c).isNotNull())
    rows = cut(rows, "path")
    point = T.ArrayType(T.DoubleType())
    kinds = {f.name: f.dataType for f in rows.schema}
    last_schema = T.StructType([T.StructField(c, kinds[c]) for c in bk]).add("_last", point)
    out_schema = T.StructType([T.StructField(c, kinds[c]) for c in [*keys, order, *coords]])

    def thinned(found: DataFrame):
        return python_partitions(found, bk).sortWithinPartitions(*bk, order)

    def kept(pdf, starts):
        return kept_rows(pdf[coords].to_numpy(dtype=float), starts, pdf["_entry"].to_numpy()[starts].tolist(), gap)

    def last_points(batches):
        for pdf, starts in whole_runs(batches, bk):
            last = np.maximum.reduceat(np.where(kept(pdf, starts), np.arange(len(pdf)), -1), starts)
            out = pdf[bk].iloc[starts].reset_index(drop=True)
            xy = pdf[coords].to_numpy(dtype=float)
            out["_last"] = pd.Series([xy[j].tolist() if j >= 0 else None for j in last.tolist()], dtype=object)
            yield out

    def points(batches):
        for pdf, starts in whole_runs(batches, bk):
            yield pdf[out_schema.fieldNames()][kept(pdf, starts)]

    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*bk).agg(F.count(F.lit(1)).alias("_n"))
    several = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks")).filter("_blocks > 1").select(*keys)
    none = F.lit(None).cast(point)
    if several.isEmpty():
        return thinned(rows.withColumn("_entry", none)).mapInPandas(points, out_schema)
    long = rows.join(several, keys, "left_semi")
    ends = cut(thinned(long.withColumn("_entry", none)).mapInPandas(last_points, last_schema), "ends")
    while True:
        entries = ends.select(*bk, F.last("_last", ignorenulls=True).over(before).alias("_entry"))
        new = cut(thinned(long.join(entries, bk)).mapInPandas(last_points, last_schema), "ends")
        moved = new.join(ends.withColumnRenamed("_last", "_then"), bk).filter(~F.col("_last").eqNullSafe(F.col("_then")))
        settled = moved.isEmpty()
        ends = new
        if settled:
            return thinned(rows.join(entries, bk, "left")).mapInPandas(points, out_schema)
