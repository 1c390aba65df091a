"""Two clocks with thresholds, cut into blocks that run in parallel.

A learning team's rows move one clock, all others' rows the other. Three things happen by threshold: the learning team changes and
snapshots are taken on the learning clock, opponents are swapped on the other one and at every change. Which clock a row moves hangs on
all changes before it, so a row by row fold would be one task a key.

Here every block of the order yields its exact transfer table: from the state in which it may be entered to the state in which it is left. What
a threshold does after its first crossing in a block hangs on the row of that crossing alone, so a table has one entry for each row that
can be the first, found by its running total; no more than the rows within one limit from the block's start. The tables are
composed along the blocks of a key, one row a block, twice: first for changes, whose outcome tells which clock each row
moves, then for snapshots and swaps. Rows are then numbered block by block. The rows' few columns are written once to the shared folder.

Keys of few rows need none of this: a pass over their order numbers them row by row, in as many tasks as there are.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.plans.folds import ordered_fold, python_partitions
from episodica.plans.lineage import cut
from episodica.plans.ordered import block_of, block_width

LONGS = T.ArrayType(T.LongType())
BLOCKS_PER_FRAME, ROWS_PER_FRAME = 64, 10_000


@dataclass(frozen=True)
class Limits:
    """More than `change` steps of the learning clock change the team, more than `save` take a snapshot; more than `swap` of the other clock swap."""

    teams: int
    change: int
    save: int
    swap: int


def whole_blocks(batches: Iterator[pd.DataFrame], bk: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of each block of a sorted stream, one block at a time."""
    held: list[pd.DataFrame] = []
    key = None
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in bk:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            here = tuple(pdf[c].iloc[a] for c in bk)
            if here != key:
                if held:
                    yield key, pd.concat(held) if len(held) > 1 else held[0]
                key, held = here, []
            held.append(pdf.iloc[a:b])
    if held:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


def crossings(total: np.ndarray, base: int, limit: int, end: int) -> list[int]:
    """Rows before `end` at which a running total exceeds the last crossing's, `base` at first, by more than limit."""
    out, last = [], base
    while True:
        j = int(np.searchsorted(total[:end], last + limit, "right"))
        if j >= end:
            return out
        out.append(j)
        last = int(total[j])


def first_rows(total: np.ndarray, length: np.ndarray, moved: np.ndarray, limit: int, end: int) -> np.ndarray:
    """Rows that can be the first crossing of a block: those that move the clock while it has no more than limit."""
    return np.flatnonzero(moved[:end] & (total[:end] - length[:end] <= limit))


def chained(total: np.ndarray, firsts: np.ndarray, limit: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(crossings, steps since the last one at `end`) if a block's first crossing is at each of these rows; all chains side by side."""
    n, rest, at = np.zeros(len(firsts), np.int64), np.zeros(len(firsts), np.int64), firsts.copy()
    live = np.arange(len(firsts))
    whole = int(total[end - 1]) if end else 0
    while len(live):
        n[live] += 1
        nxt = np.searchsorted(total[:end], total[at[live]] + limit, "right")
        over = nxt >= end
        rest[live[over]] = whole - total[at[live[over]]]
        live = live[~over]
        at[live] = nxt[~over]
    return n, rest


def frames(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pd.DataFrame]:
    """Rows of blocks in frames of some blocks each."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BLOCKS_PER_FRAME:
            yield pd.DataFrame(held, columns=schema.fieldNames())
            held = []
    if held:
        yield pd.DataFrame(held, columns=schema.fieldNames())


# --- the learning team -------------------------------------------------------------------------


def change_table(team: np.ndarray, length: np.ndarray, limits: Limits) -> tuple[list, ...]:
    """Per entering team: running totals at the rows that can change it first; changes, steps since the last, learning steps; and totals."""
    n, m = len(team), limits.teams
    mine = team[None, :] == np.arange(m)[:, None]
    total = np.cumsum(np.where(mine, length, 0), axis=1)
    at, hits, rests, learned = [], [], [], []
    for t in range(m):
        firsts = first_rows(total[t], length, mine[t], limits.change, n)
        hit, rest, steps = np.ones(len(firsts), np.int64), np.zeros(len(firsts), np.int64), total[t][firsts].copy()
        row, who, live = firsts.copy(), np.full(len(firsts), (t + 1) % m), np.arange(len(firsts))
        while len(live):
            nxt = np.empty(len(live), np.int64)
            for w in range(m):
                own = who[live] == w
                nxt[own] = np.searchsorted(total[w], total[w][row[live[own]]] + limits.change, "right")
            over = nxt >= n
            done, go = live[over], live[~over]
            rest[done] = total[who[done], -1] - total[who[done], row[done]]
            steps[done] += rest[done]
            steps[go] += total[who[go], nxt[~over]] - total[who[go], row[go]]
            row[go] = nxt[~over]
            hit[go] += 1
            who[go] = (who[go] + 1) % m
            live = go
        for out, x in zip((at, hits, rests, learned), (total[t][firsts], hit, rest, steps)):
            out.append(x.tolist())
    return at, hits, rests, learned, total[:, -1].tolist(), int(length.sum())


def compose_changes(limits: Limits):
    """One step of the fold over a key's blocks: state round, steps since the change, both clocks."""

    def step(s, row):
        out = (*row[: row._fields.index("at")], s["round"], s["since"], s["learned"], s["others"])
        t = s["round"] % limits.teams
        k = int(np.searchsorted(np.asarray(row.at[t], np.int64), limits.change - s["since"], "right"))
        if k < len(row.at[t]):
            learned = int(row.learned[t][k])
            s["round"], s["since"] = s["round"] + int(row.hits[t][k]), int(row.rests[t][k])
        else:
            learned = int(row.totals[t])
            s["since"] += learned
        s["learned"] += learned
        s["others"] += int(row.steps) - learned
        return [out]

    return step


class Block:
    """A block's rows once it is known how it is entered: who learns at each row, and both clocks within the block."""

    def __init__(self, team: np.ndarray, length: np.ndarray, limits: Limits, round0: int, since: int):
        n = self.n = len(team)
        self.limits, self.length = limits, length
        totals: dict[int, np.ndarray] = {}
        self.changes, base, start = [], -since, 0
        who = round0 % limits.teams
        learner = np.empty(n, np.int64)
        while start < n:
            total = totals.setdefault(who, np.cumsum(np.where(team == who, length, 0)))
            j = int(np.searchsorted(total, base + limits.change, "right"))
            learner[start : j + 1] = who
            if j >= n:
                break
            self.changes.append(j)
            start, who = j + 1, (who + 1) % limits.teams
            base = int(totals.setdefault(who, np.cumsum(np.where(team == who, length, 0)))[j])
        self.mine = team == learner
        self.learner = learner
        hit = np.zeros(n, np.int64)
        hit[self.changes] = 1
        self.round = round0 + np.cumsum(hit) - hit
        self.learned = np.cumsum(np.where(self.mine, length, 0))
        self.others = np.cumsum(np.where(self.mine, 0, length))

    def swaps_from(self, start: int, base: int) -> list[int]:
        """Swaps from row `start` on, the clock having stood at `base` at the last one."""
        out = []
        for end in [*[c for c in self.changes if c >= start], self.n]:
            out += crossings(self.others, base, self.limits.swap, end)
            if end < self.n:
                out.append(end)
                base = int(self.others[end])
        return out

    def tables(self) -> tuple:
        """Snapshots and swaps: running totals at rows that can be the first ones, how many follow, steps since the last; and both totals.

        The block's first change swaps whatever happened before it: what follows it is the same for all entries."""
        firsts = first_rows(self.learned, self.length, self.mine, self.limits.save, self.n)
        saves = [x.tolist() for x in (self.learned[firsts], *chained(self.learned, firsts, self.limits.save, self.n))]
        end = self.changes[0] if self.changes else self.n
        firsts = first_rows(self.others, self.length, ~self.mine, self.limits.swap, end)
        hits, rests = chained(self.others, firsts, self.limits.swap, end)
        tail_hits, tail_rest = 0, None
        if self.changes:
            later = self.swaps_from(end + 1, int(self.others[end]))
            tail_hits = 1 + len(later)
            tail_rest = int(self.others[-1] - self.others[later[-1] if later else end])
            hits, rests = hits + tail_hits, np.full(len(firsts), tail_rest)
        swaps = [x.tolist() for x in (self.others[firsts], hits, rests)]
        return *saves, *swaps, tail_hits, tail_rest, int(self.learned[-1]), int(self.others[-1])

    def saves(self, since: int) -> np.ndarray:
        """Snapshots taken at or before each row."""
        hit = np.zeros(self.n, np.int64)
        hit[crossings(self.learned, -since, self.limits.save, self.n)] = 1
        return np.cumsum(hit)

    def swaps(self, since: int) -> np.ndarray:
        return np.array(self.swaps_from(0, -since), np.int64)


def compose_saves_and_swaps(limits: Limits):
    def step(s, row):
        out = (*row[: row._fields.index("save_at")], s["snapshots"], s["saved_since"], s["swap"], s["swapped_since"])
        k = int(np.searchsorted(np.asarray(row.save_at, np.int64), limits.save - s["saved_since"], "right"))
        if k < len(row.save_at):
            s["snapshots"], s["saved_since"] = s["snapshots"] + int(row.save_hits[k]), int(row.save_rests[k])
        else:
            s["saved_since"] += int(row.learned)
        k = int(np.searchsorted(np.asarray(row.swap_at, np.int64), limits.swap - s["swapped_since"], "right"))
        if k < len(row.swap_at):
            s["swap"], s["swapped_since"] = s["swap"] + int(row.swap_hits[k]), int(row.swap_rests[k])
        elif row.tail_hits:
            s["swap"], s["swapped_since"] = s["swap"] + int(row.tail_hits), int(row.tail_rest)
        else:
            s["swapped_since"] += int(row.others)
        return [out]

    return step


NUMBERED = ("learning_team", "round", "swap", "saved", "snapshots", "learning_step", "ghost_step")


# Keys of at most so many rows for each position of a block's width are numbered row by row.
WHOLE = 16


def plain(teams: list[int], lengths: list[int], limits: Limits, s: list[int]) -> list[tuple]:
    """NUMBERED of rows in their order; s is what the rows before them left behind."""
    round_, swap, saved, snapshots, learned, others, changed, kept, swapped = s
    n, change, save, swap_after = limits.teams, limits.change, limits.save, limits.swap
    who, out = round_ % n, []
    for team, length in zip(teams, lengths):
        if team == who:
            learned += length
        else:
            others += length
        out.append((who, round_, swap, saved, snapshots, learned, others))
        turned = learned - changed > change
        if learned - kept > save:
            snapshots, kept = snapshots + 1, learned
        if turned:
            round_, changed = round_ + 1, learned
            who = round_ % n
        if turned or others - swapped > swap_after:
            swap, swapped, saved = swap + 1, others, snapshots
    s[:] = round_, swap, saved, snapshots, learned, others, changed, kept, swapped
    return out


def in_one_pass(rows: DataFrame, keys: list[str], order: list[str], names: list[str], limits: Limits, schema: T.StructType) -> DataFrame:
    """Rows of keys as a whole, numbered one after another."""

    def number(batches):
        key, state = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in keys:
                codes = batch.column(c).dictionary_encode().indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            teams, lengths = batch.column("team").to_pylist(), batch.column("length").to_pylist()
            out = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                here = tuple(batch.column(c)[a].as_py() for c in keys)
                if here != key:
                    key, state = here, [0, 0, 1, 1, 0, 0, 0, 0, 0]
                out += plain(teams[a:b], lengths[a:b], limits, state)
            numbers = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x) for x in numbers]], [*names, *NUMBERED])

    return python_partitions(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(number, schema)


def two_clocks(
    df: DataFrame, keys: list[str], order: list[str], limits: Limits, width: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Adds NUMBERED to rows (keys, order, team, length, keep): what holds when a row comes, and both clocks after it.

    saved is the number of snapshots when the last swap was made. `order` is total, its first column a number that cuts blocks of
    `width`; lengths aren't negative."""
    bk = [*keys, "_b"]
    names = [*keys, *order, "team", "length", *keep]
    rows = df.select(*keys, *order, "team", F.col("length").cast("long").alias("length"), *keep)
    kinds = {f.name: f.dataType for f in rows.schema}
    out_schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
    for c in NUMBERED:
        out_schema = out_schema.add(c, T.LongType())
    width = block_width(df, width)
    rows = rows.withColumn("_b", block_of(order[0], width))
    for c in bk:
        rows = rows.filter(F.col(c).isNotNull())
    # Several passes read these few columns: whatever they come from is computed once.
    rows = cut(rows, "clock")
    # No more than a WHOLE-th of the rows for each position of a block: few enough for all tasks.
    long = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE * width).select(*keys), "long")
    if long.isEmpty():
        return in_one_pass(rows, keys, order, names, limits, out_schema)
    short = in_one_pass(rows.join(F.broadcast(long), keys, "left_anti"), keys, order, names, limits, out_schema)
    rows = python_partitions(rows.join(F.broadcast(long), keys, "left_semi"), bk)
    per_block = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in bk])

    def sorted_rows(entry: DataFrame | None) -> DataFrame:
        found = rows if entry is None else rows.join(entry, bk)
        return found.sortWithinPartitions(*bk, *order)

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf["team"].to_numpy(dtype=np.int64), pdf["length"].to_numpy(dtype=np.int64)

    def entered(pdf: pd.DataFrame) -> Block:
        return Block(*arrays(pdf), limits, int(pdf["_round0"].iloc[0]), int(pdf["_since"].iloc[0]))

    def extended(schema: T.StructType, **columns) -> T.StructType:
        out = T.StructType(list(schema.fields))
        for name, kind in columns.items():
            out = out.add(name, kind)
        return out

    count = T.LongType()
    lists = T.ArrayType(LONGS)
    change_schema = extended(per_block, at=lists, hits=lists, rests=lists, learned=lists, totals=LONGS, steps=count)

    def change_tables(batches):
        rows = ((*key, *change_table(*arrays(pdf), limits)) for key, pdf in whole_blocks(batches, bk))
        yield from frames(rows, change_schema)

    entry_schema = extended(per_block, _round0=count, _since=count, _learned0=count, _others0=count)
    start = dict.fromkeys(("round", "since", "learned", "others"), 0)
    entries = ordered_fold(
        sorted_rows(None).mapInPandas(change_tables, change_schema), keys, ["_b"], lambda: dict(start), compose_changes(limits), entry_schema
    )

    table_schema = extended(
        entry_schema, save_at=LONGS, save_hits=LONGS, save_rests=LONGS, swap_at=LONGS, swap_hits=LONGS, swap_rests=LONGS, tail_hits=count,
        tail_rest=count, learned=count, others=count,
    )
    carried = entry_schema.fieldNames()[len(bk) :]

    def tables(batches):
        rows = ((*key, *[int(pdf[c].iloc[0]) for c in carried], *entered(pdf).tables()) for key, pdf in whole_blocks(batches, bk))
        yield from frames(rows, table_schema)

    full_schema = extended(entry_schema, _snapshots0=count, _saved_since=count, _swap0=count, _swapped_since=count)
    begin = {"snapshots": 1, "saved_since": 0, "swap": 0, "swapped_since": 0}
    entries = ordered_fold(
        sorted_rows(entries).mapInPandas(tables, table_schema), keys, ["_b"], lambda: dict(begin), compose_saves_and_swaps(limits), full_schema
    )

    last_schema = extended(full_schema, _saved=count)

    def last_saved(batches):
        def rows():
            for key, pdf in whole_blocks(batches, bk):
                block = entered(pdf)
                swaps = block.swaps(int(pdf["_swapped_since"].iloc[0]))
                saved = int(pdf["_snapshots0"].iloc[0] + block.saves(int(pdf["_saved_since"].iloc[0]))[swaps[-1]]) if len(swaps) else None
                yield (*key, *[int(pdf[c].iloc[0]) for c in full_schema.fieldNames()[len(bk) :]], saved)

        yield from frames(rows(), last_schema)

    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.last("_saved", ignorenulls=True).over(before), F.lit(1)).alias("_saved0")
    entries = sorted_rows(entries).mapInPandas(last_saved, last_schema).select(*full_schema.fieldNames(), saved)
    # The window lays blocks out by key alone; without this the rows would follow them, a key in one task.
    entries = python_partitions(entries, bk)

    def number(batches):
        held, size = [], 0
        for out in numbered(batches):
            held.append(out)
            size += len(out)
            if size >= ROWS_PER_FRAME:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    def numbered(batches):
        for _, pdf in whole_blocks(batches, bk):
            block = entered(pdf)
            entry = {c: int(pdf[c].iloc[0]) for c in ("_learned0", "_others0", "_snapshots0", "_saved_since", "_swap0", "_swapped_since", "_saved0")}
            taken = entry["_snapshots0"] + block.saves(entry["_saved_since"])
            swaps = block.swaps(entry["_swapped_since"])
            hit = np.zeros(block.n, np.int64)
            hit[swaps] = 1
            swapped = np.cumsum(hit) - hit
            out = pdf[names].copy()
            out["learning_team"], out["round"], out["swap"] = block.learner, block.round, entry["_swap0"] + swapped
            out["saved"] = np.concatenate([[entry["_saved0"]], taken[swaps]])[swapped]
            out["snapshots"] = np.concatenate([[entry["_snapshots0"]], taken[:-1]])
            out["learning_step"], out["ghost_step"] = entry["_learned0"] + block.learned, entry["_others0"] + block.others
            yield out

    return short.unionByName(sorted_rows(entries).mapInPandas(number, out_schema))
