"""Group mates: what each agent last saw of the others in its group.

Visibility inside a tick: terminal rows come first and see only terminal rows of the same tick;
decision rows see everything of the tick, including mates that just ended. A mate that ended is
forgotten after its tick. All of this is order on `2*tick + phase`, with a removal at `2*(tick+1)`.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators.sessions import order_key, sequenced
from episodica.plans.folds import python_partitions
from episodica.plans.lineage import cut
from episodica.plans.ordered import block_width, fill_forward, prefix
from episodica.schema import AGENT, GROUP


def statuses(steps: DataFrame, width: int | None = None) -> DataFrame:
    """Experiences in the row that completes them: `prv` holds all columns of the step they began with, `nxt` names the agent's next row."""
    rest = [c for c in steps.columns if c not in AGENT]
    # All columns go into both neighbours, so that rows and block summary share one exchange whatever is read of them.
    seq = sequenced(steps, ahead=rest, behind=rest, width=width)
    following = F.when(F.col("nxt").isNotNull(), F.struct("nxt.tick", "nxt.is_terminal"))
    return seq.filter(F.col("i") > 0).withColumns({"nxt": following, "ord": order_key()})


def group_totals(status: DataFrame, width: int | None = None) -> DataFrame:
    """Number of live mates, their summed last reward and how many are done, per experience row.

    No pair of agents is formed: every status adds its change to a running group total (prefix sum
    over the group's order), and a row subtracts its own share. Rows outside a group have no mates.
    """
    first = F.col("i") == 1
    change = F.struct(
        F.col("ord"),
        (F.col("reward") - F.when(first, F.lit(0.0)).otherwise(F.col("prv.reward"))).alias("dr"),
        F.when(first, 1).otherwise(0).cast("long").alias("dn"),
        F.col("is_terminal").cast("long").alias("dd"),
    )
    removal = F.struct(
        (F.col("tick") * 2 + 2).alias("ord"),
        (-F.col("reward")).alias("dr"),
        F.lit(-1).cast("long").alias("dn"),
        F.lit(-1).cast("long").alias("dd"),
    )
    changes = F.when(F.col("is_terminal"), F.array(change, removal)).otherwise(F.array(change))
    grouped = status.filter(F.col("group_id") > 0)
    per_order = (
        grouped.select(*GROUP, F.explode(changes).alias("_c"))
        .groupBy(*GROUP, "_c.ord")
        .agg(F.sum("_c.dr").alias("dr"), F.sum("_c.dn").alias("dn"), F.sum("_c.dd").alias("dd"))
    )
    running = prefix(
        per_order,
        GROUP,
        "ord",
        {"_r": F.col("dr"), "_n": F.col("dn"), "_d": F.col("dd")},
        width=2 * block_width(status, width),
    ).select(*GROUP, "ord", "_r", "_n", "_d")
    out = status.join(running, [*GROUP, "ord"], "left")
    n = F.coalesce(F.col("_n") - 1, F.lit(0))
    d = F.coalesce(F.col("_d") - F.col("is_terminal").cast("long"), F.lit(0))
    return out.select(
        *status.columns,
        n.alias("n_mates"),
        F.coalesce(F.col("_r") - F.col("reward"), F.lit(0.0)).alias("mates_reward"),
        d.alias("n_done_mates"),
        (n == d).alias("group_done"),
    )


# The binary digits by which buckets of a level are wider than those of the level below.
WIDER = 2


def level_of(length: Column) -> Column:
    """The lowest level whose buckets are as wide as an interval of this length."""
    digits = F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)
    return F.floor((digits + WIDER - 1) / WIDER).cast("int")


def bucket(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position, level * WIDER)


# Rows that a block of a group's order holds at least, the most blocks of a group, and a block's rows for each status carried into it.
FEWEST, MOST, CARRIED = 4096, 128, 4
# Before and after all ticks; a tick number leaves two bits to spare.
EVER = 1 << 61


def until() -> Column:
    """The order point at which a status ends: the agent's next row, or the end of the tick in which it is forgotten."""
    following = F.col("nxt.tick") * 2 + F.when(F.col("nxt.is_terminal"), 0).otherwise(1)
    ended = F.when(F.col("nxt").isNotNull(), following).when(F.col("is_terminal"), F.col("tick") * 2 + 2)
    return F.coalesce(ended, F.lit(2 * EVER))


def in_blocks(rows: DataFrame, where: DataFrame) -> DataFrame:
    """Statuses with `_to` in their own block (`_own`) and in each later one that they last into, as `_block`. Groups without a table entry are one block.

    The table has no more rows than one for each FEWEST rows of the log and is sent to all tasks, so no status is moved to meet it."""
    edges = F.concat(F.array(F.lit(-EVER)), F.col("_starts"), F.array(F.lit(EVER)))
    spans = where.filter("_end > 0").select(*[F.col(c).alias(f"_{c}") for c in GROUP], edges.alias("_edges"), F.explode(F.sequence(F.lit(0), "_end")).alias("_block"))
    spans = spans.select(*[f"_{c}" for c in GROUP], "_block", F.get("_edges", F.col("_block")).alias("_low"), F.get("_edges", F.col("_block") + 1).alias("_high"))
    met = F.lit(True)
    for c in GROUP:
        met &= F.col(c) == F.col(f"_{c}")
    met &= (F.col("tick") < F.col("_high")) & ((F.col("tick") >= F.col("_low")) | (F.col("_to") > F.col("_low") * 2))
    own = F.coalesce(F.col("tick") >= F.col("_low"), F.lit(True))
    found = rows.join(F.broadcast(spans), met, "left")
    return found.select(*rows.columns, F.coalesce("_block", F.lit(0)).alias("_block"), own.alias("_own"))


def blocks_of_ticks(body: DataFrame) -> DataFrame:
    """(group, _starts, _end): the ticks at which the blocks of a group's order begin, but for the first, and the last block's number.

    Rows are counted, not ticks, so a burst makes more blocks; rows of one tick share one. Starts are quantiles of a group's ticks, as many
    as leave FEWEST rows to a block; of these every n-th is kept, such that the statuses carried into blocks are a CARRIED-th of the rows at most."""
    sizes = cut(body.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")), "groups")
    none = F.array().cast("array<bigint>")
    long = sizes.filter(F.col("_n") >= 2 * FEWEST)
    if long.isEmpty():
        return sizes.select(*GROUP, none.alias("_starts"), F.lit(0).alias("_end"))

    def every(at: str, step: Column) -> list[Column]:
        starts = F.array_distinct(F.filter(at, lambda x, i: (i + 1) % step == 0))
        return [starts.alias("_starts"), F.size(starts).alias("_end")]

    quantiles = F.percentile_approx("tick", [i / MOST for i in range(1, MOST)], 4 * MOST).alias("_at")
    at = body.select(*GROUP, "tick").join(F.broadcast(long), GROUP).groupBy(*GROUP).agg(quantiles, F.first("_n").alias("_n"))
    fine = cut(at.select(*GROUP, "_n", *every("_at", F.ceil(F.lit(MOST * FEWEST) / F.col("_n")))), "blocks")
    carried = in_blocks(body.select(*GROUP, "tick", until().alias("_to")), fine).filter(~F.col("_own"))
    carried = carried.groupBy(*GROUP).agg((F.count(F.lit(1)) * CARRIED).alias("_carried"))
    step = F.greatest(F.ceil(F.coalesce("_carried", F.lit(0)) / F.col("_n")), F.lit(1))
    kept = fine.withColumnsRenamed({"_starts": "_at"}).drop("_end").join(carried, GROUP, "left").select(*GROUP, *every("_at", step))
    out = sizes.select(*GROUP).join(kept, GROUP, "left")
    return cut(out.select(*GROUP, F.coalesce("_starts", none).alias("_starts"), F.coalesce("_end", F.lit(0)).alias("_end")), "blocks")


# Pairs of a row and a status looked at together, and mates in a frame of rows handed out.
PAIRS, MATES = 1 << 21, 1 << 18


class Sweep:
    """One pass over a block's order with the statuses that are valid; rows are taken some at a time, their mates found in one comparison.

    Memory holds the valid statuses, a frame of rows and the lists of a frame handed out, whatever the block's length."""

    def __init__(self, payload: list[str], names: list[str], alike: bool, reduced: "Reduced | None"):
        self.members, self.names, self.alike, self.reduced = ["agent_id", *payload], names, alike, reduced
        self.key: tuple | None = None
        self.agent, self.to, self.at = (np.zeros(0, np.int64) for _ in range(3))
        self.since = np.zeros(0, np.int64)
        self.store: pa.StructArray | None = None

    def frames(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of one order point come together, whatever frames they come in."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            runs = self.changes(table, [*GROUP, "_block", "_own", "ord"])
            held = table.slice(int(runs[-1]))
            if runs[-1]:
                yield from self.swept(table.slice(0, int(runs[-1])))
        if held is not None:
            yield from self.swept(held)

    @staticmethod
    def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
        """Where rows begin that differ from the ones before."""
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            v = table[c].combine_chunks()
            v = (v.dictionary_encode().indices if pa.types.is_string(v.type) or pa.types.is_large_string(v.type) else v).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def swept(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        new = members(table, self.members)
        n0 = len(self.at)
        self.at = np.arange(n0)
        self.store = new if not n0 else pa.concat_arrays([self.store, new])
        agent, ord_, to = (table[c].to_numpy() for c in ("agent_id", "ord", "_to"))
        own, emit = (table[c].to_numpy() for c in ("_own", "_emit"))
        starts = self.changes(table, [*GROUP, "_block"]).tolist()
        out = Lists(table, self.store, self.names, self.reduced)
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            key = tuple(table[c][a].as_py() for c in (*GROUP, "_block"))
            if key != self.key:
                self.key = key
                self.keep(np.zeros(len(self.agent), bool))
            # Statuses carried in come first.
            first = a + int(np.searchsorted(own[a:b], True))
            if first > a:
                self.add(agent[a:first], ord_[a:first], to[a:first], np.arange(n0 + a, n0 + first))
            ends = np.append(np.flatnonzero(ord_[first + 1 : b] != ord_[first : b - 1]) + first + 1, b)
            while first < b:
                valid = len(self.agent)
                some = min(max(valid // 2, 64), max(PAIRS // (valid + 64), 1), 4096)
                end = int(ends[np.searchsorted(ends, min(first + some, b))])
                self.add(agent[first:end], ord_[first:end], to[first:end], np.arange(n0 + first, n0 + end))
                rows = np.arange(first, end)
                if self.alike:
                    rows = self.each_with_all(rows, agent, ord_)
                rows = rows[emit[rows]]
                part = max(PAIRS // len(self.agent), 1)
                for k in range(0, len(rows), part):
                    r = rows[k : k + part]
                    o = ord_[r][:, None]
                    there = (self.since <= o) & (o < self.to) & (self.agent != agent[r][:, None])
                    yield from out.add(r, np.count_nonzero(there, axis=1), np.broadcast_to(self.at, there.shape)[there])
                self.keep(self.to > ord_[end - 1])
                first = end
        yield from out.handed()
        self.store = self.store.take(pa.array(self.at))

    @staticmethod
    def each_with_all(rows: np.ndarray, agent: np.ndarray, ord_: np.ndarray) -> np.ndarray:
        """Rows of one agent and point, which stand side by side, once for each of them."""
        new = np.ones(len(rows), bool)
        new[1:] = (agent[rows[1:]] != agent[rows[:-1]]) | (ord_[rows[1:]] != ord_[rows[:-1]])
        if new.all():
            return rows
        sizes = np.diff(np.append(np.flatnonzero(new), len(rows)))
        return np.repeat(rows, np.repeat(sizes, sizes))

    def add(self, agent: np.ndarray, since: np.ndarray, to: np.ndarray, at: np.ndarray) -> None:
        agent = np.concatenate([self.agent, agent])
        by_agent = np.argsort(agent, kind="stable")
        self.agent = agent[by_agent]
        for name, x in (("since", since), ("to", to), ("at", at)):
            setattr(self, name, np.concatenate([getattr(self, name), x])[by_agent])

    def keep(self, valid: np.ndarray) -> None:
        for name in ("agent", "since", "to", "at"):
            setattr(self, name, getattr(self, name)[valid])


# What is made of a frame's lists, an array for each column, and the columns' types.
Reduced = tuple[Callable[[pa.ListArray], dict[str, pa.Array]], str]


def members(table: pa.Table, columns: list[str]) -> pa.StructArray:
    found = [table[c].combine_chunks() for c in columns]
    return pa.StructArray.from_arrays(found, fields=[pa.field(c, m.type) for c, m in zip(columns, found)])


def with_lists(rows: pa.Table, lists: pa.ListArray, reduced: Reduced | None) -> list[pa.RecordBatch]:
    columns = reduced[0](lists) if reduced else {"group_status": lists}
    for name, column in columns.items():
        rows = rows.append_column(name, column)
    return rows.combine_chunks().to_batches()


def sums(lists: pa.ListArray, values: pa.Array) -> pa.Array:
    """Sum of the values of each list's members; null where one of them is."""
    offsets = lists.offsets.to_numpy()
    some = np.flatnonzero(offsets[1:] > offsets[:-1])

    def added(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lists), x.dtype)
        if len(some):
            out[some] = np.add.reduceat(x, offsets[some])
        return out

    unknown = added(values.is_null().to_numpy(zero_copy_only=False).astype(np.int64)) > 0 if values.null_count else None
    filled = values.fill_null(0) if values.null_count else values
    return pa.array(added(filled.to_numpy(zero_copy_only=False)), mask=unknown)


class Lists:
    """Rows with their lists, or what is made of these, handed out in frames of about MATES mates."""

    def __init__(self, table: pa.Table, store: pa.StructArray, names: list[str], reduced: Reduced | None):
        self.rows, self.store, self.reduced = table.select(names), store, reduced
        self.held: list[tuple] = []
        self.mates = 0

    def add(self, rows: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sizes)
        start, done = 0, 0
        while start < len(rows):
            room = max(MATES - self.mates, 1)
            end = max(int(np.searchsorted(ends, done + room, "right")), start + 1)
            self.held.append((rows[start:end], sizes[start:end], at[done : int(ends[end - 1])]))
            self.mates += int(ends[end - 1]) - done + end - start
            start, done = end, int(ends[end - 1])
            if self.mates >= MATES or start < len(rows):
                yield from self.handed()

    def handed(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows, sizes, at = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.mates = [], 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, self.store.take(pa.array(at)))
        yield from with_lists(self.rows.take(pa.array(rows)), lists, self.reduced)


def listed(status: DataFrame, payload: list[str], reduced: Reduced | None) -> T.StructType:
    """Columns of rows with their lists."""
    mate = T.StructType([status.schema[c] for c in ("agent_id", *payload)])
    more = T.StructType.fromDDL(reduced[1]) if reduced else T.StructType().add("group_status", T.ArrayType(mate))
    return T.StructType([*status.schema.fields, *more.fields])


def with_mates(
    status: DataFrame, payload: list[str], emit: Column | None = None, alike: bool = False, reduced: Reduced | None = None
) -> DataFrame:
    """Rows of groups (those to `emit`) with the status list of their group at their order point, sorted by agent, without the row's own status.

    A status is valid from its order point until its agent's next one, or until the agent is forgotten. The group's order is cut into blocks, every status is
    moved once to its own and, as a fixed part of the rows, to blocks it lasts into; a pass over each block knows the valid ones. No list is moved. `alike`
    gives each row once for each row of the same agent and point. With `reduced` its columns come in place of the lists, which it is given
    where they are made: they are as long as the group is large, and to hand them out costs many times what it takes to make them."""
    where = blocks_of_ticks(status)
    emitted = F.lit(True) if emit is None else F.coalesce(emit, F.lit(False))
    laid = python_partitions(in_blocks(status.withColumn("_to", until()), where).drop("_to"), [*GROUP, "_block"])
    laid = laid.sortWithinPartitions(*GROUP, "_block", "_own", "ord", "agent_id").select("*", until().alias("_to"), emitted.alias("_emit"))
    names = status.columns
    return laid.mapInArrow(lambda batches: Sweep(payload, names, alike, reduced).frames(batches), listed(status, payload, reduced))


# What the lists of mates hang on, besides the payload.
BASE = (*GROUP, "agent_id", "tick", "is_terminal", "nxt", "ord")


def mate_lists(status: DataFrame, payload: list[str], emit: Column | None = None, reduced: Reduced | None = None) -> DataFrame:
    """The status list of each row's group at its order point, sorted by agent, without the row's own status."""
    wanted = F.lit(True) if emit is None else emit
    body = status.filter(F.col("group_id") > 0).select(*BASE, *[c for c in payload if c not in BASE], wanted.alias("_wanted"))
    return with_mates(cut(body, "statuses"), payload, F.col("_wanted"), reduced=reduced).drop(*[c for c in body.columns if c not in (*GROUP, "agent_id", "ord")])


def group_status(status: DataFrame, payload: list[str], reduced: Reduced | None = None) -> DataFrame:
    """Experience rows with the list of their mates' last statuses (empty outside a group), or with what `reduced` makes of it.

    Rows of one agent at one point are told apart by nothing: each comes with the list of each."""
    kept = cut(status, "statuses")
    inside = F.coalesce(F.col("group_id") > 0, F.lit(False))
    found = with_mates(kept.filter(inside), payload, alike=True, reduced=reduced)

    def alone(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32)), members(rows.slice(0, 0), ["agent_id", *payload]))
            yield from with_lists(rows, lists, reduced)

    return found.unionByName(kept.filter(~inside).mapInArrow(alone, listed(status, payload, reduced)))


def next_group_obs(status: DataFrame, horizon: int, obs: str, reduced: Reduced | None = None) -> DataFrame:
    """At the row that closes a trajectory: the current observation of every mate, or what `reduced` makes of them."""
    ends = F.col("is_terminal") | ((F.col("i") - 1) % horizon == horizon - 1)
    return mate_lists(status, [obs], emit=ends, reduced=reduced).withColumnRenamed("group_status", "next_group_obs")


def group_returns(totals: DataFrame) -> DataFrame:
    """Group reward of an agent's episode, reported where the whole group was done when it ended."""
    return (
        totals.groupBy(*GROUP, "agent_id", "episode")
        .agg(
            F.sum("group_reward").alias("group_return"),
            F.max(F.when(F.col("is_terminal") & F.col("group_done"), F.col("tick"))).alias("end_tick"),
        )
        .filter(F.col("end_tick").isNotNull())
    )


def broadcast_group_reward(rewards: DataFrame, decisions: DataFrame, width: int | None = None) -> DataFrame:
    """What each member's decisions receive of the group's rewards: of those since its last decision, the last `set` plus later `add`s.

    rewards: group_id, tick, op ('add'/'set'), amount; decisions: group_id, agent_id, tick. A reward of a decision's own tick belongs to it.
    Rewards and decisions of a group stand in one order; running sums, and their value before the last `set`, tell every decision what it receives, so
    the output is one row a decision and no member meets a reward."""
    none = F.lit(None)
    one = rewards.select(
        "group_id", none.cast("long").alias("agent_id"), (F.col("tick") * 2).alias("_at"), F.col("amount").cast("double").alias("amount"),
        (F.col("op") == "set").alias("_set"),
    ).groupBy("group_id", "agent_id", "_at").agg(F.sum("amount").alias("amount"), F.max("_set").alias("_set"))
    own = decisions.select("group_id", "agent_id", (F.col("tick") * 2 + 1).alias("_at"), F.lit(0.0).alias("amount"), F.lit(False).alias("_set"))
    order = ["_at", "agent_id"]
    summed = prefix(one.unionByName(own), ["group_id"], "_at", {"_sum": F.col("amount")}, order, width=width)
    last_set = F.when(F.col("_set"), F.struct("_at", (F.col("_sum") - F.col("amount")).alias("before")))
    known = fill_forward(summed, ["group_id"], "_at", {"_last": last_set}, width)
    mine = known.filter(F.col("agent_id").isNotNull()).withColumn("is_terminal", F.lit(False)).withColumnRenamed("_at", "tick")
    mine = sequenced(mine.select("group_id", "agent_id", "tick", "is_terminal", "_sum", "_last"), behind=["tick", "_sum"], keys=["group_id", "agent_id"], width=width)
    fresh = F.col("_last").isNotNull() & (F.col("prv").isNull() | (F.col("_last._at") > F.col("prv.tick")))
    base = F.when(fresh, F.col("_last.before")).otherwise(F.coalesce("prv._sum", F.lit(0.0)))
    return mine.select("group_id", "agent_id", F.expr("tick div 2").alias("tick"), (F.col("_sum") - base).alias("group_reward"))
