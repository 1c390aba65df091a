"""Per-agent state: trajectories assembled from a live step stream.

State per agent is bounded: the last raw step, two counters, and at most `horizon` open experiences.
Rows of one agent in one micro-batch (bounded by the source's rate limit) are put in order first.
"""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from episodica.schema import AGENT

CORE = {"tick": "long", "is_terminal": "boolean", "interrupted": "boolean", "reward": "double"}
PER_EXPERIENCE = {
    "tick": "long",
    "next_tick": "long",
    "i": "long",
    "reward": "double",
    "done": "boolean",
    "interrupted": "boolean",
}


def _ddl(cols: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in cols.items())


def in_order(rows) -> list[Row]:
    return sorted(rows, key=lambda r: (r.tick, not r.is_terminal))


class TrajectoryAssembler(StatefulProcessor):
    """Emits the experiences of a trajectory when it ends or reaches the horizon; keeps the rest open."""

    def __init__(self, horizon: int, extra: dict[str, str], resets: bool, ttl_ms: int | None = None, epochs: bool = False):
        self.horizon = horizon
        self.resets = resets
        self.epochs = epochs
        self.extra = extra
        self.ttl_ms = ttl_ms

    def init(self, handle):
        ahead = {f"next_{c}": t for c, t in self.extra.items()}
        names = Row(*AGENT, "episode", "segment", *PER_EXPERIENCE, *self.extra, *ahead)
        self.row = lambda values: names(*values)
        fields = {**PER_EXPERIENCE, **self.extra, **ahead}
        waiting = f"array<struct<{', '.join(f'{c}: {t}' for c, t in fields.items())}>>"
        # One value per agent: one read and one write per micro-batch.
        state = {"episode": "long", "i": "long", "epoch": "long", "waiting": waiting, "tick": "long", **self.extra}
        self.saved = handle.getValueState("agent", _ddl(state), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        names, resets = list(self.extra), self.resets
        episode, i, epoch, pending, last = 0, 0, 0, [], None
        before = self.saved.get()
        if before is not None:
            episode, i, epoch, waiting, tick, *rest = before
            pending = [tuple(x) for x in waiting]
            last = (tick, *rest) if tick >= 0 else None
        out = []
        for row in in_order(rows):
            reset = resets and row.is_reset
            tick, terminal, interrupted, reward = row.tick, row.is_terminal, row.interrupted, row.reward
            values = [row[n] for n in names]
            if self.epochs and row.epoch != epoch:
                # The worker was reset since the agent's last row.
                pending, last, i, episode, epoch = [], None, 0, episode + row.epoch - epoch, row.epoch
            if reset:
                # Drop what is open without handing it over; the next row starts afresh.
                pending, last, i, episode = [], None, 0, episode + 1
                continue
            if last is not None:
                pending.append((last[0], tick, i, reward, terminal, interrupted, *last[1:], *values))
                i += 1
            if pending and (terminal or len(pending) >= self.horizon):
                out.extend((*key, episode, p[2] // self.horizon, *p) for p in pending)
                pending = []
            if terminal:
                episode, i, last = episode + 1, 0, None
            else:
                last = (tick, *values)
        self.saved.update((episode, i, epoch, pending, *(last if last is not None else (-1, *(None,) * len(names)))))
        yield from map(self.row, out)

    def close(self):
        pass


def _prepared(steps: DataFrame, extra: dict[str, str]) -> DataFrame:
    cols = [F.col(c).cast(t).alias(c) for c, t in {**CORE, **extra}.items()]
    if "is_reset" in steps.columns:
        cols.append(F.coalesce("is_reset", F.lit(False)).alias("is_reset"))
    if "epoch" in steps.columns:
        cols.append(F.col("epoch").cast("long").alias("epoch"))
    return steps.select(*AGENT, *cols)


def with_epoch(steps: DataFrame, resets: DataFrame) -> DataFrame:
    """Adds epoch: how often a row's worker had been reset when it came.

    resets (worker_id, tick): control rows, a worker's reset standing before its rows of that tick. They reach all agents of the worker without being sent
    to any: an agent whose epoch changed finds out with its next row, and until then hands nothing over anyway. On a stream the table of
    resets is read anew for each micro-batch."""
    known = resets.groupBy("worker_id").agg(F.sort_array(F.collect_set("tick")).alias("_resets"))
    seen = F.coalesce(F.size(F.filter("_resets", lambda t: t <= F.col("tick"))), F.lit(0))
    return steps.join(known, "worker_id", "left").withColumn("epoch", F.greatest(seen, F.lit(0)).cast("long")).drop("_resets")


def stream_trajectories(
    steps: DataFrame, horizon: int, extra: dict[str, str] | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """Experiences of closed trajectories. `extra` names further columns (with type) to carry along;
    each comes with its next value. Rows with `is_reset` drop an agent's open trajectory, and so does a change of `epoch`
    (see `with_epoch`); both begin a new episode. `ttl_ms`
    forgets agents that vanished; it runs on processing time, so use it with a continuing trigger."""
    extra = extra or {}
    kinds = {f.name: f.dataType for f in steps.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in AGENT])
    schema = schema.add("episode", "long").add("segment", "long")
    for c, t in {**PER_EXPERIENCE, **extra, **{f"next_{c}": t for c, t in extra.items()}}.items():
        schema = schema.add(c, t)
    return (
        _prepared(steps, extra)
        .groupBy(*AGENT)
        .transformWithState(
            TrajectoryAssembler(horizon, extra, "is_reset" in steps.columns, ttl_ms, "epoch" in steps.columns),
            schema,
            "Append",
            "ProcessingTime" if ttl_ms else "None",
        )
    )


class EpisodeTotals(StatefulProcessor):
    """Return and length of each finished episode, from running sums only."""

    def init(self, handle):
        self.sums = handle.getValueState("sums", "episode long, ret double, n long, begun boolean")

    def handleInputRows(self, key, rows, timerValues):
        episode, ret, n, begun = self.sums.get() or (0, 0.0, 0, False)
        out = []
        for row in in_order(rows):
            terminal, reward, tick = row.is_terminal, row.reward, row.tick
            if begun:
                ret, n = ret + reward, n + 1
            if not terminal:
                begun = True
                continue
            if begun:
                out.append((*key, episode, ret, n - 1, tick))
            episode, ret, n, begun = episode + 1, 0.0, 0, False
        self.sums.update((episode, ret, n, begun))
        names = Row(*AGENT, "episode", "episode_return", "episode_length", "end_tick")
        yield from (names(*x) for x in out)

    def close(self):
        pass


def stream_episode_returns(steps: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in steps.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in AGENT])
    schema = schema.add("episode", "long").add("episode_return", "double").add("episode_length", "long").add("end_tick", "long")
    return _prepared(steps, {}).groupBy(*AGENT).transformWithState(EpisodeTotals(), schema, "Append", "None")
