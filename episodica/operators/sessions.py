"""From step rows to episodes, experiences and trajectories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.vectors import zeros_like
from episodica.plans.ordered import block_of, block_width, fill_forward, prefix, with_halo
from episodica.schema import AGENT, TRAJECTORY


def order_key() -> Column:
    """Rows of one tick: terminal first, then the decision of a restarted agent."""
    return F.col("tick") * 2 + F.when(F.col("is_terminal"), F.lit(0)).otherwise(F.lit(1))


def sequenced(
    steps: DataFrame,
    ahead: list[str] | None = None,
    behind: list[str] | None = None,
    keys: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Number episodes and positions, and attach the next (`nxt`) and previous (`prv`) row of the agent.

    One exchange on (agent, tick block) serves the rows and the block summary; the carry is one row
    per block. Pass only the columns needed downstream: both branches then share the exchange.
    """
    keys = keys or AGENT
    bk = [*keys, "_b"]
    # The join below implies these filters; stating them keeps both branches' exchanges identical.
    for c in keys + ["tick"]:
        steps = steps.filter(F.col(c).isNotNull())
    base = (
        steps.withColumn("_ord", order_key())
        .withColumn("_b", block_of("tick", block_width(steps, width)))
        .filter(F.col("_b").isNotNull())
    )
    w = Window.partitionBy(*bk).orderBy("_ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_rn", F.row_number().over(w))
    marks = [
        F.sum(F.col("is_terminal").cast("long")).over(before).alias("_ep"),
        F.max(F.when(F.col("is_terminal"), F.col("_rn"))).over(before).alias("_lt"),
    ]
    summary = [
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("is_terminal").cast("long")).alias("_nt"),
        F.max(F.when(F.col("is_terminal"), F.col("_rn"))).alias("_bt"),
    ]
    if ahead:
        row = F.struct(*ahead)
        marks.append(F.lead(row).over(w).alias("_nx"))
        summary.append(F.min_by(row, F.col("_ord")).alias("_first"))
    if behind:
        row = F.struct(*behind)
        marks.append(F.lag(row).over(w).alias("_pv"))
        summary.append(F.max_by(row, F.col("_ord")).alias("_last"))
    blocks = local.groupBy(*bk).agg(*summary)
    bw = Window.partitionBy(*keys).orderBy("_b")
    past = bw.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumn("_rows0", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    carry = carry.select(
        *bk,
        F.coalesce(F.sum("_nt").over(past), F.lit(0)).alias("_ep0"),
        (
            F.col("_rows0") - F.coalesce(F.max(F.col("_rows0") + F.col("_bt")).over(past), F.lit(0))
        ).alias("_since0"),
        *([F.lead("_first").over(bw).alias("_nfirst")] if ahead else []),
        *([F.lag("_last").over(bw).alias("_plast")] if behind else []),
    )
    rows = local.select("*", *marks).join(carry, bk)
    position = F.when(F.col("_lt").isNull(), F.col("_since0") + F.col("_rn") - 1).otherwise(
        F.col("_rn") - F.col("_lt") - 1
    )
    out = rows.select(
        *steps.columns,
        (F.col("_ep0") + F.coalesce("_ep", F.lit(0))).alias("episode"),
        position.alias("i"),
        *([F.coalesce("_nx", "_nfirst").alias("_nxt")] if ahead else []),
        *([F.coalesce("_pv", "_plast").alias("_prv")] if behind else []),
    )
    if ahead:
        out = out.withColumn("nxt", F.when(~F.col("is_terminal"), F.col("_nxt"))).drop("_nxt")
    if behind:
        out = out.withColumn("prv", F.when(F.col("i") > 0, F.col("_prv"))).drop("_prv")
    return out


def with_episode(steps: DataFrame, width: int | None = None) -> DataFrame:
    return sequenced(steps, width=width)


# What an experience takes from the row after it: the consequence of the action.
CONSEQUENCE = ("reward", "group_reward", "is_terminal", "interrupted", "tick", "value_est", "obs", "action")


def to_experiences(
    steps: DataFrame, horizon: int = 64, behind: list[str] | None = None, width: int | None = None
) -> DataFrame:
    """Own observation and action of step t; reward, done and interrupted of step t+1.

    The last raw row of an episode only supplies the outcome. Positions are cut into segments of at
    most `horizon`; with the agent they form the bounded partition of all later windows. Pass only
    the columns needed downstream.
    """
    taken = [c for c in CONSEQUENCE if c in steps.columns]
    # All columns go into the neighbour struct: then rows and block summary need the same columns and
    # share one exchange.
    ahead = [c for c in steps.columns if c not in AGENT]
    seq = sequenced(steps, ahead=ahead, behind=behind, width=width).filter(F.col("nxt").isNotNull())
    moved = {"reward", "group_reward", "is_terminal", "interrupted"}
    keep = [c for c in steps.columns if c not in moved]
    out = [F.col(c) for c in keep]
    out += [F.col("episode"), F.expr(f"i div {int(horizon)}").alias("segment"), F.col("i")]
    out.append((F.col("i") % int(horizon)).alias("j"))
    for c in taken:
        name = {"is_terminal": "done", "tick": "next_tick", "value_est": "next_value"}.get(
            c, c if c in moved else f"next_{c}"
        )
        out.append(F.col(f"nxt.{c}").alias(name))
    if behind:
        out.append(F.col("prv"))
    return seq.select(*out)


def trajectory_window(descending: bool = False):
    order = F.col("i").desc() if descending else F.col("i")
    return Window.partitionBy(*TRAJECTORY).orderBy(order)


def with_next(exp: DataFrame, action: str = "action", mate_action: str | None = None) -> DataFrame:
    """Next action inside the trajectory: zeros after the last own step, the current one for mates."""
    w = trajectory_window()
    zero = zeros_like(F.col(action), exp.schema[action].dataType)
    out = exp.withColumn("next_action", F.coalesce(F.lead(action).over(w), zero))
    if mate_action:
        out = out.withColumn("next_mate_action", F.coalesce(F.lead(mate_action).over(w), F.col(mate_action)))
    return out


def with_prev_action(exp: DataFrame, action: str = "action") -> DataFrame:
    """Action of the step before in the same episode; zero at its start. Needs `prv` from to_experiences."""
    zero = zeros_like(F.col(action), exp.schema[action].dataType)
    return exp.withColumn("prev_action", F.coalesce(F.col(f"prv.{action}"), zero))


def trajectories(exp: DataFrame, horizon: int, *aggs: Column, complete_only: bool = True) -> DataFrame:
    """One row per trajectory; `arrival` is the tick that closed it. Open tails are not handed over."""
    out = exp.groupBy(*TRAJECTORY).agg(
        F.count(F.lit(1)).alias("length"),
        F.max("next_tick").alias("arrival"),
        F.max(F.col("done").cast("int")).cast("boolean").alias("done"),
        *aggs,
    )
    if complete_only:
        out = out.filter(F.col("done") | (F.col("length") >= horizon))
    return out


def episode_summary(exp: DataFrame) -> DataFrame:
    """Return, length and experience count of finished episodes; the length leaves out the last experience."""
    return (
        exp.groupBy(*AGENT, "episode")
        .agg(
            F.sum("reward").alias("episode_return"),
            F.sum((~F.col("done")).cast("long")).alias("episode_length"),
            F.count(F.lit(1)).alias("n_experiences"),
            F.max("next_tick").alias("end_tick"),
            F.max(F.col("done").cast("int")).alias("_finished"),
        )
        .filter("_finished = 1")
        .drop("_finished")
    )


def episode_returns(exp: DataFrame) -> DataFrame:
    return episode_summary(exp).select(*AGENT, "episode", "episode_return")


def episode_lengths(exp: DataFrame) -> DataFrame:
    return episode_summary(exp).select(*AGENT, "episode", "episode_length", "n_experiences")


def stack_obs(
    steps: DataFrame, k: int, obs: str = "obs", size: int | None = None, width: int | None = None
) -> DataFrame:
    """Last k observations, oldest first, zeros before the episode's start. Needs `episode` and `i`."""
    keys = [*AGENT, "episode"]
    spread, part = with_halo(steps, keys, "i", k - 1, width)
    w = Window.partitionBy(*part).orderBy("i").rowsBetween(-(k - 1), 0)
    dim = F.lit(size) if size else F.size(obs)
    element = dict(steps.dtypes)[obs].removeprefix("array<").removesuffix(">")
    frames = F.collect_list(obs).over(w)
    missing = F.lit(k) - F.size("_frames")
    zeros = F.array_repeat(F.lit(0).cast(element), (missing * dim).cast("int"))
    return (
        spread.withColumn("_frames", frames)
        .filter(~F.col("_halo"))
        .withColumn("stacked", F.concat(zeros, F.flatten("_frames")))
        .select(*steps.columns, "stacked")
    )


def resequence(exp: DataFrame, length: int, values: dict[str, float]) -> DataFrame:
    """Fixed-length sequences inside each trajectory; the last one is filled up at its END.

    `values` maps a numeric column to its pad factor: a padded row holds last value x factor, and
    array columns pad with an empty list. `mask` is 1 on real rows. The fill comes from the last row.
    """
    arrays = {c for c, t in exp.dtypes if t.startswith("array")}
    w = Window.partitionBy(*TRAJECTORY)
    last = exp.withColumn("_len", F.count(F.lit(1)).over(w))
    pads = F.pmod(-F.col("_len"), F.lit(length))
    copies = F.when(F.col("j") == F.col("_len") - 1, F.sequence(F.lit(0).cast("long"), pads)).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    spread = last.withColumn("_pad", F.explode(copies))
    real = F.col("_pad") == 0
    kinds = dict(exp.dtypes)
    cols = []
    for c in exp.columns:
        if c not in values:
            cols.append(F.col(c))
        elif c in arrays:
            cols.append(F.when(real, F.col(c)).otherwise(F.array().cast(kinds[c])).alias(c))
        else:
            padded = (F.col(c).cast("double") * F.lit(float(values[c]))).cast(kinds[c])
            cols.append(F.when(real, F.col(c)).otherwise(padded).alias(c))
    position = F.col("j") + F.col("_pad")
    return spread.select(
        *[c for c in cols],
        F.when(real, 1.0).otherwise(0.0).alias("mask"),
        F.expr(f"cast((j + _pad) div {int(length)} as bigint)").alias("seq"),
        (position % int(length)).alias("pos"),
    )


def sliding_sequences(exp: DataFrame, length: int, value: str) -> DataFrame:
    """Overlapping windows (stride 1) inside each trajectory; only full ones."""
    w = trajectory_window().rowsBetween(-(length - 1), 0)
    return (
        exp.withColumn("window", F.collect_list(value).over(w))
        .filter(F.size("window") == length)
        .withColumn("seq", F.col("j") - (length - 1))
    )


def fill_actions(ticks: DataFrame, action: str = "action", width: int | None = None) -> DataFrame:
    """Between decisions an agent repeats the action it last chose."""
    return fill_forward(ticks, AGENT, "tick", {"filled_action": F.col(action)}, width)


def reward_since_decision(ticks: DataFrame, width: int | None = None) -> DataFrame:
    """Reward handed over at each decision: the last `set` since the previous one plus later `add`s.

    Input: AGENT, tick, op ('add'/'set'), amount, is_decision. A decision row closes its interval. Of an interval each tick block
    gives one row: its sum since its last `set`, and whether it has one; these rows are put together, so an agent that never decides stays spread.
    """
    numbered = prefix(
        ticks,
        AGENT,
        "tick",
        {"_closed": F.col("is_decision").cast("long")},
        inclusive=False,
        width=width,
    ).withColumnRenamed("_closed", "decision")
    numbered = numbered.withColumn("_b", block_of("tick", block_width(ticks, width)))
    whole, part = [*AGENT, "decision"], [*AGENT, "decision", "_b"]
    last_set = F.max(F.when(F.col("op") == "set", F.col("tick"))).over(Window.partitionBy(*part))
    blocks = (
        numbered.withColumn("_set", last_set)
        .filter(F.col("_set").isNull() | (F.col("tick") >= F.col("_set")))
        .groupBy(*part)
        .agg(
            F.sum("amount").alias("amount"),
            F.max("tick").alias("tick"),
            F.max(F.col("is_decision").cast("int")).alias("closed"),
            F.max("_set").alias("_set"),
        )
    )
    last_block = F.max(F.when(F.col("_set").isNotNull(), F.col("_b"))).over(Window.partitionBy(*whole))
    return (
        blocks.withColumn("_last", last_block)
        .filter(F.col("_last").isNull() | (F.col("_b") >= F.col("_last")))
        .groupBy(*whole)
        .agg(F.sum("amount").alias("reward"), F.max("tick").alias("tick"), F.max("closed").alias("closed"))
    )


def decision_ticks(df: DataFrame, period: int, offset: int = 0) -> DataFrame:
    return df.filter(F.pmod(F.col("tick"), F.lit(period)) == F.lit(offset))


def decision_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_terminal"))


def terminal_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_terminal"))


def attach_actions(steps: DataFrame, actions: DataFrame) -> DataFrame:
    """The action chosen by an agent at a tick, joined to that tick's row."""
    return steps.join(actions, [*AGENT, "tick"])


def rolling_returns(episodes: DataFrame, n: int, width: int | None = None) -> DataFrame:
    """Mean of the last n finished episodes per behaviour, in order of finishing."""
    ranked = prefix(
        episodes, ["behavior_id"], "end_tick", {"_rank": F.lit(1)}, inclusive=False, width=width
    ).withColumnRenamed("_rank", "rank")
    spread, part = with_halo(ranked, ["behavior_id"], "rank", n - 1, width)
    w = Window.partitionBy(*part).orderBy("rank").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn("rolling_return", F.avg("episode_return").over(w))
        .withColumn("n_in_buffer", F.count(F.lit(1)).over(w))
        .filter(~F.col("_halo"))
        .select(*episodes.columns, "rank", "rolling_return", "n_in_buffer")
    )
