"""Training diagnostics: losses and estimates as (partial) aggregates over step tables."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import vectors as V
from episodica.functions.concepts import BINARY_CONCEPTS
from episodica.functions.numbers import as_col, clip
from episodica.operators.replay import masked_mean


def _agg(df: DataFrame, by: list[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def policy_loss_terms(eps: float, log_prob="log_prob", old="old_log_prob", advantage="advantage", mask="mask") -> list[Column]:
    """Aggregates: clipped surrogate loss, share of clipped ratios and mean ratio."""
    ratio = F.exp(F.col(log_prob) - F.col(old))
    a = F.col(advantage)
    surrogate = F.least(ratio * a, clip(ratio, 1 - eps, 1 + eps) * a)
    return [
        (-masked_mean(surrogate, mask)).alias("policy_loss"),
        masked_mean((F.abs(ratio - 1.0) > eps).cast("double"), mask).alias("clip_fraction"),
        masked_mean(ratio, mask).alias("mean_ratio"),
    ]


def ppo_policy_loss(df: DataFrame, by: list[str], eps: float, **columns: str) -> DataFrame:
    return _agg(df, by, *policy_loss_terms(eps, **columns))


def value_loss_term(eps: float, signals: dict[str, tuple[str, str, str]], mask="mask") -> Column:
    """Aggregate: value loss inside a trust region; `signals` maps a name to (value, old value, return) columns."""
    losses = []
    for value, old, returns in signals.values():
        v, o, ret = F.col(value), F.col(old), F.col(returns)
        inside = o + clip(v - o, -eps, eps)
        worst = F.greatest(F.pow(ret - v, F.lit(2.0)), F.pow(ret - inside, F.lit(2.0)))
        losses.append(masked_mean(worst, mask))
    return V.add_up(losses) / len(losses)


def ppo_value_loss(df: DataFrame, by: list[str], eps: float, signals: dict[str, tuple[str, str, str]], mask="mask", alias="value_loss") -> DataFrame:
    return _agg(df, by, value_loss_term(eps, signals, mask).alias(alias))


def objective(policy_loss, value_loss, entropy, beta: float, baseline_loss=None) -> Column:
    """policy + 0.5 value - beta entropy; the cooperative form adds half the baseline loss to the value's."""
    value = as_col(value_loss)
    if baseline_loss is not None:
        value = value + 0.5 * as_col(baseline_loss)
    return as_col(policy_loss) + 0.5 * value - F.lit(float(beta)) * as_col(entropy)


# --- off-policy ------------------------------------------------------------------------------


def q_backup(reward, done, gamma: float, target_value, use_done: bool = True) -> Column:
    alive = 1.0 - as_col(done).cast("double") if use_done else F.lit(1.0)
    return as_col(reward) + alive * F.lit(float(gamma)) * as_col(target_value)


def half_mse(a, b, mask) -> Column:
    return 0.5 * masked_mean(F.pow(as_col(a) - as_col(b), F.lit(2.0)), mask)


def sac_continuous(df: DataFrame, by: list[str], gamma: float, ent_coef: float, target_entropy: float, mask="mask") -> DataFrame:
    """Columns: q1, q2, q1p, q2p, value, target_value, reward, done, log_probs (array)."""
    log_prob = V.total("log_probs")
    backup = q_backup("reward", "done", gamma, "target_value")
    v_backup = F.least(F.col("q1p"), F.col("q2p")) - F.lit(ent_coef) * log_prob
    return _agg(
        df,
        by,
        half_mse(backup, "q1", mask).alias("q1_loss"),
        half_mse(backup, "q2", mask).alias("q2_loss"),
        half_mse("value", v_backup, mask).alias("value_loss"),
        masked_mean(F.lit(ent_coef) * log_prob - F.col("q1p"), mask).alias("policy_loss"),
        (-masked_mean(F.lit(ent_coef) * (log_prob + target_entropy), mask)).alias("entropy_loss"),
    )


def sac_discrete(df: DataFrame, by: list[str], sizes: list[int], ent_coefs: list[float], target_entropies: list[float], mask="mask") -> DataFrame:
    """Columns: value, q1p, q2p (one value per action), log_probs (all actions), branches concatenated."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    lp, q1, q2 = ([V.items(c, n, at) for n, at in zip(sizes, starts)] for c in ("log_probs", "q1p", "q2p"))

    def expected(values: list[Column], log_probs: list[Column]) -> Column:
        return V.add_up([x * F.exp(y) for x, y in zip(values, log_probs)])

    n = float(len(sizes))
    mean_q1 = V.add_up([expected(q, p) for q, p in zip(q1, lp)])
    mean_q2 = V.add_up([expected(q, p) for q, p in zip(q2, lp)])
    bonus = [expected(p, p) for p in lp]
    weighted = [F.lit(c) * b for c, b in zip(ent_coefs, bonus)]
    v_backup = F.least(mean_q1 / n, mean_q2 / n) - V.add_up(weighted) / n
    policy = V.add_up(weighted) - mean_q1
    entropy = [F.lit(c) * (b + F.lit(t)) for c, b, t in zip(ent_coefs, bonus, target_entropies)]
    return _agg(
        df,
        by,
        half_mse("value", v_backup, mask).alias("value_loss"),
        masked_mean(policy, mask).alias("policy_loss"),
        (-masked_mean(V.add_up(entropy) / n, mask)).alias("entropy_loss"),
    )


def smooth_l1(a, b) -> Column:
    d = F.abs(as_col(a) - as_col(b))
    return F.when(d < 1.0, 0.5 * d * d).otherwise(d - 0.5)


def dqn_metrics(df: DataFrame, by: list[str], gamma: float, greedy_from: str = "current") -> DataFrame:
    """Q-learning target and loss. The greedy action comes from the current or the next Q values."""
    chosen = V.greedy_action("q" if greedy_from == "current" else "q_next")
    target = q_backup("reward", "done", gamma, F.get(F.col("q_next"), chosen.cast("int")))
    current = F.get(F.col("q"), F.col("action"))
    return _agg(df, by, F.avg(target).alias("mean_target"), F.avg(smooth_l1(current, target)).alias("q_loss"))


# --- imitation and curiosity -----------------------------------------------------------------


def bc_loss(df: DataFrame, by: list[str], sizes: list[int], continuous: tuple[str, str] | None = None, discrete: tuple[str, str] | None = None) -> DataFrame:
    """Squared error of continuous actions plus cross-entropy of the branches, both as means."""
    terms = []
    if continuous:
        a, b = continuous
        terms.append(F.sum(V.squared_distance(a, b)) / F.sum(F.size(a)))
    if discrete:
        logits, actions = discrete
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        parts = [
            V.log_sum_exp(V.items(logits, n, at)) - F.get(F.col(logits), F.get(F.col(actions), F.lit(i)) + at)
            for i, (n, at) in enumerate(zip(sizes, starts))
        ]
        terms.append(F.avg(V.add_up(parts) / float(len(sizes))))
    return _agg(df, by, V.add_up(terms).alias("bc_loss"))


def curiosity_loss(df: DataFrame, by: list[str], predicted: str, actual: str, action_probs: str, action: str, mask: str) -> DataFrame:
    """Means over the unmasked rows: next-state error and cross-entropy of the guessed action."""
    m = F.col(mask)
    inverse = -F.ln(F.get(F.col(action_probs), F.col(action)) + F.lit(V.EPS))
    return _agg(
        df,
        by,
        F.avg(F.when(m, V.curiosity_reward(predicted, actual))).alias("forward_loss"),
        F.avg(F.when(m, inverse)).alias("inverse_loss"),
    )


def gail_terms(policy="policy_estimate", expert="expert_estimate") -> list[Column]:
    p, e = F.col(policy), F.col(expert)
    return [
        F.avg(p).alias("policy_mean"),
        F.avg(e).alias("expert_mean"),
        (-F.avg(F.ln(e + F.lit(V.EPS)) + F.ln(1.0 - p + F.lit(V.EPS)))).alias("discriminator_loss"),
    ]


def gail_metrics(pairs: DataFrame, by: list[str], policy="policy_estimate", expert="expert_estimate") -> DataFrame:
    return _agg(pairs, by, *gail_terms(policy, expert))


def variational_kl_term(policy_mu: str, expert_mu: str, sigma: float) -> Column:
    s2 = float(sigma) ** 2
    per_dim = F.zip_with(
        policy_mu,
        expert_mu,
        lambda p, e: F.lit(1.0 + float(np.log(s2)) - s2) - 0.5 * e * e - 0.5 * p * p,
    )
    return F.avg(-V.total(per_dim)).alias("kl_loss")


def variational_kl(pairs: DataFrame, by: list[str], policy_mu: str, expert_mu: str, sigma: float) -> DataFrame:
    return _agg(pairs, by, variational_kl_term(policy_mu, expert_mu, sigma))


# --- concept vectors -------------------------------------------------------------------------


def concept_sparsity(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """Mean distance of a concept to the nearer of 0 and 1."""
    nearer = V.total(F.transform(vec, lambda c: F.least(c, 1.0 - c)))
    return _agg(df, by or [], (F.sum(nearer) / F.sum(F.size(vec))).alias("sparsity"))


def gram_matrix(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """X'X in long form (i, j, g). Each task reduces its rows to one partial matrix."""

    def partial(batches):
        acc = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                acc += x.T @ x
        yield pd.DataFrame({"g": [acc.reshape(-1)]})

    cells = df.select(vec).mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("p", "g"))
    summed = cells.groupBy("p").agg(F.sum("g").alias("g"))
    return summed.select(
        F.expr(f"cast(p div {dim} as int)").alias("i"), (F.col("p") % dim).alias("j"), "g"
    )


def concept_diversity(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Mean squared cosine between different concepts (columns); 0 when all are orthogonal."""
    gram = gram_matrix(df, vec, dim)
    norms = gram.filter("i = j").select(F.col("i").alias("k"), F.greatest(F.sqrt("g"), F.lit(1e-12)).alias("n"))
    return (
        gram.filter("i <> j")
        .join(norms.withColumnsRenamed({"k": "i", "n": "ni"}), "i")
        .join(norms.withColumnsRenamed({"k": "j", "n": "nj"}), "j")
        .agg((F.sum(F.pow(F.col("g") / F.col("ni") / F.col("nj"), F.lit(2.0))) / float(dim * (dim - 1))).alias("diversity"))
    )


def reconstruction_loss(df: DataFrame, rebuilt: str, original: str, by: list[str] | None = None) -> DataFrame:
    return _agg(
        df,
        by or [],
        (F.sum(V.squared_distance(rebuilt, original)) / F.sum(F.size(original))).alias("reconstruction"),
    )


def concept_total(reconstruction, sparsity, diversity, weights: tuple[float, float, float]) -> Column:
    r, s, d = (F.lit(float(w)) for w in weights)
    return r * as_col(reconstruction) + s * as_col(sparsity) + d * as_col(diversity)


def per_concept_scores(joined: DataFrame) -> DataFrame:
    """Loss and accuracy per concept. Columns: concept, logit, label, mask (boolean).

    Labels are brought into [0, 1]; a concept with NaN logits is left out; if any of its logits is
    infinite, all of them are clamped to [-10, 10].
    """
    raw, t0, m = F.col("logit"), F.col("label"), F.col("mask")
    t = clip(F.when(F.isnan(t0), 0.0).otherwise(t0), 0, 1)
    binary = F.col("concept").isin(*BINARY_CONCEPTS)

    def loss(p):
        bce = F.greatest(p, F.lit(0.0)) - p * t + F.log1p(F.exp(-F.abs(p)))
        mse = F.pow(clip(V.sigmoid(p), 0.01, 0.99) - t, F.lit(2.0))
        return F.when(binary, bce).otherwise(mse)

    hit = ((raw >= 0).cast("double") == F.rint(t)).cast("double")
    weight = F.sum(m.cast("double"))
    as_is = F.sum(F.when(m, loss(raw)).otherwise(0.0))
    clamped = F.sum(F.when(m, loss(clip(raw, -10, 10))).otherwise(0.0))
    any_inf = F.max((F.abs(raw) == F.lit(float("inf"))).cast("int")) == 1
    return (
        joined.groupBy("concept")
        .agg(
            (F.when(any_inf, clamped).otherwise(as_is) / (weight + 1e-8)).alias("loss"),
            F.avg(F.when(m & binary, hit)).alias("accuracy"),
            F.max(F.isnan(raw).cast("int")).alias("_nan"),
            weight.alias("_w"),
        )
        .filter("_nan = 0 AND _w > 0")
        .drop("_nan", "_w")
    )


def concept_scores(scored: DataFrame) -> DataFrame:
    """Mean loss over concepts and mean accuracy over the yes/no ones, from rows as for `per_concept_scores`."""
    scores = per_concept_scores(scored)
    return scores.agg(F.avg("loss").alias("concept_loss"), F.avg("accuracy").alias("concept_accuracy"))
