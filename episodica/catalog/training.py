"""Training diagnostics over order lines standing in for update batches."""

from pyspark.sql import functions as F

from episodica.catalog import query, r, table
from episodica.catalog.columns import EMB_SQL, _nsql, embeddings, navigation
from episodica.functions import concepts as C
from episodica.functions import vectors as V
from episodica.functions.concepts import CONCEPTS
from episodica.functions.numbers import steady
from episodica.operators import metrics as M

# An order line read as one row of an update batch.
BATCH_SQL = """
b AS (SELECT l_returnflag AS batch, -l_discount * 5 - 0.1::DOUBLE AS lp, -l_tax * 5 - 0.1::DOUBLE AS olp,
  (l_quantity - 25) / 10.0::DOUBLE AS adv, l_discount * 10 AS val, l_tax * 10 AS oval, l_quantity / 10.0::DOUBLE AS ret,
  l_linestatus = 'F' AS m, l_linenumber % 2 = 0 AS done, l_linenumber AS ln, l_extendedprice / 50000.0::DOUBLE AS px
  FROM lineitem)"""
MN = lambda x: f"sum(CASE WHEN m THEN {x} ELSE 0 END) / greatest(sum(CAST(m AS INT)), 1)"


def batch(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("batch"),
        (-F.col("l_discount") * 5 - 0.1).alias("log_prob"),
        (-F.col("l_tax") * 5 - 0.1).alias("old_log_prob"),
        ((F.col("l_quantity") - 25) / 10.0).alias("advantage"),
        (F.col("l_discount") * 10).alias("value"),
        (F.col("l_tax") * 10).alias("old_value"),
        (F.col("l_quantity") / 10.0).alias("returns"),
        (F.col("l_linestatus") == "F").alias("mask"),
        (F.col("l_linenumber") % 2 == 0).alias("done"),
        F.col("l_linenumber").alias("ln"),
        (F.col("l_extendedprice") / 50000.0).alias("px"),
    )


def _out(df, keep, cols):
    return df.select(*keep, *[steady(c).alias(c) for c in cols])


_RATIO = "exp(lp - olp)"
_POLICY = f"-({MN(f'least({_RATIO} * adv, greatest(least({_RATIO}, 1.2::DOUBLE), 0.8::DOUBLE) * adv)')})"
_VCLIP = "oval + greatest(least(val - oval, 0.2::DOUBLE), -0.2::DOUBLE)"
_VALUE = MN(f"greatest(power(ret - val, 2), power(ret - ({_VCLIP}), 2))")
_VCLIP2 = "oval + greatest(least(px - oval, 0.2::DOUBLE), -0.2::DOUBLE)"
_VALUE2 = MN(f"greatest(power(ret - px, 2), power(ret - ({_VCLIP2}), 2))")


@query(
    "surrogate_policy_loss",
    f"""WITH {BATCH_SQL} SELECT batch, {r(_POLICY)} AS policy_loss,
{r(MN(f'CAST(abs({_RATIO} - 1) > 0.2 AS INT)'))} AS clip_fraction, {r(MN(_RATIO))} AS mean_ratio FROM b GROUP BY 1""",
)
def surrogate_policy_loss(spark, sf_dir):
    out = M.ppo_policy_loss(batch(spark, sf_dir), ["batch"], 0.2)
    return _out(out, ["batch"], ["policy_loss", "clip_fraction", "mean_ratio"])


@query(
    "clipped_value_loss",
    f"WITH {BATCH_SQL} SELECT batch, {r(f'(({_VALUE}) + ({_VALUE2})) / 2')} AS value_loss FROM b GROUP BY 1",
)
def clipped_value_loss(spark, sf_dir):
    signals = {"extrinsic": ("value", "old_value", "returns"), "curiosity": ("px", "old_value", "returns")}
    return _out(M.ppo_value_loss(batch(spark, sf_dir), ["batch"], 0.2, signals), ["batch"], ["value_loss"])


@query(
    "training_objectives",
    f"""WITH {BATCH_SQL} SELECT batch, {r(f"({_POLICY}) + 0.5::DOUBLE * ({_VALUE}) - 0.01::DOUBLE * ({MN('-lp')})")} AS on_policy,
{r(f"({_POLICY}) + 0.5::DOUBLE * (({_VALUE}) + 0.5::DOUBLE * ({_VALUE2})) - 0.01::DOUBLE * ({MN('-lp')})")} AS cooperative
FROM b GROUP BY 1""",
)
def training_objectives(spark, sf_dir):
    b = batch(spark, sf_dir)
    j = b.groupBy("batch").agg(
        *M.policy_loss_terms(0.2),
        M.value_loss_term(0.2, {"extrinsic": ("value", "old_value", "returns")}).alias("value_loss"),
        M.value_loss_term(0.2, {"extrinsic": ("px", "old_value", "returns")}).alias("baseline_loss"),
        M.masked_mean(-F.col("log_prob"), "mask").alias("entropy"),
    )
    return j.select(
        "batch",
        steady(M.objective("policy_loss", "value_loss", "entropy", 0.01)).alias("on_policy"),
        steady(M.objective("policy_loss", "value_loss", "entropy", 0.01, "baseline_loss")).alias("cooperative"),
    )


_BACK = "(ret + (1 - CAST(done AS INT)) * 0.99::DOUBLE * px)"
_LPS = "(lp + olp)"


@query(
    "off_policy_losses_continuous",
    f"""WITH {BATCH_SQL} SELECT batch, {r(f"0.5 * {MN(f'power({_BACK} - val, 2)')}")} AS q1_loss,
{r(f"0.5 * {MN(f'power({_BACK} - oval, 2)')}")} AS q2_loss,
{r(f"0.5 * {MN(f'power(px - (least(val, oval) - 0.2::DOUBLE * {_LPS}), 2)')}")} AS value_loss,
{r(MN(f'0.2::DOUBLE * {_LPS} - val'))} AS policy_loss, {r(f"-({MN(f'0.2::DOUBLE * ({_LPS} - 2)')})")} AS entropy_loss
FROM b GROUP BY 1""",
)
def off_policy_losses_continuous(spark, sf_dir):
    b = batch(spark, sf_dir).select(
        "batch", "mask", "done", F.col("returns").alias("reward"), F.col("px").alias("value"),
        F.col("px").alias("target_value"), F.col("value").alias("q1"), F.col("old_value").alias("q2"),
        F.col("value").alias("q1p"), F.col("old_value").alias("q2p"), F.array("log_prob", "old_log_prob").alias("log_probs"),
    )
    out = M.sac_continuous(b, ["batch"], 0.99, 0.2, -2.0)
    return _out(out, ["batch"], ["q1_loss", "q2_loss", "value_loss", "policy_loss", "entropy_loss"])


@query(
    "off_policy_losses_discrete",
    f"""WITH {BATCH_SQL}, z AS (SELECT *, exp(lp) * lp + exp(olp) * olp AS h1, exp(-px) * -px AS h2,
 exp(lp) * val + exp(olp) * oval AS qa, exp(-px) * ret AS qb, exp(lp) * ret + exp(olp) * val AS qc, exp(-px) * oval AS qd FROM b)
SELECT batch, {r(f"0.5 * {MN('power(px - (least((qa + qb) / 2, (qc + qd) / 2) - (0.2::DOUBLE * h1 + 0.3::DOUBLE * h2) / 2), 2)')}")} AS value_loss,
{r(MN('0.2::DOUBLE * h1 + 0.3::DOUBLE * h2 - (qa + qb)'))} AS policy_loss,
{r(f"-({MN('(0.2::DOUBLE * (h1 + 1) + 0.3::DOUBLE * (h2 + 0.5)) / 2')})")} AS entropy_loss FROM z GROUP BY 1""",
)
def off_policy_losses_discrete(spark, sf_dir):
    b = batch(spark, sf_dir).select(
        "batch", "mask", F.col("px").alias("value"),
        F.array("log_prob", "old_log_prob", -F.col("px")).alias("log_probs"),
        F.array("value", "old_value", "returns").alias("q1p"), F.array("returns", "value", "old_value").alias("q2p"),
    )
    out = M.sac_discrete(b, ["batch"], [2, 1], [0.2, 0.3], [1.0, 0.5])
    return _out(out, ["batch"], ["value_loss", "policy_loss", "entropy_loss"])


_Q, _QN = "[val, oval, ret]", "[ret, px, oval]"


def _dqn_sql(source: str) -> str:
    return f"""WITH {BATCH_SQL}, g AS (SELECT *, {_Q} AS q, {_QN} AS qn FROM b),
t AS (SELECT *, adv + (1 - CAST(done AS INT)) * 0.9::DOUBLE * qn[list_position({source}, list_max({source}))] AS tg, q[ln % 3 + 1] AS cur FROM g)
SELECT batch, {r('avg(tg)')} AS mean_target, {r('avg(CASE WHEN abs(cur - tg) < 1 THEN 0.5 * power(cur - tg, 2) ELSE abs(cur - tg) - 0.5 END)')}
AS q_loss FROM t GROUP BY 1"""


def _dqn(spark, sf_dir, source):
    b = batch(spark, sf_dir).select(
        "batch", "done", F.col("advantage").alias("reward"), (F.col("ln") % 3).cast("int").alias("action"),
        F.array("value", "old_value", "returns").alias("q"), F.array("returns", "px", "old_value").alias("q_next"),
    )
    return _out(M.dqn_metrics(b, ["batch"], 0.9, source), ["batch"], ["mean_target", "q_loss"])


@query("q_learning_current_greedy", _dqn_sql("q"))
def q_learning_current_greedy(spark, sf_dir):
    return _dqn(spark, sf_dir, "current")


@query("q_learning_next_greedy", _dqn_sql("qn"))
def q_learning_next_greedy(spark, sf_dir):
    return _dqn(spark, sf_dir, "next")


@query(
    "cloning_loss",
    f"""WITH {BATCH_SQL}, z AS (SELECT *, ln(exp(val) + exp(oval)) AS z1, ln(exp(ret) + exp(px) + exp(adv)) AS z2 FROM b)
SELECT batch, {r('''sum(power(val - oval, 2) + power(ret - px, 2)) / (2 * count(*))
 + avg(((z1 - CASE ln % 2 WHEN 0 THEN val ELSE oval END) + (z2 - CASE ln % 3 WHEN 0 THEN ret WHEN 1 THEN px ELSE adv END)) / 2)''')}
AS bc_loss FROM z GROUP BY 1""",
)
def cloning_loss(spark, sf_dir):
    b = batch(spark, sf_dir).select(
        "batch", F.array("value", "returns").alias("a"), F.array("old_value", "px").alias("x"),
        F.array("value", "old_value", "returns", "px", "advantage").alias("logits"),
        F.array((F.col("ln") % 2).cast("int"), (F.col("ln") % 3).cast("int")).alias("d"),
    )
    return _out(M.bc_loss(b, ["batch"], [2, 3], ("a", "x"), ("logits", "d")), ["batch"], ["bc_loss"])


@query(
    "curiosity_losses",
    f"""WITH {BATCH_SQL}, z AS (SELECT *, 0.5 * (power(val - oval, 2) + power(ret - px, 2)) AS f,
  -ln(CASE ln % 2 WHEN 0 THEN exp(lp) / (exp(lp) + exp(olp)) ELSE exp(olp) / (exp(lp) + exp(olp)) END + 1e-7::DOUBLE) AS i FROM b)
SELECT batch, {r('avg(CASE WHEN m THEN f END)')} AS forward_loss, {r('avg(CASE WHEN m THEN i END)')} AS inverse_loss FROM z GROUP BY 1""",
)
def curiosity_losses(spark, sf_dir):
    b = batch(spark, sf_dir).select(
        "batch", "mask", F.array("value", "returns").alias("p"), F.array("old_value", "px").alias("a"),
        V.softmax(F.array("log_prob", "old_log_prob"), 2).alias("probs"), (F.col("ln") % 2).cast("int").alias("act"),
    )
    out = M.curiosity_loss(b, ["batch"], "p", "a", "probs", "act", "mask")
    return _out(out, ["batch"], ["forward_loss", "inverse_loss"])


@query(
    "imitation_discriminator",
    f"""WITH {BATCH_SQL}, z AS (SELECT batch, exp(lp) AS p, exp(olp) AS e, val, oval FROM b)
SELECT batch, {r('avg(p)')} AS policy_mean, {r('avg(e)')} AS expert_mean,
{r('-avg(ln(e + 1e-7::DOUBLE) + ln(1 - p + 1e-7::DOUBLE))')} AS discriminator_loss,
{r('avg(-(1 + ln(0.25::DOUBLE) - 0.5 * oval * oval - 0.5 * val * val - 0.25::DOUBLE))')} AS kl_loss FROM z GROUP BY 1""",
)
def imitation_discriminator(spark, sf_dir):
    b = batch(spark, sf_dir).select(
        "batch", F.exp("log_prob").alias("policy_estimate"), F.exp("old_log_prob").alias("expert_estimate"),
        F.array("value").alias("pm"), F.array("old_value").alias("em"),
    )
    out = b.groupBy("batch").agg(*M.gail_terms(), M.variational_kl_term("pm", "em", 0.5))
    return _out(out, ["batch"], ["policy_mean", "expert_mean", "discriminator_loss", "kl_loss"])


PROBS_SQL = (
    EMB_SQL
    + """, c AS (SELECT vec_id, v, list_transform(v, lambda y: 1 / (1 + exp(-y * 10.0::DOUBLE))) AS p FROM e),
x AS (SELECT vec_id, unnest(v) AS v, unnest(p) AS p, unnest(generate_series(0, 63)) AS i FROM c)"""
)
_SPARSE = "(SELECT avg(least(p, 1 - p)) FROM x)"
_REBUILT = "(SELECT avg(power(p - v, 2)) FROM x)"
_DIVERSE = """(SELECT sum(power(g / sqrt(ni) / sqrt(nj), 2)) / (64 * 63) FROM (
 SELECT a.i AS i, b.i AS j, sum(a.p * b.p) AS g, sum(a.p * a.p) AS ni, sum(b.p * b.p) AS nj
 FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY 1, 2))"""


def concept_probs(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.withColumn("p", V.scaled_sigmoid("v", F.lit(0.1)))


@query("concept_sparsity", f"WITH {PROBS_SQL} SELECT {r(_SPARSE, 6)} AS sparsity")
def concept_sparsity(spark, sf_dir):
    return M.concept_sparsity(concept_probs(spark, sf_dir), "p").select(steady("sparsity", 6).alias("sparsity"))


@query("concept_diversity", f"WITH {PROBS_SQL} SELECT {r(_DIVERSE, 6)} AS diversity")
def concept_diversity(spark, sf_dir):
    out = M.concept_diversity(concept_probs(spark, sf_dir), "p", 64)
    return out.select(steady("diversity", 6).alias("diversity"))


@query(
    "concept_total_loss",
    f"WITH {PROBS_SQL} SELECT {r(_REBUILT, 6)} AS reconstruction, {r(f'{_REBUILT} + 0.1::DOUBLE * {_SPARSE} + 0.05::DOUBLE * {_DIVERSE}', 6)} AS total",
)
def concept_total_loss(spark, sf_dir):
    c = concept_probs(spark, sf_dir)
    one = F.lit(1).alias("one")
    j = (
        M.reconstruction_loss(c, "p", "v").select(one, "reconstruction")
        .join(M.concept_sparsity(c, "p").select(one, "sparsity"), "one")
        .join(M.concept_diversity(c, "p", 64).select(one, "diversity"), "one")
    )
    total = M.concept_total("reconstruction", "sparsity", "diversity", (1.0, 0.1, 0.05))
    return j.select(steady("reconstruction", 6).alias("reconstruction"), steady(total, 6).alias("total"))


_LONG = " UNION ALL ".join(f"SELECT vec_id, v, '{c}' AS concept, {c} AS t, {i + 1} AS pos FROM lab" for i, c in enumerate(CONCEPTS))
_BIN = ", ".join(f"'{c}'" for c in C.BINARY_CONCEPTS)
SCORES_SQL = f"""{_nsql()}, lg AS ({_LONG}), z AS (SELECT *, v[pos] * 8 AS p, vec_id % 5 <> 0 AS m, concept IN ({_BIN}) AS b FROM lg),
s AS (SELECT concept, sum(CASE WHEN m THEN CASE WHEN b THEN greatest(p, 0) - p * t + ln(1 + exp(-abs(p)))
   ELSE power(least(greatest(1 / (1 + exp(-p)), 0.01), 0.99) - t, 2) END ELSE 0 END) / (sum(CAST(m AS INT)) + 1e-8::DOUBLE) AS loss,
  avg(CASE WHEN m AND b THEN CAST((CASE WHEN p >= 0 THEN 1 ELSE 0 END) = t AS INT) END) AS accuracy FROM z GROUP BY 1)"""


def scored_concepts(spark, sf_dir):
    """Label and guess of every concept beside each other: both come from one row."""
    nav = navigation(spark, sf_dir)
    labels = C.concept_labels("rays", "nav", 5, 1)
    each = [F.struct(F.lit(c).alias("concept"), labels[c].alias("label"), (F.get("v", F.lit(i)) * 8).alias("logit")) for i, c in enumerate(CONCEPTS)]
    return nav.select((F.col("vec_id") % 5 != 0).alias("mask"), F.inline(F.array(*each)))


@query("concept_scores", f"WITH {SCORES_SQL} SELECT {r('avg(loss)')} AS concept_loss, {r('avg(accuracy)')} AS concept_accuracy FROM s")
def concept_scores(spark, sf_dir):
    return _out(M.concept_scores(scored_concepts(spark, sf_dir)), [], ["concept_loss", "concept_accuracy"])


@query("concept_scores_each", f"WITH {SCORES_SQL} SELECT concept, {r('loss')} AS loss, {r('coalesce(accuracy, -1)')} AS accuracy FROM s")
def concept_scores_each(spark, sf_dir):
    out = M.per_concept_scores(scored_concepts(spark, sf_dir))
    return out.select("concept", steady("loss").alias("loss"), steady(F.coalesce("accuracy", F.lit(-1.0))).alias("accuracy"))
