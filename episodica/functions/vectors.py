"""Column expressions over action, logit and observation vectors."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.numbers import as_col, clip

# Guards used inside logarithms and masked logits.
EPS = 1e-7
MASK_PENALTY = 1e8


def total(arr) -> Column:
    return F.aggregate(as_col(arr), F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a, b) -> Column:
    return total(F.zip_with(as_col(a), as_col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def zeros_like(c: Column, kind) -> Column:
    """The value of a column's type with every number zero, in the column's own shape."""
    if isinstance(kind, T.StructType):
        return F.struct(*[zeros_like(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: zeros_like(x, kind.elementType))
    return F.lit(0).cast(kind)


def one_hot(index, n: int) -> Column:
    """0/1 vector of length n; an index outside the range gives all zeros."""
    index = as_col(index)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


def branches_of(arr, sizes: list[int]) -> list[Column]:
    """Cut a concatenated vector into its branches."""
    arr, out, at = as_col(arr), [], 1
    for n in sizes:
        out.append(F.slice(arr, at, n))
        at += n
    return out


def join_branches(parts: list) -> Column:
    return F.concat(*[as_col(p) for p in parts])


def flatten_action(continuous, discrete, sizes: list[int]) -> Column:
    """Continuous values followed by one one-hot vector per discrete branch."""
    hots = [one_hot(as_col(discrete)[i], n) for i, n in enumerate(sizes)]
    parts = [F.transform(as_col(continuous), lambda x: x.cast("double"))] if continuous is not None else []
    parts += [F.transform(h, lambda x: x.cast("double")) for h in hots]
    return F.concat(*parts)


def pack_action(discrete, sizes: list[int]) -> Column:
    """Scalar index of a branched action; the last branch varies fastest."""
    code = F.lit(0)
    for i, n in enumerate(sizes):
        code = code * n + as_col(discrete)[i]
    return code


def unpack_action(code, sizes: list[int]) -> Column:
    code, out, radix = as_col(code), [], 1
    for n in reversed(sizes):
        out.append(F.pmod(F.floor(code / F.lit(radix)), F.lit(n)).cast("int"))
        radix *= n
    return F.array(*reversed(out))


def squash_actions(arr) -> Column:
    """Continuous actions leave the policy clipped to [-3, 3] and scaled to [-1, 1]."""
    return F.transform(as_col(arr), lambda x: clip(x.cast("double"), -3, 3) / 3.0)


def mask_logits(logits, allowed) -> Column:
    return F.zip_with(as_col(logits), as_col(allowed), lambda x, m: x * m - F.lit(MASK_PENALTY) * (1.0 - m))


def items(arr, n: int, start: int = 0) -> list[Column]:
    """Entries of a vector of known length, as plain columns: these stay in generated code."""
    return [F.get(as_col(arr), F.lit(start + i)) for i in range(n)]


def add_up(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0])


def softmax(logits, n: int | None = None) -> Column:
    """Probabilities; give `n` where the number of actions is fixed."""
    logits = as_col(logits)
    if n:
        xs = items(logits, n)
        top = F.greatest(*xs) if n > 1 else xs[0]
        es = [F.exp(x - top) for x in xs]
        whole = add_up(es)
        return F.array(*[e / whole for e in es])
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def log_sum_exp(xs: list[Column]) -> Column:
    if len(xs) == 1:
        return xs[0]
    top = F.greatest(*xs)
    return top + F.ln(add_up([F.exp(x - top) for x in xs]))


def log_softmax(logits, n: int | None = None) -> Column:
    logits = as_col(logits)
    if n:
        xs = items(logits, n)
        whole = log_sum_exp(xs)
        return F.array(*[x - whole for x in xs])
    top = F.array_max(logits)
    log_sum = F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - log_sum)


def categorical_log_prob(probs, index) -> Column:
    return F.ln(F.get(as_col(probs), as_col(index)) + F.lit(EPS))


def categorical_entropy(probs, n: int | None = None) -> Column:
    if n:
        return -add_up([p * F.ln(p + F.lit(EPS)) for p in items(probs, n)])
    return F.aggregate(as_col(probs), F.lit(0.0), lambda a, p: a - p * F.ln(p + F.lit(EPS)))


def gaussian_log_prob(x, mean, std) -> Column:
    """One dimension."""
    x, mean, std = as_col(x), as_col(mean), as_col(std)
    return (
        -F.pow(x - mean, F.lit(2.0)) / (2.0 * std * std + F.lit(EPS))
        - F.ln(std + F.lit(EPS))
        - F.lit(math.log(math.sqrt(2 * math.pi)))
    )


def gaussian_pdf(x, mean, std) -> Column:
    return F.exp(gaussian_log_prob(x, mean, std))


def gaussian_entropy(stds) -> Column:
    """Mean over the dimensions."""
    stds = as_col(stds)
    each = F.transform(stds, lambda s: 0.5 * F.ln(F.lit(2 * math.pi * math.e) * s * s + F.lit(EPS)))
    return total(each) / F.size(stds)


def squashed_log_prob(y, mean, std) -> Column:
    """Log-density of tanh(normal) at y in (-1, 1): the change of variables is 1 - y^2."""
    y = as_col(y)
    x = F.atanh(y)
    log_jacobian = 2.0 * (F.lit(math.log(2.0)) - x - F.log1p(F.exp(-2.0 * x)))
    return gaussian_log_prob(x, mean, std) - log_jacobian


def action_entropy(entropies: list) -> Column:
    """Entropy of a hybrid action: the sum over its branches."""
    out = as_col(entropies[0])
    for e in entropies[1:]:
        out = out + as_col(e)
    return out


def flat_log_probs(continuous, discrete) -> Column:
    return F.concat(as_col(continuous), as_col(discrete))


def greedy_action(q) -> Column:
    """0-based position of the first maximum."""
    q = as_col(q)
    return F.array_position(q, F.array_max(q)) - 1


def add_signals(signals: list) -> Column:
    """Elementwise sum of one Q vector per reward signal."""
    out = as_col(signals[0])
    for s in signals[1:]:
        out = F.zip_with(out, as_col(s), lambda a, b: a + b)
    return out


def pick_by_mass(masses, u) -> Column:
    """First index whose cumulative mass reaches u of the total; masses need not sum to one."""
    masses = as_col(masses)
    cut = u * masses[F.size(masses) - 1]
    return F.size(F.filter(masses, lambda m: m < cut)).cast("int")


def explore_or_exploit(q, epsilon, u_choice, u_action) -> Column:
    """Epsilon-greedy: below the exploration rate a uniform action, else the greedy one."""
    random_index = F.floor(as_col(u_action) * F.size(as_col(q))).cast("long")
    return F.when(as_col(u_choice) < as_col(epsilon), random_index).otherwise(greedy_action(q))


def empty_action(continuous_size: int, n_branches: int) -> Column:
    return F.struct(
        F.array_repeat(F.lit(0.0).cast("float"), continuous_size).alias("continuous"),
        F.array_repeat(F.lit(0), n_branches).alias("discrete"),
    )


def random_action(uniforms_continuous: list, uniforms_discrete: list, sizes: list[int]) -> Column:
    """Uniform continuous values in [-1, 1) and uniform branch choices, from given uniforms."""
    cont = F.array(*[as_col(u) * 2.0 - 1.0 for u in uniforms_continuous])
    disc = F.array(*[F.floor(as_col(u) * n).cast("int") for u, n in zip(uniforms_discrete, sizes)])
    return F.struct(cont.alias("continuous"), disc.alias("discrete"))


def split_mask(mask, sizes: list[int]) -> Column:
    """Per-branch masks; no mask means every action is allowed."""
    flat = F.coalesce(as_col(mask), F.array_repeat(F.lit(False), sum(sizes)))
    return F.array(*branches_of(flat, sizes))


def match_result(reward) -> Column:
    reward = as_col(reward)
    return F.when(reward > 0, 1.0).when(reward < 0, 0.0).otherwise(0.5)


# --- group columns ---------------------------------------------------------------------------


def pad_list(arr, n, fill) -> Column:
    """Fill a ragged list to n entries."""
    arr = as_col(arr)
    return F.concat(arr, F.array_repeat(F.lit(fill), (as_col(n) - F.size(arr)).cast("int")))


def transpose_padded(lists, fill) -> Column:
    """List of ragged rows -> list of columns, short rows filled."""
    lists = as_col(lists)
    widest = F.array_max(F.transform(lists, lambda x: F.size(x)))
    return F.when(
        widest > 0,
        F.transform(
            F.sequence(F.lit(0), widest - 1),
            lambda i: F.transform(lists, lambda x: F.coalesce(F.get(x, i), F.lit(fill))),
        ),
    ).otherwise(F.expr("array()").cast("array<array<double>>"))


def empty_entities(entities) -> Column:
    """True where an entity row is (near) zero, i.e. padding."""
    return F.transform(as_col(entities), lambda e: dot(e, e) < F.lit(0.01))


# --- intrinsic rewards and concept math ------------------------------------------------------


def curiosity_reward(predicted, actual, strength: float | None = None) -> Column:
    """Half the squared prediction error, capped at 1/strength."""
    error = 0.5 * squared_distance(predicted, actual)
    return F.least(error, F.lit(1.0 / strength)) if strength else error


def novelty_reward(predicted, target) -> Column:
    return squared_distance(predicted, target)


def imitation_reward(estimate) -> Column:
    return -F.ln(1.0 - as_col(estimate) * F.lit(1.0 - EPS))


def weighted_reward(reward, strength) -> Column:
    return as_col(reward) * as_col(strength)


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(x)))


def anneal(step, initial: float, final: float, steps: int) -> Column:
    """Linear temperature from initial to final over `steps`."""
    progress = F.least(F.lit(1.0), as_col(step) / F.lit(float(steps)))
    return F.lit(initial) - progress * F.lit(initial - final)


def scaled_sigmoid(logits, temperature) -> Column:
    return F.transform(as_col(logits), lambda x: sigmoid(x / temperature))


def blend(a, b, weight: float) -> Column:
    """(1 - weight) a + weight b."""
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x * F.lit(1.0 - weight) + y * F.lit(weight))


# --- sensor vectors --------------------------------------------------------------------------


def polar(radius, degrees) -> Column:
    """A direction in the plane, from its angle."""
    return F.struct(
        (as_col(radius) * F.cos(F.radians(as_col(degrees)))).alias("x"),
        (as_col(radius) * F.sin(F.radians(as_col(degrees)))).alias("y"),
    )


def polar3(radius, degrees) -> Column:
    """The same direction in space: angles turn about the upright axis."""
    flat = polar(radius, degrees)
    return F.struct(flat["x"].alias("x"), F.lit(0.0).alias("y"), flat["y"].alias("z"))


def ray_vector_size(n_rays: int, n_tags: int, stacks: int = 1) -> int:
    return n_rays * (n_tags + 2) * stacks


def encode_ray(tag, hit, fraction, n_tags: int) -> Column:
    """[tag one-hot..., miss flag, hit fraction]; a miss has no tag and fraction 1."""
    hit = as_col(hit)
    tags = F.transform(one_hot(F.when(hit, as_col(tag)).otherwise(F.lit(-1)), n_tags), lambda x: x.cast("double"))
    miss = F.when(hit, 0.0).otherwise(1.0)
    return F.concat(tags, F.array(miss, F.when(hit, as_col(fraction)).otherwise(1.0)))


def decode_rays(vector, n_tags: int) -> Column:
    """Array of (tags, miss, fraction), one per ray."""
    vector, width = as_col(vector), n_tags + 2
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(vector) / width).cast("int") - 1),
        lambda i: F.struct(
            F.slice(vector, i * width + 1, F.lit(n_tags)).alias("tags"),
            F.get(vector, i * width + n_tags).alias("miss"),
            F.get(vector, i * width + n_tags + 1).alias("fraction"),
        ),
    )


def assemble_obs(fields: list[tuple]) -> Column:
    """One float vector from typed fields: ('float'|'int'|'bool', c), ('vec', c, names), ('list', c),
    ('one_hot', c, n)."""
    parts = []
    for kind, c, *rest in fields:
        c = as_col(c)
        if kind == "vec":
            parts.append(F.array(*[c.getField(n).cast("double") for n in rest[0]]))
        elif kind == "list":
            parts.append(F.transform(c, lambda x: x.cast("double")))
        elif kind == "one_hot":
            parts.append(F.transform(one_hot(c, rest[0]), lambda x: x.cast("double")))
        elif kind in ("float", "int", "bool"):
            parts.append(F.array(c.cast("double")))
        else:
            raise ValueError(f"unknown field kind {kind}")
    return F.concat(*parts)
