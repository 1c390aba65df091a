"""Human-readable concept labels from a ray sensor and a 12-value navigation vector."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodica.functions.numbers import as_col, clip
from episodica.functions.vectors import decode_rays

# Ranges and thresholds of the label definitions.
RAY_LENGTH = 100.0
MAP_HALF = 500.0
MAP_HEIGHT = 50.0
NEAR = 30.0
BLOCKED = 20.0
STUCK_DISTANCE = 15.0
STUCK_SPEED = 0.1
# The concepts.
CONCEPTS = (
    "distance_to_target",
    "direction_alignment",
    "speed",
    "moving_towards_target",
    "obstacle_in_front",
    "obstacle_on_left",
    "obstacle_on_right",
    "closest_obstacle_distance",
    "direct_path_blocked",
    "wind_force_magnitude",
    "wind_helps_or_hinders",
    "appears_stuck",
    "exploring_vs_exploiting",
    "needs_detour",
)
# Concepts judged yes/no; the others are degrees in [0, 1].
BINARY_CONCEPTS = (
    "moving_towards_target",
    "obstacle_in_front",
    "obstacle_on_left",
    "obstacle_on_right",
    "direct_path_blocked",
    "appears_stuck",
    "needs_detour",
)


def _norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0])) + F.lit(1e-8)


def _cosine(a: list[Column], b: list[Column]) -> Column:
    na, nb = _norm(a), _norm(b)
    return sum(((x / na) * (y / nb) for x, y in zip(a[1:], b[1:])), (a[0] / na) * (b[0] / nb))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def obstacle_distances(rays, n_tags: int) -> Column:
    """Distance per ray, where it met an obstacle; full length elsewhere.

    Without tags any hit counts; a single tag marks the target, so other hits count; with more, the
    first tag marks obstacles.
    """

    def distance(ray):
        hit = ray["miss"] < 0.5
        if n_tags == 1:
            hit = hit & (ray["tags"][0] <= 0.5)
        elif n_tags > 1:
            hit = ray["tags"][0] > 0.5
        return F.when(hit, ray["fraction"] * RAY_LENGTH).otherwise(F.lit(RAY_LENGTH))

    return F.transform(decode_rays(rays, n_tags), distance)


def concept_labels(rays, vector, n_rays: int, n_tags: int) -> dict[str, Column]:
    """All labels by name; null for a row whose vector has not 12 values or whose rays do not fit."""
    vector = as_col(vector)
    fits = (F.size(vector) == 12) & (F.size(as_col(rays)) == n_rays * (n_tags + 2))
    v = [F.get(vector, F.lit(i)).cast("double") for i in range(12)]
    scale = [MAP_HALF, MAP_HEIGHT, MAP_HALF]
    to_target = [v[3 + i] * scale[i] - v[i] * scale[i] for i in range(3)]
    wind, velocity = v[6:9], v[9:12]
    distance = clip(1.0 - F.exp(-_norm(to_target) / (MAP_HALF * 0.5)), 0, 1)
    speed = 0.9 * clip(_norm(velocity), 0, 1) + 0.05
    heading = _cosine(to_target, velocity)

    d = obstacle_distances(rays, n_tags)
    middle = n_rays // 2
    left = middle - 1 if n_rays % 2 == 0 else middle
    front = F.least(d[left], d[middle]) if n_rays % 2 == 0 else d[middle]
    none = F.lit(RAY_LENGTH)
    left_min = F.array_min(F.slice(d, 1, left)) if left > 0 else none
    right_n = n_rays - middle - 1
    right_min = F.array_min(F.slice(d, middle + 2, right_n)) if right_n > 0 else none
    nearest = F.array_min(d)
    blocked = front < BLOCKED
    stuck = (speed < STUCK_SPEED) & (distance > 0.15) & (nearest < STUCK_DISTANCE)
    # The names, as in CONCEPTS.
    labels = {
        "distance_to_target": distance,
        "direction_alignment": clip(0.5 * (heading + 1.0), 0, 1),
        "speed": speed,
        "moving_towards_target": _flag(heading > 0),
        "obstacle_in_front": _flag(front < NEAR),
        "obstacle_on_left": _flag(left_min < NEAR),
        "obstacle_on_right": _flag(right_min < NEAR),
        "closest_obstacle_distance": F.least(nearest / RAY_LENGTH, F.lit(1.0)),
        "direct_path_blocked": _flag(blocked),
        "wind_force_magnitude": clip(_norm(wind), 0, 1),
        "wind_helps_or_hinders": clip(0.5 * (_cosine(wind, to_target) + 1.0), 0, 1),
        "appears_stuck": _flag(stuck),
        "exploring_vs_exploiting": distance,
        "needs_detour": _flag(blocked & (distance > 0.2)),
    }
    return {k: F.when(fits, clip(c, 0, 1)) for k, c in labels.items()}
