"""Weights, rewards and rule scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp

STRATEGIES = ("geometric", "multiply", "average", "max", "min")
# fixed values: weights and factors of rewards
REWARD = {"perceptual": 0.45, "user": 0.35, "compression": 0.20, "target_bytes": 512_000, "edited": 0.8, "accepted": 1.2, "declined": 0.8, "no_rating": 0.6}
# fixed values: stones of the 27 levels of r, g, b (3 each), b running fastest
STONES = (
    "white", "white", "empty",
    "white", "empty", "empty",
    "empty", "empty", "black",
    "white", "empty", "empty",
    "empty", "empty", "empty",
    "empty", "empty", "black",
    "empty", "empty", "black",
    "empty", "empty", "black",
    "black", "black", "black",
)


def merged(strategy: str, query: Column, key: Column) -> Column:
    return {"geometric": F.sqrt(query * key), "multiply": query * key, "average": (query + key) / 2.0, "max": F.greatest(query, key), "min": F.least(query, key)}[strategy]


def power_blend(q: Column, k: Column, alpha: Column, temperature: float) -> Column:
    return F.pow(q, alpha) * F.pow(k, 1 - alpha) * (q * k / F.sqrt(F.lit(temperature)))


def perceptual_score(ssim: Column, delta_e: Column) -> Column:
    return 0.7 * clamp(ssim, 0.0, 1.0) + 0.3 / (1 + delta_e / 10.0)


def user_score(rating: Column, edited: Column, accepted: Column) -> Column:
    base = F.when(rating.isNotNull(), clamp(rating.cast("double"), 1.0, 5.0) / 5.0).otherwise(REWARD["no_rating"])
    return clamp(base * F.when(edited, REWARD["edited"]).otherwise(1.0) * F.when(accepted, REWARD["accepted"]).otherwise(REWARD["declined"]), 0.0, 1.0)


def compression_score(size: Column) -> Column:
    return F.when(size <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 / (1 + size / float(REWARD["target_bytes"]))))


def total_reward(perceptual: Column, user: Column, compression: Column) -> Column:
    return REWARD["perceptual"] * perceptual + REWARD["user"] * user + REWARD["compression"] * compression


def tier(reward: Column) -> Column:
    return F.when(reward >= 0.8, "excellent").when(reward >= 0.6, "good").when(reward >= 0.4, "acceptable").otherwise("poor")


def fitness(quality: Column, adoptions: Column, generation: Column) -> Column:
    return 0.6 * quality + 0.3 * F.log(adoptions + 1.0) / 10 + 0.1 * F.least(F.lit(1.0), generation / 10.0)


def stone(value: Column, black: float, white: float) -> Column:
    return F.when(value >= black, "black").when(value <= white, "white").otherwise("empty")


def stone_of_index(index: Column) -> Column:
    return F.when(index < 85, "black").when(index < 170, "white").otherwise("empty")


def codon_stone(r: Column, g: Column, b: Column) -> Column:
    level = lambda c: F.least(F.lit(2), F.floor(c / 85.0)).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in STONES]), level(r) * 9 + level(g) * 3 + level(b) + 1)


def soft_stones(brightness: Column, saturation: Column, energy: Column, black: float, white: float, temperature: float) -> tuple[Column, Column, Column]:
    """Probabilities of black, white and empty: a three-way softmax, shifted by the largest."""
    logits = (black * brightness + (1 - black) * energy, (1 - white) * (1 - brightness), 0.5 - F.abs(brightness - 0.5) * 0.3 + saturation * 0.2)
    top = F.greatest(*logits)
    e = [F.exp((x - top) / temperature) for x in logits]
    return tuple(x / (e[0] + e[1] + e[2]) for x in e)


def ownership_weight(o: Column) -> Column:
    return (1 - o) / 2.0


def board_weight(stone_: Column, neutral: float = 0.5) -> Column:
    return F.when(stone_ == "black", 1.0).when(stone_ == "white", 0.0).otherwise(neutral)


def quality_setting(thermal: Column, memory_mb: Column, battery: Column) -> Column:
    """The first condition that holds."""
    return F.when((thermal >= 3) | (memory_mb > 900), "minimal").when((thermal == 2) | (battery < 0.15), "low").when((thermal == 1) | (battery < 0.3), "medium").otherwise("high")


CONTENT_TYPES = ("nature", "portrait", "action", "urban", "abstract", "low_light", "text", "animation")


def content_scores(f: dict[str, Column]) -> dict[str, Column]:
    """Points of each content type from mean_v, var_v, mean_s, var_s, hue, hue_spread, edge, motion, unique."""
    hue, spread, edge, motion, unique = f["hue"], f["hue_spread"], f["edge"], f["motion"], f["unique"]
    v, var_v, s, var_s = f["mean_v"], f["var_v"], f["mean_s"], f["var_s"]
    # fixed values: rules and their points; of a list of rules the first that holds counts
    rules = {
        "nature": [(hue.between(0.2, 0.5), 0.3), (s.between(0.3, 0.7), 0.25), (var_v > 0.02, 0.2), (spread > 0.3, 0.15), (motion < 0.15, 0.1)],
        "portrait": [((hue <= 0.1) | (hue >= 0.9), 0.35), (s.between(0.2, 0.5), 0.25), (spread < 0.2, 0.2), (v.between(0.3, 0.7), 0.1), (edge < 0.25, 0.1)],
        "action": [[(motion > 0.3, 0.4), (motion > 0.15, 0.2)], (var_v > 0.03, 0.2), (unique > 0.3, 0.15), (s > 0.3, 0.15), (spread > 0.3, 0.1)],
        "urban": [(s < 0.3, 0.3), (hue.between(0.5, 0.7), 0.2), (edge.between(0.2, 0.4), 0.2), (motion < 0.1, 0.15), (var_v.between(0.01, 0.04), 0.15)],
        "abstract": [(var_s > 0.04, 0.25), (spread > 0.5, 0.25), (unique > 0.5, 0.2), (var_v > 0.04, 0.15), (motion < 0.2, 0.15)],
        "low_light": [[(v < 0.25, 0.5), (v < 0.35, 0.25)], (s < 0.3, 0.25), (var_v < 0.02, 0.15), (edge < 0.2, 0.1)],
        "text": [(s < 0.15, 0.3), (edge > 0.4, 0.3), (unique < 0.2, 0.2), (var_v > 0.05, 0.1), (motion < 0.05, 0.1)],
        "animation": [[(s > 0.7, 0.35), (s > 0.5, 0.2)], (var_s < 0.02, 0.2), (edge > 0.35, 0.2), (unique < 0.3, 0.15), (spread > 0.4, 0.1)],
    }

    def points(rule) -> Column:
        out = None
        for cond, p in rule if isinstance(rule, list) else [rule]:
            out = F.when(cond, p) if out is None else out.when(cond, p)
        return out.otherwise(0.0)

    def total(group) -> Column:
        out = points(group[0])
        for rule in group[1:]:
            out = out + points(rule)
        return out

    return {name: total(group) for name, group in rules.items()}
