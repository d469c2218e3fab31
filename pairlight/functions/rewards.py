"""The search reward, as one struct expression and as a plain function for sequential rollouts."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RewardWeights:
    """The default weights."""

    model_failure_weight: float = 1.0
    low_confidence_weight: float = 0.6
    low_confidence_margin: float = 0.2
    complexity_weight: float = 0.02
    dependency_distance_weight: float = 0.5
    attractor_weight: float = 1.0
    clause_depth_weight: float = 1.0
    invalid_structure_penalty: float = 1.0
    length_penalty: float = 0.002
    grammar_failure_penalty: float = 1.0
    template_switch_penalty: float = 0.15
    simple_stop_penalty: float = 0.1
    repeated_edit_penalty: float = 0.1


PENALTY_FLAGS = ("invalid_action", "grammar_invalid", "switched_template", "stopped_simple", "repeated_edit")


def breakdown(margin: Column, failed: Column, tokens: Column, distance: Column, attractors: Column, depth: Column, flags: dict[str, Column] | None = None, weights: RewardWeights | None = None, extra: float = 0.0) -> Column:
    """Struct of the reward and its parts. ``flags``: any of ``PENALTY_FLAGS``; absent ones are false."""
    w = weights or RewardWeights()
    flag = {k: F.coalesce((flags or {}).get(k, F.lit(False)), F.lit(False)) for k in PENALTY_FLAGS}
    near = F.abs(margin) < w.low_confidence_margin
    low = F.when(near, w.low_confidence_weight * (1.0 - F.abs(margin) / w.low_confidence_margin) * F.when(margin >= 0, 1.0).otherwise(0.5)).otherwise(0.0)
    load = w.dependency_distance_weight * distance + w.attractor_weight * attractors + w.clause_depth_weight * depth
    on = lambda cond, amount: F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))
    parts = {
        "model_failure_reward": on(failed, w.model_failure_weight),
        "low_confidence_reward": low,
        "complexity_reward": F.when(failed | near, w.complexity_weight * load).otherwise(0.0),
        "invalid_penalty": on(flag["invalid_action"], w.invalid_structure_penalty),
        "length_penalty": w.length_penalty * tokens,
        "grammar_penalty": on(flag["grammar_invalid"], w.grammar_failure_penalty),
        "switching_penalty": on(flag["switched_template"], w.template_switch_penalty),
        "simple_stop_penalty": on(flag["stopped_simple"], w.simple_stop_penalty),
        "repeated_edit_penalty": on(flag["repeated_edit"], w.repeated_edit_penalty),
    }
    gains = [k for k in parts if k.endswith("_reward")]
    reward = parts[gains[0]] + parts[gains[1]] + parts[gains[2]]
    for k in parts:
        if k not in gains:
            reward = reward - parts[k]
    return F.struct((reward - extra).alias("reward"), *[v.alias(k) for k, v in parts.items()])


def reward_parts(margin: float, failed: bool, tokens: int, distance: int, attractors: int, depth: int, flags: set[str] = frozenset(), weights: RewardWeights | None = None) -> dict[str, float]:
    """The same breakdown for one transition of a rollout."""
    w = weights or RewardWeights()
    near = abs(margin) < w.low_confidence_margin
    gain = {
        "model_failure_reward": w.model_failure_weight if failed else 0.0,
        "low_confidence_reward": w.low_confidence_weight * (1.0 - abs(margin) / w.low_confidence_margin) * (1.0 if margin >= 0 else 0.5) if near else 0.0,
        "complexity_reward": w.complexity_weight * (w.dependency_distance_weight * distance + w.attractor_weight * attractors + w.clause_depth_weight * depth) if failed or near else 0.0,
    }
    amounts = asdict(w)
    named = {"invalid_penalty": ("invalid_action", "invalid_structure_penalty"), "grammar_penalty": ("grammar_invalid", "grammar_failure_penalty"), "switching_penalty": ("switched_template", "template_switch_penalty"), "simple_stop_penalty": ("stopped_simple", "simple_stop_penalty"), "repeated_edit_penalty": ("repeated_edit", "repeated_edit_penalty")}
    loss = {name: amounts[amount] if flag in flags else 0.0 for name, (flag, amount) in named.items()} | {"length_penalty": w.length_penalty * tokens}
    return {"reward": sum(gain.values()) - sum(loss.values()), **gain, **loss}


def scalar_reward(margin: Column, failed: Column, tokens: Column, distance: Column, attractors: Column, depth: Column, flags: dict[str, Column] | None = None, weights: RewardWeights | None = None, penalty: Column | float = 0.0) -> Column:
    """The reward alone. Where nothing but the failure and the penalty is given (all numbers 0, no flag, default weights)
    it is the older ``failed - penalty``, without the low-confidence part that a margin of 0 would have."""
    penalty = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    full = breakdown(margin, failed, tokens, distance, attractors, depth, flags, weights)["reward"] - penalty
    if weights is not None:
        return full
    plain = margin == 0
    for c in (tokens, distance, attractors, depth):
        plain = plain & (c == 0)
    for c in (flags or {}).values():
        plain = plain & ~F.coalesce(c, F.lit(False))
    return F.when(plain, failed.cast("double") - penalty).otherwise(full)


def q_step(old: float, reward: float, next_max: float, learning_rate: float, discount: float) -> float:
    return old + learning_rate * (reward + discount * next_max - old)


def linear_decay(start: float, end: float, step: int | Column, steps: int | Column) -> float | Column:
    """From ``start`` to ``end`` over ``steps``, held at the end."""
    if isinstance(step, Column) or isinstance(steps, Column):
        f = F.least(F.lit(1.0), step / F.greatest(F.lit(1), steps if isinstance(steps, Column) else F.lit(steps)))
        return start + (end - start) * f
    return start + (end - start) * min(1.0, step / max(1, steps))
