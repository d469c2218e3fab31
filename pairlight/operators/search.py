"""The structural search: environment, rollouts over executors, and sequential Q-learning on the driver."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.lexicon import PREPOSITIONS, PRONOUNS, SLOTS, VERBS_PLURAL, VERBS_SINGULAR
from pairlight.functions.rewards import RewardWeights, linear_decay, q_step, reward_parts

# Action names in tie-breaking order.
ACTIONS = ("select_simple_template", "select_pp_template", "select_relative_clause_template", "add_plural_attractor", "change_preposition", "change_relative_pronoun", "increase_depth_if_valid", "stop")
#: Fixed values per template type: distance, attractors, depth, tokens.
SHAPE = {"unset": (0, 0, 0, 0), "simple_agreement": (1, 0, 0, 3), "pp_attractor": (4, 1, 0, 6), "relative_clause": (5, 0, 1, 7)}


@dataclass(frozen=True)
class State:
    template_type: str = "unset"
    stopped: bool = False
    preposition: str = "near"
    relative_pronoun: str = "that"
    step_count: int = 0
    invalid_actions: int = 0
    preposition_changes: int = 0
    pronoun_changes: int = 0

    @property
    def subtype(self) -> str:
        return {"unset": "unset", "simple_agreement": "simple_singular", "pp_attractor": f"pp_plural_attractor_{self.preposition}", "relative_clause": f"object_relative_clause_{self.relative_pronoun}"}[self.template_type]

    @property
    def key(self) -> str:
        distance, attractors, depth, _ = SHAPE[self.template_type]
        return "|".join(map(str, (self.template_type, distance, attractors, depth, int(self.stopped), min(self.preposition_changes, 1), min(self.pronoun_changes, 1))))


def valid_actions(s: State) -> list[str]:
    if s.stopped:
        return []
    if s.template_type == "unset":
        return list(ACTIONS[:3])
    if s.template_type == "simple_agreement":
        return ["stop", "add_plural_attractor", "increase_depth_if_valid"]
    if s.template_type == "pp_attractor":
        return ["stop", *(["change_preposition"] if s.preposition_changes < 1 else []), "increase_depth_if_valid"]
    return ["stop", *(["change_relative_pronoun"] if s.pronoun_changes < 1 else [])]


def moved(s: State, action: str) -> State:
    """The state after a valid action other than stop."""
    nxt = replace(s, step_count=s.step_count + 1)
    turn = lambda values, v: values[(values.index(v) + 1) % len(values)] if v in values else values[0]
    if action == "select_simple_template":
        return replace(nxt, template_type="simple_agreement", preposition_changes=0, pronoun_changes=0)
    if action in ("select_pp_template", "add_plural_attractor"):
        return replace(nxt, template_type="pp_attractor")
    if action in ("select_relative_clause_template", "increase_depth_if_valid"):
        return replace(nxt, template_type="relative_clause")
    if action == "change_preposition":
        return replace(nxt, preposition=turn(PREPOSITIONS, s.preposition), preposition_changes=s.preposition_changes + 1)
    return replace(nxt, relative_pronoun=turn(PRONOUNS, s.relative_pronoun), pronoun_changes=s.pronoun_changes + 1)


def state_key(template_type: Column, distance: Column, attractors: Column, depth: Column, stopped: Column, preposition_changes: Column, pronoun_changes: Column) -> Column:
    """``State.key`` as a column: changes count at most once."""
    once = lambda c: F.least(c, F.lit(1))
    return F.concat_ws("|", template_type, *[c.cast("string") for c in (distance, attractors, depth, stopped.cast("int"), once(preposition_changes), once(pronoun_changes))])


def transitions() -> list[tuple[str, str, str, str, str]]:
    """(state key, subtype, action, key after it, subtype after it) of all valid actions in the states that can be reached."""
    seen, todo, out = set(), [State()], []
    while todo:
        s = todo.pop()
        if (s.key, s.subtype) in seen:
            continue
        seen.add((s.key, s.subtype))
        for action in valid_actions(s):
            after = replace(s, stopped=True) if action == "stop" else moved(s, action)
            out.append((s.key, s.subtype, action, after.key, after.subtype))
            todo.append(after)
    return sorted(out)


def length_scorer(sentence: str) -> float:
    tokens = sentence.split()
    return sum(map(len, tokens)) / len(tokens) if tokens else 0.0


class Environment:
    """Edits a structure step by step; stop realises and scores it. Stepping after stop is a void step."""

    def __init__(self, seed: int, max_steps: int = 8, scorer: Callable[[str], float] = length_scorer, weights: RewardWeights | None = None) -> None:
        self.rng = random.Random(seed)
        self.max_steps, self.scorer, self.weights = max_steps, scorer, weights
        self.state = State()

    def realize(self) -> tuple[str, str]:
        words = {slot: self.rng.choice(values) for slot, values in SLOTS.items()}
        one, many = self.rng.choice(list(zip(VERBS_SINGULAR, VERBS_PLURAL, strict=True)))
        s = self.state
        stem = {
            "pp_attractor": f"The {words['subject_singular']} {s.preposition} the {words['attractor_plural']}",
            "relative_clause": f"The {words['person_singular' if s.relative_pronoun == 'who' else 'subject_singular']} {s.relative_pronoun} the {words['object_singular']} {words['embedded_verb_singular']}",
        }.get(s.template_type, f"The {words['subject_singular']}")
        return f"{stem} {one}.", f"{stem} {many}."

    def step(self, action: str) -> tuple[float, bool, dict]:
        s = self.state
        if s.stopped:
            return 0.0, True, {"valid": False}
        distance, attractors, depth, tokens = SHAPE[s.template_type]
        if action not in valid_actions(s):
            self.state = replace(s, step_count=s.step_count + 1, invalid_actions=s.invalid_actions + 1)
            # an invalid action passes a margin of 0, so it keeps the low-confidence reward
            parts = reward_parts(0.0, False, tokens, 0, 0, 0, {"invalid_action"}, self.weights)
            return parts["reward"], self.state.step_count >= self.max_steps, {"valid": False, "margin": 0.0, "model_failed": False}
        if action == "stop":
            self.state = replace(s, stopped=True, step_count=s.step_count + 1)
            good, bad = self.realize()
            margin = self.scorer(good) - self.scorer(bad)
            failed = self.scorer(bad) > self.scorer(good)
            flags = {"stopped_simple"} if s.template_type == "simple_agreement" else set()
            parts = reward_parts(margin, failed, tokens, distance, attractors, depth, flags, self.weights)
            return parts["reward"], True, {"valid": True, "good": good, "bad": bad, "margin": margin, "model_failed": failed}
        self.state = moved(s, action)
        return 0.0, self.state.step_count >= self.max_steps, {"valid": True}


Policy = Callable[[State, list[str]], str]


def run_episode(env: Environment, policy: Policy, on_step: Callable[[State, str, float, State, bool], None] | None = None) -> dict:
    """Up to max_steps - 1 actions, then a forced stop; one record."""
    total, steps, info, final = 0.0, [], {}, None

    def act(action: str) -> bool:
        nonlocal total, info, final
        before = env.state
        reward, done, got = env.step(action)
        if on_step:
            on_step(before, action, reward, env.state, done)
        total += reward
        steps.append(action)
        if done:
            info = got
            final = got.get("good")
        return done and (final is not None or env.state.stopped)

    for _ in range(max(1, env.max_steps - 1)):
        if act(policy(env.state, valid_actions(env.state))):
            break
    if final is None and not env.state.stopped:
        act("stop")
    kind = env.state.template_type if final is not None else None
    return {"total_reward": total, "steps": len(steps), "actions": ",".join(steps), "template_type": kind, "subtype": env.state.subtype if kind else None, "sentence_good": final, "sentence_bad": info.get("bad"), "margin": info.get("margin"), "model_failed": info.get("model_failed")}


def random_policy(rng: random.Random, go_on: float = 0.0) -> Policy:
    """Uniform over valid actions; with probability ``go_on`` uniform over those other than stop."""

    def pick(_: State, actions: list[str]) -> str:
        others = [a for a in actions if a != "stop"]
        if go_on and others and rng.random() < go_on:
            return rng.choice(others)
        return rng.choice(actions)

    return pick


def greedy_policy(q: dict[str, dict[str, float]]) -> Policy:
    """The highest value; ties by the fixed order of actions."""
    return lambda s, actions: min(actions, key=lambda a: (-q.get(s.key, {}).get(a, 0.0), ACTIONS.index(a)))


EPISODE_SCHEMA = "policy string, episode long, total_reward double, steps int, actions string, template_type string, subtype string, sentence_good string, sentence_bad string, margin double, model_failed boolean"


def rollouts(spark: SparkSession, policy: str, episodes: int, seed: int, max_steps: int = 8, q: dict | None = None, go_on: float = 0.0) -> DataFrame:
    """Independent episodes spread over executors, each with its own generators seeded by seed and episode (so the result
    does not depend on partitions; a shared generator would tie episodes to one process)."""
    table = q or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e in pdf["id"]:
                env = Environment(seed + int(e), max_steps)
                pick = greedy_policy(table) if policy == "trained" else random_policy(random.Random(f"{seed}-{e}"), go_on)
                rows.append({"policy": policy, "episode": int(e), **run_episode(env, pick)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EPISODE_SCHEMA.split(", ")])

    return spark.range(episodes).mapInPandas(run, EPISODE_SCHEMA)


def train(episodes: int = 100, seed: int = 42, learning_rate: float = 0.2, discount: float = 0.9, epsilon: tuple[float, float] = (0.4, 0.05), max_steps: int = 8, weights: RewardWeights | None = None) -> tuple[dict[str, dict[str, float]], list[dict]]:
    """Tabular Q-learning. Each update depends on the one before, so it runs on the driver; the table has a few dozen
    entries whatever the number of episodes."""
    rng = random.Random(seed)
    q: dict[str, dict[str, float]] = {}
    log = []

    def learn(before: State, action: str, reward: float, after: State, done: bool) -> None:
        best = 0.0 if done else max((q.get(after.key, {}).get(a, 0.0) for a in valid_actions(after)), default=0.0)
        values = q.setdefault(before.key, {})
        values[action] = q_step(values.get(action, 0.0), reward, best, learning_rate, discount)

    for e in range(episodes):
        eps = linear_decay(*epsilon, e, max(episodes - 1, 1))
        greedy = greedy_policy(q)
        pick = lambda s, actions, eps=eps, greedy=greedy: rng.choice(actions) if rng.random() < eps else greedy(s, actions)
        log.append({"episode": e, "epsilon": eps, **run_episode(Environment(seed + e, max_steps, weights=weights), pick, learn)})
    return q, log


def q_rows(spark: SparkSession, q: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(s, a, float(v)) for s, values in sorted(q.items()) for a, v in sorted(values.items())], "state_key string, action string, q double")


#: The keys of the initial state and of a fresh relative clause.
INITIAL_STATE, RELATIVE_STATE = "unset|0|0|0|0|0|0", "relative_clause|5|0|1|0|0|0"


def q_report(q: DataFrame, n: int = 10) -> DataFrame:
    """One row on a Q-table: ranked actions of two states and the best of each, whether stopping at once is best at the
    start, the ``n`` highest entries and the number of states. Equal values are ranked by state and action."""
    of = lambda key: F.array_sort(F.collect_list(F.when(F.col("state_key") == key, F.struct((-F.col("q")).alias("_"), "action", F.col("q").alias("q_value")))))
    actions = lambda c: F.transform(c, lambda x: F.struct(x["action"].alias("action"), x["q_value"].alias("q_value")))
    best = lambda c: F.get(F.col(c), F.lit(0))["action"]
    states = q.agg(actions(of(INITIAL_STATE)).alias("initial_state_actions"), actions(of(RELATIVE_STATE)).alias("relative_clause_actions"), F.count_distinct("state_key").alias("state_count"))
    states = states.withColumn("best_initial_action", best("initial_state_actions")).withColumn("best_relative_clause_action", best("relative_clause_actions"))
    states = states.withColumn("favors_immediate_stop_initially", F.coalesce(F.col("best_initial_action") == "stop", F.lit(False)))
    top = q_summary(q, n).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("_"), "state_key", "action", "q"))), lambda x: F.struct(x["state_key"].alias("state"), x["action"].alias("action"), x["q"].alias("q_value"))).alias("top_q_entries"))
    one = F.lit(1).alias("_one")
    return states.select("*", one).join(top.select("*", one), "_one").drop("_one")  # one row each


def q_summary(q: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest values over all states."""
    return q.orderBy(F.desc("q"), "state_key", "action").limit(n)
