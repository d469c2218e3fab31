"""Scorers and the result rows that all summaries start from."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions.text import distance_bucket, length_score, md5_number, parse_judgement
from pairlight.operators.ranking import first_of_each, running_index
from pairlight.storage import materialize

#: A scorer turns a sentence column into a score column.
Scorer = Callable[[Column], Column]
NEAR_FAILURE_MARGIN = 0.01
RESULT_FIELDS = ["dataset", "model_id", "pair_id", "phenomenon", "subtype", "template_type", "dependency_distance", "dependency_distance_bucket", "clause_depth", "grammatical", "ungrammatical", "grammatical_score", "ungrammatical_score", "preference_margin", "correct", "failure", "near_failure"]

# Provider names of each kind of scorer.
PROVIDERS = {
    "length": ("length", "length_normalized", "dry_run"),
    "causal_lm": ("hf", "huggingface", "huggingface_causal_lm"),
    "judge": ("openai", "openai_responses"),
}


@dataclass(frozen=True)
class ScorerOptions:
    """What a configuration says about a scorer; all options reach the scorer, whichever entry point builds it."""

    provider: str = "length"
    name: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


def hash_scorer(model_id: str) -> Scorer:
    """A test scorer: a pseudo-random multiple of 1/1024 from model and sentence, so sums of scores are exact."""
    return lambda s: (md5_number(F.lit(model_id), s) % 20001 - 10000) / F.lit(1024.0)


def batch_scorer(load: Callable[[], Callable[[list[str]], list[float]]]) -> Scorer:
    """A scorer run in Python by Arrow batches; ``load`` runs once a worker and returns a function over sentence lists."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for s in batches:
            yield pd.Series(run([x or "" for x in s]), dtype=float)

    return score


def causal_lm_scorer(name: str, normalize: bool = True, device: str = "auto", dtype: str = "auto", loader: Callable[[], Any] | None = None) -> Scorer:
    """Mean (or sum) token log probability under a causal language model; blank is -inf, under two tokens 0.0.

    ``loader`` gives ``(encode, log_probs)`` and defaults to the transformers library, imported only on the workers.
    """

    def load() -> Callable[[list[str]], list[float]]:
        encode, log_probs = loader() if loader else _transformers(name, device, dtype)

        def run(sentences: list[str]) -> list[float]:
            out = []
            for s in sentences:
                if not s.strip():
                    out.append(float("-inf"))
                    continue
                ids = encode(s)
                parts = log_probs(ids) if len(ids) >= 2 else []
                out.append(0.0 if not len(parts) else float(sum(parts)) / (len(parts) if normalize else 1))
            return out

        return run

    return batch_scorer(load)


def _transformers(name: str, device: str, dtype: str) -> tuple[Callable, Callable]:
    import torch
    from transformers import AutoModelForCausalLM, AutoTokenizer

    where = ("cuda" if torch.cuda.is_available() else "cpu") if device == "auto" else device
    kind = getattr(torch, dtype) if dtype != "auto" else (torch.float16 if where == "cuda" else torch.float32)
    tokenizer = AutoTokenizer.from_pretrained(name)
    model = AutoModelForCausalLM.from_pretrained(name, torch_dtype=kind).to(where).eval()

    def log_probs(ids: list[int]) -> list[float]:
        x = torch.tensor([ids], device=where)
        with torch.no_grad():
            logits = torch.log_softmax(model(x).logits[0, :-1].float(), dim=-1)
        return logits.gather(1, x[0, 1:, None])[:, 0].tolist()

    return tokenizer.encode, log_probs


def judge_scorer(client: Callable[[], Callable[[str], str]]) -> Scorer:
    """A remote judge: ``client`` gives, once a worker, a function from sentence to answer text; blank scores 0.0. An
    answer without a number is an error."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = client()
        for s in batches:
            yield s.map(lambda x: run(x) if x and x.strip() else "0")

    def score(s: Column) -> Column:
        value = parse_judgement(ask(s))
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("the judge's answer holds no score")).cast("double"))

    return score


#: What a judge is asked where a configuration does not say.
INSTRUCTIONS = "Rate how grammatical the sentence is, from 0 to 1. Answer with JSON: {\"score\": number}."


def is_judge(provider: str) -> bool:
    return provider.strip().lower() in PROVIDERS["judge"]


def remote_client(model: str, key_variable: str, instructions: str = INSTRUCTIONS, max_output_tokens: int = 32) -> Callable[[], Callable[[str], str]]:
    """A client for ``judge_scorer`` over the remote library, which is imported on the worker; the key is read there from
    an environment variable, so it is not part of the plan. Needs the library and a network."""

    def client() -> Callable[[str], str]:
        import os

        import openai

        remote = openai.OpenAI(api_key=os.environ[key_variable])
        ask = lambda s: remote.responses.create(model=model, instructions=instructions, input=s, max_output_tokens=max_output_tokens)
        return lambda s: response_text(ask(s))

    return client


def response_text(response: Any) -> str:
    """The text of a judge's answer object: its ``output_text``, else the texts of its output parts, a line each."""
    if whole := getattr(response, "output_text", None):
        return str(whole)
    parts = (part for item in getattr(response, "output", None) or () for part in getattr(item, "content", None) or ())
    return "\n".join(str(t) for p in parts if (t := getattr(p, "text", None)))


def build_scorer(options: ScorerOptions) -> Scorer:
    kind = next((k for k, names in PROVIDERS.items() if options.provider.strip().lower() in names), None)
    if kind == "length":
        return length_score
    if kind == "causal_lm":
        return causal_lm_scorer(options.name or "", **options.options)
    if kind == "judge" and "client" in options.options:
        return judge_scorer(options.options["client"])
    raise ValueError(f"no scorer for provider {options.provider!r}")


def add_scores(pairs: DataFrame, scorer: Scorer, near: float = NEAR_FAILURE_MARGIN) -> DataFrame:
    """Scores of both sides, and ``with_flags``."""
    return with_flags(pairs.withColumn("grammatical_score", scorer(F.col("grammatical"))).withColumn("ungrammatical_score", scorer(F.col("ungrammatical"))), near)


def with_flags(scored: DataFrame, near: float = NEAR_FAILURE_MARGIN) -> DataFrame:
    """Margin and flags of scored rows.

    Correct: margin above 0, never NaN; a tie is a failure. Near failure: margin within ``near`` of 0, whatever the other
    flags. ``model_failed`` (bad side strictly above): a tie is none. Null scores are not correct.
    """
    m = F.col("preference_margin")
    scored = scored.withColumn("preference_margin", F.col("grammatical_score") - F.col("ungrammatical_score"))
    scored = scored.withColumn("correct", F.coalesce((m > 0) & ~F.isnan(m), F.lit(False))).withColumn("failure", ~F.col("correct"))
    scored = scored.withColumn("near_failure", F.coalesce(F.abs(m) <= near, F.lit(False)))
    worse = (F.col("ungrammatical_score") > F.col("grammatical_score")) & ~F.isnan("ungrammatical_score") & ~F.isnan("grammatical_score")
    return scored.withColumn("model_failed", F.coalesce(worse, F.lit(False)))


def with_pair_ids(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Null or empty pair ids become the row's index by ``order`` over all rows, from 0."""
    rows = running_index(pairs, [], order, "_index")
    return rows.withColumn("pair_id", F.coalesce(F.nullif("pair_id", F.lit("")), F.col("_index").cast("string"))).drop("_index")


def score_pairs(pairs: DataFrame, scorers: dict[str, Scorer], near: float = NEAR_FAILURE_MARGIN, max_examples: int | None = None) -> DataFrame:
    """Result rows of every pair under every model.

    ``pairs``: ``dataset, pair_id, grammatical, ungrammatical`` and metadata. All models' scores are computed in one scan
    of the pairs and exploded into rows: models and pairs need no join. ``max_examples``: the first of each dataset by
    ``pair_id``.
    """
    if not scorers:
        raise ValueError("no enabled model")
    if max_examples is not None:
        pairs = head_per_group(pairs, ["dataset"], ["pair_id"], max_examples)
    pairs = pairs.withColumn("dependency_distance_bucket", distance_bucket("dependency_distance"))
    each = [F.struct(F.lit(m).alias("model_id"), s(F.col("grammatical")).alias("good"), s(F.col("ungrammatical")).alias("bad")) for m, s in scorers.items()]
    rows = pairs.select("*", F.explode(F.array(*each)).alias("_s")).select(*pairs.columns, "_s.model_id", F.col("_s.good").alias("grammatical_score"), F.col("_s.bad").alias("ungrammatical_score"))
    return with_flags(rows, near)


def score_each_model(pairs: DataFrame, scorers: dict[str, Scorer], near: float = NEAR_FAILURE_MARGIN, keep_going: bool = True) -> tuple[DataFrame | None, list[dict[str, str]]]:
    """As ``score_pairs``, but each model is run for itself: one that fails is listed with its error and adds no row."""
    out, errors = None, []
    for model_id, scorer in scorers.items():
        try:
            part = materialize(score_pairs(pairs, {model_id: scorer}, near))
        except Exception as e:  # noqa: BLE001
            if not keep_going:
                raise
            errors.append({"model_id": model_id, "error": str(e).split("\n")[0]})
            continue
        out = part if out is None else out.unionByName(part)
    return out, errors


def head_per_group(df: DataFrame, groups: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order (Spark limits each group before the shuffle)."""
    return first_of_each(df, groups, order, n).drop("rank")
