"""Published evaluation results, recomputed from their per-subtype rows.

Fixed values: rl and benchmark accuracies of two models on 240 pairs each; 40 pairs per simple, 10 per prepositional and
16 per relative-clause subtype.
"""

import pytest

from pairlight.operators import compare

SIZES = {"simple": 40, "pp": 10, "relative": 16}
# subtype: (hf_distilgpt2 benchmark, rl, hf_gpt2 benchmark, rl)
ACCURACY = {
    "object_relative_clause_plural_embedded_that": (0.5, 0.3125, 0.75, 0.375),
    "object_relative_clause_plural_embedded_who": (0.4375, 0.375, 0.625, 0.5),
    "object_relative_clause_that": (0.75, 0.75, 0.8125, 0.75),
    "object_relative_clause_who": (0.875, 0.9375, 0.75, 0.6875),
    "plural_object_relative_clause_that": (0.875, 0.875, 0.9375, 0.9375),
    "pp_plural_attractor_behind": (0.3, 0.5, 0.5, 0.8),
    "pp_plural_attractor_beside": (0.9, 0.8, 0.7, 0.9),
    "pp_plural_attractor_near": (0.3, 0.6, 0.6, 0.5),
    "pp_plural_attractor_with": (0.7, 0.3, 0.8, 0.4),
    "pp_singular_attractor_behind": (0.9, 1.0, 1.0, 1.0),
    "pp_singular_attractor_beside": (1.0, 0.9, 1.0, 1.0),
    "pp_singular_attractor_near": (0.9, 1.0, 1.0, 1.0),
    "pp_singular_attractor_with": (0.9, 0.8, 0.8, 0.8),
    "simple_plural": (1.0, 1.0, 1.0, 1.0),
    "simple_singular": (0.725, 0.775, 0.925, 0.85),
}


@pytest.fixture(scope="module")
def grouped(spark):
    rows = []
    for subtype, values in ACCURACY.items():
        n = SIZES["simple" if subtype.startswith("simple") else "pp" if subtype.startswith("pp") else "relative"]
        for (model, dataset), a in zip([(m, d) for m in ("hf_distilgpt2", "hf_gpt2") for d in ("benchmark", "rl")], values, strict=True):
            k = round(a * n)
            rows.append((model, dataset, "subtype", subtype, n, k, k / n, 1 - k / n, 0.0))
    return spark.createDataFrame(rows, "model_id string, dataset string, group_by string, group_name string, total long, correct long, accuracy double, failure_rate double, mean_preference_margin double")


def test_failure_concentration(grouped):
    got = {r.model_id: r for r in compare.failure_concentration(grouped).collect()}
    assert got["hf_distilgpt2"].top_failure_share == pytest.approx(0.48276, abs=1e-5) and not got["hf_distilgpt2"].concentrated
    assert got["hf_gpt2"].top_failure_share == pytest.approx(0.48)


def test_harder_subtypes_in_order(grouped):
    rows = compare.harder_shared(grouped).orderBy("model_id", "rank").collect()
    gpt2 = [r.subtype for r in rows if r.model_id == "hf_gpt2"]
    assert gpt2[:5] == ["pp_plural_attractor_with", "object_relative_clause_plural_embedded_that", "object_relative_clause_plural_embedded_who", "pp_plural_attractor_near", "simple_singular"]
    distil = [r.subtype for r in rows if r.model_id == "hf_distilgpt2"]
    assert distil[:4] == ["pp_plural_attractor_with", "object_relative_clause_plural_embedded_that", "pp_plural_attractor_beside", "pp_singular_attractor_beside"]


def test_totals_and_mismatch(grouped):
    got = {(r.model_id, r.dataset): (r.t, r.c) for r in grouped.groupBy("model_id", "dataset").agg({"total": "sum", "correct": "sum"}).toDF("model_id", "dataset", "t", "c").collect()}
    assert got["hf_distilgpt2", "rl"] == (240, 182) and got["hf_gpt2", "rl"] == (240, 190) and got["hf_gpt2", "benchmark"] == (240, 203)
    assert compare.distribution_mismatch(grouped).isEmpty()
