import csv
import json

import pytest

from pairlight.__main__ import main
from pairlight.plans import pipelines
from pairlight.sources import sinks


def rows(path):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pairs")
    bench = pipelines.run_generation(spark, {"experiment": {"seed": 123}, "generation": {"count": 240, "balanced": True, "exact_replay": True}, "outputs": {"path": str(d / "bench.jsonl"), "csv_path": str(d / "bench.csv")}})
    rl = pipelines.run_quota_generation(spark, {"inputs": {"benchmark_distribution": {"path": bench["pairs"]}}, "generation": {"target_total": 120}, "scorer": {"provider": "dry_run", "id": "len"}, "outputs": {"dir": str(d / "rl")}})
    return bench, rl


MODELS = [{"id": "hf_tiny_gpt2", "provider": "dry_run"}, {"id": "hf_gpt2", "provider": "length", "max_examples_per_dataset": None}, {"id": "hf_distilgpt2", "provider": "length"}, {"id": "off", "enabled": False}, {"id": "broken", "provider": "hf", "name": "x", "loader": lambda: 1 / 0}]


def test_generation(generated, spark):
    bench, rl = generated
    assert len(rows(bench["csv"])) == 240 and pipelines.run_validation(spark, bench["pairs"]) == []
    comparison = rows(rl["comparison"])
    assert sum(int(r["target_count"]) for r in comparison) == 120 and all(r["missing_count"] == "0" for r in comparison)
    uids = [json.loads(x)["uid"] for x in open(rl["pairs"], encoding="utf-8")]
    assert sorted(uids) == [f"rl_dist_{i:04d}" for i in range(1, 121)]


def test_comparison_and_sanity_check(generated, spark, tmp_path):
    bench, rl = generated
    inputs = {"benchmark": bench["pairs"], "rl": {"path": rl["pairs"]}}
    old = tmp_path / "old.csv"
    old.write_text("model_id,group_by,group,accuracy,failure_rate,mean_preference_margin,total,correct\nm,subtype,s,0.5,0.5,0.1,4,2\n")
    got = pipelines.run_comparison(spark, {"inputs": inputs, "models": MODELS, "cross_run_sources": [{"label": "old", "path": str(old)}, {"label": "gone", "path": "/none.csv"}], "outputs": {"comparison_dir": str(tmp_path / "c")}})
    overall = {(r["model_id"], r["dataset"]): r for r in rows(got["overall_summary"])}
    assert len(overall) == 6 and overall["hf_gpt2", "benchmark"]["correct"] == "144"
    report = json.load(open(got["report_json"], encoding="utf-8"))
    assert [e["model_id"] for e in report["errors"]] == ["broken"] and len(report["overall"]) == 3
    assert {r["source"] for r in rows(got["cross_run_hardest"])} == {"current", "old", "gone"}
    san = pipelines.run_sanity_check(spark, {"inputs": {**inputs, "results": got["results"]}, "outputs": {"sanity_dir": str(tmp_path / "s")}})
    flags = json.load(open(san["summary"], encoding="utf-8"))["flags"]
    assert flags["validation_error_count"] == 0 and len(rows(san["pair_validation"])) == 120
    again = pipelines.run_comparison(spark, {"inputs": inputs, "models": MODELS[:1], "matched_subset": {"examples_per_group": 3, "max_total_examples": 20}, "outputs": {"comparison_dir": str(tmp_path / "m")}})
    assert len(rows(again["results"])) == 40


def test_subtype_analysis_and_baseline(generated, spark, tmp_path):
    bench, _ = generated
    got = pipelines.run_subtype_analysis(spark, {"inputs": {"dataset": bench["pairs"]}, "models": MODELS[:3], "outputs": {"analysis_dir": str(tmp_path / "a")}})
    assert len(rows(got["accuracy_by_subtype"])) == 15
    base = pipelines.run_baseline(spark, {"data": {"path": bench["pairs"]}, "outputs": {"dir": str(tmp_path / "b")}})
    assert json.load(open(base["summary"], encoding="utf-8"))["correct"] == 144
    with pytest.raises(ValueError):
        pipelines.run_baseline(spark, {"data": {"path": bench["pairs"]}, "evaluation": {"group_by": ["colour"]}, "outputs": {"dir": str(tmp_path)}})


def test_training_report_and_reevaluation(spark, tmp_path):
    got = pipelines.run_training(spark, {"training": {"episodes": 40, "eval_episodes": 10}, "outputs": {"dir": str(tmp_path / "t")}})
    assert {r["policy"] for r in rows(got["summary"])} == {"trained", "random"}
    rep = pipelines.run_report(spark, {"inputs": {"q_values": got["q_values"], "trajectories": got["trajectories"]}, "outputs": {"dir": str(tmp_path / "r")}})
    assert json.load(open(rep["json"], encoding="utf-8"))["episodes"] == 20
    lines = [json.loads(x) for x in open(got["pairs"], encoding="utf-8")]
    for policy in ("trained", "random"):
        (tmp_path / f"{policy}.jsonl").write_text("\n".join(json.dumps(r) for r in lines if r["policy"] == policy))
    re = pipelines.run_reevaluation(spark, {"inputs": {p: str(tmp_path / f"{p}.jsonl") for p in ("trained", "random")}, "models": MODELS[:2], "outputs": {"dir": str(tmp_path / "e")}})
    assert len(rows(re["model_policy_comparison"])) == 4
    assert "rollouts.jsonl" in pipelines.run_rollouts(spark, {"outputs": {"dir": str(tmp_path / "o")}})["trajectories"]


def test_validation_of_broken_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"uid": "a"}\n\nnot json\n[1]\n')
    got = pipelines.run_validation(spark, str(p))
    assert [r["uid"] for r in got].count("<unknown>") == 2 and any("phenomenon" in r["errors"] for r in got)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x,y")], "b int, c string, a string")
    assert sinks.write_csv(df, tmp_path / "d/1.csv").read_text() == 'a,b,c\n"x,y",1,\n'
    assert sinks.write_csv(df.limit(0), tmp_path / "2.csv").read_text() == "\n"
    assert sinks.write_csv(df.limit(0), tmp_path / "3.csv", ["b"]).read_text() == "b\n"
    assert json.loads(sinks.write_jsonl(df, tmp_path / "4.jsonl").read_text()) == {"b": 1, "c": None, "a": "x,y"}
    assert spark.read.parquet(sinks.write_parts(df, str(tmp_path / "5"))).count() == 1
    with pytest.raises(ValueError):
        sinks.rows_of(spark.range(5), 3)


def test_command_line():
    assert main(["health"]) == 0
