import json

import pytest

from pairlight.sources import records


def write(p, text):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


GOOD = {"UID": "u1", "pairID": "3", "linguistics_term": "subject_agreement", "sentence_good": "A runs.", "sentence_bad": "A run.", "field": "syntax"}


def test_jsonl_with_blank_lines_and_metadata(spark, tmp_path):
    path = write(tmp_path / "x_agreement.jsonl", json.dumps(GOOD) + "\n\n  \n" + json.dumps({**GOOD, "pairID": "4", "subtype": " "}) + "\n")
    got = {r.pair_id: r for r in records.load_pairs(spark, path, dataset="rl").collect()}
    assert set(got) == {"u1-3", "u1-4"} and got["u1-3"].phenomenon == "subject_agreement" and got["u1-3"].dataset == "rl"
    assert got["u1-3"].metadata == {"linguistics_term": "subject_agreement", "field": "syntax"} and got["u1-4"].subtype == " "


@pytest.mark.parametrize("bad", ["[1, 2]\n", "not json\n", '{"a": \n'])
def test_bad_lines(spark, tmp_path, bad):
    path = write(tmp_path / "a.jsonl", json.dumps(GOOD) + "\n" + bad)
    with pytest.raises(Exception):  # noqa: B017
        records.load_pairs(spark, path).collect()


@pytest.mark.parametrize("drop", ["sentence_good", "ids", "phenomenon"])
def test_missing_fields(spark, tmp_path, drop):
    gone = {"ids": ["UID", "pairID"], "phenomenon": ["linguistics_term", "field"]}.get(drop, [drop])
    rows = [GOOD, {**GOOD, "pairID": "9", **{g: " " for g in gone}}]
    path = write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)))
    with pytest.raises(Exception, match="record without"):
        records.load_pairs(spark, path, "").collect()


def test_uniqueness_comes_before_the_filter(spark, tmp_path):
    other = {**GOOD, "linguistics_term": "anaphor"}
    path = write(tmp_path / "a.jsonl", json.dumps(GOOD) + "\n" + json.dumps(other))
    with pytest.raises(ValueError, match="u1-3"):
        records.load_pairs(spark, path)


def test_csv_json_and_discovery(spark, tmp_path):
    write(tmp_path / "d/b.csv", 'uid,phenomenon,sentence_good,sentence_bad\n7,Agreement,"A, b runs.","A, b run."\n8,other,C runs.,C run.\n')
    write(tmp_path / "d/a.json", json.dumps({"pairs": [{**GOOD, "pairID": "5"}]}))
    write(tmp_path / "d/._c.jsonl", "junk")
    assert [p.rsplit("/", 1)[1] for p in records.discover(str(tmp_path / "d"), "agreement")] == ["a.json", "b.csv"]
    got = {r.pair_id: r.grammatical for r in records.load_pairs(spark, str(tmp_path / "d")).collect()}
    assert got == {"7": "A, b runs.", "u1-5": "A runs."}
    write(tmp_path / "d/my_agreement.json", json.dumps([{**GOOD, "pairID": "6"}], indent=2))
    assert [r.pair_id for r in records.load_pairs(spark, str(tmp_path / "d")).collect()] == ["u1-6"]
    with pytest.raises(ValueError):
        records.discover(write(tmp_path / "x.txt", ""), "a")


def test_configuration(tmp_path):
    assert records.read_config(write(tmp_path / "e.yaml", "")) == {}
    assert records.read_config(write(tmp_path / "f.yaml", "a: {b: 1}")) == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        records.read_config(write(tmp_path / "g.yaml", "- 1"))
    assert records.optional_document(str(tmp_path / "none.json")) is None
    assert records.optional_document(write(tmp_path / "base_summary.json", '{"x": 1}'))["name"] == "base"
    assert records.data_path(None, str(tmp_path), "e") == str(tmp_path) and records.data_path("p", "", "") == "p"


def test_line_number_of_a_bad_line_and_all_repeated_ids(spark, tmp_path, monkeypatch):
    lines = [json.dumps({**GOOD, "pairID": str(i)}) for i in range(3)]
    path = write(tmp_path / "a.jsonl", "\n".join([lines[0], "", lines[1], '{"a": 1} x', lines[2]]))
    with pytest.raises(ValueError, match=r"a\.jsonl:4: not a JSON object"):
        records.load_pairs(spark, path)
    with pytest.raises(Exception, match="not a JSON object"):
        records.load_pairs(spark, write(tmp_path / "d.json", '{"items": []}'))
    monkeypatch.setattr(records, "LISTED_IDS", 1)
    again = write(tmp_path / "b.jsonl", "\n".join(lines * 2))
    with pytest.raises(ValueError, match=r"u1-0, \.\.\. \(all in .*table-") as e:
        records.load_pairs(spark, again)
    folder = str(e.value).split("all in ")[1].rstrip(")")
    assert {r.pair_id for r in spark.read.parquet(folder).collect()} == {"u1-0", "u1-1", "u1-2"}


def test_names_that_differ_by_case_and_files_with_other_headers(spark, tmp_path):
    both = {**GOOD, "uid": "low", "Subtype": "kept"}
    got = records.load_pairs(spark, write(tmp_path / "a.jsonl", json.dumps(both))).first()
    assert got.pair_id == "low-3" and got.metadata["Subtype"] == "kept" and got.subtype == "subject_agreement"
    write(tmp_path / "c/one.csv", 'uid,phenomenon,sentence_good,sentence_bad,note\n1,agreement,A runs.,A run.,"two\nlines"\n')
    write(tmp_path / "c/two.csv", "sentence_bad,sentence_good,linguistics_term,pair_id\nB run.,B runs.,agreement,2\n")
    got = {r.pair_id: r for r in records.load_pairs(spark, str(tmp_path / "c")).collect()}
    assert {k: r.grammatical for k, r in got.items()} == {"1": "A runs.", "2": "B runs."} and got["1"].metadata == {"note": "two\nlines"}
    assert got["2"].source_file.endswith("c/two.csv")
