import datetime as dt
import random

from pairlight.operators.wide import read_catalog, resolve_cells, wide_table

SCHEMA = "record_id long, run_id long, model_id string, attr_name string, val_text string, recorded_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def rows():
    random.seed(2)
    out, k = [], 0
    for _ in range(3000):
        k += 1
        run = random.choice([1, 1, 1, 2, 3, None])
        out.append((random.randrange(2000), run, random.choice(["a", None]), random.choice(["Total", " total", "matched", "note", "other", None]), random.choice(["1", "2.0", "x", "yes", "no", " hi ", "", None]), random.choice([T0 + dt.timedelta(days=random.randrange(5)), None])))
    return out + [(1, None, None, "total", "5", T0)]


def usable(attr, v):
    v = (v or "").strip()
    if attr == "total":
        return str(int(float(v))) if v in ("1", "2.0") else None
    if attr == "matched":
        return {"yes": "true", "no": "false", "1": "true"}.get(v)
    return v or None


def test_cells_against_brute_force(spark):
    data = rows()
    catalog = read_catalog(spark.createDataFrame([("total", "int"), ("matched", "boolean"), (" Note", "string"), ("unseen", "odd")], "attr_name string, val_type string"))
    assert catalog == {"matched": "boolean", "note": "string", "total": "int", "unseen": "string"}
    best = {}
    for rec, run, model, attr, val, at in data:
        a = (attr or "").strip().lower()
        t = usable(a, val) if a in catalog else None
        if t is None or (run is None and model is None):
            continue
        key, cand = (run, model, a), ((at or dt.datetime.min), rec, t)
        if key not in best or cand > best[key]:
            best[key] = cand
    facts = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(r.run_id, r.model_id, a): (c.record_id, c.text) for r in resolve_cells(facts, catalog, ["run_id", "model_id"]).collect() for a, c in r.cells.items()}
    assert got == {k: v[1:] for k, v in best.items()}


def test_typed_columns_name_clash_and_empty(spark):
    catalog = spark.createDataFrame([("run_id", "int"), ("day", "date"), ("rate", "double")], "attr_name string, val_type string")
    facts = spark.createDataFrame([(1, 7, "a", "RUN_ID", "3", T0), (2, 7, "a", "day", "2025-02-03", T0), (3, 7, "a", "rate", "50 %", T0), (4, 8, "a", "rate", "?", T0)], SCHEMA)
    wide = wide_table(facts, catalog, ["run_id", "model_id"])
    assert wide.columns == ["run_id", "model_id", "day", "rate", "attr_run_id"]
    assert [tuple(r) for r in wide.collect()] == [(7, "a", dt.date(2025, 2, 3), 0.5, 3)]
    assert wide_table(facts.limit(0), catalog, ["run_id", "model_id"]).isEmpty()
    assert wide_table(facts, catalog.limit(0), ["run_id", "model_id"]).isEmpty()
