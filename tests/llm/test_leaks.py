import random
import tracemalloc

from pairlight.llm import leaks
from pairlight.llm.leaks import ItemIndex, clean_documents, find_leaks, own_places, quick_words, without_leaks, words_of

random.seed(11)
VOCAB = [f"w{chr(97 + k % 26)}{k}" for k in range(600)]
OPENING = "read the short passage and decide which of the two endings is right".split()


def text(n):
    return [random.choice(VOCAB) for _ in range(n)]


ITEMS = {i: OPENING + text(40) for i in range(1, 9)}
NOISE = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(60))


def docs_and_truth():
    docs, truth = [], set()
    add = lambda d, t: docs.append((d, t))
    for d in range(40):
        i = d % 8 + 1
        body = ITEMS[i][len(OPENING) :]
        a = random.randrange(0, 20)
        part = body[a : a + 14 + d % 7]
        kind = d % 8
        if kind == 0:
            shown = " ".join(part)
        elif kind == 1:
            shown = "<p>" + " ".join(f"<b>{w.upper()}</b>," for w in part) + "</p>"
        elif kind == 2:  # two of the words changed
            p = part[:14]
            p[4], p[9] = "zzz", "yyy"
            shown = " ".join(p)
        elif kind == 3:  # one dropped, one put in
            shown = " ".join(part[:5] + part[6:11] + ["xxx"] + part[11:])
            part = part if len(part) >= 14 else body[a : a + 15]
        elif kind == 4:
            shown = " ".join(w[:2] + "​" + w[2:] for w in part)
        elif kind == 5:
            shown = " ".join(part[:13])  # too short
        elif kind == 6:
            shown = " ".join(OPENING)  # shared wording
        else:  # three of fourteen changed
            p = part[:14]
            p[3] = p[7] = p[11] = "zzz"
            shown = " ".join(p)
        add(d, f"{NOISE()}\n{shown}\n{NOISE()}")
        if kind < 5:
            truth.add((d, i))
    return docs + [(90, None), (91, ""), (92, "&amp; <b>"), (93, "x " * 50_000)], truth


def test_found_pairs(spark):
    docs, truth = docs_and_truth()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w).capitalize() + ".") for i, w in ITEMS.items()] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, items).collect()}
    assert got == truth
    assert find_leaks(d.limit(0), items).isEmpty() and find_leaks(d, items.limit(0)).isEmpty()


def test_every_spread_of_changes_is_found():
    """Any two changed words of fourteen leave a run of four, whichever they are."""
    body = text(14)
    index = ItemIndex([(1, body, [])])
    for a in range(14):
        for b in range(a + 1, 14):
            w = list(body)
            w[a], w[b] = "zzz", "yyy"
            # a stretch begins and ends with an item's word: a change at an end leaves fewer than fourteen
            assert bool(index.find(" ".join(["q"] * 5 + w + ["r"] * 5))) == (0 < a and b < 13)


def test_two_places_and_spans():
    body = text(30)
    index = ItemIndex([(1, body, [])])
    doc = "Before. " + " ".join(body[:16]) + " middle words here. " * 40 + " ".join(body[10:]) + " end"
    found = index.find(doc)
    assert len(found) == 2
    assert [doc[s:e].split()[0] for *_, s, e in found] == [body[0], body[10]]


def test_words():
    assert words_of("A­-B <br/>c&eacute;d_e ﬁx Ｆull")[0] == ["a", "b", "ced", "e", "fix", "full"]
    assert words_of("01: one two\n> 02: three 26 four\n 3) five 4: x")[0] == ["one", "two", "three", "26", "four", "five", "4", "x"]
    for t in ("01: a\n02: b", "Ünï​code text", "plain", "a < b & c", "été"):
        assert quick_words(t) == words_of(t)[0]


def test_long_tags():
    for tag in ('<span style="{}">', "<img hidden alt='x' src = '{}'/>", '<a href=data:{} rel="a=b" >', '<p title="{}" class=c data-x="{}">'):
        long = tag.replace("{}", "color of words; a=b " * 300 if "data:" not in tag else "abc=" * 2000)
        assert words_of(f"one {long}two</span> three")[0] == ["one", "two", "three"], tag
    body = ITEMS[1][len(OPENING) :][:14]
    cut = " ".join(body[:7]) + ' <i style="' + "margin of words " * 200 + '">' + " ".join(body[7:])
    assert words_of(cut)[0] == body
    assert "w300" in words_of("a <b " + " ".join(f"w{k}" for k in range(400)) + " c> d")[0]  # no tag
    assert len(words_of("<a b=c" * 20_000 + "<a " + "b=c " * 20_000)[0]) > 20_000  # never closed: in linear time


def test_shared_wording():
    sharing = [(p, 100) for p in range(12)] + [(12, 5), (13, 2)]
    assert own_places(20, sharing).tolist() == [False] * 12 + [True] * 8
    assert own_places(20, [(p, 2) for p in range(12)]).tolist() == [False] * 12 + [True] * 8
    assert own_places(5, []).all()


def test_cutting(spark):
    body = text(20)
    d = spark.createDataFrame([(1, "keep this " + " ".join(body) + " and this", "s"), (2, "clean", "t"), (3, None, None)], "doc_id long, text string, start string")
    items = spark.createDataFrame([(7, " ".join(body))], "item_id long, text string")
    found = find_leaks(d, items)
    cut = {r.doc_id: r for r in without_leaks(d, found).collect()}
    assert cut[1].text == "keep this  and this" and cut[1].start == "s" and cut[2].text == "clean" and cut[3].text is None
    assert {r.doc_id for r in without_leaks(d, found, whole=True).collect()} == {2, 3}


def test_many_blocks_find_the_same_in_one_scan(spark, monkeypatch):
    docs, truth = docs_and_truth()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id long, text string")
    want = sorted(map(tuple, find_leaks(d, items).collect()))
    clean = sorted(map(tuple, clean_documents(d, items).collect()), key=str)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 120)
    looked_at = []
    monkeypatch.setattr(leaks, "possible_documents", lambda *a, f=leaks.possible_documents: looked_at.append(f(*a)) or looked_at[-1])
    assert sorted(map(tuple, find_leaks(d, items).collect())) == want and {(r[0], r[1]) for r in want} == truth
    assert len(looked_at) == 1 and truth_docs(truth) <= {r.doc_id for r in looked_at[0].collect()} and looked_at[0].count() < d.count()
    assert sorted(map(tuple, clean_documents(d, items).collect()), key=str) == clean
    monkeypatch.setattr(leaks, "MAP_BITS", 8)  # a crowded map lets more documents pass, and misses none
    assert sorted(map(tuple, find_leaks(d, items).collect())) == want


def truth_docs(truth):
    return {d for d, _ in truth}


def test_cleaning_in_one_scan(spark):
    docs, _ = docs_and_truth()
    d = spark.createDataFrame([(i, t, None if i % 3 else 2**60 + i) for i, t in docs], "doc_id long, text string, start long")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id long, text string")
    got = clean_documents(d, items)
    assert got.columns == d.columns
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(without_leaks(d, find_leaks(d, items)))
    assert "Exchange" not in d.coalesce(4).transform(lambda x: clean_documents(x, items))._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")
    assert find_leaks(got, items).isEmpty() and clean_documents(d.limit(0), items).isEmpty()


def test_alignments_of_large_items_keep_few_rows(monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    for _ in range(60):
        doc, item = [rng.choice(words) for _ in range(rng.randrange(1, 50))], [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        paths = []
        for cells in (10**6, 10):
            monkeypatch.setattr(leaks, "CELLS", cells)
            paths.append([leaks._align(doc, item, gain) for gain in (1, 7)])
        assert paths[0] == paths[1]
    monkeypatch.setattr(leaks, "CELLS", 4_000_000)
    item = [f"w{rng.randrange(2000)}" for _ in range(4000)]
    doc = ["x"] * 500 + item[:2500] + ["y"] * 9 + item[2500:] + ["x"] * 900
    tracemalloc.start()
    found = ItemIndex([(1, item, [])]).find(" ".join(doc))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:3] for f in found] == [(1, 4000, 9)] and peak < 50e6


def leaked(doc, item, least=14, one_in=7):
    """By trying every pair of starts: is some stretch of the item, first and last word kept, within the changes?"""
    for i0 in range(len(item) - least + 1):
        for j0 in range(len(doc)):
            if item[i0] != doc[j0]:
                continue
            before = list(range(len(doc) - j0 + 1))
            for i in range(i0, len(item)):
                now = [before[0] + 1]
                for j in range(j0, len(doc)):
                    now.append(min(before[j - j0] + (item[i] != doc[j]), before[j - j0 + 1] + 1, now[-1] + 1))
                before = now
                n = i - i0 + 1
                if n >= least and any(now[j - j0 + 1] * one_in <= n and doc[j] == item[i] for j in range(j0, len(doc))):
                    return True
    return False


def test_random_changes_against_trying_everything():
    rng = random.Random(8)
    yes = 0
    for case in range(250):
        item = [rng.choice(VOCAB[:25]) for _ in range(22)]
        doc = list(item[rng.randrange(0, 5) : 22 - rng.randrange(0, 5)])
        for _ in range(rng.randrange(0, 5)):
            at, kind = rng.randrange(len(doc)), rng.random()
            if kind < 0.5:
                doc[at] = rng.choice(VOCAB[25:60])
            elif kind < 0.75:
                del doc[at]
            else:
                doc.insert(at, rng.choice(VOCAB[:60]))
        doc = [rng.choice(VOCAB[:60]) for _ in range(4)] + doc + [rng.choice(VOCAB[:60]) for _ in range(4)]
        want = leaked(doc, item)
        yes += want
        assert bool(ItemIndex([(1, item, [])]).find(" ".join(doc))) == want, (case, doc, item)
    assert 60 < yes < 220
