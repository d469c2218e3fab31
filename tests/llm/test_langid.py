import numpy as np
from pyspark.sql import functions as F

from pairlight.llm import langid

WORDS = {
    "en": "the of and that with this from which would there house water people little under after".split(),
    "de": "der und nicht dass mit diese haus wasser leute kleine unter nach werden schon über sehr".split(),
    "fr": "le des et que avec cette maison eau gens petite sous après être déjà très pour".split(),
    "es": "los de y que con esta casa agua gente pequeña bajo después será muy para desde".split(),
}
rng = np.random.default_rng(4)


def sentence(lang):
    w = rng.choice(WORDS[lang], 9)
    return " ".join(w).capitalize() + "."


def passage(lang, n):
    return " ".join(sentence(lang) for _ in range(n))


def corpus():
    docs, i = [], 0
    for lang in WORDS:
        for _ in range(30):
            i += 1
            docs.append((i, passage(lang, 5), lang))
    return docs


def test_codewords():
    for k in (2, 3, 4, 7, 12):
        code = langid.codewords(k)
        apart = [int((code[a] != code[b]).sum()) for a in range(k) for b in range(a)]
        assert set(code.ravel()) == {-1.0, 1.0} and min(apart) >= (1 if k < 4 else 3 if k > 4 else 2)
        assert all(len(set(c)) == 2 for c in code.T)


def test_held_out_accuracy_with_wrong_labels():
    docs = corpus()
    labels = [lab if i % 12 else "es" for i, (_, _, lab) in enumerate(docs)]
    m = langid.fit([langid.sample_sentences(t) for _, t, _ in docs], labels)
    tests = [(lang, sentence(lang)) for lang in WORDS for _ in range(50)]
    right = sum(m.segments(t)[0][2] == lang for lang, t in tests)
    assert right >= 0.97 * len(tests)


def test_segments_and_asides():
    docs = corpus()
    m = langid.fit([langid.sample_sentences(t) for _, t, _ in docs], [x for _, _, x in docs])
    t = "# Titel\n" + passage("en", 3) + "\n" + passage("de", 2) + "\n* The house of people.\n" + passage("fr", 1) + " " + passage("en", 2)
    assert [(s[2], s[4]) for s in m.segments(t)] == [("en", 3), ("de", 2), ("fr", 1), ("en", 2)]
    assert m.segments(None) == [] and m.segments("") == [] and m.segments("42 …") == []
    assert len(m.segments("# The house of the people")) == 1
    wrapped = "The house of the people with\nwater and this. " + sentence("en")
    assert m.segments(wrapped)[0][4] == 2


def test_marked_lines_of_two_sentences_are_text():
    docs = corpus()
    m = langid.fit([langid.sample_sentences(t) for _, t, _ in docs], [x for _, _, x in docs])
    for line in ("*Hinweis*: {}", "**Note** {}", "[12:30] level=info user=7 {}", "# {}", "• {}", "„{}“", "\"{}\""):
        two = m.segments(passage("en", 4) + "\n" + line.format(passage("de", 2)) + "\n" + passage("en", 3))
        assert [(s[2], s[4]) for s in two] == [("en", 4), ("de", 2), ("en", 3)], line
        one = m.segments(passage("en", 4) + "\n" + line.format(passage("de", 1)) + "\n" + passage("en", 3))
        assert [(s[2], s[4]) for s in one] == [("en", 7)], line
    assert langid.sentences("[12:30] level=info\n* \n##") == []


def test_found_languages(spark):
    docs = corpus()
    mixed = [
        (1001, passage("en", 4) + "\n\n" + passage("fr", 2), "en"), (1002, passage("de", 4) + " " + passage("fr", 1) + " " + passage("de", 3), "de"), (1003, passage("de", 3), "fr"),
        (1004, passage("es", 3), None), (1005, passage("es", 3), "??"), (1006, passage("es", 3), "Español"), (1007, passage("en", 3), "en_US"), (1008, None, "en"), (1009, "", None), (1010, "42", None), (1011, passage("de", 3000), "mul"),
    ]
    d = spark.createDataFrame(docs + mixed, "doc_id long, text string, lang string")
    m = langid.train(d)
    got = {(r.doc_id, r.found_lang, r.label_state) for r in langid.find_languages(d.where("doc_id > 1000"), m).collect()}
    assert got == {
        (1001, "en", "mixed"), (1001, "fr", "mixed"), (1002, "de", "right"), (1003, "de", "wrong"), (1004, "es", "missing"), (1005, "es", "missing"), (1006, "es", "right"), (1007, "en", "right"), (1011, "de", "missing"),
    }
    assert langid.find_segments(d.limit(0), m).isEmpty()


def test_alternating_languages_hold_passages_of_both(spark):
    docs = corpus()
    en, fr = (lambda: sentence("en")), (lambda: sentence("fr"))
    alternating = " ".join([en(), fr(), en(), fr(), en(), fr()] + [en() for _ in range(5)])
    apart = " ".join([en(), fr(), en(), en(), en(), fr(), en(), en(), en()])
    d = spark.createDataFrame(docs + [(1001, alternating, "en"), (1002, apart, "en")], "doc_id long, text string, lang string")
    m = langid.train(d)
    assert [s[4] for s in m.segments(alternating)][:6] == [1] * 6
    got = {(r.doc_id, r.found_lang, r.sentences, r.label_state) for r in langid.find_languages(d.where("doc_id > 1000"), m).collect()}
    assert got == {(1001, "en", 8, "mixed"), (1001, "fr", 3, "mixed"), (1002, "en", 7, "right")}


def test_passages():
    s = lambda lang, n, ambiguous=False: (0, 1, lang, 1.0, n, ambiguous)
    assert langid.passages([s("en", 3), s("fr", 1), s("en", 1), s("fr", 1)]) == {"en": 4, "fr": 2}
    assert langid.passages([s("fr", 1), s("en", 2), s("fr", 1), s("de", 1, True), s("fr", 1)]) == {"fr": 2, "en": 2, "de": 0}
    assert langid.passages([]) == {}


def test_sample_takes_sentences_from_the_whole_text():
    t = passage("en", 400)
    got = langid.sample_sentences(t)
    assert len(got) == langid.SAMPLE_SENTENCES and max(t.index(s) for s in got) > len(t) // 2
    assert langid.sample_sentences(None) == [] and langid.sample_sentences("x" * 5000) == []


def test_no_labels_at_all(spark):
    d = spark.createDataFrame([(1, "Some text without any label at all, long enough.", None)], "doc_id long, text string, lang string")
    m = langid.train(d)
    assert langid.find_languages(d, m).isEmpty()


def test_label_codes(spark):
    rows = [("en",), (" EN-gb",), ("deutsch",), ("español",), ("nld",), ("xx",), ("",), (None,), ("pt_BR",), ("und",)]
    got = spark.createDataFrame(rows, "l string").select(langid.label_code(F.col("l"))).collect()
    assert [r[0] for r in got] == ["en", "en", "de", "es", "nl", None, None, None, "pt", None]


def test_rare_languages_are_learned_and_wrong_labels_are_none(spark):
    greek = "Το σπίτι των ανθρώπων είναι κάτω από το νερό. Αυτό είναι το μικρό σπίτι που θα δούμε μετά."
    docs = corpus() + [(2000, greek, "Greek"), (2001, greek[::-1] + ". " + greek, None), (2002, passage("en", 6), "ja"), (2003, passage("fr", 6), "sw")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = langid.train(d)
    assert m.languages == ["de", "el", "en", "es", "fr"]
    got = {(r.doc_id, r.found_lang, r.label_state) for r in langid.find_languages(d.where("doc_id >= 2000"), m).collect()}
    assert got == {(2000, "el", "right"), (2001, "el", "missing"), (2002, "en", "wrong"), (2003, "fr", "wrong")}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGE_CHARS", 900)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda samples, labels, learn: seen.append((samples, labels)))
    langid.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    ((samples, labels),) = seen
    for lang in WORDS:
        assert 300 < sum(len(s) for own, lab in zip(samples, labels, strict=True) if lab == lang for s in own) <= 900


def test_names_of_all_languages(spark):
    rows = ["Greek", "jpn", "ελληνικά", "Swahili", "cat", "ger", "norsk", "zz", "no language"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "l string").select(langid.label_code("l")).collect()]
    assert got == ["el", "ja", "el", "sw", "ca", "de", "no", None, None]


def test_passages_count_unless_ambiguous(spark):
    one = {c: c.upper() + c * 30 + "." for c in "abcd"}
    weights = np.zeros((langid.BUCKETS, 1), np.float32)
    for c, f in {"a": 6.0, "b": -1.8, "c": -4.6, "d": -1.0}.items():  # probabilities 0.998, 0.86, 0.99, 0.73
        weights[langid._grams(one[c])] = f
    m = langid.LanguageModel(["de", "en"], np.array([[1.0], [-1.0]]), weights, np.zeros(1))
    main = " ".join([one["a"]] * 4)
    d = spark.createDataFrame([(1, f"{main}\n{one['b']} {one['c']}", "de"), (2, f"{main}\n{one['d']} {one['d']}", "de")], "doc_id long, text string, lang string")
    assert 0.8 < m.segments(d.first().text)[1][3] < 0.93 and m.segments(d.collect()[1].text)[1][5]
    assert {(r.doc_id, r.found_lang, r.label_state) for r in langid.find_languages(d, m).collect()} == {(1, "de", "mixed"), (1, "en", "mixed"), (2, "de", "right")}


def test_any_two_letter_language_is_learned(spark):
    greek = ["Το σπίτι των ανθρώπων είναι κάτω από το νερό.", "Αυτό είναι το μικρό σπίτι που θα δούμε μετά.", "Οι άνθρωποι και το νερό ήταν εδώ για πολύ."]
    docs = corpus() + [(2000 + i, " ".join(greek[i % 3 :] + greek[: i % 3]), "el" if i else "EL_gr") for i in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = langid.train(d)
    assert m.languages == ["de", "el", "en", "es", "fr"]
    assert {(r.found_lang, r.label_state) for r in langid.find_languages(d.where("doc_id >= 2000"), m).collect()} == {("el", "right")}
