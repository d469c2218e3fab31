"""Languages of documents and their segments, by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.names import trimmed_lower
from pairlight.storage import spread

#: Language codes with the names and three-letter codes under which labels also appear.
NAMES = {
    "cs": "cze ces czech čeština",
    "da": "dan danish dansk",
    "de": "ger deu german deutsch",
    "en": "eng english",
    "es": "spa spanish español espanol castellano",
    "fi": "fin finnish suomi",
    "fr": "fre fra french français francais",
    "hu": "hun hungarian magyar",
    "it": "ita italian italiano",
    "nl": "dut nld dutch nederlands",
    "no": "nor nob norwegian norsk",
    "pl": "pol polish polski",
    "pt": "por portuguese português portugues",
    "ro": "rum ron romanian română",
    "ru": "rus russian русский",
    "sv": "swe swedish svenska",
    "tr": "tur turkish türkçe",
    "uk": "ukr ukrainian українська",
}
#: The two-letter codes of ISO 639-1: each is a language of its own.
CODES = """
aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj
fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky
la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru
rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo
za zh zu
""".split()


@lru_cache(maxsize=1)
def label_names() -> dict[str, str]:
    """Names and three-letter codes of all languages of CODES: those that the JVM knows, and NAMES."""
    out = {name: code for code, names in NAMES.items() for name in names.split()}
    locales = SparkContext._active_spark_context._jvm.java.util.Locale
    for code in CODES:
        one = locales.forLanguageTag(code)
        for name in (one.getISO3Language(), one.getDisplayLanguage(locales.ENGLISH), one.getDisplayLanguage(one)):
            if len(name) > 2:
                out.setdefault(name.lower(), code)
    return out


#: Labelled documents a language is learned from, at most, and sentences of each: the bound of the training sample.
SAMPLE_DOCS = 300
SAMPLE_SENTENCES = 10
#: Sentences of other lengths in characters are not learned from.
LEARNED_LENGTH = (20, 1000)
#: Characters of the sample, at most: of a language, and of all together.
LANGUAGE_CHARS, SAMPLE_CHARS = 400_000, 24_000_000
#: Languages weigh alike in learning, but for those with fewer sentences than this, which weigh by their sentences: so the
#: few texts that a wrong label makes up a language of stay with the language they are in, and are cleaned out.
EVEN_SENTENCES = 50
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: A segment is ambiguous, and no passage beside the main language, where the nearest codeword's probability is under this.
SURE = 0.8
#: Sentences of one step of learning.
BATCH = 1024
#: Texts are classified together up to so many characters.
CHUNK_CHARS = 60_000

#: (start, end, language, confidence, sentences, ambiguous)
Segment = tuple[int, int, str, float, int, bool]

_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
#: Marks at the start of headings, list items and log lines, with the fields of a log line; they are no text of the author.
_MARK = re.compile(r"(?:\s*(?:[#*•]+|\[[^\]]*\](?:\s*[\w.-]+=\S*(?!\S))*))+\s*")
#: Lines that are one quotation.
_QUOTED = re.compile(r"\s*[“„«\"][^”“»\"]*[”“»\"]\s*$")
_LINE = re.compile(r"[\r\n]+")
_LETTERS = re.compile(r"[^\W\d_]{2}")


def label_code(c: str | Column) -> Column:
    """The two-letter code of a label: names, three-letter codes, regions and case folded; null where it names none."""
    pairs = [F.lit(x) for kv in sorted(label_names().items()) for x in kv]
    low = F.regexp_replace(trimmed_lower(c), r"[-_].*$", "")
    return F.when(low.isin(CODES), low).otherwise(F.create_map(*pairs)[low])


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Lines, with those joined that only go on where a sentence was wrapped (the next line starts in lower case)."""
    at = 0
    for m in _LINE.finditer(text):
        following = text[m.end() : m.end() + 20].lstrip(" \t>")
        if following[:1].islower() and m.group() in ("\n", "\r\n") and text[m.start() - 1 : m.start()] not in (".", "!", "?", "…"):
            continue
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def sentences(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, aside) of each sentence with letters; marks at the start of a line are no part of its sentences.

    ``aside`` for headings (also lines of up to four words without an end mark), list items, log lines and quotations of
    one sentence; with more sentences such a line is running text like any other.
    """
    out: list[tuple[int, int, bool]] = []
    if not text:
        return out
    for start, end in _lines(text):
        line = text[start:end]
        short = len(line.split()) <= 4 and not line.rstrip().endswith((".", "!", "?", "…"))
        mark = _MARK.match(line)
        at = mark.end() if mark else 0
        found = []
        for m in [*_END.finditer(line, at), None]:
            stop = m.start() if m else len(line)
            if _LETTERS.search(line, at, stop):
                found.append((start + at, start + stop))
            at = m.end() if m else at
        aside = short or (len(found) < 2 and bool(mark or _QUOTED.match(line)))
        out += [(a, b, aside) for a, b in found]
    return out


#: Which code points of the basic plane are letters; those beyond it are taken as letters.
_IS_LETTER = np.array([chr(c).isalpha() or c == 39 for c in range(0x10000)] + [True])


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, with everything that is no letter or apostrophe as a space."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; places must stay true
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    return np.where(_IS_LETTER[np.minimum(c, 0x10000).astype(np.int64)], c, np.uint64(32))


def _hashed(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, buckets, n) of the n-grams of each order; runs of spaces give no short n-grams."""
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            size = len(c) - n + 1
            if size <= 0:
                return
            h = h[:size] * np.uint64(1_000_003) + c[n - 1 : n - 1 + size] + np.uint64(n)
            if n in ORDERS:
                starts = np.flatnonzero(~((c[:size] == 32) & (c[n - 1 : n - 1 + size] == 32) & (n < 3)))
                mixed = h[starts]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield starts, ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), n


def _grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    return np.concatenate([np.empty(0, np.uint16), *[b.astype(np.uint16) for _, b, _ in _hashed(_codes(text))]])


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1/-1 with large distances: the best of many random codes; columns are neither constant nor equal."""
    if k < 2:
        return np.ones((k, 1))
    bits = max(k, int(np.ceil(3 * np.log2(k))) + 7)
    bits = min(bits, 2 ** (k - 1) - 1)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(400):
        code = np.where(rng.random((k, bits)) < 0.5, -1, 1)
        half = {tuple(col * col[0]) for col in code.T}
        if len(half) < bits or any(len(set(col)) < 2 for col in code.T):
            continue
        apart = min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a))
        if apart > far:
            best, far = code, apart
    if best is None:  # few classes: all distinct columns
        best = np.array([[1 if a == 0 or not (b >> (a - 1)) & 1 else -1 for b in range(1, bits + 1)] for a in range(k)])
    return best.astype(float)


@dataclass
class LanguageModel:
    """Codewords and the binary classifiers that predict their bits; about 2 MB, so it can be broadcast."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bits(self, text: str, spans: list[tuple[int, int, bool]]) -> np.ndarray:
        """What the classifiers say of each span (in order, apart from each other): mean n-gram weights and bias."""
        total = np.zeros((len(spans), self.code.shape[1]))
        count = np.zeros(len(spans))
        # the span of every character, -1 between spans
        lengths = np.array([x for at, (a, b, _) in zip([0, *[b for _, b, _ in spans]], spans, strict=False) for x in (a - at, b - a)])
        owner = np.repeat(np.stack([np.full(len(spans), -1), np.arange(len(spans))], axis=1).ravel().astype(np.int32), lengths)
        for starts, buckets, n in _hashed(_codes(text)):
            starts = starts[: np.searchsorted(starts, len(owner) - n, side="right")]
            own = owner[starts]
            inside = np.flatnonzero((own >= 0) & (own == owner[starts + n - 1]))
            own, buckets = own[inside], buckets[inside]
            if not len(own):
                continue
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(np.take(self.weights, buckets, axis=0, mode="clip"), first, axis=0)
            count += np.bincount(own, minlength=len(spans))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def _decode(self, bits: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: the codeword with the smallest sum of the bits' logistic losses is nearest."""
        loss = np.logaddexp(0.0, -bits[:, None, :] * self.code[None, :, :]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)

    def segments(self, text: str | None) -> list[Segment]:
        return next(self.segments_of([text]))

    def segments_of(self, texts: Iterable[str | None]) -> Iterator[list[Segment]]:
        """(start, end, language, confidence, sentences, ambiguous) for each text: runs of sentences of one language.

        Asides belong to the run around them and do not count as its sentences, unless the text holds nothing else. A
        sentence that is ambiguous by itself takes the language of its neighbours where both sides agree. Texts are
        joined up to CHUNK_CHARS characters, so that many short ones cost one pass over arrays; the joins are no part of
        any span.
        """
        held: list[tuple[list, int]] = []
        joined: list[str] = []
        size = 0

        def flush() -> Iterator[list[Segment]]:
            whole = "\n".join(joined)
            spans = [(a + at, b + at, aside) for body, at in held for a, b, aside in body]
            p = self._decode(self.bits(whole, spans)) if spans else np.zeros((0, len(self.languages)))
            row = 0
            for body, _ in held:
                yield self._runs(body, p[row : row + len(body)])
                row += len(body)

        for text in texts:
            spans = sentences(text) if self.languages else []
            body = [s for s in spans if not s[2]] or spans
            held.append((body, size))
            joined.append(text if isinstance(text, str) and body else "")
            size += len(joined[-1]) + 1
            if size >= CHUNK_CHARS:
                yield from flush()
                held, joined, size = [], [], 0
        yield from flush()

    def _runs(self, body: list[tuple[int, int, bool]], p: np.ndarray) -> list[Segment]:
        if not body:
            return []
        pick = p.argmax(axis=1)
        for i in np.flatnonzero(p.max(axis=1) < SURE):
            near = {int(pick[j]) for j in (i - 1, i + 1) if 0 <= j < len(pick)}
            if len(near) == 1:
                pick[i] = near.pop()
        out = []
        a = 0
        for b in range(1, len(body) + 1):
            if b == len(body) or pick[b] != pick[a]:
                weights = np.array([e - s for s, e, _ in body[a:b]], dtype=float)
                sure = float((p[a:b, pick[a]] * weights).sum() / weights.sum())
                out.append((body[a][0], body[b - 1][1], self.languages[pick[a]], sure, b - a, sure < SURE))
                a = b
        return out


@dataclass
class Sample:
    """Hashed n-grams of the sampled sentences in one array; row i starts at ``starts[i]`` and has ``sizes[i]``."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    y: np.ndarray

    @staticmethod
    def of(grams: list[np.ndarray], y: np.ndarray) -> Sample:
        order = np.random.default_rng(1).permutation(len(grams))
        grams, y = [grams[i] for i in order], y[order]
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint16)
        return Sample(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes, y)

    def learn(self, code: np.ndarray, bit: int, rounds: int) -> np.ndarray:
        """Weights of one bit's classifier, the bias last: logistic regression on mean n-gram weights, by Adagrad over
        batches of sentences in mixed order."""
        target = code[self.y, bit]
        # languages count alike, as labels are unevenly frequent
        even = 1.0 / np.maximum(np.bincount(self.y, minlength=len(code)), EVEN_SENTENCES)[self.y]
        even /= even.mean()
        w, bias, g2 = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
        batches = []
        for a in range(0, len(self.sizes), BATCH):
            b = min(a + BATCH, len(self.sizes))
            first, last = self.starts[a], self.starts[b - 1] + self.sizes[b - 1]
            rows = np.repeat(np.arange(b - a, dtype=np.int32), self.sizes[a:b])
            batches.append((a, b, self.flat[first:last], self.starts[a:b] - first, rows))
        for _ in range(rounds):
            for a, b, flat, starts, rows in batches:
                f = np.add.reduceat(w[flat], starts) / self.sizes[a:b] + bias
                pull = even[a:b] * target[a:b] / (1.0 + np.exp(np.clip(target[a:b] * f, -30, 30)))
                grad = np.bincount(flat, weights=(pull / self.sizes[a:b])[rows], minlength=BUCKETS)
                g2 += grad * grad
                w += 1.5 * grad / np.sqrt(g2)
                bias += 0.05 * pull.mean()
        return np.append(w, bias)


#: Learns all bits of a code: (sample, code, rounds) to weights, one column a bit.
Learner = Callable[[Sample, np.ndarray, int], np.ndarray]


def learn_here(sample: Sample, code: np.ndarray, rounds: int) -> np.ndarray:
    return np.stack([sample.learn(code, bit, rounds) for bit in range(code.shape[1])], axis=1)


def learn_on(spark: SparkSession) -> Learner:
    """The bits are independent problems: one task each. The sample is broadcast: at most SAMPLE_CHARS characters, with two
    bytes for each n-gram order of each, so some 200 MB."""

    def learn(sample: Sample, code: np.ndarray, rounds: int) -> np.ndarray:
        bits = code.shape[1]
        sent = spark.sparkContext.broadcast((sample, code))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own, codes = sent.value
                yield pd.DataFrame({"bit": pdf["id"], "w": [own.learn(codes, int(b), rounds).tobytes() for b in pdf["id"]]})

        rows = spark.range(0, bits, 1, bits).mapInPandas(run, "bit long, w binary").collect()
        return np.stack([np.frombuffer(r.w) for r in sorted(rows, key=lambda r: r.bit)], axis=1)

    return learn


def sample_sentences(text: str | None, n: int = SAMPLE_SENTENCES) -> list[str]:
    """Up to ``n`` sentences out of the whole text: those with the smallest checksums, so they are spread over it."""
    low, high = LEARNED_LENGTH
    found = {text[a:b] for a, b, aside in sentences(text) if not aside and low <= b - a <= high}
    return sorted(found, key=lambda s: (zlib.crc32(s.encode("utf-8", "replace")), s))[:n]


def fit(samples: list[list[str]], labels: list[str], rounds: int = 5, clean: bool = True, learn: Learner = learn_here) -> LanguageModel:
    """Learns the binary classifiers from the sentences of labelled documents.

    Labels may be wrong for some documents: after a first fit, sentences that it gives to another language are left out
    and the classifiers are learned again. A language that keeps no sentence was a wrong label and is no language.
    """
    pieces = [_grams(s) for sample in samples for s in sample]
    names = np.array([lab for sample, lab in zip(samples, labels, strict=True) for _ in sample], dtype=object)
    keep = np.array([len(g) > 0 for g in pieces], dtype=bool)
    languages, model = sorted(set(labels)), None
    for step in range(2 if clean else 1):
        if model is None or languages != model.languages:
            code = codewords(len(languages))
            model = LanguageModel(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]))
        at = np.flatnonzero(keep)
        if not len(at) or len(languages) < 2:
            break
        y = np.array([languages.index(names[i]) for i in at], dtype=int)
        w = learn(Sample.of([pieces[i] for i in at], y), code, rounds)
        model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
        if step == 0 and clean:
            bits = np.stack([model.weights[pieces[i]].sum(axis=0) / len(pieces[i]) + model.bias for i in at])
            keep[at] = model._decode(bits).argmax(axis=1) == y
            languages = sorted(set(names[keep]))
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from at most ``sample_docs`` labelled documents a language: those with the smallest hash of their id.

    The first pass finds each language's largest hash of the sample, from ids and labels alone and per task first (a
    map-side combine), so no language's documents are gathered; the second takes sentences from the sampled documents'
    whole texts. Repeated rows of a document count once. Documents without a usable label or text are left out.
    """
    rows = docs.select(F.xxhash64(doc_id).alias("h"), label_code(label).alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in batches:
            kept = pd.concat([kept, pdf]) if kept is not None else pdf
            kept = kept.drop_duplicates().sort_values("h").groupby("label", sort=False).head(sample_docs)
        if kept is not None:
            yield kept

    hashes = rows.select("label", "h").mapInPandas(smallest, "label string, h long")
    merged = hashes.groupBy("label").applyInPandas(lambda pdf: pdf.drop_duplicates().sort_values("h").head(sample_docs), "label string, h long")
    bounds = merged.groupBy("label").agg(F.max("h").alias("top")).collect()
    if not bounds:
        return fit([], [])
    sampled = F.lit(False)
    for r in bounds:  # one a language
        sampled = sampled | ((F.col("label") == r.label) & (F.col("h") <= r.top))

    @F.pandas_udf("array<string>")
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(sample_sentences)

    limit = min(LANGUAGE_CHARS, SAMPLE_CHARS // len(bounds))

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        """The documents of a language, at most ``sample_docs``, up to the limit of characters."""
        pdf = pdf.sort_values("h")
        chars = pdf["s"].map(lambda s: sum(map(len, s))).cumsum()
        return pdf[chars <= limit]

    one = rows.where(sampled).groupBy("label", "h").agg(F.max("text").alias("text"))
    sample = one.select("label", "h", chosen("text").alias("s")).where("size(s) > 0").groupBy("label").applyInPandas(bounded, "label string, h long, s array<string>")
    found = sample.orderBy("label", "h").collect()
    return fit([list(r.s) for r in found], [r.label for r in found], learn=learn_on(docs.sparkSession))


def find_segments(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, segment, start, end, lang, confidence, sentences, ambiguous``: the language segments of whole texts.

    Texts without letters (null, empty, only numbers or marks) have no segment. Repeated rows give their segments again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(doc_id).dtypes)[doc_id]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *s) for d, found in zip(pdf["doc_id"], sent.value.segments_of(pdf["text"]), strict=True) for i, s in enumerate(found)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "segment", "start", "end", "lang", "confidence", "sentences", "ambiguous"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    return spread(rows).mapInPandas(scan, f"doc_id {kind}, segment int, start int, end int, lang string, confidence double, sentences int, ambiguous boolean")


def passages(segments: list[Segment]) -> dict[str, int]:
    """For each language of a text, the sentences of its longest passage; 0 where all its segments are ambiguous.

    A passage goes on over single sentences in other languages, so texts in which two languages alternate sentence by
    sentence hold a passage of both. Ambiguous segments belong to no passage.
    """
    longest: dict[str, int] = {}
    open_: dict[str, tuple[int, int]] = {}  # sentences so far, number of the sentence after it
    at = 0
    for _, _, lang, _, n, ambiguous in segments:
        longest.setdefault(lang, 0)
        if not ambiguous:
            before, end = open_.get(lang, (0, at))
            so_far = before + n if at - end <= 1 else n
            open_[lang] = (so_far, at + n)
            longest[lang] = max(longest[lang], so_far)
        at += n
    return longest


def find_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", label: str = "lang", passage: int = 2) -> DataFrame:
    """``doc_id, found_lang, main, confidence, chars, sentences, label_state``: every language with a passage in a document.

    A passage holds at least ``passage`` sentences that are not ambiguous, see ``passages``: the language may alternate with
    another sentence by sentence, but two lone sentences far apart are none. The main language, that with the most
    characters, always counts. ``label_state``: ``missing`` (no language named), ``wrong`` (not the main one), ``mixed`` (several found) or
    ``right``; a label is taken as wrong before it is taken as mixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(doc_id).dtypes)[doc_id]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, segments, lab in zip(pdf["doc_id"], sent.value.segments_of(pdf["text"]), pdf["label"], strict=True):
                by: dict[str, list[float]] = {}
                for start, end, lang, sure, _, _ in segments:
                    x = by.setdefault(lang, [0, 0.0])
                    x[0] += end - start
                    x[1] += sure * (end - start)
                if not by:
                    continue
                longest = passages(segments)
                main = max(sorted(by), key=lambda k: by[k][0])
                found = sorted(k for k in by if k == main or longest[k] >= passage)
                state = "missing" if not isinstance(lab, str) else "wrong" if lab != main else "mixed" if len(found) > 1 else "right"
                rows += [(d, k, k == main, by[k][1] / max(1, by[k][0]), int(by[k][0]), longest[k], state) for k in found]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "found_lang", "main", "confidence", "chars", "sentences", "label_state"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label_code(label).alias("label")).where("text is not null and doc_id is not null")
    return spread(rows).mapInPandas(scan, f"doc_id {kind}, found_lang string, main boolean, confidence double, chars int, sentences int, label_state string")
