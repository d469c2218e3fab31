"""Passages of evaluation items in training documents."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.storage import materialize, spread

#: Words of an index n-gram. Of 14 words with two changed, the 12 others stand in at most three runs: one has four or more.
SEED_WORDS = 4
#: A run of so many words found in two or more items is wording that they share.
SHARED_WORDS = 8
MIN_WORDS = 14
#: At most one word in so many may be changed.
CHANGED_IN = 7
#: Items go out by broadcast in blocks of about so many words (some 100 MB as a Python index). With more than one block a
#: first scan picks the documents that any item may be in, and only those are searched block by block.
BLOCK_WORDS = 400_000
#: Largest size of the bit map of item n-grams that picks those documents, as a power of two of bits: 128 MB.
MAP_BITS = 30

_WORD = re.compile(r"\w+")
#: Numbers of lines, as in a listing.
_LINE_NUMBER = re.compile(r"^[ \t>]*\d{1,4}[:.)|](?=[ \t])", re.M)
#: Tags of any length. What stands between their attributes' values is short: else a "<" of running text ("a <b") would
#: take everything up to a far ">" with it.
_TAG = r"""<[/!]?[A-Za-z](?:[^<>]{0,500}|(?:[^<>"'=]{0,500}=(?:\s*"[^"<>]*"|\s*'[^'<>]*'|[^\s<>"']+))++[^<>"'=]{0,500})>"""
#: Tags, comments, character references and numbers of lines.
_MARKUP = re.compile(_TAG + r"|<!--.*?-->|&#?\w{1,10};|" + f"(?m:{_LINE_NUMBER.pattern})", re.S)


def words_of(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text and their places in it.

    Markup tags, numbers of lines and zero-width or other format characters are dropped, references resolved, compatibility
    characters (ligatures, full-width letters, odd spaces) and case folded; words are runs of letters and digits, with
    underscores, punctuation and accents' encoding ignored.
    """
    if not text:
        return [], []
    chars: list[str] = []
    places: list[int] = []
    plain = text.isascii()
    at = 0
    for m in _MARKUP.finditer(text):
        _fold(text, at, m.start(), plain, chars, places)
        found = m.group()
        value = html.unescape(found) if found[0] == "&" else " "
        if found[0] == "&" and value == found:
            value = "&"
        for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value).lower()):
            if unicodedata.category(ch) not in ("Cf", "Mn"):
                chars.append(ch)
                places.append(m.start())
        at = m.end()
    _fold(text, at, len(text), plain, chars, places)
    folded = "".join(chars)
    words, spans = [], []
    places.append(len(text))
    for m in _WORD.finditer(folded.replace("_", " ")):
        words.append(m.group())
        spans.append((places[m.start()], places[m.end() - 1] + 1))
    return words, spans


_DROPPED = re.compile("[\u0300-\u036f\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def quick_words(text: str | None) -> list[str]:
    """The words of ``words_of`` without their places; only to tell which texts need a closer look."""
    if not text:
        return []
    if "<" in text or "&" in text:
        return words_of(text)[0]
    text = _LINE_NUMBER.sub(" ", text)
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower()))
        if not text.isascii() and any(unicodedata.category(c) in ("Mn", "Cf") for c in set(text) if not c.isascii()):
            return words_of(text)[0]
    return _WORD.findall(text.lower().replace("_", " "))


def _fold(text: str, start: int, end: int, plain: bool, chars: list[str], places: list[int]) -> None:
    if start >= end:
        return
    piece = text[start:end]
    if plain or piece.isascii():
        chars.extend(piece.lower())
        places.extend(range(start, end))
        return
    for i, ch in enumerate(piece, start):
        if ch.isascii():
            chars.append(ch.lower())
            places.append(i)
        elif unicodedata.category(ch) not in ("Cf", "Mn"):
            # accents are dropped on both sides, so composed and decomposed letters are the same
            for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", ch).lower()):
                if unicodedata.category(x) != "Mn":
                    chars.append(x)
                    places.append(i)


#: Up to so many cells an alignment keeps all its scores; a larger one keeps some rows and computes the others again.
CELLS = 4_000_000


def _score_rows(d: np.ndarray, q: np.ndarray, gain: int, row: np.ndarray, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows ``start`` + 1 to ``stop`` of the scores, from row ``start`` on."""
    steps = np.arange(len(d) + 1)
    for i in range(start, stop):
        diagonal = row[:-1] + np.where(d == q[i], gain, -1)
        best = np.maximum(np.maximum(diagonal, row[1:] - 1), 0)
        # a gap in the item: carried along the row with cost 1 a word
        row = np.maximum(np.maximum.accumulate(np.concatenate([[0], best]) + steps) - steps, 0).astype(np.int32)
        yield row


def _align(doc: list[str], item: list[str], gain: int) -> list[tuple[int, int]]:
    """The best local alignment of ``item`` with ``doc``, a match worth ``gain`` and a change -1, as pairs (place in doc
    or -1, place in item or -1). With a gain of 1 it keeps to dense stretches, with a large one it crosses changes that
    follow each other. Memory grows with the document's window times the root of the item's length."""
    n, m = len(doc), len(item)
    ids: dict[str, int] = {}
    d = np.array([ids.setdefault(w, len(ids)) for w in doc], dtype=np.int32)
    q = np.array([ids.setdefault(w, len(ids)) for w in item], dtype=np.int32)
    every = m + 1 if (m + 1) * (n + 1) <= CELLS else int(np.sqrt(m)) + 1
    kept = {0: np.zeros(n + 1, dtype=np.int32)}  # every so many rows one to start again from
    top, i, j = 0, 0, 0
    block = [kept[0]]
    for k, row in enumerate(_score_rows(d, q, gain, kept[0], 0, m), 1):
        if k % every == 0:
            kept[k] = row
        if every > m:
            block.append(row)
        at = int(row.argmax())
        if row[at] > top:
            top, i, j = int(row[at]), k, at
    path: list[tuple[int, int]] = []
    first = 0 if every > m else m + 1  # the row that the block at hand starts with
    while i and j:
        if i - 1 < first:
            first = (i - 1) // every * every
            block = [kept[first], *_score_rows(d, q, gain, kept[first], first, i)]
        here, above = block[i - first], block[i - 1 - first]
        s = here[j]
        if s <= 0:
            break
        if s == above[j - 1] + (gain if d[j - 1] == q[i - 1] else -1):
            i, j = i - 1, j - 1
            path.append((j, i))
        elif s == above[j] - 1:
            i -= 1
            path.append((-1, i))
        else:
            j -= 1
            path.append((j, -1))
    return path[::-1]


def _stretch(path: list[tuple[int, int]], doc: list[str], item: list[str], counts: np.ndarray, changed_in: int) -> tuple[int, int, int, int] | None:
    """(item words, changes, first, last place in doc) of the longest stretch of a path with one change in ``changed_in``
    at most, from a kept word to a kept word.

    Only words that ``counts`` marks as the item's own count as item words; matches of shared wording neither count nor cost.
    """
    same = np.array([i >= 0 and j >= 0 and doc[j] == item[i] for j, i in path], dtype=bool)
    if not same.any():
        return None
    mine = np.array([i >= 0 and bool(counts[i]) for _, i in path], dtype=np.int64)
    # own words pay for changes: words - changed_in * changes must not be negative
    gain = np.concatenate([[0], np.cumsum(mine - changed_in * ~same)])
    own = np.concatenate([[0], np.cumsum(mine)])
    least = np.iinfo(np.int64).min
    # the last kept word whose balance is no lower than that before the first one: the greatest balance from a place on falls
    ahead = np.maximum.accumulate(np.where(np.concatenate([[False], same]), gain, least)[::-1])[::-1]
    starts = np.flatnonzero(same)
    ends = len(path) - np.searchsorted(ahead[::-1], gain[starts])
    words = np.where(ends > starts, own[ends] - own[starts], -1)
    at = int(words.argmax())
    if words[at] < 0:
        return None
    a, b = int(starts[at]), int(ends[at])
    places = [j for j, _ in path[a:b] if j >= 0]
    return int(words[at]), int((~same[a:b]).sum()), places[0], places[-1]


def own_places(length: int, sharing: list[tuple[int, int]], shared_words: int = SHARED_WORDS) -> np.ndarray:
    """Which of an item's words are its own. ``sharing``: (place, texts that share a run through it), absent where none.

    Shared wording is ``shared_words`` words in a row that about as many texts share (within a factor of two). So an
    opening that half of all items have does not take along the two or three words after it that some of them happen to
    go on with: by themselves those are too short to be shared wording.
    """
    texts = np.ones(length)
    for place, n in sharing:
        texts[place] = n
    own = np.ones(length, dtype=bool)
    for a in range(length - shared_words + 1):
        window = texts[a : a + shared_words]
        if window.min() > 1 and window.max() <= 2 * window.min():
            own[a : a + shared_words] = False
    return own


def least_grams(n: int, min_words: int, changed_in: int) -> int:
    """q-gram lemma: w words with e changes share at least w - n + 1 - e n grams with the item."""
    return max(1, min_words - n + 1 - n * (min_words // changed_in))


def gram_codes(words: list[str], n: int = SEED_WORDS) -> np.ndarray:
    """One 64-bit code for each run of ``n`` words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    code = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(words) - n + 1 + k]
    return code


class ItemIndex:
    """The items' n-grams as a hash map, with each item's words and which of them are its own."""

    def __init__(self, items: list[tuple[int, list[str], list[tuple[int, int]]]], seed_words: int = SEED_WORDS) -> None:
        self.seed_words = seed_words
        self.items = {i: (words, own_places(len(words), sharing)) for i, words, sharing in items}
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, (words, own) in self.items.items():
            for k in range(len(words) - seed_words + 1):
                if own[k : k + seed_words].any():
                    self.grams[tuple(words[k : k + seed_words])].append((i, k))
        self.grams = dict(self.grams)

    def find(self, text: str | None, min_words: int = MIN_WORDS, changed_in: int = CHANGED_IN) -> list[tuple[int, int, int, int, int]]:
        """(item, item words, changes, start, end in the text) of the items' passages in a text; one for each place."""
        n = self.seed_words
        needed = least_grams(n, min_words, changed_in)
        quick = quick_words(text)
        if sum(map(self.grams.__contains__, zip(*[quick[k:] for k in range(n)], strict=False))) < needed:
            return []
        words, spans = words_of(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        grams = self.grams
        for j, gram in enumerate(zip(*[words[k:] for k in range(n)], strict=False)):
            for i, k in grams.get(gram, ()):
                hits[i].append((j, k))
        changes = min_words // changed_in
        found = []
        for i, places in hits.items():
            if len(places) < needed:
                continue
            item, own = self.items[i]
            shared = np.concatenate([[0], np.cumsum(~own)])
            # A stretch with one change in changed_in has one of min_words words with no more than `changes`: its hits lie
            # close together and on diagonals close by. Shared words between two hits are no distance.
            near = [(j, j - k, j - int(shared[k])) for j, k in sorted(places)]
            dense = []
            for x, (j, diagonal, own_j) in enumerate(near):
                close = 0
                for y in range(x, len(near)):
                    j2, diagonal2, own_j2 = near[y]
                    if close >= needed or j2 - j > min_words + changes + len(item):
                        break
                    close += abs(diagonal2 - diagonal) <= changes and own_j2 - own_j <= min_words + changes - n
                if close >= needed:
                    dense.append((j, diagonal))
            slack = len(item) // changed_in + n + 1
            # places whose windows touch are verified together; a window holds every stretch through its hits
            windows: list[list[int]] = []
            for _, diagonal in sorted(dense, key=lambda d: d[1]):
                lo, hi = max(0, diagonal - slack), min(len(words), diagonal + len(item) + slack)
                if windows and lo <= windows[-1][1] and hi - windows[-1][0] <= 6 * len(item) + 400:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                stack = [(lo, hi)]
                while stack:
                    a, b = stack.pop()
                    # what lies beside a passage may hold the item again, but only where hits are dense
                    if not any(a <= j < b for j, _ in dense):
                        continue
                    path = _align(words[a:b], item, 1)
                    if not path:
                        continue
                    got = _stretch(path, words[a:b], item, own, changed_in)
                    first, last = a + min(j for j, _ in path if j >= 0), a + max(j for j, _ in path if j >= 0)
                    if got is None or got[0] < min_words:
                        wide = _stretch(_align(words[a:b], item, changed_in), words[a:b], item, own, changed_in)
                        if wide and wide[0] >= min_words:
                            got, first, last = wide, a + wide[2], a + wide[3]
                    if got and got[0] >= min_words:
                        found.append((i, got[0], got[1], spans[a + got[2]][0], spans[a + got[3]][1]))
                    stack += [(a, first), (last + 1, b)]
        return sorted(set(found), key=lambda x: (x[3], x[0]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def normal_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: words_of(t)[0])


def item_words(items: DataFrame, item_id: str, text: str, shared_words: int = SHARED_WORDS) -> DataFrame:
    """``item_id, words, sharing``: normalised words, and for each place in a run of ``shared_words`` words that other
    items have too the number of texts that share it (the most of the runs through it).

    Repeated rows of an item count once; items with equal text count as one item for sharing, else a text that is listed
    twice would have no words of its own. Null ids and empty texts are left out.
    """
    base = items.select(F.col(item_id).alias("item_id"), normal_words(text).alias("words")).where("item_id is not null and size(words) > 0")
    base = base.groupBy("item_id").agg(F.max("words").alias("words"))
    grams = base.where(F.size("words") >= shared_words).select(
        "item_id", F.xxhash64("words").alias("text_key"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - shared_words + 1), lambda k: F.array_join(F.slice("words", k, shared_words), " "))).alias("at", "gram")
    )
    shared = grams.groupBy("gram").agg(F.countDistinct("text_key").alias("texts")).where("texts > 1")
    places = grams.join(shared, "gram").select("item_id", "texts", F.explode(F.sequence("at", F.col("at") + shared_words - 1)).alias("place"))
    most = places.groupBy("item_id", "place").agg(F.max("texts").alias("texts"))
    listed = most.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", "texts"))).alias("sharing"))
    return base.join(listed, "item_id", "left")


_INDEXES: dict[str, ItemIndex] = {}


def _cached_index(key: str, listed: Broadcast) -> ItemIndex:
    """The index of a block, built once a worker process and not once a task; only the last one is kept."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(listed.value)
    return _INDEXES[key]


def _blocks(words: DataFrame) -> list[Broadcast]:
    """The items in broadcasts of about BLOCK_WORDS words each."""
    spark = words.sparkSession
    n = max(1, -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS))
    out = []
    for block in range(n):
        part = words if n == 1 else words.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block)
        out.append(spark.sparkContext.broadcast([(r.item_id, r.words, [tuple(x) for x in r.sharing or ()]) for r in part.collect()]))
    return out


def gram_map(words: DataFrame) -> np.ndarray:
    """A bit map, 64 bits an entry, of the codes of all items' n-grams; some 16 bits an n-gram, at most 2 ** MAP_BITS.

    A code beyond that size shares its bit with others: more documents are then looked at, none is missed.
    """
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = min(MAP_BITS, max(10, int(total).bit_length() + 4))

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = np.concatenate([np.empty(0, np.uint64), *[gram_codes(list(w)) for w in pdf["words"]]]) >> np.uint64(64 - bits)
            own = np.unique(own)
            yield pd.DataFrame({"entry": (own >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (own & np.uint64(63))).view(np.int64)})

    rows = words.select("words").mapInPandas(codes, "entry long, bit long").groupBy("entry").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["entry"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def possible_documents(rows: DataFrame, words: DataFrame, min_words: int, changed_in: int) -> DataFrame:
    """``rows`` (``doc_id, text``) that may hold a passage of any item, written to the shared folder: one scan of the corpus
    with one bit map, however many items there are."""
    sent = words.sparkSession.sparkContext.broadcast(gram_map(words))
    needed = least_grams(SEED_WORDS, min_words, changed_in)

    def hits(text: str | None) -> int:
        own = sent.value
        code = gram_codes(quick_words(text)) >> np.uint64(64 - 6 - (len(own).bit_length() - 1))
        return int(((own[code >> np.uint64(6)] >> (code & np.uint64(63))) & np.uint64(1)).sum())

    @F.pandas_udf("boolean")
    def possible(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hits(t) >= needed)

    return materialize(rows.where(possible("text")))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, changed_in: int = CHANGED_IN) -> DataFrame:
    """``doc_id, item_id, words, changes, start, end``: each passage of an item in a document.

    The items' n-grams are broadcast as a hash map and every document's token windows are looked up in it, in one scan
    without a shuffle; each candidate place is verified by an alignment. Items beyond ``BLOCK_WORDS`` words go out in
    several blocks, so a broadcast has a fixed bound; the corpus is then still scanned once, see ``possible_documents``.
    A passage has at least ``min_words`` words of the item's own, at most one word in ``changed_in`` replaced, dropped or
    put in. Null and empty texts have no passages; repeated rows of a document give their passages once a row.
    """
    words = materialize(item_words(items, item_id, item_text))
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    item_kind = dict(words.dtypes)["item_id"]
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null"))
    blocks = _blocks(words)
    if len(blocks) > 1:
        rows = possible_documents(rows, words, min_words, changed_in)
    out = None
    for listed in blocks:

        def scan(batches: Iterator[pd.DataFrame], listed=listed, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            index = _cached_index(key, listed)
            for pdf in batches:
                hits = [(d, *f) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for f in index.find(t, min_words, changed_in)]
                if hits:
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id", "words", "changes", "start", "end"])

        found = rows.mapInPandas(scan, f"doc_id {kind}, item_id {item_kind}, words int, changes int, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if text is None or not spans:
        return text
    kept, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            kept.append(text[at:start])
        at = max(at, end)
    return "".join([*kept, text[at:]])


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, changed_in: int = CHANGED_IN) -> DataFrame:
    """``docs`` with the passages of items cut out of their texts; other columns and other documents are unchanged.

    Passages are found and cut in one scan of the texts, nothing is shuffled, and columns beside the text do not leave the
    JVM. Items of more than one block (see ``find_leaks``) are found first and then cut by a join. Null texts stay null.
    """
    words = materialize(item_words(items, item_id, item_text))
    listed = _blocks(words)
    if len(listed) > 1:
        return without_leaks(docs, find_leaks(docs, items, doc_id, text, item_id, item_text, min_words, changed_in), doc_id, text)
    sent, key = listed[0], uuid.uuid4().hex

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _cached_index(key, sent)
        for texts in batches:
            yield pd.Series([_without(t, [f[3:] for f in index.find(t, min_words, changed_in)]) for t in texts], dtype=object)

    return spread(docs).withColumn(text, cut(F.col(f"`{text}`"))).select(*[f"`{c}`" for c in docs.columns])


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` without the found passages (``whole``: without the documents that hold any); other documents unchanged."""
    if whole:
        return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
    spans = leaks.groupBy(F.col("doc_id").alias(doc_id)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans, strict=True)
        return pd.Series([_without(t, [(x["start"], x["end"]) for x in s] if s is not None else []) for t, s in pairs], dtype=object)

    joined = docs.join(spans, doc_id, "left")
    return joined.withColumn(text, cut(F.col(text), F.col("_spans"))).select(*docs.columns)
