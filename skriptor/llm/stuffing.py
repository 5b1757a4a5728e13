"""Keyword-stuffed pages and link lists, by mutual information of neighbouring words.

Texts are read as a sequence of words in which links, tags, prices and numbers are
one class each; a line of links without a sentence is read as its links, whatever
their anchor texts, and the number that opens a list item is left out.  Every line
counts, however often it stands there.  Two passes over all texts:

1. Counts of words and of neighbouring pairs in the whole corpus, hashed to
   sketches of a fixed width.  A text adds no more of one pair or word than a
   natural text would (CLIP), so that stuffed pages don't become the norm even
   where a third of all texts are stuffed.
2. For each text the pointwise mutual information of its pairs: its mean, and what
   the pairs bring in that repeat beyond what the corpus makes likely (the
   *collocated* information), each of at most CAP.

In texts whose repetition is rich in function words, lines that repeat are a refrain
and count once.  Word salad from stock phrases repeats its few collocations, and its mean information
lies above the corpus' prose; long books repeat pairs only as often as the corpus does.
Text decoded wrongly is told by its lead characters, foreign writing by its many
different words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.functions import sketch
from skriptor.llm.quality import WORDS
from skriptor.session import cut, prepare

PAIR_BITS, WORD_BITS = 22, 20  # cells of the sketches
PAIR_FLOOR = 2.5e-6  # relative frequency from which a pair counts as known, several times the sketch's mean overcount
LEAST = 5  # and so many occurrences; a pair that one text has so often is known whatever the corpus has
CLIP = (2, 50, 20)  # a text adds at most 2, or one in 50 of its pairs, of one pair; and at most 2, or one in 20, of one word
SLACK = 1.5  # repetitions allowed beyond the expected
CAP = 5.0  # largest information of one pair
ANCHOR = 8  # words that belong to one link at most
CHUNK_CHARS = 1_500_000

# Decision: see found().
WEIGHT, SPREAD, RANGE = 0.25, 2.0, (-0.5, 2.0)  # of the mean information beyond prose; see bound(); what of it counts
STUFFED = 1.0  # score
FUNCTION = 0.1  # with more function words in what repeats, whole lines that repeat are a refrain
RARE, FEW_WORDS = 0.3, 4.0  # with more rare pairs a text must have fewer different words than so many times the root of all
GARBLED = 0.2  # share of lead characters of text decoded wrongly

_RAW = re.compile(r"""(?:https?://|www\.)[^\s<>"')\]]+|\#?[^\W_](?:[\w.'’-]*[^\W_])?(?:/[\w./?=&%-]+)?""")
_TAG = re.compile(r"""<(?:a\s[^<>]*?href\s*=\s*["']([^"'<>]*)["'][^<>]*|/?[a-z!][^<>]*)>""", re.I)
_NUMBER = re.compile(r"[\d.,:/-]+$")
_FILES = "md|txt|docx?|pdf|rtf|odt|epub|fb2|html?|csv|xlsx?|jpe?g|png|gif|svg|webp|mp3|mp4|wav|zip|py|js|json|ya?ml"
_HOST = rf"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?!(?:{_FILES})\b)[a-z]{{2,12}}"
_URL = re.compile(rf"""(?:https?://|www\.)[^\s<>"')\]]+|\b{_HOST}\b(?:/[^\s<>"')\]]*)?""", re.I)
_LINK = re.compile(rf"(?:https?://|www\.)|{_HOST}(?:/|$)")
_ITEM = re.compile(r"\s*\d{1,4}[.)]\s")
_STOP, _TOKEN = re.compile(r"[.!?…]"), re.compile(r"\w+")
LINK, TAG, PRICE, NUMBER = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("\0link", "\0tag", "\0price", "\0number"))
_CURRENCY = frozenset(xxhash.xxh64_intdigest(x) for x in "руб рублей р usd eur gbp uah грн dollars euros $ € ₽ £".split())
DROPPED, PARTICLE = np.uint64(0), np.uint64(1)  # single letters; those that are function words
FUNCTION_WORDS = np.array([xxhash.xxh64_intdigest(w) for w in WORDS if len(w) > 1], np.uint64)
_LEADS = re.compile("[╨╤�]|[ÃÂÐÑРСпя][^\x00-\x7fА-Яа-яЁё]")  # what the first bytes of Cyrillic letters become when they are decoded wrongly
_CODES: dict[str, int] = {}


def _has_sentence(text: str) -> bool:
    """Whether four words or more stand before a sentence's end."""
    for piece in _STOP.split(text)[:-1]:
        words = _TOKEN.findall(piece)
        if len(words) > 3 and len(words[-1]) > 1 and all(w.isalpha() for w in words[-4:]):
            return True
    return False


def _code(raw: str) -> int:
    if len(_CODES) > 2_000_000:
        _CODES.clear()
    if len(raw) == 1 and not raw.isdigit():
        c = PARTICLE if raw.lower() in WORDS else DROPPED
    elif _LINK.match(raw):
        c = LINK
    elif raw[0] == "#":
        c = TAG
    elif _NUMBER.match(raw):
        c = NUMBER
    else:
        c = np.uint64(xxhash.xxh64_intdigest(raw.lower()))
    c = _CODES[raw] = int(c)
    return c


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all texts in order, each one's text number, whether a single-letter
    function word stands before it, and whether its line is the text's first of that kind."""
    again: list[tuple[int, int]] = []
    codes, counts, get, link, number, price = [], [], _CODES.get, int(LINK), int(NUMBER), int(PRICE)
    for t in texts:
        begin = len(codes)
        if t:
            if "<" in t:
                t = _TAG.sub(lambda m: f" {m[1] or ''} ", t)
            seen: set[str] = set()
            for line in t.splitlines():
                old = line in seen
                seen.add(line)
                if line[:8].lstrip()[:1].isdigit() and (m := _ITEM.match(line)):
                    line = line[m.end() :]
                own = [_code(r) if (c := get(r)) is None else c for r in _RAW.findall(line)]
                if link in own and len(own) <= (ANCHOR + 1) * own.count(link) and not _has_sentence(_URL.sub(" ", line)):
                    own = [link] * own.count(link)  # a link beside a sentence is a cited source
                elif number in own and not _CURRENCY.isdisjoint(own):
                    own = [price if c == number and i + 1 < len(own) and own[i + 1] in _CURRENCY else c for i, c in enumerate(own) if not (i and c in _CURRENCY and own[i - 1] == number)]
                if old:
                    again.append((len(codes), len(codes) + len(own)))
                codes += own
        counts.append(len(codes) - begin)
    c = np.array(codes, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = c > PARTICLE
    led = np.zeros(len(c), bool)
    led[1:] = c[:-1] == PARTICLE
    first = np.ones(len(c), bool)
    for a, b in again:
        first[a:b] = False
    return c[keep], doc[keep], led[keep], first[keep]


def _pairs(c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every pair of neighbours and the position of its first word."""
    at = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        return _mix(c[at] * np.uint64(0x9E3779B97F4A7C15) + _mix(c[at + 1])), at


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK_CHARS or i + 1 == len(texts):
            yield ids.slice(begin, i + 1 - begin), texts[begin : i + 1]
            begin, held = i + 1, 0


def _clipped(doc: np.ndarray, h: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (text, value) pairs' values and how often each may count."""
    size = np.bincount(doc) if len(doc) else doc
    order = np.lexsort((h, doc))
    o, p = doc[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(o)))
    return p[first], np.minimum(times, np.maximum(CLIP[0], -(-size[o[first]] // share)))


def corpus_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of pair and word counts over all texts of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch):
                c, doc, *_ = read(texts)
                h, at = _pairs(c, doc)
                for total, bits, (values, n) in ((pairs, PAIR_BITS, _clipped(doc[at], h, CLIP[1])), (words, WORD_BITS, _clipped(doc, c, CLIP[2]))):
                    total += np.bincount(_cell(values, bits), n, minlength=len(total)).astype(np.int64) if len(values) else 0
        for begin, total in ((0, pairs), (1 << PAIR_BITS, words)):
            at = np.flatnonzero(total)
            for i in range(0, len(at), 200_000):
                part = at[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + begin), pa.array(total[part])], ["cell", "n"])

    summed = rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    got = sketch.gather(summed, (1 << PAIR_BITS) + (1 << WORD_BITS)).astype(np.float32)
    return got[: 1 << PAIR_BITS], got[1 << PAIR_BITS :]


def _times(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each pair stands in its own text."""
    order = np.lexsort((h, owner))
    o, p = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(o)))
    out = np.empty(len(o), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _repetition(c: np.ndarray, doc: np.ndarray, led: np.ndarray, k: int, pairs: np.ndarray, words: np.ndarray, np_: float, nw: float) -> list[np.ndarray]:
    """Pairs, their mean information, and repeated, collocated, function and rare of ``collocations`` for k texts."""
    h, at = _pairs(c, doc)
    owner, own = doc[at], _times(doc[at], h)
    n = np.bincount(owner, minlength=k)
    joint = np.maximum(pairs[_cell(h, PAIR_BITS)], 1) / np_
    single = np.log(np.maximum(words[_cell(c, WORD_BITS)], 1) / nw)
    often = joint >= max(PAIR_FLOOR, LEAST / np_)
    # a pair only this text has is judged by its own rate here
    info = np.log(np.where(often, joint, own / np.maximum(n[owner], 1))) - single[at] - single[at + 1]
    known = often | (own >= LEAST)
    worded = (c[at] != NUMBER) & (c[at + 1] != NUMBER)
    excess = worded * known * np.maximum(0, 1 - (1 + SLACK * n[owner] * joint) / own)
    per_text = lambda x: np.bincount(owner, x, minlength=k)
    plain = np.isin(c, FUNCTION_WORDS)
    function = per_text(excess * (0.5 * plain[at] + 0.5 * plain[at + 1] + led[at + 1])) / np.maximum(per_text(excess * (1.0 + led[at + 1])), 1e-9)
    n_often, some = per_text(often), np.maximum(n, 1)
    return [n, per_text(info * often) / np.maximum(n_often, 1), per_text(excess) / some, per_text(excess * np.clip(info, 0, CAP)) / some, function, 1 - n_often / some]


def _describe(texts: list[str | None], *counts) -> list[np.ndarray]:
    k = len(texts)
    c, doc, led, first = read(texts)
    measured = _repetition(c, doc, led, k, *counts)
    refrain = (np.bincount(doc, ~first, minlength=k) > 0) & (measured[4] > FUNCTION)
    if refrain.any():  # lines that repeat count once
        part = first & refrain[doc]
        for whole, once in zip(measured, _repetition(c[part], doc[part], led[part], k, *counts)):
            whole[refrain] = once[refrain]
    n_words = np.bincount(doc, minlength=k)
    order = np.lexsort((c, doc))
    o, w = doc[order], c[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    garbled = np.array([len(_LEADS.findall(t)) / max(1, len(t) - t.count(" ")) if t else 0.0 for t in texts])
    share = lambda code: np.bincount(doc, c == code, minlength=k) / np.maximum(n_words, 1)
    return [n_words, *measured, share(LINK), share(TAG), np.bincount(o[new], minlength=k), garbled]


SCHEMA = "words bigint, pairs bigint, information double, repeated double, collocated double, function double, rare double, links double, tags double, kinds bigint, garbled double"
TYPES = [np.int64 if x.endswith("bigint") else float for x in SCHEMA.split(", ")[2:]]


def collocations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, pairs, information, repeated, collocated, function, rare, links, tags, kinds, garbled) of every row.

    ``information`` is the mean over the pairs the corpus knows, ``rare`` the share of
    the others; ``repeated`` is the share of pairs beyond what is likely, ``collocated``
    the information they bring in per pair of the text and ``function`` the share of
    function words among them.  ``kinds`` counts the different words, ``garbled`` is the
    share of lead characters.

    Null, empty and blank texts have 0 words and zeros; rows that repeat come out
    as often as they come in, and count as often in the corpus.
    """
    spark = prepare(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    pairs, words = corpus_counts(rows)
    shared = spark.sparkContext.broadcast((pairs, words, float(max(pairs.sum(dtype=np.float64), 1)), float(max(words.sum(dtype=np.float64), 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                n_words, n, *rest = _describe(texts, *shared.value)
                arrays = [ids, pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), *(pa.array(x.astype(t)) for x, t in zip(rest, TYPES))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", *(x.split()[0] for x in SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"key {id_type}, {SCHEMA}").withColumnRenamed("key", id_col)


def bound(scores: DataFrame) -> float:
    """Mean information above that of prose: the 30 % point of the texts' means plus SPREAD times its
    distance from the 5 % point, so that it holds for a corpus with a third of its texts stuffed."""
    q = scores.where("pairs >= 20 and rare <= 0.2").agg(F.percentile_approx("information", [0.05, 0.3], 10_000).alias("q")).first()["q"]
    return q[1] + SPREAD * max(q[1] - q[0], 0.05) if q else 4.0


def found(scores: DataFrame) -> DataFrame:
    """The rows of ``collocations`` that are stuffed pages, with their score and the kind of what they repeat.

    The score is the collocated information, less that of function words, plus WEIGHT
    times the mean information beyond prose, as far as the pairs are known.  A text
    without a repeated collocation is no case, whatever its mean.
    """
    scores = cut(scores)
    mean = F.greatest(F.least(F.col("information") - bound(scores), F.lit(RANGE[1])), F.lit(RANGE[0])) * (1 - F.col("rare"))
    score = F.col("collocated") * (1 - F.col("function")) + WEIGHT * mean
    readable = (F.col("garbled") < GARBLED) & ((F.col("rare") <= RARE) | (F.col("kinds") <= FEW_WORDS * F.sqrt("words")))
    reason = F.when(F.col("links") > F.greatest("tags", F.lit(0.5)), "links").when(F.col("tags") > 0.5, "tags").otherwise("collocations")
    return scores.withColumn("score", score).withColumn("reason", reason).where((F.col("repeated") > 0) & readable & (F.col("score") >= STUFFED))
