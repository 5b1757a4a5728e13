"""Near-duplicate records: an inverted join on signature coordinates, then exact Jaccard.

Every text is a set of word shingles; a signature holds, for each of k hash
functions, the smallest hash in the set, so two sets agree in a coordinate with
a probability equal to their Jaccard similarity J.  Texts are posted under
(coordinate, value) pairs.  A pair that agrees in at least t of k coordinates
must share a posting among each side's k - t + 1 first ones under any order
common to all texts; the order used is rarest value first, so that a value many
texts share (boilerplate) is posted only where a text has nothing rarer.  Lists
of one text are skipped by the join, as are pairs whose set sizes already rule
the threshold out.  Pairs with t agreements are verified on their full sets.

k and t follow from the threshold: a pair exactly at it misses t agreements with a
probability of at most MISSED, one above it with less (threshold 0.7: k = 24, t = 8,
2e-5; a pair with J = 0.8 then 1e-8).  Lists that many texts share even so, such as
those of a cluster of near copies, are split into blocks and joined block by block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.functions import bloom, sketch
from skriptor.session import cut, prepare

MISSED = 1e-4  # largest probability of missing a pair at the threshold
COORDINATES = (24, 32, 48, 64, 96, 128)  # numbers of coordinates tried, for at least LEAST agreements
LEAST = 4
SKETCH_BITS = (17, 22)  # cells of the frequency sketch that orders postings: a sixteenth of the postings, within these bounds
LIST_BLOCK = 4000  # postings of one list that are joined in one piece
CLASS_BLOCK = 256  # members of a class of copies handled by one task row
CHUNK_CHARS = 4_000_000

_WORD = re.compile("[А-ЯЁа-яёA-Za-z]+")
_CODES: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout(threshold: float) -> tuple[int, int]:
    """The numbers of coordinates and of agreements for a threshold."""
    for k in COORDINATES:
        missed, t = 0.0, 0
        while t < k and missed + math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t) <= MISSED:
            missed += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
            t += 1
        if t >= LEAST:
            return k, t
    raise ValueError(f"a threshold of {threshold} is too low for {COORDINATES[-1]} coordinates")


def _code(word: str) -> int:
    if len(_CODES) > 2_000_000:
        _CODES.clear()
    c = _CODES[word] = xxhash.xxh64_intdigest(word.lower().replace("ё", "е"))
    return c


def shingle_sets(texts: list[str | None], width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, where each text's begin, and their number.

    A text that is null or has fewer than ``min_words`` words has none.
    """
    hashes, counts, get = [], [], _CODES.get
    for t in texts:
        words = _WORD.findall(t) if t else []
        if len(words) < max(min_words, width):
            words = []
        for w in words:
            hashes.append(get(w) or _code(w))
        counts.append(len(words))
    h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            s = s * np.uint64(0x9E3779B97F4A7C15) + _mix(h[i : i + len(s)])
    s, doc, same = _mix(s), doc[: len(s)], doc[: len(s)] == doc[width - 1 :]
    s, doc = s[same], doc[same]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    size = np.bincount(doc, minlength=len(n)).astype(np.int64)
    return s, np.cumsum(size) - size, size


def signatures(s: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """k x texts array of 32-bit coordinate values; all texts given must have shingles."""
    rng = np.random.RandomState(20240229)
    a = rng.randint(1, 1 << 62, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.randint(1, 1 << 62, k, dtype=np.int64).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat((s * x + y) >> np.uint64(32), begin) for x, y in zip(a, b)]).astype(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK_CHARS or i + 1 == len(texts):
            yield ids.slice(begin, i + 1 - begin), texts[begin : i + 1]
            begin, held = i + 1, 0


def _described(df: DataFrame, width: int, min_words: int, k: int) -> DataFrame:
    """(id, c1, c2, n, sig, short) of every row that has shingles; c1, c2 name the set, short has the
    last byte of each coordinate, eight in a number: pairs that agree in t coordinates also do in t bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                s, begin, size = shingle_sets(texts, width, min_words)
                keep = np.flatnonzero(size)
                if not len(keep):
                    continue
                begin, size = begin[keep], size[keep]
                with np.errstate(over="ignore"):
                    c1 = np.add.reduceat(_mix(s + np.uint64(1)), begin).view(np.int64)
                    c2 = np.add.reduceat(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)), begin).view(np.int64)
                sig = signatures(s, begin, size, k).T
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keep) + 1) * k, pa.int32()), pa.array(sig.reshape(-1).astype(np.uint32).view(np.int32), pa.int32())
                )
                packed = np.ascontiguousarray(sig.astype(np.uint8)).reshape(-1).view(np.int64)
                short = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * (k // 8), pa.int32()), pa.array(packed, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep)), pa.array(c1), pa.array(c2), pa.array(size.astype(np.int32)), lists, short], ["id", "c1", "c2", "n", "sig", "short"]
                )

    return df.mapInArrow(run, "id bigint, c1 bigint, c2 bigint, n int, sig array<int>, short array<bigint>")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(coordinate, value) pairs as one whole number each."""
    return (np.arange(sig.shape[1], dtype=np.int64) << 32) + sig.astype(np.int64).astype(np.uint32)


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(tokens.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def _frequencies(known: DataFrame, k: int) -> np.ndarray:
    """Posting counts by sketch cell over all texts, in at most 2^22 cells."""
    n = max(1, known.count() * k // 16)
    bits = min(max(n.bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_cells(_tokens(_matrix(batch.column(0), k)), bits).reshape(-1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return sketch.gather(known.select("sig").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), 1 << bits)


def _postings(known: DataFrame, reps: DataFrame, k: int, t: int, list_block: int) -> DataFrame:
    """(token, id, n) of the k - t + 1 rarest coordinates of each representative; equal tokens of
    different coordinates are a matter of chance and only add candidates.

    A list of more than ``list_block`` postings by the sketch has several blocks: a text is in one of them as
    the right side (2) and in all as the left one (1), so that two texts meet in one block; else it is both (3).
    """
    shared = reps.sparkSession.sparkContext.broadcast(_frequencies(known, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts = k - t + 1, shared.value
        bits, usual = len(counts).bit_length() - 1, counts.mean()
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(_matrix(batch.column(2), k))
            rank = np.minimum(counts[_cells(tokens, bits)], (1 << 23) - 1) << 40 | tokens  # a token has 32 bits and its coordinate
            rank.sort(axis=1)
            first = rank[:, :keep].reshape(-1)
            blocks = 1 + np.maximum((first >> 40) - usual, 0).astype(np.int64) // list_block
            token = (_mix((first & ((1 << 40) - 1)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids, n = np.repeat(batch.column(0).to_numpy(), keep), np.repeat(batch.column(1).to_numpy(), keep)
            hot = np.flatnonzero(blocks > 1)
            times = np.where(blocks > 1, blocks, 1)
            row = np.repeat(np.arange(len(token)), times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            side = np.where(blocks[row] > 1, 1, 3)
            own = (_mix(ids[hot].astype(np.uint64)) % blocks[hot].astype(np.uint64)).astype(np.int64)
            row, block, side = np.concatenate([row, hot]), np.concatenate([block, own]), np.concatenate([side, np.full(len(hot), 2)])
            place = (token[row].astype(np.int64) << 16) + block
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids[row]), pa.array((n[row] * 4 + side).astype(np.int64))], ["token", "id", "n"])

    return reps.select("id", "d.n", "d.sig").mapInArrow(run, "token bigint, id bigint, n bigint")


def _sets_of(df: DataFrame, ids: DataFrame, width: int, min_words: int) -> DataFrame:
    """(id, s array<bigint>) of the rows whose id may be among ``ids``."""
    known = bloom.build(ids, ["id"])
    shared = df.sparkSession.sparkContext.broadcast(known.words)
    probes = [p.alias(f"b{i}") for i, p in enumerate(bloom.positions([F.col("id")], known))]
    held = len(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.flatnonzero(bloom.hits(shared.value, [batch.column(i).to_numpy() for i in range(2, 2 + held)]))
            if not len(maybe):
                continue
            for ids_, texts in _pieces(batch.select([0, 1]).take(pa.array(maybe))):
                s, begin, size = shingle_sets(texts, width, min_words)
                edges = np.concatenate([begin, [len(s)]]) if len(begin) else np.zeros(1)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids_, lists], ["id", "s"])

    return df.select("id", "text", *probes).mapInArrow(run, "id bigint, s array<bigint>")


def _unequal_bytes(x: Column) -> Column:
    """How many bytes of a number aren't zero."""
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return F.bit_count(x)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    min_words: int = 15,
    coordinates: int | None = None,
    matches: int | None = None,
    list_block: int = LIST_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): class membership of every text and links between classes.

    members: id, rep, n_shingles; texts with equal shingle sets form a class named by its
    smallest id.  links: a, b (representatives, a < b), common, jaccard; all
    pairs of different sets with an exact Jaccard similarity of ``threshold`` or more.
    Words are runs of Russian and English letters, lower-case, ё as е.  Null ids,
    null texts and texts of fewer than ``min_words`` words take no part; rows that
    repeat an id count once; empty tables give empty results.
    """
    spark = prepare(df.sparkSession)
    own = layout(threshold) if coordinates is None or matches is None else (coordinates, matches)
    coordinates, matches = own[0] if coordinates is None else coordinates, own[1] if matches is None else matches
    limit = Fraction(str(threshold))
    num, den = limit.numerator, limit.denominator
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    known = cut(_described(rows, width, min_words, coordinates))
    named = known.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    members = known.select("id", "c1", "c2", "n").distinct().join(named, ["c1", "c2"]).select("id", "rep", F.col("n").alias("n_shingles"))
    # one shuffle by id serves the postings and both signature look-ups
    first = known.groupBy("id").agg(F.first(F.struct("n", "sig", "short")).alias("d"))
    reps = first.join(named.select(F.col("rep").alias("id")), "id")

    posted = _postings(known, reps, coordinates, matches, list_block)
    x, y = posted.alias("x"), posted.alias("y")
    size = lambda side: F.shiftright(f"{side}.n", 2)
    role = lambda side: F.col(f"{side}.n").bitwiseAND(3)
    smaller, larger = F.least(size("x"), size("y")), F.greatest(size("x"), size("y"))
    # texts of one list are put in order; where it has blocks, the left one meets each right one once
    placed = F.when(role("x") == 3, F.col("x.id") < F.col("y.id")).otherwise((role("x") == 1) & (role("y") == 2) & (F.col("x.id") != F.col("y.id")))
    hits = x.join(y, (F.col("x.token") == F.col("y.token")) & placed & (smaller * den >= larger * num))
    pairs = hits.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    parts = range(coordinates // 8)
    look = lambda id_, s: reps.select(F.col("id").alias(id_), *[F.get("d.short", F.lit(i)).alias(f"{s}{i}") for i in parts])
    agree = sum((8 - _unequal_bytes(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in parts), F.lit(0))
    close = pairs.join(look("a", "p"), "a").join(look("b", "q"), "b").where(agree >= matches).select("a", "b")
    close = cut(close)
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets_of(rows, ids, width, min_words)
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    checked = (
        close.join(sets.select(F.col("id").alias("a"), F.col("s").alias("ta")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("tb")), "b")
        .select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).cast("long").alias("both"))
        .where((F.col("both") > F.col("common")) & (F.col("common") * den >= (F.col("both") - F.col("common")) * num))
    )
    links = checked.groupBy("a", "b").agg(F.max("common").alias("common"), F.max(F.col("common") / (F.col("both") - F.col("common"))).alias("jaccard"))
    return members, links


def document_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a document: id, rep, copies (documents with the same set), links (of its class)."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.select("id", "rep").join(sizes, "rep").join(degree, "rep", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )


def document_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a < b) of documents behind the links, copies expanded.

    Classes are joined in blocks of members, so no task holds a whole large class.
    """
    members = cut(members.select("id", "rep"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / CLASS_BLOCK))
    ones = F.expr("explode(sequence(0L, blocks - 1))")
    blocked = members.join(sizes, "rep").select("id", "rep", F.expr("pmod(xxhash64(id), blocks)").alias("block"))

    def expand(edges: DataFrame, side: str, other: list[str], out: str) -> DataFrame:
        spread = edges.join(sizes.select(F.col("rep").alias(side), "blocks"), side).withColumn("block", ones).drop("blocks")
        return spread.join(blocked.select(F.col("rep").alias(side), "block", F.col("id").alias(out)), [side, "block"]).select(*other, out)

    across = expand(expand(links.select("a", "b"), "a", ["b"], "x"), "b", ["x"], "y")
    several = members.join(sizes.where("size > 1").select("rep"), "rep").select("rep", F.col("id").alias("x"))
    within = expand(several.select("rep", "x"), "rep", ["x"], "y").where("x < y")
    return across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
