"""Text that was decoded with the wrong character encoding: labelled by a hidden Markov model, restored per span.

The model has one clean state and one state for each encoding pair (and one for
replacement characters).  A state emits a character given the one before it; its
probabilities are counted on all different texts of the data itself, as it stands
for the clean state, passed through the pair's damage for the others: a pair of
characters becomes the same string wherever it stands, so counts of clean pairs give
those of the damaged ones.  The most likely path labels every character, and each
labelled span is put through the inverse of its state's damage.

Texts in which no stretch gains more under the best other state than entering
one costs are clean by that path as well; they are told apart with one table
look-up a character.  In the others only such stretches are searched, since no
best path leaves the clean state outside of them; long ones in pieces that overlap.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.session import prepare

MASS_TEXTS, MASS_CHARS = 800, 4000  # counts of all texts are scaled to those of so many texts of so many characters at most: see BETA
COUNT_CHARS = 1_000_000  # characters counted at once
START, CAPITALS = 0x110000, 1 << 42  # before a text's first character; mark of pairs of the text in capitals
ENTER, LEAVE = -12.0, -3.0  # log probabilities of leaving the clean state and of returning
ALPHABET = 640  # characters with a row of their own in the emission tables
RARE = 0.01  # see Model
FLOOR = 1e-4  # least probability of a letter in clean text
MARKS = "…—–«»“”„’№"  # punctuation beyond ASCII that follows letters in clean text
BETA = 4.0  # weight of the unigram in a bigram's probability, beside counts of the mass above
CELLS = 6_000_000  # characters x states searched at once
PIECE, OVERLAP = 4000, 200  # longest stretch searched as a whole; characters shared with the next piece

#: Words with the letters of languages that the texts may not hold; damaged states know them as well.
SEEDS = [
    "Łódź, Wrocław, Gdańsk, Kraków, Poznań; żółw, gęś, źrebię, ćma, święto, książka, miłość, łąka, dzień, proszę, cześć",
    "Příliš žluťoučký kůň; Dvořák, Plzeň, Škoda, děti, město, měsíc, člověk, větší, čtyři, ráno, květen, únor, září",
    "Győr, Szőke, őszi, tűz, füst, szép, köszönöm, hétfő, nyúl, árvíztűrő, tükörfúrógép, erdő, múlt, fő",
    "Straße, über, Köln, für, schön, Mädchen, größer, Füße, Bücher, Österreich, Ähre, hören, Tür, süß, natürlich",
    "été, où, français, garçon, élève, forêt, naïf, cœur, déjà, être, père, là, août, hôtel, ça, Noël, après",
    "niño, señor, mañana, corazón, qué, está, años, también, árbol, pequeño, día, música, útil, así",
    "你好世界我们今天在图书馆看书他说这是一个很好的地方明天早上火车从北京到上海",
    "こんにちは世界今日は図書館で本を読みますこれはとても良い場所ですカタカナテキスト",
    "안녕하세요 세계 우리는 오늘 도서관에서 책을 읽습니다 이것은 아주 좋은 곳입니다",
]

#: Fixed values: (name, right encoding, wrong encoding, how often applied).
PAIRS = [
    ("utf-8 as cp1252", "utf-8", "cp1252", 1),
    ("utf-8 as latin-1", "utf-8", "latin-1", 1),
    ("utf-8 as cp1251", "utf-8", "cp1251", 1),
    ("utf-8 as koi8-r", "utf-8", "koi8-r", 1),
    ("utf-8 as cp866", "utf-8", "cp866", 1),
    ("utf-8 as cp437", "utf-8", "cp437", 1),
    ("utf-8 as cp850", "utf-8", "cp850", 1),
    ("utf-8 as mac-roman", "utf-8", "mac-roman", 1),
    ("utf-8 as mac-cyrillic", "utf-8", "mac-cyrillic", 1),
    ("utf-8 as iso8859-5", "utf-8", "iso8859-5", 1),
    ("utf-8 as cp1252, twice", "utf-8", "cp1252", 2),
    ("utf-8 as latin-1, twice", "utf-8", "latin-1", 2),
    ("utf-8 as cp1251, twice", "utf-8", "cp1251", 2),
    ("cp1251 as cp1252", "cp1251", "cp1252", 1),
    ("cp1251 as koi8-r", "cp1251", "koi8-r", 1),
    ("cp1251 as cp866", "cp1251", "cp866", 1),
    ("cp1251 as mac-cyrillic", "cp1251", "mac-cyrillic", 1),
    ("koi8-r as cp1251", "koi8-r", "cp1251", 1),
    ("koi8-r as cp1252", "koi8-r", "cp1252", 1),
    ("koi8-r as cp866", "koi8-r", "cp866", 1),
    ("cp866 as cp1251", "cp866", "cp1251", 1),
    ("cp866 as cp1252", "cp866", "cp1252", 1),
    ("cp866 as koi8-r", "cp866", "koi8-r", 1),
    ("utf-8 as cp1250", "utf-8", "cp1250", 1),
    ("cp1250 as cp1252", "cp1250", "cp1252", 1),
    ("gbk as cp1252", "gbk", "cp1252", 1),
    ("shift_jis as cp1252", "shift_jis", "cp1252", 1),
    ("euc-kr as cp1252", "euc-kr", "cp1252", 1),
]
OWN_SEEDS = {"cp1250": SEEDS[:3], "gbk": SEEDS[6:7], "shift_jis": SEEDS[7:8], "euc-kr": SEEDS[8:9]}  # encodings of none of the texts
LOST = "replacement characters"
STATES = ["clean", LOST, *(p[0] for p in PAIRS)]

_TABLES: dict[str, tuple[list[str], dict[str, int]]] = {}


def _table(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; bytes without a character stand for themselves (C1)."""
    if encoding not in _TABLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _TABLES[encoding] = (chars, {c: b for b, c in enumerate(chars)})
    return _TABLES[encoding]


def damage(text: str, pair: tuple) -> str:
    """``text`` as it looks after the pair's wrong decoding."""
    _, right, wrong, times = pair
    chars = _table(wrong)[0]
    for _ in range(times):
        text = "".join([chars[b] for b in text.encode(right, "replace")])
    return text


def restore(text: str, pair: tuple) -> tuple[str, bool]:
    """Inverse of ``damage`` and whether nothing was lost."""
    _, right, wrong, times = pair
    back, whole = _table(wrong)[1], True
    for _ in range(times):
        out, held = [], bytearray()

        def flush() -> None:
            nonlocal whole
            if held:
                s = bytes(held).decode(right, "replace")
                whole &= "�" not in s
                out.append(s)
                held.clear()

        for c in text:
            b = back.get(c)
            if b is None:  # not a character of the wrong encoding
                flush()
                whole &= c != "�"
                out.append(c)
            else:
                held.append(b)
        flush()
        text = "".join(out)
    return text, whole


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in order and each text's number of them."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.array([len(t) for t in texts], np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, texts) of several, each key once."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([p[i] for p in parts]), len(key)).astype(np.int64) for i in (1, 2)]
    return key, sums[0], sums[1]


def count_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, texts) of the pairs of neighbouring characters of whole texts, as they stand and in capitals."""
    parts, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= COUNT_CHARS or i + 1 == len(texts):
            for kind, own in ((0, texts[begin : i + 1]), (CAPITALS, [x.upper() for x in texts[begin : i + 1]])):
                p, n = _points(own)
                cur, prev = p.astype(np.int64), np.empty(len(p), np.int64)
                prev[1:] = cur[:-1]
                prev[(np.cumsum(n) - n)[n > 0]] = START
                once, times = np.unique(np.repeat(np.arange(len(n)), n) << 43 | kind | prev << 21 | cur, return_counts=True)
                parts.append(_merged([(once & (1 << 43) - 1, times, np.ones(len(once), np.int64))]))
            begin, held = i + 1, 0
    return _merged(parts)


class Counts:
    """Pairs of characters (key, n, number of texts) and the number of texts they are of."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int):
        (self.key, self.n, self.docs), self.texts = pairs, texts

    @classmethod
    def of(cls, texts: list[str]) -> Counts:
        return cls(count_pairs(texts), len(texts))

    def without(self, other: Counts) -> Counts:
        key, n, docs = _merged([(self.key, self.n, self.docs), (other.key, -other.n, -other.docs)])
        return Counts((key[n > 0], n[n > 0], docs[n > 0]), self.texts - other.texts)

    def side(self, capitals: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Character before, character, n and texts of the pairs of one kind."""
        at = (self.key & CAPITALS > 0) == capitals
        return (self.key[at] & (CAPITALS - 1)) >> 21, self.key[at] & (1 << 21) - 1, self.n[at].astype(float), self.docs[at].astype(float)


def _damaged(prev: np.ndarray, cur: np.ndarray, n: np.ndarray, pair: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of characters of texts after the damage, of those before it: within each character's string and between two."""
    chars, at = np.unique(cur, return_inverse=True)
    become = [list(map(ord, damage(chr(c), pair))) for c in chars]
    times = np.bincount(at, n, len(chars))
    last = np.full(START + 1, START, np.int64)
    last[chars] = [b[-1] for b in become]
    inner = [(x, y, t) for b, t in zip(become, times) for x, y in zip(b, b[1:])]
    x, y, t = (np.array([i[k] for i in inner], (np.int64, np.int64, float)[k]) for k in range(3))
    first = np.array([b[0] for b in become], np.int64)[at] if len(chars) else cur
    return np.concatenate([last[prev], x]), np.concatenate([first, y]), np.concatenate([n, t])


def _script(c: str) -> int:
    """1 Latin (ASCII), 2 Russian, 3 Greek, 0 anything else."""
    if c.isascii():
        return int(c.isalpha())
    return 2 if "а" <= c.lower() <= "я" or c in "ёЁіѕјІЅЈ" else 3 if "α" <= c.lower() <= "ω" else 0


class Model:
    """Emission tables of all states over a shared alphabet (index 0: start, 1: any other character)."""

    def __init__(self, counts: Counts, rare: float = 0.0):
        """``rare``: share of texts below which a pair with an unusual character isn't taken for clean."""
        prev, cur, own, docs = counts.side(False)
        scale = min(1.0, MASS_TEXTS * min(MASS_CHARS, own.sum() / max(1, counts.texts)) / max(1.0, own.sum()))
        capital, many, quarter = counts.side(True), counts.texts > 9, 0.25  # clean text also comes in capitals
        seeds = Counts.of(SEEDS).side(False)
        known_as = [(prev, cur, own * scale, docs), (capital[0], capital[1], capital[2] * scale * quarter, capital[3] * quarter)]
        clean = [*known_as, *([(*seeds[:2], 4 * seeds[2], 4 * seeds[3])] if many else [])]
        versions = [tuple(np.concatenate(x) for x in zip(*clean))[:3], *(self._damaged(known_as[0][:3], seeds[:3], p, many) for p in PAIRS)]
        counted = np.zeros(START, float)
        for _, c, n in versions:
            counted += np.bincount(c, n, START)
        counted[0xFFFD] += 1 << 40
        known = np.argsort(-counted, kind="stable")[: min(ALPHABET - 2, int((counted > 0).sum()))]
        self.index = np.ones(0x110000, np.int16)
        self.index[known] = np.arange(2, 2 + len(known))
        n = 2 + len(known)
        at = np.append(self.index, 0).astype(np.int64)  # START is 0
        self.tables = np.empty((len(STATES), n, n), np.float32)
        lost, total = int(self.index[0xFFFD]), max(1, versions[0][2].sum())
        for s, (before, c, weight) in zip([0, *range(2, len(STATES))], versions):
            cell = at[before] * n + at[c]
            pair = np.bincount(cell, weight, n * n).reshape(n, n)
            if s == 0 and rare:
                held = np.bincount(cell, np.concatenate([x[3] for x in clean]), n * n).reshape(n, n)
                usual = np.array([True, False, *(_script(chr(c)) in (1, 2) or c < 128 or chr(c) in MARKS for c in known)])
                few = (held < rare * ((1 + quarter) * counts.texts + 4 * len(SEEDS) * many)) & ~(usual[:, None] & usual[None, :])
                pair[few] = 0
            # a state counted on seeds alone knows nothing of other characters
            seeded = s > 1 and PAIRS[s - 2][1] in OWN_SEEDS
            uni = pair.sum(0) + (0.02 * min(1.0, pair.sum() / total) if seeded else 0.02)
            uni[0] = 1e-9
            uni[1] += 0.2 if s == 0 else 0
            uni[lost] = 1e-9
            uni /= uni.sum()
            pair[:, lost] = 0
            self.tables[s] = np.log((pair + BETA * uni) / (pair.sum(1, keepdims=True) + BETA))
        self.tables[1] = -40.0
        self.tables[1][:, lost] = -0.01
        self._allow_lookalikes(known)
        plain = np.zeros(n, bool)  # ASCII looks the same either way and never speaks for damage
        plain[[i + 2 for i, c in enumerate(known) if c < 128]] = True
        plain[0] = True
        ascii_pair = plain[:, None] & plain[None, :]
        for t in self.tables[2:]:
            t[ascii_pair] = np.minimum(t, self.tables[0] - np.float32(0.02))[ascii_pair]
        self._gains()

    @staticmethod
    def _damaged(clean: tuple, seeds: tuple, pair: tuple, many: bool) -> tuple:
        """Pairs a damaged state is counted on: the texts', and the seeds' where the encoding has their letters."""
        own = OWN_SEEDS.get(pair[1])
        if own:
            return Counts.of([damage(t, pair) for t in own]).side(False)[:3]
        both = [np.concatenate(x) for x in zip(clean, seeds)] if pair[1] == "utf-8" and many else clean
        return _damaged(*both, pair)

    def _gains(self) -> None:
        self.gains = self.tables[1:] - self.tables[0]
        self.gain = self.gains.max(0)

    def __getstate__(self) -> dict:
        return {"tables": self.tables.astype(np.float16), "index": self.index}  # logarithms down to -40

    def __setstate__(self, state: dict) -> None:
        self.tables, self.index = state["tables"].astype(np.float32), state["index"]
        self._gains()

    def shared(self, spark: SparkSession):
        """The model's broadcast, made once an application; bounded by ALPHABET and the number of states."""
        app = spark.sparkContext.applicationId
        if getattr(self, "_shared", (None, None))[0] != app:
            self._shared = app, spark.sparkContext.broadcast(self)
        return self._shared[1]

    def _allow_lookalikes(self, known: np.ndarray) -> None:
        """Invisible and combining characters, odd spaces and letters of another script in a word
        are damage of another kind: the clean state emits them rarely, but after anything."""
        clean, chars = self.tables[0], [chr(c) for c in known]
        odd = [i + 2 for i, c in enumerate(chars) if c in "\xa0\xad" or (ord(c) > 160 and unicodedata.category(c) in ("Cf", "Zs", "Mn"))]
        uni = np.exp(clean[1])
        clean[:, odd] = np.maximum(clean[:, odd], np.log(2e-3))
        clean[odd, :] = np.maximum(clean[odd, :], np.log(0.5 * uni + 1e-9))
        script = np.array([0, 0, *(_script(c) for c in chars)])
        letter = np.array([False, False, *(c.isascii() and c.isalpha() for c in chars)])
        small = np.array([False, False, *("ß" <= c <= "ž" and c.isalpha() and c.islower() for c in chars)])
        large = np.array([False, False, *("À" <= c <= "Ž" and c.isalpha() and c.isupper() for c in chars)])
        for p, q, least in ((letter, small, 1e-3), (small, letter, 1e-2), (large, letter, 1e-2)):  # accents in Latin words
            at = p[:, None] & q[None, :]
            clean[at] = np.maximum(clean[at], np.log(least))
        # rare names: any small letter may follow a letter of its script
        small_letter = np.array([False, False, *(c.islower() for c in chars)])
        natural = (script[:, None] > 0) & (script[:, None] == script[None, :]) & small_letter[None, :]
        clean[natural] = np.maximum(clean[natural], np.log(1e-3))
        # names of any language: a span must read well in its own state, not only badly in the clean one
        letters = np.array([False, False, *(ord(c) > 127 and c.isalpha() for c in chars)])
        named = letters[None, :] & ((script[:, None] != 2) | (script[None, :] != 2))
        clean[named] = np.maximum(clean[named], np.log(FLOOR))
        ending = (script[:, None] > 0) & np.array([False, False, *(c in MARKS for c in chars)])[None, :]
        clean[ending] = np.maximum(clean[ending], np.log(1e-3))
        mixed = (script[:, None] > 0) & (script[None, :] > 0) & (script[:, None] != script[None, :])
        clean[mixed] = np.maximum(clean[mixed], np.log(2e-4))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p, n = _points(texts)
        ids = self.index[p].astype(np.int64)
        prev = np.zeros_like(ids)
        prev[1:] = ids[:-1]
        starts = np.cumsum(n) - n
        prev[starts[n > 0]] = 0
        return ids, prev

    def suspects(self, texts: list[str]) -> np.ndarray:
        """Whether some stretch of each text gains enough in some state other than the clean one."""
        out = self._gaining(texts, [self.gain])
        if len(held := np.flatnonzero(out)):
            out[held] = self._gaining([texts[i] for i in held], self.gains)
        return out

    def _gaining(self, texts: list[str], gains) -> np.ndarray:
        n = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts), bool)
        ids, prev = self.ids(texts)
        if not len(ids):
            return out
        starts = (np.cumsum(n) - n)[n > 0]
        flat = prev * self.gain.shape[1] + ids
        best = np.full(len(starts), -np.inf)
        for gain in gains:
            own = gain.reshape(-1)[flat].astype(np.float64)
            d = own.copy()
            d[starts] -= 1e5  # stretches end with their text
            c = np.cumsum(d)
            before = np.concatenate([[0.0], c[:-1]])
            before[starts] = c[starts] - own[starts]
            best = np.maximum(best, np.maximum.reduceat(c - np.minimum.accumulate(before), starts))
        out[n > 0] = best > -ENTER
        return out

    def _stretches(self, texts: list[str], flat: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, begin, end) of the stretches that may leave the clean state: where the largest sum of gains that
        ends at a character is positive, as far as it reaches the cost of entering somewhere in them."""
        own = self.gain.reshape(-1)[flat].astype(np.float64)
        d, starts = own.copy(), (np.cumsum(n) - n)[n > 0]
        d[starts] -= 1e5
        c = np.cumsum(d)
        before = np.concatenate([[0.0], c[:-1]])
        before[starts] = c[starts] - own[starts]
        ending = c - np.minimum.accumulate(before)
        up = np.concatenate([[False], ending > 0, [False]])
        doc = np.repeat(np.arange(len(n)), n)
        edge = np.flatnonzero((up[1:] != up[:-1]) | np.concatenate([[False], (doc[1:] != doc[:-1]) & up[1:-2] & up[2:-1], [False]]))
        out, first = [], np.cumsum(n) - n
        for a, b in zip(edge[:-1], edge[1:]):
            if up[a + 1] and ending[a:b].max() > -ENTER:
                i = int(doc[a])
                out.append((i, int(a - first[i]), int(b - first[i])))
        return out

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """State of every character on the most likely path of each text."""
        n = np.array([len(t) for t in texts], np.int64)
        out = [np.zeros(k, np.int8) for k in n]
        if not n.sum():
            return out
        ids, prev = self.ids(texts)
        first = np.cumsum(n) - n
        pieces = []  # (text, begin, end, begins inside a stretch, ends inside one, ends with its text)
        for i, a, b in self._stretches(texts, prev * self.gain.shape[1] + ids, n):
            for x in range(a, b, PIECE):
                y = min(x + PIECE, b)
                pieces.append((i, max(a, x - OVERLAP), min(b, y + OVERLAP), x > a, y < b, b == n[i], x, y))
        pieces.sort(key=lambda q: q[2] - q[1])
        begin = 0
        while begin < len(pieces):
            end = begin + 1
            while end < len(pieces) and (end + 1 - begin) * (pieces[end][2] - pieces[end][1]) * len(STATES) <= CELLS:
                end += 1
            group = pieces[begin:end]
            cuts = [slice(first[q[0]] + q[1], first[q[0]] + q[2]) for q in group]
            paths = self._search([ids[c] for c in cuts], [prev[c] for c in cuts], np.array([q[3] for q in group]), np.array([q[4] or q[5] for q in group]))
            for (i, a, _, _, _, _, x, y), path in zip(group, paths):
                out[i][x:y] = path[x - a : y - a]
            begin = end
        return out

    def _search(self, ids: list[np.ndarray], prev: list[np.ndarray], inside: np.ndarray, open_end: np.ndarray) -> list[np.ndarray]:
        """Most likely paths; ``inside``: any state may come first, ``open_end``: any may be the last at no cost."""
        n = np.array([len(x) for x in ids])
        rows, width, states = len(ids), int(n.max()), len(STATES)
        at = np.zeros((rows, width), np.int64)
        before = np.zeros((rows, width), np.int64)
        mask = np.arange(width)[None, :] < n[:, None]
        at[mask], before[mask] = np.concatenate(ids), np.concatenate(prev)
        stay = np.ones((width, rows, states), bool)  # others: stayed (else entered from clean)
        source = np.zeros((width, rows), np.int8)  # clean: the state it came from
        v = np.full((rows, states), ENTER)
        v[:, 0] = 0.0
        v[inside] = 0.0
        ends = np.zeros((rows, states))
        for t in range(width):
            if t:
                other = v[:, 1:].max(1) + LEAVE
                leave = other > v[:, 0]
                source[t] = np.where(leave, v[:, 1:].argmax(1) + 1, 0)
                entered = (v[:, 0] + ENTER)[:, None]
                stay[t] = v >= entered
                v = np.maximum(v, entered)
                v[:, 0] = np.where(leave, other, entered[:, 0] - ENTER)
            v = v + self.tables[:, before[:, t], at[:, t]].T
            done = n == t + 1
            if done.any():
                ends[done] = v[done]
        ends[:, 1:] += np.where(open_end, 0.0, LEAVE)[:, None]
        paths = np.zeros((rows, width), np.int8)
        state = ends.argmax(1).astype(np.int8)
        everyone = np.arange(rows)
        for t in range(width - 1, -1, -1):
            live = n > t
            paths[live, t] = state[live]
            if t:
                back = np.where(state == 0, source[t], np.where(stay[t, everyone, state], state, 0))
                state = np.where(live, back, state).astype(np.int8)
        return [paths[i, : n[i]] for i in range(rows)]


def _dirty(model: Model, texts: list[str]) -> list[str]:
    """The texts in which the model finds damage."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= COUNT_CHARS or i + 1 == len(texts):
            own = texts[begin : i + 1]
            own = [t for t, bad in zip(own, model.suspects(own)) if bad]
            out += [t for t, path in zip(own, model.label(own)) if path.any()]
            begin, held = i + 1, 0
    return out


def _refined(model: Model, counts: Counts, dirty: Counts) -> Model:
    return Model(counts.without(dirty) if dirty.texts < counts.texts else counts) if dirty.texts else model


def _train(texts: list[str]) -> Model:
    """A model of the texts, then one of those only that the first found clean."""
    texts = [t for t in texts if t]
    counts = Counts.of(texts)
    model = Model(counts, rare=RARE)
    return _refined(model, counts, Counts.of(_dirty(model, texts)))


def train(parts: list[tuple[DataFrame, str]], rows: int | None = None) -> Model:
    """Model of all different texts of each (table, text column), whole; with ``rows``, of so many of each by the text's hash.

    Two passes: pairs of characters are counted over all texts, then over those in which the
    first model finds damage, which are taken off.  What is counted comes to the driver as one number
    for each different pair of characters.
    """
    spark = prepare(parts[0][0].sparkSession)
    each = []
    for df, column in parts:
        some = df.select(F.col(column).cast("string").alias("c")).where("c is not null and c <> ''").select("c", F.xxhash64("c").alias("h"))
        if rows is not None:
            some = some.join(F.broadcast(some.select("h").distinct().orderBy("h").limit(rows)), "h").select("c", "h")
        each.append(some.repartition("h"))  # copies come together and count once

    def counted(model=None) -> Counts:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            parts, held, n = [], 0, 0
            for batch in batches:
                texts = []
                for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if h not in seen:
                        seen.add(h)
                        texts.append(t)
                texts = texts if model is None else _dirty(model.value, texts)
                parts.append(count_pairs(texts))
                held, n = held + len(parts[-1][0]), n + len(texts)
                if held > COUNT_CHARS:
                    parts = [_merged(parts)]
                    held = 0
            key, times, docs = _merged(parts)
            # the number of texts under a key of its own
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key, -1)), pa.array(np.append(times, n)), pa.array(np.append(docs, n))], ["key", "n", "docs"])

        found = [df.mapInArrow(run, "key bigint, n bigint, docs bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow() for df in each]
        key, n, docs = _merged([tuple(t.column(c).to_numpy() for c in ("key", "n", "docs")) for t in found])
        return Counts((key[key >= 0], n[key >= 0], docs[key >= 0]), int(n[key < 0].sum()))

    counts = counted()
    if not counts.texts:
        return _train([" "])
    model = Model(counts, rare=RARE)
    return _refined(model, counts, counted(model.shared(spark)))


def _whole_words(text: str, path: np.ndarray) -> np.ndarray:
    """Labels carried on over the letters beyond ASCII that touch a labelled span, and taken off the blanks at its ends."""
    path = path.copy()
    edges = np.flatnonzero(np.diff(path)) + 1
    for a, b in zip([0, *edges], [*edges, len(path)]):
        if path[a] > 1:
            while a < b and text[a] in " \n\t":
                path[a] = 0
                a += 1
            while b > a and text[b - 1] in " \n\t":
                path[b - 1] = 0
                b -= 1
    for at in (*np.flatnonzero(np.diff(path)),):
        a, b = at, at + 1
        if path[a] == 0 and path[b] > 1:
            while a >= 0 and path[a] == 0 and ord(text[a]) > 127 and text[a].isalpha():
                path[a] = path[b]
                a -= 1
        elif path[b] == 0 and path[a] > 1:
            while b < len(path) and path[b] == 0 and ord(text[b]) > 127 and text[b].isalpha():
                path[b] = path[a]
                b += 1
    return path


def _restored(model: Model, piece: str, pair: tuple) -> tuple[str, bool]:
    """The span under the pair's inverse, or under that of another pair that loses nothing and leaves it clean;
    the span as it is where every inverse loses characters."""
    text, ok = restore(piece, pair)
    if ok:
        return text, True
    if "\ufffd" in text:
        other = next((p for p in PAIRS if p[1] not in OWN_SEEDS and _clean_under(model, piece, p)), None)
        return (restore(piece, other)[0], True) if other else (piece, False)
    return text, False


def _clean_under(model: Model, piece: str, pair: tuple) -> bool:
    text, ok = restore(piece, pair)
    return ok and text != piece and not model.suspects([text])[0]


def _as_seeds(text: str, pair: tuple) -> bool:
    """Whether a restored span reads like the languages of its encoding: letters of theirs, at least two."""
    odd = [c for c in text if ord(c) > 127]
    if pair[1] == "cp1250":
        return len(odd) > 1 and all(c.lower() in "".join(SEEDS[:3]).lower() for c in odd)
    return len(odd) > 1 and sum(c.isalpha() for c in odd) >= 0.8 * len(odd)


def judge(model: Model, texts: list[str]) -> list[tuple | None]:
    """For each text None, or (restored text, whether nothing was lost, pairs found)."""
    out: list[tuple | None] = [None] * len(texts)
    suspects = np.flatnonzero(model.suspects(texts))
    if not len(suspects):
        return out
    for i, path in zip(suspects, model.label([texts[i] for i in suspects])):
        if not path.any():
            continue
        text, parts, whole, found = texts[i], [], True, set()
        path = _whole_words(text, path)
        edges = np.flatnonzero(np.diff(path)) + 1
        for a, b in zip([0, *edges], [*edges, len(path)]):
            state, piece = int(path[a]), text[a:b]
            if state > 1 and sum(ord(c) > 127 for c in piece) < 2:
                state = 0  # one odd character is no wrong decoding
            if state == 1:
                whole = False
            elif state > 1:
                back, ok = _restored(model, piece, PAIRS[state - 2])
                if PAIRS[state - 2][1] in OWN_SEEDS and not (ok and _as_seeds(back, PAIRS[state - 2])):
                    state = next((STATES.index(p[0]) for p in PAIRS if p[1] not in OWN_SEEDS and _clean_under(model, piece, p)), 0)
                    back, ok = _restored(model, piece, PAIRS[state - 2]) if state else (piece, True)
                piece = back
                whole &= ok
            if state:
                found.add(STATES[state])
            parts.append(piece)
        if found:
            out[i] = ("".join(parts), whole, sorted(found))
    return out


def flag_garbled(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, garbled) of every row with a text: whether some of it was decoded wrongly."""
    shared = model.shared(prepare(df.sparkSession))
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).cast("string").alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            garbled = [v is not None for v in judge(shared.value, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(garbled, pa.bool_())], ["rec_id", "garbled"])

    return rows.mapInArrow(run, "rec_id bigint, garbled boolean")


def find_garbled(df: DataFrame, model: Model, id_col: Column | str, text_col: Column | str) -> DataFrame:
    """(rec_id, restored, complete, pairs) of the rows with wrongly decoded text.

    ``restored`` has every labelled span put right as far as possible and
    ``complete`` says whether nothing was lost.  Null and empty texts are never
    affected; rows that repeat come out as often as they come in.
    """
    spark = prepare(df.sparkSession)
    shared = model.shared(spark)
    rows = df.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("bigint").alias("rec_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string").alias("t")).where(
        "t is not null and t <> ''"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, back = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            verdicts = judge(shared.value, list(texts))
            at = [i for i, k in enumerate(back) if verdicts[k]]
            hits = [verdicts[back[i]] for i in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.bool_()), pa.array([h[2] for h in hits], pa.list_(pa.string()))],
                ["rec_id", "restored", "complete", "pairs"],
            )

    return rows.mapInArrow(run, "rec_id bigint, restored string, complete boolean, pairs array<string>")
