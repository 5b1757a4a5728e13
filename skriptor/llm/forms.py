"""One consistent form for text that looks the same but differs in its characters.

A transducer reads the text grapheme cluster by grapheme cluster and, at each
place, applies the longest match of one table that is built once from rules over
Unicode's own data: full-width forms, letters with separate marks, characters that
stand for another one, invisible characters, odd spaces, hyphens and ligatures.
Words with a letter of another script are mapped to the script most of their
letters have; these images depend on the word and are part of the same table.
What comes out is composed at the seams, where an invisible character or a
look-alike stood between a letter and its mark.  The table is checked: every key
has one image, no image holds a key, and images are composed, so that the form of
a form is the form itself.  Clusters of emoji and stress marks without a
precomposed letter stay as they are.

Texts without a character that may be part of a key are told in the JVM and never
reach Python.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.session import prepare

# Letters that look alike in Latin, Cyrillic and Greek print ("-": no counterpart).
LATIN = "A B C E H I J K M O P S T X Y a c e i j o p s x y u v b k r n w d g t m l q f z h"
CYRILLIC = "А В С Е Н І Ј К М О Р Ѕ Т Х У а с е і ј о р ѕ х у - - - к - - - - - - - - - - - һ"
GREEK = "Α Β - Ε Η Ι - Κ Μ Ο Ρ - Τ Χ Υ α - ε ι - ο ρ - χ υ - ν β κ - - ω - - τ - - - - - -"

INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0]
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-"}
JOINER, EMOJI_STYLE, TEXT_STYLE, BOM = "‍", "️", "︎", "﻿"

SETS = {"L": LATIN.split(), "C": CYRILLIC.split(), "G": GREEK.split()}
LETTERS = {"L": "A-Za-zÀ-ÖØ-öø-ɏ", "C": "Ѐ-ԯ", "G": "Ͱ-Ͽἀ-῿"}

_SCRIPT: dict[str, str] = {}


def script_of(c: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter, else nothing."""
    s = _SCRIPT.get(c)
    if s is None:
        name = unicodedata.name(c, "") if c.isalpha() else ""
        s = _SCRIPT[c] = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.partition(" ")[0], "")
    return s


def build_alike() -> dict[tuple[str, str], str]:
    """(script of the word, letter of another script) to the letter that looks like it."""
    out: dict[tuple[str, str], str] = {}
    for to, images in SETS.items():
        for name, letters in SETS.items():
            for a, b in zip(letters, images):
                if name != to and a != "-" and b != "-":
                    out.setdefault((to, a), b)
    return out


def build_table() -> dict[str, tuple[str, str]]:
    """Key (one or more characters) to its image and the kind of difference, checked together with ``build_alike``."""
    table: dict[str, tuple[str, str]] = {}

    def add(key: str, image: str, kind: str) -> None:
        if table.setdefault(key, (image, kind)) != (image, kind):
            raise ValueError(f"two images of {key!r}")

    for cp in range(0xFF01, 0xFF5F):
        add(chr(cp), chr(cp - 0xFEE0), "width")
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" and not 0xE0020 <= cp <= 0xE007F or cp in INVISIBLE:
            add(c, "", "invisible")
        elif kind == "Zs" and c != " ":
            add(c, " ", "space")
        elif kind[0] == "L" and 0xFB00 <= cp <= 0xFB06:
            add(c, unicodedata.normalize("NFKC", c), "ligature")
        elif kind[0] in "LS" and unicodedata.normalize("NFC", c) != c and len(unicodedata.normalize("NFC", c)) == 1:
            add(c, unicodedata.normalize("NFC", c), "same sign")
        elif kind[0] == "L" and cp < 0xAC00:
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and all(unicodedata.combining(x) for x in parts[1:]):
                add(parts, c, "accent")
                half = unicodedata.decomposition(c)  # a precomposed letter with one more mark
                if half and not half.startswith("<"):
                    pair = "".join(chr(int(x, 16)) for x in half.split())
                    if pair != parts:
                        add(pair, c, "accent")
    for c, image in HYPHENS.items():
        add(c, image, "hyphen")
    for (to, letter), image in build_alike().items():
        if script_of(image) != to or script_of(letter) == to:
            raise ValueError(f"{letter!r} and {image!r} are of the wrong script")
    for image in [*(x for x, _ in table.values()), *build_alike().values()]:
        parts = (image[i:j] for i in range(len(image)) for j in range(i + 1, len(image) + 1))
        if any(k in table for k in parts) or unicodedata.normalize("NFC", image) != image:
            raise ValueError(f"an image is a key itself or not composed: {image!r}")
    return table


def _ranges(points: list[int]) -> str:
    """A character class of code points; gaps are closed where no letter or mark of usual text lies in them."""
    usual = regex.compile(r"[\p{Latin}\p{Cyrillic}Ͱ-Ͽ‒-‧‰-⁞№\x00-\x9f]")
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and p - out[-1][1] <= 300 and not any(usual.match(chr(x)) for x in range(out[-1][1] + 1, p)):
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def trigger() -> str:
    """A pattern that texts with anything to map hold, for the JVM and for Python."""
    table = build_table()
    points = [ord(k) for k in table if len(k) == 1] + [ord(k[-1]) for k in table if len(k) > 1]
    points += [c for c in range(0x300, 0x370)] + [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]  # marks to compose, Hangul parts
    mixed = "|".join(f"[{a}][{b}]" for a in LETTERS.values() for b in LETTERS.values() if a != b)
    return f"[{_ranges(points)}]|{mixed}"


class Transducer:
    """The table compiled to a trie and a scanner for the places where it may apply."""

    def __init__(self):
        self.trie: dict = {}
        table = build_table()
        for key, out in table.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        self.alike = build_alike()
        self.trigger = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: regex.escape(chr(int(m[1], 16))), trigger()))
        self.cluster = regex.compile(r"\X")
        self.word = regex.compile(r"[\p{L}\p{M}]+")

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text in one form, and the kinds of differences met."""
        if not self.trigger.search(text, 1 if text[:1] == BOM else 0):
            return text, []
        kinds: set[str] = set()
        head, body = (BOM, text[1:]) if text[:1] == BOM else ("", text)
        out = []
        for line in body.splitlines(keepends=True):
            if self.trigger.search(line):
                line = self._compose(self._mark_runs(line, kinds), kinds)
                line = self._compose(self.word.sub(lambda m: self._word(m[0], kinds), line), kinds)
            out.append(line)
        return head + "".join(out), sorted(kinds)

    @staticmethod
    def _compose(line: str, kinds: set[str]) -> str:
        """The line composed at the seams of images; marks in their canonical order."""
        if unicodedata.is_normalized("NFC", line):
            return line
        kinds.add("accent")
        return unicodedata.normalize("NFC", line)

    def _mark_runs(self, line: str, kinds: set[str]) -> str:
        out = []
        for cluster in self.cluster.findall(line):
            if cluster.isascii() or (JOINER in cluster or EMOJI_STYLE in cluster or TEXT_STYLE in cluster) and self._emoji(cluster):
                out.append(cluster)
                continue
            i = 0
            while i < len(cluster):
                node, best, end = self.trie, None, i
                for j in range(i, len(cluster)):
                    node = node.get(cluster[j])
                    if node is None:
                        break
                    if "" in node:
                        best, end = node[""], j + 1
                if best is None:
                    out.append(cluster[i])
                    i += 1
                else:
                    out.append(best[0])
                    kinds.add(best[1])
                    i = end
        return "".join(out)

    @staticmethod
    def _emoji(cluster: str) -> bool:
        """Symbols joined to symbols; a joiner that joins nothing is an invisible character."""
        base = cluster.replace(EMOJI_STYLE, "").replace(TEXT_STYLE, "")
        return all(p and unicodedata.category(p[0]) in ("So", "Sm", "Po", "Nd", "Sk") for p in base.split(JOINER))

    def _word(self, word: str, kinds: set[str]) -> str:
        if word.isascii():
            return word
        counts: dict[str, int] = {}
        for c in word:
            if s := script_of(c):
                counts[s] = counts.get(s, 0) + 1
        if len(counts) < 2:
            return word
        kinds.add("look-alike")
        for to in sorted(counts, key=lambda s: (-counts[s], "CLG".index(s))):
            mapped = "".join(c if script_of(c) in ("", to) else self.alike.get((to, c), "\0") for c in word)
            if "\0" not in mapped:
                return mapped
        return word


_MADE: list[Transducer] = []


def transducer() -> Transducer:
    """The worker's transducer, built once."""
    if not _MADE:
        _MADE.append(Transducer())
    return _MADE[0]


def may_differ(text: Column) -> Column:
    """Whether a text holds a character that may have to change; false is certain."""
    return text.rlike(trigger())


def unify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, form, kinds) of every row: the text, its consistent form and what differed.

    ``kinds`` is empty where nothing had to change; one byte order mark as the
    first character stays.  A word whose foreign letters have no counterpart keeps
    its letters and is reported as look-alike all the same.  Null texts have a
    null form and no kinds; repeated rows come out as often as they come in.
    """
    prepare(df.sparkSession)

    @F.pandas_udf("form string, kinds array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        apply = transducer()
        done = [(None, []) if t is None else apply(t) for t in texts]
        return pd.DataFrame({"form": pd.Series([d[0] for d in done], dtype=object), "kinds": pd.Series([d[1] for d in done], dtype=object)})

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.withColumn("done", run(F.when(may_differ(F.col("text")), F.col("text"))))
    return out.select(F.col("key").alias(id_col), "text", F.coalesce("done.form", "text").alias("form"), "done.kinds")
