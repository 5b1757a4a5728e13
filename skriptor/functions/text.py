"""Scalar text functions as column expressions: folding, tokens, sentences, n-grams, hashes."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes written so that Java's and RE2's regular expressions agree.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER = "А-ЯЁа-яёA-Za-z"
LINE_END = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
SENTENCE_END = rf"[.!?…]+[{SPACE}]|[.!?…]+$"

NAME_TOKEN = rf"[{LETTER}][{LETTER}-]+"
COUNT_TOKEN = rf"[{LETTER}]+(?:-[{LETTER}]+)*"
ECHO_TOKEN = r"[а-яёa-z]+(?:-[а-яёa-z]+)*"
SHINGLE_TOKEN = rf"[{LETTER}]+"


def fold_yo(s: Column) -> Column:
    """ё as е, of the same length."""
    return F.translate(s, "Ёё", "Ее")


def strip(s: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def matches(s: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def sentences(s: Column) -> Column:
    """Stripped pieces between sentence ends, without empty ones."""
    return F.filter(F.transform(F.split(s, SENTENCE_END), strip), lambda x: x != "")


def lines(s: Column) -> Column:
    """Lines of a text; one line end at the very end opens no further line."""
    parts = F.split(s, LINE_END)
    return F.when(s == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def name_tokens(s: Column) -> Column:
    """Words of two or more letters or hyphens."""
    return matches(s, NAME_TOKEN)


def count_tokens(s: Column) -> Column:
    """Words with inner hyphens, from one letter on."""
    return matches(s, COUNT_TOKEN)


def echo_tokens(s: Column) -> Column:
    """Lower-case, folded words with inner hyphens."""
    return matches(fold_yo(F.lower(s)), ECHO_TOKEN)


def shingle_tokens(s: Column) -> Column:
    """Lower-case, folded runs of letters."""
    return matches(fold_yo(F.lower(s)), "[а-яa-z]+")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` consecutive words joined by a space; empty where there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, width: int = 5, min_words: int = 15) -> Column:
    """Set of word runs of a column of words; null where there are fewer than ``min_words``.

    ``words`` should be a plain column: an expression would be evaluated again for each run.
    """
    return F.when(F.size(words) >= min_words, F.array_distinct(ngrams(words, width)))


def content_hash(s: Column) -> Column:
    """md5 of the text's white-space separated words, one a line."""
    return F.md5(F.array_join(F.filter(F.split(s, rf"[{SPACE}]+"), lambda x: x != ""), "\n"))


def phrase_count(folded: Column, phrase: Column | str) -> Column:
    """Non-overlapping occurrences of a phrase in a text already lower-cased and folded."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return ((F.length(folded) - F.length(F.replace(folded, p, F.lit("")))) / F.length(p)).cast("long")


def word_bounded(phrase: str) -> str:
    """Pattern of a phrase that is no part of a longer word; its spaces stand for any white space."""
    body = "".join("\\" + c if c in r".^$*+?()[]{}|\/-" else rf"[{SPACE}]+" if c == " " else c for c in phrase)
    return rf"(?<![{LETTER}]){body}(?![{LETTER}])"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


CHUNK = 256  # matches added up in one fold, so that no array is grown by one again and again


def offsets(s: Column, pattern: str) -> Column:
    """array<struct<pos, line, hit>> of all matches: 0-based start, 1-based line and text, like an iterator over matches.

    Sums run within chunks of matches and then over the chunks, so the work grows
    with the text and not with its matches squared.
    """
    kind = "array<struct<pos:int,line:int,hit:string>>"
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    none = F.array().cast(kind)

    def add(acc: Column, x: Column) -> Column:
        pos, line = acc["end"] + F.length(x["gap"]), acc["line"] + breaks(x["gap"])
        hit = F.array(F.struct(pos.alias("pos"), line.alias("line"), x["hit"].alias("hit")))
        return F.struct((pos + F.length(x["hit"])).alias("end"), (line + breaks(x["hit"])).alias("line"), F.concat(acc["out"], hit).alias("out"))

    def chunk(pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(F.lit(0).alias("end"), F.lit(0).alias("line"), none.alias("out")), add)

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda m: F.struct((m["pos"] + acc["end"]).alias("pos"), (m["line"] + acc["line"]).alias("line"), m["hit"].alias("hit")))
        return F.struct((acc["end"] + x["end"]).alias("end"), (acc["line"] + x["line"]).alias("line"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def summed(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: chunk(F.slice(pairs, i * CHUNK + 1, CHUNK)))
        first = F.struct(F.lit(0).alias("end"), F.lit(1).alias("line"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(chunks, first, join, lambda acc: F.flatten(acc["out"]))

    def paired(hits: Column) -> Column:
        gaps = F.slice(F.split(s, pattern), F.lit(1), F.size(hits))
        return F.when(F.size(hits) > 0, let(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), summed)).otherwise(none)

    return let(matches(s, pattern), paired)


PIECE, AROUND = 4096, 512


def pieces(s: Column) -> Column:
    """The text in overlapping pieces, in which ``context_in`` finds a place without reading from the start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / PIECE).cast("int")), lambda i: F.substring(s, i * PIECE + 1, PIECE + AROUND))


def context(s: Column, pos: Column, length: Column, width: int = 40) -> Column:
    """The text around a place on one line, with … where it is cut."""
    return _around(s, F.length(s), F.lit(0), pos, length, width)


def context_in(parts: Column, whole: Column, pos: Column, length: Column, width: int = 40) -> Column:
    """``context`` from the ``pieces`` of a text of ``whole`` characters; a match longer than AROUND is cut."""
    at = F.floor(F.greatest(pos - width, F.lit(0)) / PIECE).cast("int")
    return _around(F.get(parts, at), whole, at * PIECE, pos, F.least(length, F.lit(AROUND - 2 * width)), width)


def _around(part: Column, whole: Column, begins: Column, pos: Column, length: Column, width: int) -> Column:
    begin = F.greatest(pos - width, F.lit(0))
    end = F.least(pos + length + width, whole)
    body = F.replace(F.substring(part, begin - begins + 1, end - begin), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(begin > 0, "…").otherwise(""), strip(body), F.when(end < whole, "…").otherwise(""))


def line_of(s: Column, pos: Column) -> Column:
    """1-based line of a 0-based position."""
    return F.size(F.split(F.substring(s, F.lit(1), pos), "\n"))


def code_points(s: Column) -> Column:
    """``U+XXXX`` of every character, separated by a space."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), " ")


def is_capitalised(word: Column) -> Column:
    """Begins with a capital and isn't written in capitals throughout."""
    return (F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))) & (word != F.upper(word))


def clock(seconds: Column) -> Column:
    """``MM:SS`` of whole seconds, not below 00:00."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


# Parts of a page without text of their own, and what stands for a character: by name, or by its number in decimal or hexadecimal.
UNSEEN = ("script", "style", "noscript")
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named() -> dict[str, str]:
    """Characters of the names that HTML defines, from Python's own table; names without a semicolon are left out."""
    return {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}


def resolve_entities(s: Column) -> Column:
    """All entities of HTML in one pass over the text, so what an entity stands for isn't read again."""
    names = _named()

    def image(e: Column) -> Column:
        name = F.regexp_extract(e, ENTITY, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        by_number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(name.startswith("#"), by_number).otherwise(F.coalesce(F.element_at(F.from_json(F.lit(_table(names)), "map<string,string>"), name), e))

    def joined(hits: Column) -> Column:
        parts = F.arrays_zip(F.split(s, ENTITY).alias("gap"), hits.alias("hit"))
        return F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.when(x["hit"].isNull(), "").otherwise(image(x["hit"])))), "")

    return F.when(s.contains("&"), let(matches(s, ENTITY), joined)).otherwise(s)


def _table(names: dict[str, str]) -> str:
    import json

    return json.dumps(names, ensure_ascii=True)


def html_to_text(page: Column) -> Column:
    """Readable text of a page: no comments, scripts, styles or tags; entities resolved; blank lines at most single."""
    unseen = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in UNSEEN)
    bare = F.regexp_replace(page, rf"(?is)<!--.*?-->|{unseen}|<[^>]+>", " ")
    rows = F.transform(F.split(resolve_entities(bare), "\n"), lambda row: F.trim(F.regexp_replace(row, r"[ \t\f]+", " ")))
    return strip(F.regexp_replace(F.array_join(rows, "\n"), r"\n{3,}", "\n\n"))
