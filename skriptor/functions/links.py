"""Links of markdown texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skriptor.functions.state import SOFT

FENCES = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*(?:\n.*?^[ \t]*\1[`~]*[ \t]*$|.*\z)"
INLINE = r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)"  # on one line; a class, so that long lines need no deep stack
# lines that begin with four blanks after a blank line, or at the start, and the blank lines between them
INDENTED = rf"(?dm)(?:\A|^[{SOFT}]*\n)(?:[{SOFT}]*\n)*+ {{4}}[^\n]*(?:\n|\z)(?: {{4}}[^\n]*(?:\n|\z)|[{SOFT}]*\n)*+"
WIKI = r"\[\[([^\[\]\n]*)\]\]"
MARKDOWN = r"(?<!\[)\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\]\((<[^<>\n]*>|(?:[^()\n]|\([^()\n]*\))*)\)"
SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"
EXTENSION = r"\.(?=[a-z0-9]*[a-z])[a-z0-9]{1,8}$"


def without_code(text: Column) -> Column:
    """``text`` without fenced blocks (an open one runs to the end), indented blocks and inline code."""
    unfenced = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), FENCES, "\x01")  # no blank line, so no indented block follows
    return F.regexp_replace(F.regexp_replace(unfenced, INDENTED, "\n"), INLINE, "")


def wiki_targets(text: Column) -> Column:
    """Insides of ``[[...]]`` outside code."""
    return F.regexp_extract_all(without_code(text), F.lit(WIKI), F.lit(1))


def markdown_targets(text: Column) -> Column:
    """Insides of the parentheses of ``[...](...)`` outside code."""
    return F.regexp_extract_all(without_code(text), F.lit(MARKDOWN), F.lit(1))


def percent_decoded(s: Column) -> Column:
    """``s`` percent-decoded; as it is where that fails.  A plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def _finished(s: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("/")), r"[\u00a0\s]+", " ")))
    return F.trim(F.regexp_replace(s, r"\.md$", ""))


def clean_wiki(raw: Column) -> Column:
    """Target of a wiki link: up to ``|`` or ``#``, ``/`` for ``\\``, no ``.md``, lower-case."""
    return _finished(F.regexp_replace(F.regexp_extract(raw, r"^[^|#]*", 0), r"\\$", ""))


def clean_markdown(raw: Column) -> Column:
    """Target of a markdown link; empty for external addresses and pure anchors."""
    inner = F.trim(raw)
    inner = F.when(inner.rlike("^<.*>$"), F.regexp_replace(inner, "^<|>$", "")).otherwise(
        F.regexp_replace(inner, r"\s+(?:\"[^\"]*\"|'[^']*')$", "")
    )
    path = F.regexp_extract(inner, r"^[^|#]*", 0)
    return F.when(inner.rlike(SCHEME), F.lit("")).otherwise(_finished(percent_decoded(path)))


def relative_path(folder: Column, target: Column) -> Column:
    """A path seen from a folder, with ``.`` and ``..`` resolved; one that leads above the root stays there."""
    parts = F.split(F.when(target.startswith("/"), target).otherwise(F.concat(folder, F.lit("/"), target)), "/")
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/?[^/]*$", "")).when(x.isin("", "."), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit("/"), x))
    return F.aggregate(parts, F.lit(""), step)


def last_component(target: Column) -> Column:
    """What stands behind the last ``/``."""
    return F.trim(F.regexp_extract(target, r"[^/]*$", 0))
