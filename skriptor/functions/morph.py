"""Case forms of Russian names as column expressions, by the ending of the word.

No dictionary is needed: a rule takes words by their ending, cuts it off and puts
the endings of the other cases in its place.  Only words in the nominative are
meant; a word without a rule has no form but itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (ending of the nominative, letters cut off, endings of the genitive, dative, accusative, instrumental
# and prepositional case), the first ending that fits counts.
DECLENSIONS = [
    ("[гкх]ий", 2, "ого ому ого им ом"),
    ("[жчшщ]ий", 2, "его ему его им ем"),
    ("ний", 2, "его ему его им ем"),
    ("[^аеёиоуыэюя]ый|[^аеёиоуыэюя]ой", 2, "ого ому ого ым ом"),
    ("[гкхжчшщ]ая", 2, "ой ой ую ой ой"),
    ("[^аеёиоуыэюя]ая", 2, "ой ой ую ой ой"),
    ("няя", 2, "ей ей юю ей ей"),
    ("[оеё]ва|[иы]на", 1, "ой ой у ой ой"),
    ("[^аеёиоуыэюя][оеё]в|[^аеёиоуыэюя][иы]н", 0, "а у а ым е"),
    ("ия", 1, "и и ю ей и"),
    ("[гкх]а", 1, "и е у ой е"),
    ("[жчшщц]а", 1, "и е у ей е"),
    ("[^аеёиоуыэюя]а", 1, "ы е у ой е"),
    ("я", 1, "и е ю ей е"),
    ("ий", 1, "я ю я ем и"),
    ("[аеоуэыя]й", 1, "я ю я ем е"),
    ("ь", 1, "я ю я ем е"),
    ("[жчшщц]", 0, "а у а ем е"),
    ("[бвгдзклмнпрстфх]", 0, "а у а ом е"),
]
LEAST = 3  # letters of the shortest word that is declined


def case_forms(word: Column) -> Column:
    """array<string>: a lower-case word and its forms in the other cases, without repeats."""
    forms = F.array(word)
    for ending, cut, cases in reversed(DECLENSIONS):
        stem = F.substring(word, F.lit(1), F.length(word) - cut)
        own = F.array(word, *[F.concat(stem, F.lit(e)) for e in cases.split()])
        forms = F.when(word.rlike(f"(?:{ending})$"), own).otherwise(forms)
    plain = word.rlike(f"^[а-яё]{{{LEAST},}}$")
    return F.array_distinct(F.when(plain, forms).otherwise(F.array(word)))


def term_forms(term: Column) -> Column:
    """Forms of a term, lower-case: of its last word, the others stay; none for an empty term."""
    low = F.lower(F.trim(term))
    head, last = F.regexp_extract(low, r"^(.*\s)?(\S+)$", 1), F.regexp_extract(low, r"(\S+)$", 1)
    return F.when(last == "", F.array().cast("array<string>")).otherwise(F.transform(case_forms(last), lambda w: F.concat(head, w)))


def term_pattern(exact: list[str], inflected: list[str] = ()) -> str:
    """One alternation for terms: ``exact`` ones in any case, ``inflected`` single words only with a capital."""
    whole = [rf"(?iu:{re.escape(t)})" for t in sorted(set(exact), key=lambda t: (-len(t), t))]
    named = [re.escape(t[:1].upper()) + f"(?iu:{re.escape(t[1:])})" for t in sorted(set(inflected) - {x.lower() for x in exact}, key=lambda t: (-len(t), t)) if t]
    return r"(?U)(?<![\w])(?:" + "|".join([*whole, *named]) + r")(?![\w])" if whole or named else r"(?!)"


def combined(patterns: dict[str, str]) -> tuple[str, list[str]]:
    """One pattern with a group for each key, and the keys in the order of their groups, so that a match tells whose it is."""
    keys = list(patterns)
    for key in keys:
        if re.compile(patterns[key].replace("(?iu:", "(?i:").replace("(?U)", "")).groups:
            raise ValueError(f"the pattern of {key} has groups of its own")
    return "|".join(f"({patterns[k]})" for k in keys), keys
