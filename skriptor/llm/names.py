"""Entries of one person or organisation under many spellings, by a noisy channel.

Spellings are parsed to a given name and a surname (or an organisation's core,
kinds and suffix, or its acronym) in one alphabet; legal forms don't distinguish.  Frequent spellings are candidate canonical
forms.  A variant is attached to the candidate with the largest posterior: the
candidate's frequency as prior, times the likelihoods of the typing errors,
nicknames and initials that would turn it into the variant; against it stands the
variant being a name of its own, the likelier the more entries spell it so, unless
the candidate's entries times the error's likelihood explain as many.
Pet names are learned from the entries' own lists, next to a given table.  A name
and the lists of its entry name the same one; bare given names and names in
old_dangerous prove nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriptor.llm.components import components, pairs_within
from skriptor.session import cut, prepare

EDIT, PET, INITIAL, START, NEW = -4.0, -1.0, -1.5, -3.0, -9.0  # log likelihoods
MARGIN = 0.75  # posterior share that settles an ambiguous spelling
GIVEN_PARTNERS, GIVEN_LEAD, GIVEN_WINS = 8, 2.0, 0.5  # a given name stands with so many words, so many times as many as half of these do
PET_SUPPORT, PET_SHARE = 2, 0.02  # surnames two forms of a name are listed with, and share of those of the rarer form
LEXICON = 200_000  # largest number of given names and of pairs of forms, the most frequent ones

# Titles, kinds of organisations and connecting words, as skeletons.
TITLES = (
    "dr mr mrs miss ms master captain dame sir lady lord prof professor the aunt uncle доктор г-н г-жа господин госпожа капитан тётушка тетя дядюшка мастер мисс мистер миссис профессор"
)
# Kinds of organisations, the whole word first, then its abbreviations; legal forms.
KINDS = """издательство изд-во изд izdatelstvo, артель арт artel, гильдия гильд gildiya, мастерская маст masterskaya, товарищество т-во тов-во tovarishchestvo,
press pr, association assoc assn, workshop wksp, company co, brothers bros, фабрика ф-ка, завод з-д, фонд, институт ин-т, университет ун-т, общество об-во о-во,
типография тип, редакция ред, агентство аг-во, кооператив кооп, союз, академия акад, музей, театр, библиотека биб-ка, institute inst, university univ, society soc,
foundation fdn, academy acad, museum mus, library lib, agency, bank, group grp, holdings hldgs, partners, publishers publ, publishing, works wks, guild, union, studio, school"""
LEGAL = "ооо оао зао пао ао ип нко ltd limited llc llp lp inc incorporated corp corporation gmbh ag kg sa sas srl sarl bv nv oy ab plc spa pty"
SUFFIXES = {"сыновья": "sons", "synovya": "sons", "sons": "sons", "daughters": "daughters", "партнёры": "partners", "partnery": "partners", "partners": "partners"}
LINKS = "и i and & y"

# Cyrillic letters in a Latin alphabet in which each has one sign, so that one typing error stays one
# error, and the usual transliterations of these letters, longest first.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхчшщыэюяё", "abvgdeʒziiklmnoprstufhʧʃɕieʉɐe")) | {"ц": "ts", "ъ": "", "ь": ""}
ALIKE = [("shch", "ɕ"), ("sch", "ɕ"), ("zh", "ʒ"), ("kh", "h"), ("ch", "ʧ"), ("sh", "ʃ"), ("x", "h"), ("yu", "ʉ"), ("ju", "ʉ"), ("iu", "ʉ"), ("ya", "ɐ"), ("ja", "ɐ"), ("ia", "ɐ"), ("ye", "e"), ("je", "e"), ("iy", "i"), ("ij", "i"), ("yy", "i"), ("y", "i"), ("j", "i")]
PATRONYMIC = re.compile(r"(?:ович|евич|ич|овна|евна|ична|инична|ovich|evich|ovna|evna|ichna)$")


def _is_cyrillic(s: str) -> bool:
    return any("а" <= c <= "я" or c == "ё" for c in s.lower())


def skeleton(word: str, transliterated: bool = False) -> str:
    """A word in one small alphabet; a Latin word is read as a transliteration only if it is said to be one."""
    w = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", word)).lower()
    if _is_cyrillic(w):
        w = w.replace("ий", "и").replace("ый", "и")
        w = "".join(CYRILLIC.get(c, c) for c in w)
    elif transliterated:
        w = re.sub(r"(?<=[bcdfghklmnpqrstvwxz])[yj]o", "e", w)
        for a, b in ALIKE:
            w = w.replace(a, b)
    w = "".join(c for c in unicodedata.normalize("NFD", w) if c.isalnum())
    return w.replace("iɐ", "ɐ").replace("iʉ", "ʉ") if transliterated or _is_cyrillic(word) else w


_TITLES = frozenset(map(skeleton, TITLES.split()))
_KIND_OF = {skeleton(w, not _is_cyrillic(w) and w in ("izdatelstvo", "artel", "gildiya", "masterskaya", "tovarishchestvo")): skeleton(group.split()[0]) for group in KINDS.split(",") for w in group.split()}
_RU_KINDS = frozenset(skeleton(x, True) for x in ("izdatelstvo", "artel", "gildiya", "masterskaya", "tovarishchestvo"))
_KINDS = frozenset(_KIND_OF) - {skeleton("partners")}  # a suffix as well
_LEGAL = frozenset(map(skeleton, LEGAL.split()))
_SUFFIXES = {skeleton(k): v for k, v in SUFFIXES.items()}
_LINKS = frozenset(LINKS.split())


def words_of(raw: str) -> tuple[list[str], bool]:
    """Words of a name without quotes, titles and stray signs, and whether a comma followed the first."""
    s = unicodedata.normalize("NFKC", raw).replace("_", " ")
    s = re.sub(r"[«»\"“”„‘()\[\]]", " ", s)
    comma = "," in s
    out = []
    for i, part in enumerate(s.split(",")):
        for w in re.findall(r"&|[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?", part.replace(".", ". ")):
            out.append((i, w))
    kept = [(i, w) for i, w in out if skeleton(w) not in _TITLES]
    first = [w for i, w in kept if i == 0]
    return [w for _, w in (kept or out)], comma and bool(first) and len(first) < len(kept)


def parse(raw: str, kind: str | None, given: set[str], russian: set[str] = frozenset()) -> tuple[str, str, str] | None:
    """(type, first, second): person p (given, surname), initial i (letter, surname) or
    organisation o (kind and suffix, core); None for what proves nothing.

    ``russian``: the given names met in Cyrillic; a Latin name with one of them is a transliteration.
    """
    words, comma = words_of(raw)
    low = [w.lower().rstrip(".") for w in words]
    skel = [skeleton(w) for w in words]
    if not _is_cyrillic(raw):
        read = [skeleton(w, True) for w in words]
        if any(m in _RU_KINDS or len(m) > 2 and m in russian and not (m == s and s in given - russian) for m, s in zip(read, skel)):
            skel = read
    if kind == "org" or kind != "person" and len(words) > 1 and any(s in _KINDS or s in _LEGAL for s in skel):
        return _parse_org(words, low, skel)
    letters = [s for s, w in zip(skel, words) if len(w.rstrip(".")) == 1 and s]
    full = [(s, w.lower().rstrip(".")) for s, w in zip(skel, words) if len(w.rstrip(".")) > 1 and s]
    if len(full) > 2:
        full = [x for i, x in enumerate(full) if not PATRONYMIC.search(x[1]) or i == 0] if sum(bool(PATRONYMIC.search(x[1])) for x in full) else full
    full = [s for s, _ in full]
    if len(full) == 1:
        return ("i", letters[0], full[0]) if letters else None
    if len(full) < 2:
        return None
    if comma:
        return "p", full[1], full[0]
    known = [i for i, s in enumerate(full) if s in given]
    if not known:
        near = [i for i, s in enumerate(full) if len(s) > 3 and any(x in given for x in deletions(s)) or any(within_one(s, g) for g in given if abs(len(g) - len(s)) < 2 and g[:1] == s[:1])]
        known = near
    at = known[0] if known else min(range(len(full)), key=lambda i: (len(full[i]), i))  # surnames run longer
    rest = [s for i, s in enumerate(full) if i != at]
    return "p", full[at], rest[-1]


def _parse_org(words: list[str], low: list[str], skel: list[str]) -> tuple[str, str, str] | None:
    """(o, kinds and suffix, core) of an organisation, or (a, kinds and suffix, letters) of its acronym."""
    core = [(s, w) for s, w, raw in zip(skel, low, words) if s not in _KINDS and s not in _SUFFIXES and s not in _LEGAL and w not in _LINKS and len(s) > 1]
    if not core:  # made of kinds only
        core = [(s, w) for s, w in zip(skel, low) if s not in _LEGAL and w not in _LINKS and len(s) > 1]
        return ("o", "/", " ".join(s for s, _ in core)) if core else None
    kinds = sorted({_KIND_OF[s] for s in skel if s in _KINDS})
    suffix = sorted({_SUFFIXES[s] for s in skel if s in _SUFFIXES})
    key = "+".join(kinds) + "/" + "+".join(suffix)
    raw = next(w.rstrip(".") for w, s in zip(words, skel) if s == core[0][0])
    if len(core) == 1 and 2 <= len(core[0][0]) <= 5 and raw.isupper() and (len(words) == 1 or not all(w.isupper() for w in words)):
        return "a", key, core[0][0]
    return "o", key, " ".join(s for s, _ in core)


def deletions(s: str) -> list[str]:
    """``s`` and all strings with one character less."""
    return list(dict.fromkeys([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))]))


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]
    if len(a) < len(b):
        a, b = b, a
    return a[i + 1 :] == b[i:]


class Lexicon:
    """Given names and the pairs of a name and its pet form, at most LEXICON of each."""

    def __init__(self, given: set[str], pets: set[tuple[str, str]], russian: set[str] = frozenset()):
        self.given, self.russian = given, russian
        self.other: dict[str, set[str]] = {}
        for a, b in pets:
            self.other.setdefault(a, set()).add(b)
            self.other.setdefault(b, set()).add(a)

    def keys(self, kind: str, first: str, second: str) -> list[str]:
        """Blocking keys: two spellings that may be one share at least one.

        Keys hold a surname and (the beginning of) a given name, so that the people of one
        surname don't meet; only initials, of which a surname has few, meet all that begin so.
        """
        if kind == "a":
            return [f"a|{second}"]
        if kind == "o":
            parts = second.split(" ")
            return [f"o|{first}|{d}" for d in deletions(second)] + ([f"a|{''.join(x[0] for x in parts)}"] if len(parts) > 1 else [])
        if kind == "i":
            return [f"i|{d}|{first}" for d in deletions(second)]
        other = self.other.get(first, ())
        names = {first[:2], *(f"{x}." for x in (first, *other) if other)}
        out = [f"s|{d}|{c}" for d in deletions(second) for c in sorted(names)]
        out += [f"i|{d}|{first[:1]}" for d in deletions(second)]
        return out + [f"g|{second}|{d}" for d in deletions(first)]

    def likelihood(self, v: tuple, c: tuple, own: bool) -> float | None:
        """Log likelihood of the spelling v for the canonical c, or None; ``own``: only typing errors."""
        if v[0] == "a":
            fits = c[0] == "o" and v[1] in ("/", c[1]) and "".join(x[0] for x in c[2].split(" ")) == v[2]
            return INITIAL if fits and not own else None
        if v[0] == "o" or c[0] == "o":
            if v[0] != c[0] or v[1] != c[1] or not within_one(v[2], c[2]) or min(len(v[2]), len(c[2])) < 6:
                return None
            return EDIT if v[2] != c[2] else 0.0
        if c[0] != "p":
            return None
        if v[2] != c[2] and (not within_one(v[2], c[2]) or min(len(v[2]), len(c[2])) < 6):
            return None
        cost = EDIT if v[2] != c[2] else 0.0
        a, b = v[1], c[1]
        if v[0] == "i":
            return None if own or not b.startswith(a) else cost + INITIAL
        if a == b:
            return cost
        if own:
            if a in self.given and b in self.given or min(len(a), len(b)) < 3 or not within_one(a, b):
                return None
            return cost + EDIT
        if b in self.other.get(a, ()):
            return cost + PET
        if self.other.get(a, set()) & self.other.get(b, set()):
            return cost + 4 * PET  # by way of a name that neither is
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if a not in self.given and same >= 2 and same >= min(len(a), len(b)) - 2 and a != b:
            return cost + START
        return None


def spellings(entries: DataFrame) -> DataFrame:
    """(id, kind, source, raw): the name and listed names of entries that have a name; old_dangerous is left out."""

    def told(column: str, source: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(F.lit(source).alias("source"), x.alias("raw")))

    listed = [told("forms", "form"), told("old_forms", "old"), told("typos", "typo")]
    name = F.array(F.struct(F.lit("name").alias("source"), F.col("name").alias("raw")))
    rows = entries.where(r"entry_id is not null and name rlike '\\S'").dropDuplicates(["entry_id"])
    return rows.select(F.col("entry_id").cast("bigint").alias("id"), "kind", F.explode(F.concat(name, *listed)).alias("s")).select("id", "kind", "s.source", "s.raw").where(
        r"raw rlike '\\S'"
    )


def learn(rows: DataFrame, table: DataFrame | None) -> Lexicon:
    """Given names: those of ``table`` and words that stand with many others, which don't themselves; pet forms: of
    the table, and pairs of given names that entries list with the same surname, for so large a share of the rarer one's."""
    given, pets, russian = set(), set(), set()
    if table is not None:
        for r in table.select("given_name", "short_name").distinct().collect():  # a fixed list of names
            a, b = skeleton(r["given_name"] or ""), skeleton(r["short_name"] or "")
            given |= {a, b} - {""}
            russian |= {x for x, raw in ((a, r["given_name"]), (b, r["short_name"])) if x and _is_cyrillic(raw)}
            if a and b and a != b:
                pets.add((a, b))

    def two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = []
            for i, s, raw in zip(x["id"], x["source"], x["raw"]):
                w = [skeleton(t) for t in words_of(raw)[0]]
                if len(w) == 2 and min(map(len, w)) > 1 and not any(t in _KINDS or t in _SUFFIXES for t in w):
                    own = _is_cyrillic(raw)
                    got += [(i, s, w[0], w[1], own), (i, s, w[1], w[0], own)]
            yield pd.DataFrame(got, columns=["id", "source", "a", "b", "cyrillic"])

    pairs = cut(rows.where("source <> 'typo' and (kind is null or kind <> 'org')").mapInPandas(two, "id bigint, source string, a string, b string, cyrillic boolean"))
    partners = pairs.select("a", "b").distinct()
    degree = pairs.groupBy("a").agg(F.count_distinct("b").alias("n"), F.max("cyrillic").alias("cyrillic"))
    # a given name stands with more words than these words themselves do, at any size of the registry
    other = degree.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    leads = partners.join(degree, "a").join(other, "b").groupBy("a").agg(F.max("n").alias("n"), F.max("cyrillic").alias("cyrillic"), F.avg((F.col("n") >= GIVEN_LEAD * F.col("n_b")).cast("int")).alias("wins"))
    often = leads.where((F.col("n") >= GIVEN_PARTNERS) & (F.col("wins") >= GIVEN_WINS)).orderBy(F.desc("n"), "a").limit(LEXICON).collect()
    given |= {r["a"] for r in often}
    russian |= {r["a"] for r in often if r["cyrillic"]}
    names = pairs.sparkSession.createDataFrame([(g,) for g in sorted(given)] or [("",)], "a string")
    told = pairs.where("source in ('name', 'form')").select("id", "a", "b").distinct()
    x, y = told.join(F.broadcast(names), "a").alias("x"), told.alias("y")
    both = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.a") != F.col("y.a")))
    learned = both.groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.countDistinct("x.b").alias("n")).where(F.col("n") >= PET_SUPPORT)
    sized = learned.join(degree.select("a", F.col("n").alias("n_a")), "a").join(other, "b")
    kept = sized.where(F.col("n") >= PET_SHARE * F.least("n_a", "n_b")).orderBy(F.desc("n"), "a", "b").limit(LEXICON)
    pets |= {(r["a"], r["b"]) for r in kept.collect() if r["b"] in given or not within_one(r["a"], r["b"])}
    return Lexicon(given, pets, russian)


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: few bytes, but much work in Python for each."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _parsed(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(i, s, *p) for i, k, s, raw in zip(x["id"], x["kind"], x["source"], x["raw"]) if (p := parse(raw, k, shared.value.given, shared.value.russian))]
            yield pd.DataFrame(got, columns=["id", "source", "type", "first", "second"])

    out = rows.mapInPandas(run, "id bigint, source string, type string, first string, second string")
    return out.withColumn("m", F.expr("xxhash64(type, first, second) | 1L"))  # odd: spellings; entries have even nodes


def _candidates(spelt: DataFrame, shared) -> DataFrame:
    """(v, c, own, p, ...) of all spellings and candidate canonical forms that share a key: ``own`` is the log likelihood
    of typing errors alone, ``p`` that of errors, other names and initials; null where there is none."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(k, *r) for r in x.itertuples(index=False) for k in shared.value.keys(r[1], r[2], r[3])]
            yield pd.DataFrame(got, columns=["key", *x.columns])

    fields = "m bigint, type string, first string, second string, n bigint, spelt bigint"
    keys = _spread(spelt.select("m", "type", "first", "second", "n", "spelt")).mapInPandas(keyed, "key string, " + fields)
    x = keys.select("key", F.struct("m", "type", "first", "second", "n", "spelt").alias("v"))
    y = keys.where("type not in ('i', 'a')").select("key", F.struct("m", "type", "first", "second", "n", "spelt").alias("c"))
    met = x.join(y, "key").where("v.m <> c.m").select("v", "c").distinct()
    flat = met.select(*[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "vc" for f in ("m", "type", "first", "second", "n", "spelt")])

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = []
            for r in x.itertuples(index=False):
                v, c = (r.v_type, r.v_first, r.v_second), (r.c_type, r.c_first, r.c_second)
                own = None if r.v_type in "ia" else shared.value.likelihood(v, c, True)
                p = shared.value.likelihood(v, c, False)
                if own is not None or p is not None:
                    rank_v = (r.v_n, r.v_first in shared.value.given, r.v_spelt, r.v_m)
                    rank_c = (r.c_n, r.c_first in shared.value.given, r.c_spelt, r.c_m)
                    got.append((r.v_m, r.c_m, own, p, int(r.v_n), int(r.c_n), int(r.v_spelt), r.v_second != r.c_second, bool(rank_c > rank_v), r.v_type in "ia"))
            yield pd.DataFrame(got, columns=["v", "c", "own", "p", "v_n", "c_n", "v_spelt", "moved", "leads", "initial"])

    return flat.mapInPandas(judged, "v bigint, c bigint, own double, p double, v_n bigint, c_n bigint, v_spelt bigint, moved boolean, leads boolean, initial boolean")


def _settle(vague: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges of spellings to the component that clearly leads, and the spellings where none does."""
    root_v, root_c = roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), roots.select(F.col("node").alias("c"), F.col("root").alias("rc"))
    other = vague.join(root_c, "c").join(root_v, "v", "left").where("rv is null or rv <> rc")
    weight = other.groupBy("v", "rc").agg(F.sum(F.exp("p") * F.greatest("c_n", F.lit(1))).alias("w"))
    per = Window.partitionBy("v")
    ranked = weight.withColumn("share", F.col("w") / F.sum("w").over(per)).withColumn("r", F.row_number().over(per.orderBy(F.desc("w"), "rc")))
    ranked = cut(ranked.where("r = 1"))
    return ranked.where(F.col("share") >= MARGIN).select(F.col("v").alias("a"), F.col("rc").alias("b")), ranked.where(F.col("share") < MARGIN).select("v")


def linked_entries(entries: DataFrame, given_names: DataFrame | None = None) -> DataFrame:
    """(id, root) of every entry that is linked to a spelling; equal roots: the same person or organisation.

    Entries without a name take no part; null or empty lists count as none; rows
    that repeat an entry_id count once.  Columns: entry_id, name, forms, old_forms, typos, kind.
    """
    spark = prepare(entries.sparkSession)
    rows = cut(_spread(spellings(entries)))
    lexicon = learn(rows, given_names)
    shared = spark.sparkContext.broadcast(lexicon)
    parsed = cut(_parsed(rows, shared))
    whole = "type not in ('i', 'a')"
    sure = parsed.where(whole).select("id").distinct()
    # an initial or an acronym only speaks for an entry that has no full name
    said = parsed.where(whole).unionByName(parsed.where(f"not {whole}").join(sure, "id", "left_anti"))
    said = cut(said)
    counted = said.groupBy("m", "type", "first", "second").agg(F.countDistinct(F.when(F.col("source") != "typo", F.col("id"))).alias("n"))
    by_surname = said.where("source <> 'typo'").groupBy("type", "second").agg(F.countDistinct("id").alias("spelt"))
    spelt = cut(counted.join(by_surname, ["type", "second"], "left").fillna(0, ["spelt"]))

    # typing errors: attach to the largest posterior, against the spelling being a name of its own
    candidates = cut(_candidates(spelt, shared))
    close = candidates.where("own is not null").withColumn("p", F.col("own"))
    score = F.col("p") + F.ln(F.greatest("c_n", F.lit(1)))
    times = F.greatest(F.when(F.col("moved"), F.greatest("v_spelt", "v_n")).otherwise(F.col("v_n")), F.lit(1))
    expected = F.col("c_n") * F.exp("p")  # entries of the candidate in which this error is likely
    fits = close.where((F.col("p") == 0) | ((-F.col("p") * times <= -F.lit(NEW)) | (times <= expected)) & F.col("leads"))
    best = Window.partitionBy("v").orderBy(score.desc(), "c")
    attached = fits.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("v").alias("a"), F.col("c").alias("b"))

    node = F.expr("shiftleft(id, 1)")
    told = said.where(whole).select(node.alias("a"), F.col("m").alias("b")).union(attached)
    first = cut(components(told))

    # pet names, then initials: attach to the component with the largest posterior, if it stands out
    vague = candidates.where("p < 0")
    settled, _ = _settle(vague.where("not initial"), first)
    second = cut(_merged(first, settled))
    settled, unclear = _settle(vague.where("initial"), second)
    initials = said.where(f"not {whole}").join(unclear.select(F.col("v").alias("m")), "m", "left_anti").select(node.alias("a"), F.col("m").alias("b"))
    last = _merged(second, settled.union(initials))
    return last.where("node % 2 = 0").select(F.expr("shiftright(node, 1)").alias("id"), "root")


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after further edges; only the components' roots and what is new take part in the rounds."""
    edges = cut(edges)
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    short = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = cut(components(short))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.union(joined.join(moved.select("node"), "node", "left_anti").select("node", "root"))


def linked_pairs(entries: DataFrame, given_names: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of different entries of the same person or organisation."""
    return pairs_within(linked_entries(entries, given_names))
