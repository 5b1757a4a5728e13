"""Entity names: candidates, spellings, mentions of a registry's terms, and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriptor.functions import morph as M
from skriptor.functions import text as T
from skriptor.functions import words as W

NAME_RU, NAME_EN = r"(?U)\b[А-ЯЁ][а-яё]+(?:-[а-яё]+)?", r"(?U)\b[A-Z][a-z]+(?:[-‘’][A-Z][a-z]+)*"
PAIR_RU, PAIR_EN = r"(?U)\b[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+\b", r"(?U)\b[A-Z][a-z]+(?:[-‘’][A-Z][a-z]+)* [A-Z][a-z]+(?:[-‘’][A-Z][a-z]+)*\b"
FIELDS = {"name": "ok", "forms": "ok", "old_forms": "old", "old_dangerous": "dangerous", "typos": "typo"}
BREAK = rf"[^{T.LETTER} «»\"“”„-]+|\s-\s"  # what ends a run of words
WORD = rf"[{T.LETTER}]+(?:-[{T.LETTER}]+)*"


def _sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(T.sentences(F.col(text_col))).alias("s"))


def name_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[str] = (), min_len: int = 3, lang: str | None = None) -> DataFrame:
    """(id, word): words with a capital that don't begin a sentence, folded; no stop words, none known."""
    out = sorted({w.lower().replace("ё", "е") for w in [*W.stop_words(lang), *known]} | set(W.stop_words(lang)))
    words = _sentences(df, id_col, text_col).select(id_col, F.posexplode(T.name_tokens(F.col("s"))).alias("at", "w"))
    kept = words.where((F.col("at") > 0) & T.is_capitalised(F.col("w")) & (F.length("w") >= min_len))
    return kept.select(id_col, T.fold_yo(F.lower("w")).alias("word")).where(~F.col("word").isin(out))


def pair_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[str] = (), min_len: int = 3, lang: str | None = None) -> DataFrame:
    """(id, pair): two words in a row that begin with a capital, folded; neither a stop word nor known."""
    out = sorted({w.lower().replace("ё", "е") for w in [*W.stop_words(lang), *known]} | set(W.stop_words(lang)))
    words = _sentences(df, id_col, text_col).select(id_col, T.name_tokens(F.col("s")).alias("w"))
    pairs = words.where(F.size("w") > 1).select(id_col, F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    begins = lambda c: F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1))
    kept = pairs.where(begins(F.col("p.a")) & begins(F.col("p.b")) & (F.length("p.a") >= min_len) & (F.length("p.b") >= min_len))
    low = kept.select(id_col, T.fold_yo(F.lower("p.a")).alias("a"), T.fold_yo(F.lower("p.b")).alias("b"))
    return low.where(~F.col("a").isin(out) & ~F.col("b").isin(out)).select(id_col, F.concat_ws(" ", "a", "b").alias("pair"))


def registry_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[str] = (), titles: list[str] = (), min_count: int = 2, lang: str | None = None) -> DataFrame:
    """(kind, name, n): single words and pairs; a pair that begins with a known title counts its second word."""
    single = name_candidates(df, id_col, text_col, known, lang=lang).select("word")
    pairs = pair_candidates(df, id_col, text_col, known, lang=lang)
    first, second = F.substring_index("pair", " ", 1), F.substring_index("pair", " ", -1)
    titled = first.isin([t.lower().replace("ё", "е") for t in titles]) if titles else F.lit(False)
    words = single.union(pairs.where(titled).select(second.alias("word"))).select(F.lit("word").alias("kind"), F.col("word").alias("name"))
    both = words.union(pairs.where(~titled).select(F.lit("pair"), "pair"))
    return both.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def cast_list(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str | None = None, min_count: int = 1) -> DataFrame:
    """(kind, name, n): names and "First Last" pairs by their spelling.

    A stop word is no name in a text where it only comes first among a sentence's names; for ``en`` never.
    """
    name, pair = (NAME_EN, PAIR_EN) if lang == "en" else (NAME_RU, PAIR_RU)
    sents = _sentences(df, id_col, text_col)
    words = sents.select(id_col, F.posexplode(T.matches(F.col("s"), name)).alias("at", "name"))
    a_text = words.groupBy(id_col, "name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at") > 0, 1)).alias("mid"))
    stop = T.fold_yo(F.lower("name")).isin(sorted(set(W.stop_words(lang))))
    kept = a_text.where(~(stop & (F.lit(lang == "en") | (F.col("mid") == 0))))
    single = kept.groupBy("name").agg(F.sum("n").alias("n")).select(F.lit("name").alias("kind"), "name", "n")
    pairs = sents.select(F.explode(T.matches(F.col("s"), pair)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("pair").alias("kind"), "name", "n")
    return single.union(pairs).where(F.col("n") >= min_count)


def spelling_variants(cast: DataFrame) -> DataFrame:
    """(folded, spellings, n): names that differ only in case or ё; spellings by falling count."""
    folded = T.fold_yo(F.lower("name"))
    each = cast.where("kind = 'name'").groupBy(folded.alias("folded")).agg(F.collect_list(F.struct((-F.col("n")).alias("c"), "name")).alias("l"), F.sum("n").alias("n"))
    return each.where(F.size("l") > 1).select("folded", F.transform(F.array_sort("l"), lambda x: x["name"]).alias("spellings"), "n")


def terms(entries: DataFrame, fields: dict[str, str] | None = None, group_col: str | None = None) -> DataFrame:
    """(entity, kind, term): every listed spelling of a registry, folded; ``entity`` is the entry's name.

    With ``group_col`` (a vault, say) each term also has its ``grp``.
    """
    fields = FIELDS if fields is None else fields
    group = [F.col(group_col).alias("grp")] if group_col else []
    kept = ["grp"] if group_col else []
    listed = lambda f: F.array(F.col(f)) if entries.schema[f].dataType.simpleString() == "string" else F.coalesce(F.col(f), F.array().cast("array<string>"))
    each = [F.struct(F.lit(kind).alias("kind"), listed(f).alias("l")) for f, kind in fields.items()]
    rows = entries.where(r"name rlike '\\S'").select(*group, T.strip(F.col("name")).alias("entity"), F.explode(F.array(*each)).alias("s"))
    listed = rows.select(*kept, "entity", "s.kind", F.explode("s.l").alias("t"))
    return listed.select(*kept, "entity", "kind", F.array_join(T.matches(T.fold_yo(F.lower("t")), WORD.replace("А-ЯЁа-яёA-Za-z", "а-яa-z")), " ").alias("term")).where("term <> ''").distinct()


def inflected(terms: DataFrame) -> DataFrame:
    """``terms`` (entity, kind, term, ...) with the case forms of each; a form that an entity lists itself stays of its own kind."""
    others = [c for c in terms.columns if c not in ("kind", "term")]
    forms = terms.select(*others, "kind", F.explode(F.transform(M.term_forms(F.col("term")), T.fold_yo)).alias("term"))
    own = terms.select(*others, "term").distinct()
    return terms.unionByName(forms.join(own, [*others, "term"], "left_anti")).distinct()


FORM_FIELDS = ("forms", "old_forms", "typos")


def unlisted_forms(entries: DataFrame) -> DataFrame:
    """(entity, field, missing): case forms of an entry's listed spellings that it lists nowhere, by the field they belong to.

    A form belongs to the first field that leads to it; spellings in old_dangerous are another's and not declined.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(F.trim(x)))
    rows = entries.where(r"name rlike '\\S'").select(T.strip(F.col("name")).alias("entity"), *[low(c).alias(c) for c in (*FORM_FIELDS, "old_dangerous")])
    have = F.concat(F.array(F.lower("entity")), *[F.col(c) for c in (*FORM_FIELDS, "old_dangerous")])
    found, earlier = [], have
    for c in FORM_FIELDS:
        own = F.array_sort(F.array_distinct(F.array_except(F.flatten(F.transform(c, M.term_forms)), earlier)))
        found.append(F.struct(F.lit(c).alias("field"), own.alias("missing")))
        earlier = F.concat(earlier, own)
    return rows.select("entity", F.explode(F.array(*found)).alias("f")).select("entity", "f.field", "f.missing").where("size(missing) > 0")


def mentions(df: DataFrame, registry: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int | None = None, group_col: str | None = None) -> DataFrame:
    """(id, line_no, entity, kind, term, at): registry terms met in the texts, on whole words, case and ё ignored.

    Texts are cut to runs of words without a sign between them and joined with the
    terms by equality, so the cost grows with the texts and not with texts times
    terms; runs are as long as the registry's terms are (``max_words`` None), of the
    lengths that occur there only.  Signs within a term, such as quotation marks, count
    as blanks in text and term alike.  With ``group_col`` only terms of the text's own
    group (their ``grp``) are met, so a name that many groups use is no hot key.  A term within a longer
    one of the same entity and kind at that place doesn't count again.
    """
    group = [F.col(group_col).alias("grp")] if group_col else []
    own = [id_col, *(["grp"] if group_col else [])]
    lengths = sorted(r["k"] for r in registry.select(F.size(F.split("term", " ")).alias("k")).distinct().collect())  # as many rows as lengths of names
    lengths = [k for k in lengths if max_words is None or k <= max_words] or [1]
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), *group, F.posexplode(T.lines(T.fold_yo(F.lower(F.col(text_col))))).alias("n", "line"))
    chunks = lines.select(*own, (F.col("n") + 1).alias("line_no"), F.posexplode(F.split("line", BREAK)).alias("c", "chunk"))
    words = chunks.select(*own, "line_no", "c", T.matches(F.col("chunk"), "[а-яa-z]+(?:-[а-яa-z]+)*").alias("w")).where(F.size("w") >= lengths[0])
    runs = []
    for k in lengths:
        at = F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1)))
        grams = F.transform(at, _gram(k))
        runs.append(F.when(F.size("w") >= k, grams).otherwise(F.array().cast("array<struct<at:int,k:int,term:string>>")))
    each = words.select(*own, "line_no", "c", F.explode(F.concat(*runs)).alias("g")).select(*own, "line_no", "c", "g.at", "g.k", "g.term")
    hits = each.join(registry, ["term", *own[1:]])
    same = Window.partitionBy(id_col, "line_no", "c", "entity", "kind").orderBy("at", F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("at") + F.col("k")).over(same), F.lit(0))
    return hits.withColumn("_end", covered).where(F.col("at") >= F.col("_end")).select(id_col, "line_no", "entity", "kind", "term", (F.col("c") * 10000 + F.col("at")).alias("at"))


def _gram(k: int):
    return lambda i: F.struct(i.cast("int").alias("at"), F.lit(k).alias("k"), F.array_join(F.slice("w", i, k), " ").alias("term"))


def entity_matrix(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(entity, id, n): mentions of each entity in each text."""
    return found.groupBy("entity", id_col).agg(F.count(F.lit(1)).alias("n"))


def consistency(found: DataFrame) -> DataFrame:
    """(entity, ok, old, dangerous, typo, check): mentions by kind and whether the entity needs a look."""
    kinds = list(dict.fromkeys(FIELDS.values()))
    wide = found.groupBy("entity").pivot("kind", kinds).count().na.fill(0, kinds)
    return wide.select("entity", *kinds, (F.col("old") + F.col("dangerous") + F.col("typo") > 0).alias("check"))


NOTE_TEXTS = 10_000  # texts in one note


def entity_notes(matrix: DataFrame, id_col: str = "doc_id", block: int = NOTE_TEXTS) -> DataFrame:
    """(entity, part, texts, note): a markdown note of each entity with its texts by falling count.

    An entity met in more than ``block`` texts has several parts, cut by rank; ``texts`` counts those of the part.
    Ranks come from the counts: texts of one count are numbered within blocks of their hash.
    """
    counted = matrix.select("entity", F.col(id_col).alias("id"), "n", F.expr(f"pmod(xxhash64({id_col}), 64)").alias("h"))
    sizes = matrix.groupBy("entity").agg(F.count(F.lit(1)).alias("size"))
    small = counted.join(sizes.where(F.col("size") <= block).select("entity"), "entity").withColumn("part", F.lit(0).cast("long"))
    large = counted.join(sizes.where(F.col("size") > block).select("entity"), "entity")
    cells = large.groupBy("entity", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("entity").orderBy(F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("entity", "n", "h", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ranked = large.withColumn("r", F.row_number().over(Window.partitionBy("entity", "n", "h").orderBy("id"))).join(offsets, ["entity", "n", "h"])
    placed = small.select("entity", "part", "id", "n").union(ranked.select("entity", F.floor((F.col("r") + F.col("offset") - 1) / block).alias("part"), "id", "n"))
    listed = placed.groupBy("entity", "part").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("c"), F.col("id")))).alias("l"))  # at most a block
    lines = F.transform("l", lambda x: F.concat(F.lit("- [["), x["id"].cast("string"), F.lit("]] — "), (-x["c"]).cast("string")))
    return listed.select("entity", F.col("part").cast("int").alias("part"), F.size("l").alias("texts"), F.concat(F.lit("# "), F.col("entity"), F.lit("\n"), F.array_join(lines, "\n")).alias("note"))


def new_candidates(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The candidates (name, ...) that are no term of the registry, by an anti join."""
    known = registry.select(F.col("term").alias("_k")).distinct()
    return candidates.join(known, T.fold_yo(F.lower("name")) == F.col("_k"), "left_anti")


def missing_forms(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """(entity, missing): forms of ``expected`` (entity, forms) that the registry doesn't list."""
    own = entries.select(T.strip(F.col("name")).alias("entity"), F.transform(F.coalesce("forms", F.array().cast("array<string>")), lambda x: F.lower(x)).alias("have"))
    both = expected.join(own, "entity")
    return both.select("entity", F.filter("forms", lambda x: ~F.array_contains("have", F.lower(x))).alias("missing")).where("size(missing) > 0")


def name_risk(df: DataFrame, reserved: DataFrame, name_col: str = "name") -> DataFrame:
    """(name, hits, risk): reserved names (category, reserved) equal to, inside or around each name.

    reserved is a small fixed list.  risk: high (equal), raised (a short Latin word), medium (one other word), low, or empty.
    """
    low = F.lower(T.strip(F.col(name_col)))
    names = df.select(F.col(name_col).alias("name"), low.alias("low")).distinct()
    listed = [r for r in reserved.select("category", "reserved").distinct().collect()]  # a fixed list
    equal = F.array(*[F.lit(r["reserved"].lower()) for r in listed]).cast("array<string>")
    near = F.filter(equal, lambda r: (r == F.col("low")) | ((F.length(r) >= 5) & (F.col("low") != "") & (F.col("low").contains(r) | r.contains(F.col("low")))))
    one = ~F.col("low").contains(" ")
    risk = (
        F.when(F.coalesce(F.col("low"), F.lit("")) == "", "empty")
        .when(F.array_contains(equal, F.col("low")), "high")
        .when(F.col("low").rlike("^[a-z]{1,12}$"), "raised")
        .when(one & (F.length("low") >= 5) & F.col("low").rlike(r"[^\x00-\x7f]"), "medium")
        .otherwise("low")
    )
    return names.select("name", F.array_sort(near).alias("hits"), risk.alias("risk"))
