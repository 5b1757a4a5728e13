"""Rule dictionaries and phrase lists: scanning with priorities, counts, plans and cleaning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.operators.clean import replace_word

LEVELS = ("hard", "soft")


@dataclass(frozen=True)
class Rule:
    """One rule: what to find, how serious it is, what to say and what to put in its place."""

    cat: str
    level: str
    source: str
    hint: str = ""
    fix: str = ""

    @property
    def pattern(self) -> str:
        return f"(?iuU){self.source}"


def make_rules(items: list[dict], name: str = "rules") -> list[Rule]:
    """Checked rules of a list of ``cat``, ``level``, ``re`` or ``word``, ``hint``, ``fix``; a ValueError names the rule at fault."""
    if not isinstance(items, list):
        raise ValueError(f"{name}: a list of rules is expected")
    out = []
    for i, item in enumerate(items, 1):
        where = f"{name}, rule {i}"
        if not isinstance(item, dict):
            raise ValueError(f"{where}: a mapping is expected")
        get = lambda k, d="", item=item: str(item.get(k) or d).strip()
        cat, level, source, word = get("cat"), get("level", "hard").lower(), get("re"), get("word")
        if not cat:
            raise ValueError(f"{where}: cat is empty")
        if level not in LEVELS:
            raise ValueError(f"{where}: level {level!r} is neither hard nor soft")
        if bool(source) == bool(word):
            raise ValueError(f"{where}: exactly one of re and word is needed")
        source = source or rf"\b(?:{re.escape(word)})\b"
        try:
            empty = re.compile(source, re.I).match("")
        except re.error as e:
            raise ValueError(f"{where}: {e}") from e
        if empty:
            raise ValueError(f"{where}: it matches the empty text")
        out.append(Rule(cat, level, source, get("hint"), get("fix")))
    return out


def _tagged(text: Column, rule: Rule, i: int) -> Column:
    return F.transform(T.offsets(text, rule.pattern), lambda m: F.struct(F.lit(i).alias("rule"), m["pos"].alias("pos"), m["line"].alias("line"), m["hit"].alias("hit")))


def rule_findings(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, cat, level, fragment, context, hint) of each text's rule matches.

    Rules have priority in their order; a match that overlaps one accepted before is dropped.
    """
    c = F.col(text_col)
    rows = df.where(c.rlike("|".join(f"(?:{r.pattern})" for r in rules)))
    found = rows.select(F.col(id_col), F.length(c).alias("_n"), T.pieces(c).alias("_p"), F.concat(*[_tagged(c, r, i) for i, r in enumerate(rules)]).alias("m"))
    each = found.select(id_col, "_n", "_p", F.explode(_accepted(F.col("m"))).alias("m"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("m.rule") + 1)
    return each.select(
        id_col,
        F.col("m.line").alias("line_no"),
        pick([r.cat for r in rules]).alias("cat"),
        pick([r.level for r in rules]).alias("level"),
        F.col("m.hit").alias("fragment"),
        T.context_in(F.col("_p"), F.col("_n"), F.col("m.pos"), F.length("m.hit")).alias("context"),
        pick([r.hint for r in rules]).alias("hint"),
    )


def _accepted(m: Column) -> Column:
    """The matches that overlap none of an earlier rule.

    Matches are put in order of their places; those of a stretch without a gap hang
    together and are judged by the order of rules, stretch by stretch.
    """
    kind = "array<struct<rule:int,pos:int,line:int,hit:string>>"
    ordered = F.array_sort(
        F.transform(F.filter(m, lambda x: x["hit"] != ""), lambda x: F.struct(x["pos"].alias("pos"), x["rule"].alias("rule"), x["line"].alias("line"), x["hit"].alias("hit")))
    )

    def clear(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda a: (x["pos"] < a["pos"] + F.length(a["hit"])) & (a["pos"] < x["pos"] + F.length(x["hit"])))
        return F.when(free, F.concat(acc, F.array(F.struct(x["rule"].alias("rule"), x["pos"].alias("pos"), x["line"].alias("line"), x["hit"].alias("hit"))))).otherwise(acc)

    def judged(stretch: Column) -> Column:
        by_rule = F.array_sort(F.transform(stretch, lambda x: F.struct(x["rule"].alias("rule"), x["pos"].alias("pos"), x["line"].alias("line"), x["hit"].alias("hit"))))
        return F.when(F.size(stretch) == 1, F.transform(by_rule, lambda x: x)).otherwise(F.aggregate(by_rule, F.array().cast(kind), clear))

    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,rule:int,line:int,hit:string>>").alias("held"), F.array().cast(f"array<{kind}>").alias("out"))

    def grow(acc: Column, x: Column) -> Column:
        apart = x["pos"] >= acc["end"]
        done = F.when(apart & (F.size(acc["held"]) > 0), F.concat(acc["out"], F.array(judged(acc["held"])))).otherwise(acc["out"])
        held = F.when(apart, F.array(x)).otherwise(F.concat(acc["held"], F.array(x)))
        return F.struct(F.greatest(acc["end"], x["pos"] + F.length(x["hit"])).alias("end"), held.alias("held"), done.alias("out"))

    return F.aggregate(ordered, first, grow, lambda acc: F.flatten(F.concat(acc["out"], F.array(judged(acc["held"])))))


def rule_counts(findings: DataFrame) -> DataFrame:
    """(cat, level, n), with a total row for each level (cat null) and one overall (both null)."""
    return findings.cube("level", "cat").agg(F.count(F.lit(1)).alias("n")).where("not (level is null and cat is not null)").select("cat", "level", "n")


def rule_clean(text: Column, rules: list[Rule]) -> Column:
    """Matches of hard rules replaced by their fix, or cut out with the blanks before them (and behind them, where a sign or the line's end follows)."""
    for r in rules:
        if r.level == "hard":
            fix = r.fix.replace("\\", "\\\\").replace("$", "\\$")
            text = F.regexp_replace(text, rf"(?iuU)[ \t]*(?:{r.source})(?:[ \t]*(?=[\n.,!?;:…—)»\"]|$))?", fix)
    return text


def control_pass(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(level, before, left): findings of each level in the texts, and in the texts once cleaned.

    ``exit_code`` tells whether hard ones are left.
    """
    cleaned = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), rule_clean(F.col(text_col), rules).alias(text_col))
    count = lambda x, name: rule_findings(x, rules, id_col, text_col).groupBy("level").agg(F.count(F.lit(1)).alias(name))
    levels = df.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    out = levels.join(F.broadcast(count(df, "before")), "level", "left").join(F.broadcast(count(cleaned, "left")), "level", "left")
    return out.na.fill(0, ["before", "left"])


def phrase_totals(df: DataFrame, phrases: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(phrase, total, documents): occurrences, case and ё ignored; overlapping phrases count each for itself."""
    phrases = STOCK_PHRASES if phrases is None else phrases
    folded = T.fold_yo(F.lower(F.col(text_col)))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), folded.alias("_t"))
    each = [F.struct(F.lit(p).alias("phrase"), T.phrase_count(F.col("_t"), p.lower().replace("ё", "е")).alias("n")) for p in phrases]
    counted = rows.select(id_col, F.explode(F.array(*each)).alias("s")).where("s.n > 0")
    return counted.groupBy("s.phrase").agg(F.sum("s.n").alias("total"), F.count(F.lit(1)).alias("documents"))


def phrase_review(df: DataFrame, phrases: list[str], id_col: str = "doc_id", text_col: str = "text", width: int = 30) -> DataFrame:
    """(id, line_no, phrase, fragment): every occurrence with its surroundings."""
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(T.lines(F.col(text_col))).alias("n", "line"))
    folded = lines.withColumn("_f", T.fold_yo(F.lower("line")))
    out = None
    for p in phrases:
        low = p.lower().replace("ё", "е")
        pattern = "".join("\\" + c if c in r".^$*+?()[]{}|\/-" else c for c in low)
        part = folded.where(F.col("_f").contains(low)).select(id_col, (F.col("n") + 1).alias("line_no"), F.lit(p).alias("phrase"), "line", F.explode(T.offsets(F.col("_f"), pattern)).alias("m"))
        part = part.select(id_col, "line_no", "phrase", T.context(F.col("line"), F.col("m.pos"), F.length("m.hit"), width).alias("fragment"))
        out = part if out is None else out.union(part)
    return out


def cleaning_plan(totals: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(phrase, total, documents, action, image): replace, delete or manual for each phrase found."""
    plan = totals.sparkSession.createDataFrame([(k, v) for k, v in mapping.items()] or [("", "")], "phrase string, image string")
    action = F.when(F.col("image").isNull(), "manual").when(F.col("image") == "", "delete").otherwise("replace")
    return totals.join(F.broadcast(plan), "phrase", "left").select("phrase", "total", "documents", action.alias("action"), "image")


# Words whose meaning or usual spelling hangs on ё.
YO_PAIRS = {
    "омографы": [("все", "всё"), ("мел", "мёл"), ("небо", "нёбо"), ("ведро", "вёдро"), ("падеж", "падёж")],
    "словарные": [("черный", "чёрный"), ("желтый", "жёлтый"), ("зеленый", "зелёный"), ("легкий", "лёгкий"), ("жесткий", "жёсткий"), ("шепот", "шёпот"), ("объем", "объём"), ("желоб", "жёлоб"), ("шел", "шёл")],
}


def yo_targets(pairs: dict[str, list[tuple[str, str]]] | None = None, names: list[tuple[str, str]] = ()) -> list[tuple[str, str, str]]:
    """(wrong, right, category) in both directions; the first one of a spelling counts."""
    out: dict[str, tuple[str, str, str]] = {}
    for cat, own in (YO_PAIRS if pairs is None else pairs).items():
        for plain, yo in own:
            out.setdefault(plain.lower(), (plain, yo, cat))
            if plain != yo:
                out.setdefault(yo.lower(), (yo, plain, cat))
    for alt, right in names:
        out.setdefault(alt.lower(), (alt, right, "имена"))
    return list(out.values())


def _yo_pattern(word: str) -> str:
    return rf"(?U)(?<![\wёЁ])(?iu:{re.escape(word)})(?![\wёЁ])"


def yo_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(cat, wrong, right, n, documents) of spellings met, ё and е told apart."""
    targets = yo_targets() if targets is None else targets
    low = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_t"), F.lower(F.col(text_col)).alias("_l"))

    def counted(w: str, r: str, c: str) -> Column:
        n = F.regexp_count("_t", F.lit(_yo_pattern(w))).cast("long")
        return F.struct(F.lit(c).alias("cat"), F.lit(w).alias("wrong"), F.lit(r).alias("right"), F.when(F.col("_l").contains(w.lower()), n).otherwise(F.lit(0).cast("long")).alias("n"))

    rows = low.select(F.explode(F.array(*[counted(*t) for t in targets])).alias("s")).where("s.n > 0").select("s.*")
    return rows.groupBy("cat", "wrong", "right").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def yo_occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: list[tuple[str, str, str]] | None = None, width: int = 30, longest: int = 80) -> DataFrame:
    """(id, line_no, found, right, cat, fragment): every place of a spelling, ё and е told apart, with its surroundings."""
    targets = yo_targets() if targets is None else targets
    words = "|".join(re.escape(w) for w, _, _ in sorted(targets, key=lambda t: (-len(t[0]), t[0])))
    pattern = rf"(?U)(?<![\wёЁ])(?iu:{words})(?![\wёЁ])"  # all spellings in one pass; which one it is, the word itself tells
    known = F.create_map(*[F.lit(x) for w, r, c in targets for x in (w.lower(), f"{r}\x01{c}")])
    lines = df.where(F.col(text_col).rlike(pattern)).select(F.col(id_col), F.posexplode(T.lines(F.regexp_replace(F.col(text_col), r"^\x{feff}", ""))).alias("n", "line"))
    hits = lines.where(F.col("line").rlike(pattern)).select(id_col, (F.col("n") + 1).alias("line_no"), "line", F.explode(T.offsets(F.col("line"), pattern)).alias("m"))
    told = F.split(known[F.lower("m.hit")], "\x01")
    begin = F.greatest(F.col("m.pos") - width, F.lit(0))
    body = T.strip(F.substring("line", begin + 1, F.col("m.pos") + F.length("m.hit") + width - begin))
    return hits.select(id_col, "line_no", F.col("m.hit").alias("found"), told[0].alias("right"), told[1].alias("cat"), F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(body, 1, longest)).alias("fragment"))


def yo_letters(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: letters (ё and Ё of all texts), documents with any."""
    n = F.regexp_count(F.col(text_col), F.lit("[ёЁ]"))
    return df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("letters"), F.count(F.when(n > 0, 1)).alias("documents"))


def yo_fix(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words replaced, the first letter's case kept."""
    for wrong, right in pairs:
        text = replace_word(text, wrong, right)
    return text


# Stock phrases, and what to put in their place ("": cut out).
PHRASE_MAP = {
    "стоит отметить, что": "", "важно отметить, что": "", "необходимо отметить, что": "", "следует отметить, что": "", "нужно отметить, что": "",
    "стоит отметить,": "", "важно отметить,": "", "в заключение стоит сказать, что": "", "подводя итог,": "", "таким образом,": "", "в конечном итоге": "в итоге",
    "в современном мире": "сегодня", "в наше время": "сегодня", "на сегодняшний день": "сегодня", "с каждым днем": "всё чаще", "все чаще и чаще": "всё чаще",
    "имеет большое значение": "важно", "имеет огромное значение": "крайне важно", "не вызывает сомнений": "очевидно", "трудно переоценить": "крайне важно",
    "как известно,": "", "известно, что": "", "играет важную роль в": "важен для", "играет ключевую роль в": "определяет", "не секрет, что": "",
    "давайте рассмотрим": "рассмотрим", "давайте разберёмся": "разберёмся", "перейдём к следующему": "далее", "с одной стороны": "", "с другой стороны": "зато",
    "тем не менее,": "однако", "в целом, можно сказать, что": "", "можно с уверенностью сказать, что": "",
}

# Stock phrases of generated text, set descriptions and officialese; the default list to look for.
STOCK_PHRASES = [
    "стоит отметить, что", "важно отметить, что", "необходимо отметить", "следует отметить", "в заключение стоит сказать", "подводя итог", "таким образом,", "в конечном итоге", "в целом, можно сказать",
    "с одной стороны", "с другой стороны", "тем не менее,", "однако, важно понимать", "не секрет, что", "давайте рассмотрим", "давайте разберёмся", "перейдём к следующему",
    "особое внимание", "играет важную роль", "играет ключевую роль", "в современном мире", "в наше время", "на сегодняшний день", "по сей день", "в последние годы", "все чаще и чаще", "широко распространено", "с каждым днем",
    "в рамках данного", "в рамках реализации", "в целях повышения", "в соответствии с требованиями", "в связи с вышеизложенным", "осуществляет деятельность", "осуществление деятельности", "имеет место быть",
    "данный метод позволяет", "данный подход позволяет", "данный вопрос требует", "в процессе работы над данным", "комплексный подход", "эффективное решение", "инновационные технологии", "оптимизация процессов",
    "выполнение поставленных задач", "реализация поставленных задач", "представляет собой", "в случае возникновения", "при необходимости можно", "является целесообразным", "целесообразно рассмотреть", "необходимо провести",
    "существует необходимость", "имеет большое значение", "имеет огромное значение", "не вызывает сомнений", "трудно переоценить", "как известно,", "известно, что",
]
