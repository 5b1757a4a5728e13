"""Text cleaners: white space, separators, typography, phrases. The source is never changed: each gives a new column.

All are projections over the lines of a text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriptor.functions import state
from skriptor.functions import text as T
from skriptor.functions import words as W

CYR = "А-Яа-яЁё"
CAPITAL = "А-ЯЁ"

# Contexts a rule of typography may ask for, each one character wide; "": anything.
CONTEXT = {
    "": "", "letter": f"[{CYR}]", "capital": f"[{CAPITAL}]", "solid": r"\S", "blank": r"\s", "digit": r"\d",
    "no letter": rf"[^{CYR}\w-]", "no dash": r"[^\s—–-]", "opens": f"[{CYR}«(]", "sentence": f"[{CAPITAL}«—(]", "no pipe": r"[^\s|]",
}
FAMILIES = ("dots", "dash", "quotes", "punct", "nbsp")


@dataclass(frozen=True)
class Setting:
    """One rule of typography: what stands between two contexts, and its image; counted under its family.

    ``start`` lets the beginning of a stretch stand for the left context.
    """

    family: str
    left: str
    what: str
    right: str
    image: str
    start: bool = False

    @property
    def pattern(self) -> str:
        before, after = CONTEXT[self.left], CONTEXT[self.right]
        look = (f"(?<={before})" if not self.start else f"(?:^|(?<={before}))") if before else ""
        return f"(?U){look}{self.what}" + (f"(?={after})" if after else "")


def _short(words: list[str]) -> str:
    return "|".join(words)


# Abbreviations that are written apart, units and words that stay with a number or with the next word.
AFTER_T = "дпченко"  # т. д., т. п., т. ч., т. е., т. н., т. к., т. о.
UNITS = ["гг?\\.", "вв?\\.", "тыс\\.", "млн", "млрд", "руб\\.", "коп\\.", "стр\\."]

#: Signs: blanks before them go, one blank follows; abbreviations apart; runs of blanks become one.
SIGNS = [
    Setting("punct", "no letter", rf"т\.(?=[{AFTER_T}]\.)", "", "т. ", start=True),
    Setting("punct", "solid", r" +(?=[,.;:!?…](?!\)))", "", ""),
    Setting("punct", "", r"(?<=[,;])", "opens", " "),
    Setting("punct", "", r"(?<=[.!?…])(?!\(\))", "sentence", " "),
    Setting("punct", "solid", "  +", "no pipe", " "),
]
POINTS = [Setting("dots", "", r"(?<=[?!])\.\.\.+", "", ".."), Setting("dots", "", r"\.\.\.+", "", "…")]
BARS = [
    Setting("dash", "solid", " - ", "solid", " — "),
    Setting("dash", "solid", "(?: -- |--)", "solid", " — "),
    Setting("dash", "blank", "—", "solid", "— "),
    Setting("dash", "", r"(?<=\d{4})-(?=\d{4})", "", "—"),
    Setting("dash", "digit", "–", "digit", "—"),
]
SPEECH = [Setting("dash", "", r"^(\s*)- ", "solid", "$1— ")]
INSIDE = [Setting("quotes", "", "([«„]) +", "no dash", "$1"), Setting("quotes", "no dash", " +(?=[»“])", "", "")]
#: No-break spaces: initials, abbreviations, numbers with what they count, short words, the number sign, before a dash.
TIES = [
    Setting("nbsp", "capital", r"\. ", "capital", ".\u00a0"),
    Setting("nbsp", "no letter", r"и (?=(?:др|пр|т)\.)", "", "и\u00a0", start=True),
    Setting("nbsp", "no letter", rf"т\. (?=[{AFTER_T}]\.)", "", "т.\u00a0", start=True),
    Setting("nbsp", "digit", f" (?=(?:{_short(UNITS)}|[{CYR}A-Za-z«]))", "", "\u00a0"),
    Setting("nbsp", "no letter", f"((?iu:{_short(W.NBSP_WORDS)})) ", "solid", "$1\u00a0", start=True),
    Setting("nbsp", "", "№ ", "solid", "№\u00a0"),
    Setting("nbsp", "solid", " (?=—(?:\\s|$))", "", "\u00a0"),
]

# Classes of typography issues; None: opening and closing quotation marks that don't match.
ISSUES = [
    ("straight_quotes", ['"']),
    ("unpaired_quotes", None),
    ("double_space", [SIGNS[4].pattern]),
    ("space_before_sign", [SIGNS[1].pattern]),
    ("no_space_after_sign", [SIGNS[2].pattern, SIGNS[3].pattern]),
    ("hyphen_for_dash", [BARS[0].pattern, r"(?<=\S)--(?=\S)"]),
    ("dots_for_ellipsis", [POINTS[1].pattern]),
    ("hyphen_in_years", [BARS[3].pattern]),
    ("dots_after_mark", [POINTS[0].pattern]),
    ("space_in_quotes", [x.pattern for x in INSIDE]),
]


def _replaced(s: Column, rules: list[Setting]) -> Column:
    for r in rules:
        s = F.regexp_replace(s, r.pattern, r.image)
    return s


def over_lines(text: Column, fn: Callable[[Column], Column], front_matter: bool = False) -> Column:
    """``text`` with ``fn`` applied to each line outside fences (and front matter)."""
    marked = state.masked_lines(text, front_matter=front_matter)
    return F.array_join(F.transform(marked, lambda x: F.when(x["masked"], x["line"]).otherwise(fn(x["line"]))), "\n")


def outside_code(line: Column, fn: Callable[[Column], Column], unpaired: Callable[[Column], Column] | None = None) -> Column:
    """``fn`` on the stretches of a line outside inline code; ``unpaired`` on lines with an odd number of backticks."""
    parts = F.split(line, "`")
    paired = F.size(parts) % 2 == 1
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, fn(s)).otherwise(s)), "`")
    return F.when(paired, joined).otherwise((unpaired or fn)(line))


def clean_whitespace(text: Column, max_blank: int = 1, keep_breaks: bool = False) -> Column:
    """Outside fences no trailing blanks, no tabs, single spaces; at most ``max_blank`` blank lines in a
    row, none at the start; one line end at the end.  ``keep_breaks`` keeps two trailing spaces."""

    def line(s: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(s, rf"[{T.SPACE}]+$", ""), r"[ \t]{2,}|\t", " ")
        return F.when(s.endswith("  ") & (body != ""), F.concat(body, F.lit("  "))).otherwise(body) if keep_breaks else body

    out = over_lines(text, line)
    out = F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"\n{%d,}" % (max_blank + 2), "\n" * (max_blank + 1))
    out = F.regexp_replace(out, r"\n+\z", "")
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))


SEPARATORS = "*/=~-_+%&@•·—–§"


def clean_separators(text: Column, symbols: str = SEPARATORS, min_run: int = 3, max_blank: int = 1, front_matter: bool = False) -> Column:
    """Without lines of one symbol repeated ``min_run`` times or more (single spaces allowed), outside
    fences and front matter; where they stood between texts ``max_blank`` blank lines remain."""
    chars = "".join("\\" + c for c in symbols)
    junk = rf"^[{T.SPACE}]*([{chars}])(?: *\1){{{max(min_run, 1) - 1},}}[{T.SPACE}]*$"
    marked = over_lines(text, lambda s: F.when(s.rlike(junk), "\x01").otherwise(s), front_matter)
    head = F.regexp_extract(marked, r"^[\n\x01]*\x01[\n\x01]*", 0)
    blanks = F.length(F.regexp_replace(head, "\x01", "")) - F.length(F.regexp_replace(head, "\n", ""))
    out = F.concat(F.repeat(F.lit("\n"), F.greatest(F.least(F.lit(max_blank), blanks), F.lit(0))), F.regexp_replace(marked, r"^[\n\x01]*\x01[\n\x01]*", ""))
    out = F.regexp_replace(out, r"[\n\x01]*\x01[\n\x01]*\z", "")
    out = F.regexp_replace(out, r"(?<=[^\n\x01])\n+\x01[\n\x01]*(?=[^\n\x01])", "\n" * (max_blank + 1))
    out = F.regexp_replace(out, r"\n+\z", "")
    return F.when(~marked.contains("\x01"), text).when(out == "", "").when(text.endswith("\n"), F.concat(out, F.lit("\n"))).otherwise(out)


def separator_lines(text: Column, symbols: str = SEPARATORS, min_run: int = 3, front_matter: bool = False) -> Column:
    """Number of lines that ``clean_separators`` removes."""
    chars = "".join("\\" + c for c in symbols)
    junk = rf"^[{T.SPACE}]*([{chars}])(?: *\1){{{max(min_run, 1) - 1},}}[{T.SPACE}]*$"
    return F.size(F.filter(F.split(over_lines(text, lambda s: F.when(s.rlike(junk), "\x01").otherwise(s), front_matter), "\n"), lambda s: s == "\x01"))


def _quotes(s: Column) -> Column:
    """Straight quotation marks in pairs with Cyrillic inside become «», or „“ where «» are already there."""
    s = F.regexp_replace(s, "„([^“\"]*)“", "«$1»")
    parts = F.split(s, '"')
    inside = F.filter(parts, lambda x, i: i % 2 == 1)
    fits = (F.size(parts) > 1) & (F.size(parts) % 2 == 1) & ~s.contains("=") & ~s.rlike(r"https?://|www\.|\]\(") & F.forall(inside, lambda x: x.rlike(f"[{CYR}]"))
    return F.when(fits & s.contains("«"), F.regexp_replace(s, '"([^"]*)"', "„$1“")).when(fits, F.regexp_replace(s, '"([^"]*)"', "«$1»")).otherwise(s)


def typography(text: Column, nbsp: bool = False, dialogue: bool = False, front_matter: bool = False) -> Column:
    """Russian typography outside fences, front matter and inline code: punctuation, ellipses, dashes
    and ranges, quotation marks, then, if asked for, no-break spaces and dialogue dashes."""

    def rules(with_nbsp: bool) -> Callable[[Column], Column]:
        def apply(s: Column) -> Column:
            s = _replaced(_quotes(_replaced(s, _before_quotes(dialogue))), INSIDE)
            return _replaced(s, TIES) if with_nbsp else s

        return apply

    return over_lines(text, lambda line: outside_code(line, rules(nbsp), rules(False)), front_matter)


def _before_quotes(dialogue: bool) -> list[Setting]:
    return [*SIGNS, *POINTS, *BARS, *(SPEECH if dialogue else [])]


def typography_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", nbsp: bool = False, dialogue: bool = False, front_matter: bool = False) -> DataFrame:
    """(id, one count for each rule family): what ``typography`` with these settings replaces, rule after rule, outside code."""
    marked = F.filter(state.masked_lines(F.col(text_col), front_matter=front_matter), lambda x: ~x["masked"])

    def stretches(line: Column) -> Column:
        parts = F.split(line, "`")
        paired = F.size(parts) % 2 == 1
        own = F.when(paired, F.filter(parts, lambda x, i: i % 2 == 0)).otherwise(F.array(line))
        return F.transform(own, lambda x: F.struct(x.alias("s"), paired.alias("paired"), *[F.lit(0).alias(f) for f in FAMILIES]))

    def step(found: Column, rule: Setting) -> Column:
        def one(x: Column) -> Column:
            n = F.regexp_count(x["s"], F.lit(rule.pattern))
            applies = x["paired"] if rule.family == "nbsp" else F.lit(True)
            counts = [(x[f] + F.when(applies, n).otherwise(0) if f == rule.family else x[f]).alias(f) for f in FAMILIES]
            return F.struct(F.when(applies, F.regexp_replace(x["s"], rule.pattern, rule.image)).otherwise(x["s"]).alias("s"), x["paired"].alias("paired"), *counts)

        return F.transform(found, one)

    def quoted(x: Column) -> Column:
        after = _quotes(x["s"])
        marks = lambda s: F.length(s) - F.length(F.translate(s, '"„“', ""))
        n = F.when(after == x["s"], 0).otherwise(F.floor((marks(x["s"]) + F.length(after) - F.length(F.translate(after, "«»„“", "")) - (F.length(x["s"]) - F.length(F.translate(x["s"], "«»„“", "")))) / 4))
        return F.struct(after.alias("s"), x["paired"].alias("paired"), *[(x[f] + n.cast("int") if f == "quotes" else x[f]).alias(f) for f in FAMILIES])

    found = F.flatten(F.transform(marked, lambda x: stretches(x["line"])))
    for rule in _before_quotes(dialogue):
        found = step(found, rule)
    found = F.transform(found, quoted)
    for rule in [*INSIDE, *(TIES if nbsp else [])]:
        found = step(found, rule)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), found.alias("_f"))
    total = lambda family: F.aggregate("_f", F.lit(0).cast("long"), lambda acc, x: acc + x[family])
    return rows.select(id_col, *[total(f).alias(f) for f in FAMILIES])


def typography_check(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, issue, fragment): at most one finding an issue and line, outside fences, front matter and inline code."""
    lines = state.state_lines(df, id_col, text_col).where("not masked")
    parts = F.split("line", "`")
    segments = F.when(F.size(parts) % 2 == 1, F.filter(parts, lambda x, i: i % 2 == 0)).otherwise(F.array("line"))
    rows = lines.select(id_col, "line_no", segments.alias("segs"))
    found = []
    for name, patterns in ISSUES:
        first = F.get(F.filter("segs", _test(patterns)), F.lit(0))
        found.append(F.when(first.isNotNull(), F.struct(F.lit(name).alias("issue"), F.substring(T.strip(first), 1, 80).alias("fragment"))))
    return rows.select(id_col, "line_no", F.explode(F.array_compact(F.array(*found))).alias("f")).select(id_col, "line_no", "f.issue", "f.fragment")


def _test(patterns: list[str] | None) -> Callable[[Column], Column]:
    if patterns is None:
        return lambda s: F.length(F.replace(s, F.lit("«"), F.lit(""))) != F.length(F.replace(s, F.lit("»"), F.lit("")))
    return lambda s: s.rlike("|".join(patterns))


def _phrase(phrase: str) -> str:
    body = "".join("[её]" if c in "её" else "\\" + c if c in r".^$*+?()[]{}|\/-" else c for c in phrase.lower())
    return f"(?iu:{body})"


def _image(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def replace_phrase(s: Column, phrase: str, image: str = "") -> Column:
    """A phrase replaced, with a capital at the start of a sentence; ё as е, case ignored.

    Without an image it is cut out: one space remains inside a line, none at its
    edges; blanks before a line end stay.
    """
    p = _phrase(phrase)
    if image:
        s = F.regexp_replace(s, rf"(^|[.!?\n\r])([ \t]*){p}", "$1$2" + _image(image[:1].upper() + image[1:]))
        return F.regexp_replace(s, p, _image(image))
    s = F.regexp_replace(s, rf"(?<=[^ \t\r\n])[ \t]*{p}[ \t]*(?=[^ \t\r\n])", " ")
    s = F.regexp_replace(s, rf"(^|[\r\n])[ \t]*{p}[ \t]*(?=[^ \t\r\n])", "$1")
    return F.regexp_replace(s, rf"[ \t]*{p}", "")


def replace_phrases(s: Column, mapping: dict[str, str]) -> Column:
    """All phrases of a mapping, the longest first."""
    for phrase in sorted(mapping, key=lambda x: (-len(x), x)):
        s = replace_phrase(s, phrase, mapping[phrase])
    return s


def replace_word(s: Column, wrong: str, right: str) -> Column:
    """A whole word replaced; its first letter's case is kept.  ё and е differ."""
    w = "".join("\\" + c if c in r".^$*+?()[]{}|\/-" else c for c in wrong)
    head, tail = (w[:2], w[2:]) if w.startswith("\\") else (w[:1], w[1:])
    edge = r"(?U)(?<![\wёЁ]){}(?iu:{})(?![\wёЁ])"
    s = F.regexp_replace(s, edge.format(head.upper(), tail), _image(right[:1].upper() + right[1:])) if head.upper() != head else s
    return F.regexp_replace(s, edge.format(head, tail), _image(right))


def replace_all(df: DataFrame, text_col: str, old: str, new: str, regex: bool = False, path_col: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """``df`` with ``text_new`` and ``changes``: literal or pattern replaced where the path fits."""
    c = F.col(text_col)
    pattern = old if regex else "".join("\\" + x if x in r".^$*+?()[]{}|\/-" else x for x in old)
    fits = F.lit(True)
    if path_col and include:
        fits &= F.col(path_col).rlike(include)
    if path_col and exclude:
        fits &= ~F.col(path_col).rlike(exclude)
    fits = F.coalesce(fits, F.lit(False))
    return df.withColumn("changes", F.when(fits & c.isNotNull(), F.regexp_count(c, F.lit(pattern))).otherwise(0)).withColumn(
        "text_new", F.when(fits, F.regexp_replace(c, pattern, new if regex else _image(new))).otherwise(c)
    )


def replace_icons(s: Column, icons: dict[str, str]) -> Column:
    """Emoji and other marks replaced, the longest first."""
    for k in sorted(icons, key=lambda x: (-len(x), x)):
        s = F.replace(s, F.lit(k), F.lit(icons[k]))
    return s


ICON_STYLE = ".icon { width: 1em; height: 1em; vertical-align: -0.125em; }"
ICON_MARK = "/* icons */"


def icons_in_page(page: Column, icons: dict[str, str], style: str = ICON_STYLE, always: list[str] = ()) -> Column:
    """A page with its icons replaced by markup: assignments of texts that hold one (or a sign of ``always``) become
    assignments of markup, and the style goes once into its style sheet.  A page that was done before stays as it is."""
    signs = "|".join("\\Q" + k + "\\E" for k in sorted(icons, key=lambda x: (-len(x), x)))
    if not signs:
        return page
    asked = "|".join([signs, *("\\Q" + x + "\\E" for x in always)])
    rows = F.transform(F.split(page, "\n"), lambda x: F.when(x.rlike(asked), F.regexp_replace(x, r"^(.*?)\.textContent = ", "$1.innerHTML = ")).otherwise(x))
    body = replace_icons(F.array_join(rows, "\n"), icons)
    styled = F.regexp_replace(body, r"^((?s).*?)</style>", "$1" + _image(f"{ICON_MARK} {style}\n") + "</style>")
    return F.when(page.contains(ICON_MARK) | ~page.rlike(asked), page).otherwise(styled)


def icon_counts(page: Column, icons: dict[str, str]) -> Column:
    """map<icon, n> of a text, the longest icon at a place first."""
    signs = "|".join("\\Q" + k + "\\E" for k in sorted(icons, key=lambda x: (-len(x), x)))
    hits = T.matches(page, signs) if signs else F.array().cast("array<string>")
    keys = F.array_distinct(hits)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(hits, lambda h: h == k))))


def apply_selection(lines: DataFrame, selection: DataFrame, mapping: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """(id, text_new): only the chosen (id, line_no, phrase) replaced.

    lines: id, line_no, line.  The lines of a text are put together again in order.
    """
    chosen = selection.select(id_col, "line_no", "phrase").distinct().groupBy(id_col, "line_no").agg(F.collect_set("phrase").alias("phrases"))
    out = F.col("line")
    for phrase in sorted(mapping, key=lambda x: (-len(x), x)):
        out = F.when(F.array_contains(F.coalesce("phrases", F.array().cast("array<string>")), phrase), replace_phrase(out, phrase, mapping[phrase])).otherwise(out)
    changed = lines.join(chosen, [id_col, "line_no"], "left").select(id_col, F.struct("line_no", out.alias("l")).alias("s"))
    return changed.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["l"]), "\n").alias("text_new"))
