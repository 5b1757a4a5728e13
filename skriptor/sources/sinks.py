"""Writing results: new versions of texts, reports, diaries, notes, registries. Sources are never written to."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriptor.session import prepare


def write_texts(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """New text versions as Parquet at a new place; the source is the backup, so the place must not exist."""
    writer = df.write.mode("error")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_versions(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", new_col: str = "text_new") -> None:
    """Changed texts as a new version below ``path``, and the texts as they were as ``first``, which no later run replaces.

    The version is numbered by what lies there already; unchanged texts are in neither.
    """
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []
    changed = df.where(~F.col(text_col).eqNullSafe(F.col(new_col)))
    first = changed.select(id_col, F.col(text_col).alias("text"))
    if "first" in held:
        first = first.join(spark.read.parquet(f"{path}/first*").select(id_col), id_col, "left_anti")
    number = 1 + sum(x.startswith("version") for x in held)
    first.write.mode("error").parquet(f"{path}/first" if "first" not in held else f"{path}/first{number}")
    changed.select(id_col, F.col(new_col).alias("text")).write.mode("error").parquet(f"{path}/version{number}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def append_diary(stats: DataFrame, path: str) -> None:
    """(stamp, file, words, sents, avg_sent, dialog_share) added to a diary folder of CSV files with ``;``."""
    rows = stats.select(F.date_format("stamp", "yyyy-MM-dd HH:mm").alias("stamp"), "file", "words", "sents", "avg_sent", "dialog_share")
    rows.write.mode("append").csv(path, sep=";", header=True)


def append_log(findings: DataFrame, path: str, stamp: str) -> None:
    """A run's findings added to a log, one Parquet part of it for each stamp."""
    findings.withColumn("run", F.lit(stamp)).write.mode("append").partitionBy("run").parquet(path)


def report(df: DataFrame, title: str, limit: int | None = 40) -> str:
    """A markdown table of a result's first rows (None: of all), which says so where there are more; for small, aggregated results."""
    rows = df.limit(limit + 1).collect() if limit else df.collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = ["# " + title, "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    more = [] if not limit or len(rows) <= limit else ["", f"The first {limit} rows; there are more."]
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows[: limit or len(rows)]), *more, ""])


def write_report(text: str, path: str) -> None:
    """A report as a file; ``-`` prints it, missing folders are made."""
    if path == "-":
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def registry_yaml(df: DataFrame, top: int | None = 1000) -> str:
    """The ``top`` most frequent candidates (name, n) as a registry in YAML (None: all); a comment says where it is cut."""
    ordered = df.orderBy(F.desc("n"), "name")
    rows = ordered.limit(top + 1).collect() if top else ordered.collect()
    cut = [f"# the {top} most frequent; there are more"] if top and len(rows) > top else []
    return "\n".join([*cut, registry_text([(r["name"], [r["name"]], [], [], []) for r in rows[: top or len(rows)]])])


_FIELDS = ("формы", "старое", "старое_опасное", "опечатки")


def registry_text(rows: list[tuple]) -> str:
    """A registry of (name, forms, old_forms, old_dangerous, typos), all lists kept, as ``read_registry`` reads it."""
    quote = lambda s: json.dumps(str(s), ensure_ascii=False)
    out = ["персонажи:"]
    for name, *lists in rows:
        out.append(f"- имя: {quote(name)}")
        out += [f"  {field}: [{', '.join(quote(x) for x in items or [])}]" for field, items in zip(_FIELDS, lists)]
    return "\n".join(out) + "\n"


def write_registry(entries: DataFrame, path: str) -> None:
    """The entries of one vault's registry as a file, which takes the place of an older one only when it is whole."""
    rows = entries.where(r"name rlike '\\S'").select("name", "forms", "old_forms", "old_dangerous", "typos").orderBy("name").collect()  # a file read by people
    text = registry_text([tuple(r) for r in rows])
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


_MARKS = re.compile(r"\*\*(?P<b>[^*]+)\*\*|__(?P<b2>[^_]+)__|(?<![\w*])\*(?P<i>[^*\s][^*]*)\*(?!\w)|(?<!\w)_(?P<i2>[^_\s][^_]*)_(?!\w)|`(?P<code>[^`]+)`|~~(?P<s>[^~]+)~~")
_FORMATS = {"b": "<w:b/>", "i": "<w:i/>", "s": "<w:strike/>", "code": '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>'}


def _run(text: str, marks: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""


def inline_runs(text: str) -> str:
    """Runs of a line with bold, italic, struck and code text."""
    out, at = [], 0
    for m in _MARKS.finditer(text):
        kind = m.lastgroup
        out += [_run(text[at : m.start()]), _run(m[kind], _FORMATS[kind.rstrip("2")])]
        at = m.end()
    return "".join([*out, _run(text[at:])])


def _table_row(row: str) -> str:
    """Cells of a table row as text parted by tabs; none for the row of hyphens."""
    cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]
    return "" if all(re.fullmatch(r":?-+:?", c) for c in cells) else "\t".join(cells)


def docx_bytes(blocks: list[tuple[str, int, str]]) -> bytes:
    """A Word document of (kind, level, content) blocks in order."""
    style = {"heading": "Heading{}", "bullet": "ListBullet", "number": "ListNumber", "quote": "Quote", "code": "Code"}
    body = []
    for kind, level, content in blocks:
        name = style.get(kind, "Normal").format(level)
        if kind == "table" and not (content := _table_row(content)):
            continue
        runs = _run(content, _FORMATS["code"]) if kind == "code" else inline_runs(content)
        body.append(f'<w:p><w:pPr><w:pStyle w:val="{name}"/></w:pPr>{runs}</w:p>')
    document = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(body) + "</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", document)
    return out.getvalue()


def export_docx(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): each text's blocks (id, line_no, kind, level, content) as a Word document."""
    prepare(blocks.sparkSession)
    packed = blocks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "level", "content"))).alias("b"))  # one text's lines

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({id_col: x[id_col], "content": [docx_bytes([(r["kind"], r["level"], r["content"]) for r in b]) for b in x["b"]]})

    return packed.mapInPandas(run, f"{id_col} {blocks.schema[id_col].dataType.simpleString()}, content binary")
