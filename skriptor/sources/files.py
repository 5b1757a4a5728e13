"""Reading a corpus from files: listing, decoding, Word documents, pages, registries, rules, diaries."""

from __future__ import annotations

import io
import os
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skriptor.functions import text as T
from skriptor.functions import words as W
from skriptor.operators.rules import Rule, make_rules
from skriptor.session import prepare
from skriptor.sources import plain

MAX_BYTES = 64 << 20
CODEPAGES = ("cp1251", "koi8-r", "cp866", "cp1252")
REGISTRY_SCHEMA = "name string, forms array<string>, old_forms array<string>, old_dangerous array<string>, typos array<string>"
DIARY_SCHEMA = "stamp timestamp, file string, words int, sents int, avg_sent double, dialog_share double"


def check_root(root: str | None) -> str:
    """The path as given; a ValueError where it is empty or, if local, missing."""
    if not root or not str(root).strip():
        raise ValueError("an input path is needed")
    if "://" not in str(root) and not os.path.exists(root):
        raise ValueError(f"there is no {root}")
    return str(root)


def in_service_folder(path: Column, folders: list[str] | None = None) -> Column:
    """Whether a path leads through a folder that a walk leaves out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, W.SERVICE_FOLDERS if folders is None else folders)))


def listed(df: DataFrame, path_col: str = "path", extensions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of files with one of the extensions, outside service folders, no backups; ``limit`` of 0 or less is none."""
    own = [e.lower().lstrip(".") for e in (W.TEXT_EXTENSIONS if extensions is None else extensions)]
    kept = df.where(F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1)).isin(own) & ~in_service_folder(F.col(path_col)))
    return kept.orderBy(path_col).limit(limit) if limit and limit > 0 else kept


# The most frequent letters of Russian, from the most frequent on; letters of other languages score half.
FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"


def plausibility(text: str) -> float:
    """How much a decoded text reads like prose: frequent small letters and punctuation speak for it,
    capitals within words, controls and drawing signs against."""
    score, before = 0.0, ""
    for c in text:
        if c.isalpha() and before.isalpha() and ("а" <= c.lower() <= "ё") != ("а" <= before.lower() <= "ё"):
            score -= 1.5  # two scripts in one word
        if c in FREQUENT:
            score += 1 - FREQUENT.index(c) / 50
        elif c.isalpha():
            score += (0.5 if c.isascii() else 0.3) if not (c.isupper() and before.islower()) else -1
        elif not c.isascii():
            score += 0.2 if c in "«»—–…№“”„’" else -1
        elif not c.isprintable() and c not in "\r\n\t":
            score -= 2
        before = c
    return score / max(1, sum(not c.isascii() or c.isalpha() for c in text))


def detect_encoding(data: bytes, sample: int = 65536) -> str:
    """Encoding of bytes: UTF-8 where they are that, else by the share of bytes in the upper Cyrillic ranges,
    else the code page under which the first ``sample`` bytes beyond ASCII, with their surroundings, read best."""
    try:
        data.decode("utf-8")
        return "utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8"
    except UnicodeDecodeError:
        pass
    upper = sum(0xC0 <= b <= 0xDF for b in data)
    lower = sum(0xE0 <= b <= 0xFE for b in data)
    if upper + lower > 0.2 * len(data):
        # lower-case Russian lies in the second range of cp1251 and in the first of koi8-r
        return "koi8-r" if upper >= lower else "cp1251"
    begin = next((i for i, b in enumerate(data) if b > 127), 0)
    piece = data[max(0, begin - 64) : begin + sample]
    best = None
    for name in CODEPAGES:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        score = plausibility(piece.decode(name, "replace"))
        if best is None or score > best[0] + 1e-9:
            best = score, name
    return best[1] if best else "latin-1"


def decode(data: bytes) -> str:
    """Text of bytes in the encoding found."""
    return data.decode(detect_encoding(data), "replace")


def bad_utf8_line(data: bytes) -> int | None:
    """1-based line of the first byte that is no UTF-8."""
    try:
        data.decode("utf-8")
        return None
    except UnicodeDecodeError as e:
        return data.count(b"\n", 0, e.start) + 1


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = ("word/document.xml", "word/header", "word/footer", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")


def docx_text(data: bytes) -> str:
    """Filled paragraphs of a Word document's body, headers, footers, notes and comments, one a line; empty where it can't be read."""
    out: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for part in _PARTS:
                for name in sorted(n for n in z.namelist() if n.startswith(part) and n.endswith(".xml")):
                    for p in ElementTree.fromstring(z.read(name)).iter(f"{_W}p"):
                        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
                        if text.strip():
                            out.append(text)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return ""
    return "\n".join(out)


def decoded(df: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """``df`` without its bytes, with text, encoding and bad_line (of the first byte that is no UTF-8).

    Valid UTF-8 is decoded by the JVM; only other bytes and Word documents reach Python.
    """
    prepare(df.sparkSession)
    c = F.col(content_col)
    docx = F.lower(F.col(path_col)).endswith(".docx")

    @F.pandas_udf("text string, encoding string, bad_line int")
    def by_python(content: pd.Series, is_docx: pd.Series) -> pd.DataFrame:
        got = []
        for b, d in zip(content, is_docx):
            if b is None:
                got.append((None, None, None))
            elif d:
                got.append((docx_text(b), "docx", None))
            else:
                got.append((decode(b), detect_encoding(b), bad_utf8_line(b)))
        return pd.DataFrame(got, columns=["text", "encoding", "bad_line"])

    plain = ~docx & F.coalesce(F.is_valid_utf8(c.cast("string")), F.lit(False))
    other = by_python(F.when(plain, F.lit(None)).otherwise(c), docx)
    rows = df.withColumn("_o", other).withColumn("_plain", plain)
    raw = F.when(F.col("_plain"), F.decode(c, "utf-8")).otherwise(F.col("_o.text"))
    text = F.regexp_replace(raw, r"^\x{feff}", "")
    encoding = F.when(F.col("_plain"), F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", "utf-8-sig").otherwise("utf-8")).otherwise(F.col("_o.encoding"))
    return rows.select(*[x for x in df.columns if x != content_col], text.alias("text"), encoding.alias("encoding"), F.col("_o.bad_line").alias("bad_line"))


def read_corpus(spark: SparkSession, root: str, extensions: list[str] | None = None, limit: int | None = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, ext, length, text, encoding, bad_line) of the files below a folder; pages come as text.

    Files over ``max_bytes`` are left out (0 or None: none is); see ``oversized``.
    Files without a byte, which make no split, have a row with an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(check_root(root))
    kept = files.where(F.col("length") <= max_bytes) if max_bytes else files
    rows = decoded(listed(kept, "path", extensions).select("path", "length", "content"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(ext.isin("html", "htm"), T.html_to_text(F.col("text"))).otherwise(F.col("text"))
    out = rows.select("path", ext.alias("ext"), "length", text.alias("text"), "encoding", "bad_line")
    none = listed(empty_files(spark, root), "path", extensions)
    out = out.unionByName(none.select("path", ext.alias("ext"), F.lit(0).cast("long").alias("length"), F.lit("").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(None).cast("int").alias("bad_line")))
    return out.orderBy("path").limit(limit) if limit and limit > 0 else out


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files without a byte below a folder; names only, listed by the driver as a scan's files are."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(check_root(root))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, walk = [], system.listFiles(path, True)
    while walk.hasNext():
        status = walk.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def oversized(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length) of the files that ``read_corpus`` leaves out for their size; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(check_root(root)).select("path", "length").where(F.col("length") > max_bytes)


def encoding_audit(df: DataFrame) -> DataFrame:
    """(encoding, files) of decoded files, and how many of each aren't UTF-8."""
    return df.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("bad_line").isNotNull(), 1)).alias("not_utf8"))


def _yaml(path: str):
    with open(path, encoding="utf-8") as f:
        return plain.load(f.read())


def _dictionary(path: str | None):
    """A dictionary file's value; None where it is missing or can't be read."""
    try:
        return _yaml(path) if path else None
    except (OSError, ValueError):
        return None


def _strings(items) -> list[str]:
    return list(dict.fromkeys(str(x).strip() for x in items if x is not None and str(x).strip())) if isinstance(items, list) else []


def read_words(path: str | None, default: list[str]) -> list[str]:
    """Words or phrases of a dictionary: a list, or all lists of a mapping in turn, the first of equal ones; ``default`` where there are none."""
    data = _dictionary(path)
    items = [x for v in data.values() for x in _strings(v)] if isinstance(data, dict) else _strings(data)
    return list(dict.fromkeys(items)) or list(default)


def read_mapping(path: str | None, default: dict[str, str]) -> dict[str, str]:
    """What to put in the place of each phrase; a null or missing image cuts it out.  ``default`` where there is no mapping."""
    data = _dictionary(path)
    if isinstance(data, dict) and len(data) == 1 and isinstance(next(iter(data.values())), dict):
        data = next(iter(data.values()))
    out = {str(k).strip(): "" if v is None else str(v) for k, v in data.items() if str(k).strip() and not isinstance(v, (list, dict))} if isinstance(data, dict) else {}
    return out or dict(default)


def read_pairs(path: str | None, default: dict[str, list[tuple[str, str]]]) -> dict[str, list[tuple[str, str]]]:
    """Pairs of spellings by category, each a list of two or a mapping; pairs without two words are left out."""
    data, out = _dictionary(path), {}
    for cat, items in data.items() if isinstance(data, dict) else ():
        own = list(items.items()) if isinstance(items, dict) else [tuple(x) for x in items if isinstance(x, list)] if isinstance(items, list) else []
        kept = [(str(x[0]).strip(), str(x[1]).strip()) for x in own if len(x) == 2 and all(y is not None and str(y).strip() for y in x)]
        if kept:
            out[str(cat)] = kept
    return out or dict(default)


def read_reserved(spark: SparkSession, path: str | None, default: list[tuple[str, str]] = ()) -> DataFrame:
    """(category, reserved): names that are taken, by category; ``default`` where the file gives none."""
    data = _dictionary(path)
    rows = [(str(cat), x) for cat, items in data.items() for x in _strings(items)] if isinstance(data, dict) else []
    return spark.createDataFrame(rows or list(default), "category string, reserved string")


_KEYS = {"имя": "name", "формы": "forms", "старое": "old_forms", "старое_опасное": "old_dangerous", "опечатки": "typos"}


def registry_rows(data) -> list[tuple]:
    """Rows of a registry: a list of mappings, single values as lists, items stripped; anything else gives none."""
    items = data.get("персонажи", data.get("characters", [])) if isinstance(data, dict) else data
    rows = []
    for item in items if isinstance(items, list) else []:
        if not isinstance(item, dict):
            continue
        own = {_KEYS.get(k, k): v for k, v in item.items()}
        name = str(own.get("name") or "").strip()
        if name:
            as_list = lambda v: [str(x).strip() for x in (v if isinstance(v, list) else [v]) if x is not None and str(x).strip()]
            rows.append((name, *(as_list(own.get(f)) for f in ("forms", "old_forms", "old_dangerous", "typos"))))
    return rows


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a YAML registry; a broken or missing file gives none."""
    try:
        rows = registry_rows(_yaml(path))
    except Exception:
        rows = []
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def read_rules(path: str) -> list[Rule]:
    """Rules of a YAML file; a ValueError names the file and the rule at fault."""
    if not os.path.exists(path):
        raise ValueError(f"there is no {path}")
    data = _yaml(path)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a section 'rules' is expected")
    return make_rules(data.get("rules"), os.path.basename(path))


def union_corpora(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(origin, path, text) of notes (rel, text) and of other files (path, ext, text) that aren't notes themselves."""
    a = notes.select(F.lit("note").alias("origin"), F.col("rel").alias("path"), "text")
    b = files.where(F.lower("ext") != "md").select(F.lower("ext").alias("origin"), "path", "text")
    return a.unionByName(b)


def read_diary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a volume diary (CSV with ; and a header); broken rows are dropped."""
    return spark.read.csv(check_root(path), sep=";", header=True, schema=DIARY_SCHEMA, mode="DROPMALFORMED", timestampFormat="yyyy-MM-dd HH:mm")


def newest_backups(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(original, backup) of ``x.bak`` files and of snapshots ``folder/<stamp>/x``, the newest stamp for each file."""
    p = F.col(path_col)
    bak = files.where(p.endswith(".bak")).select(F.regexp_replace(p, r"\.bak$", "").alias("original"), p.alias("backup"), F.lit("").alias("stamp"))
    snap = files.where(p.rlike(r"/md_replace_backups/[^/]+/")).select(
        F.regexp_replace(p, r"/md_replace_backups/[^/]+/", "/").alias("original"), p.alias("backup"), F.regexp_extract(p, r"/md_replace_backups/([^/]+)/", 1).alias("stamp")
    )
    return bak.union(snap).groupBy("original").agg(F.max_by("backup", "stamp").alias("backup"))
