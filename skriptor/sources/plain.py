"""A reader of the YAML that registries, dictionaries and front matter are written in.

It knows block mappings and lists, flow lists and mappings on one line, quoted and
plain scalars, literal blocks and comments.  What it can't read raises ValueError, so
that results don't hang on what else is installed.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:\-\[\]{}&*!|>%@`"'][^#:]*?|[^\s:]+?)\s*:(?:\s+(.*)|$)""")


def load(text: str):
    """The value of a document; None for an empty one."""
    rows = []
    for no, line in enumerate(text.splitlines(), 1):
        body = line.strip()
        if not rows and body == "---" or body.startswith("%"):
            continue
        lead = line[: len(line) - len(line.lstrip())]
        if "\t" in lead and body and not body.startswith("#"):
            raise ValueError(f"line {no}: a tab indents")
        rows.append((no, len(lead), line.rstrip()))
    reader = _Reader(rows)
    reader.blank()
    if reader.done():
        return None
    value = reader.block(reader.rows[reader.at][1])
    reader.blank()
    if not reader.done():
        raise ValueError(f"line {reader.rows[reader.at][0]}: indented otherwise than before")
    return value


class _Reader:
    def __init__(self, rows: list[tuple[int, int, str]]):
        self.rows, self.at = rows, 0

    def done(self) -> bool:
        return self.at >= len(self.rows)

    def blank(self) -> None:
        while not self.done() and (not self.rows[self.at][2].strip() or self.rows[self.at][2].lstrip().startswith("#")):
            self.at += 1

    def block(self, indent: int):
        body = self.rows[self.at][2].strip()
        if body == "-" or body.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        no = self.rows[self.at][0]
        self.at += 1
        return scalar(body, no)

    def sequence(self, indent: int) -> list:
        out = []
        while True:
            self.blank()
            if self.done() or self.rows[self.at][1] != indent:
                break
            no, _, line = self.rows[self.at]
            body = line.strip()
            if not (body == "-" or body.startswith("- ")):
                break
            rest = body[1:].strip()
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.nested(indent))
            elif _KEY.match(rest) and rest[:1] not in "\"'[{" or rest.startswith("- "):
                inner = indent + len(body) - len(body[1:].lstrip())
                self.rows[self.at] = (no, inner, " " * inner + rest)
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(scalar(rest, no))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while True:
            self.blank()
            if self.done() or self.rows[self.at][1] != indent:
                break
            no, _, line = self.rows[self.at]
            m = _KEY.match(line.strip())
            if not m:
                raise ValueError(f"line {no}: a key is expected")
            key, rest = str(scalar(m[1], no)), (m[2] or "").strip()
            self.at += 1
            if rest[:1] in ("|", ">") and re.fullmatch(r"[|>][+-]?\d*", rest):
                out[key] = self.literal(indent, rest[0] == ">")
            elif not rest or rest.startswith("#"):
                out[key] = self.nested(indent)
            else:
                out[key] = scalar(rest, no)
        if not self.done() and self.rows[self.at][1] > indent:
            raise ValueError(f"line {self.rows[self.at][0]}: indented without a key")
        return out

    def nested(self, indent: int):
        self.blank()
        if self.done():
            return None
        own = self.rows[self.at][1]
        listed = self.rows[self.at][2].strip()
        return self.block(own) if own > indent or own == indent and (listed == "-" or listed.startswith("- ")) else None

    def literal(self, indent: int, folded: bool) -> str:
        held = []
        while not self.done() and (not self.rows[self.at][2].strip() or self.rows[self.at][1] > indent):
            held.append(self.rows[self.at][2].strip())
            self.at += 1
        return (" " if folded else "\n").join(held).strip()


def scalar(s: str, no: int = 0):
    """A value on one line."""
    value, rest = _flow(s, 0, no, top=True)
    rest = rest.strip()
    if rest and not rest.startswith("#"):
        raise ValueError(f"line {no}: {rest!r} follows a value")
    return value


def _flow(s: str, depth: int, no: int, top: bool = False):
    s = s.lstrip()
    if s[:1] in ("[", "{"):
        if depth > 50:
            raise ValueError(f"line {no}: nested too deeply")
        closing, items = ("]" if s[0] == "[" else "}"), []
        table, s = s[0] == "{", s[1:].lstrip()
        while s[:1] != closing:
            if not s:
                raise ValueError(f"line {no}: {closing} is missing")
            value, s = _flow(s, depth + 1, no)
            s = s.lstrip()
            if table:
                if s[:1] == ":":
                    other, s = _flow(s[1:], depth + 1, no)
                    value, s = (value, other), s.lstrip()
                else:
                    value = (value, None)
            items.append(value)
            if s[:1] == ",":
                s = s[1:].lstrip()
            elif s[:1] != closing:
                raise ValueError(f"line {no}: a comma is missing")
        return (dict(items) if table else items), s[1:]
    if s[:1] == '"':
        m = re.match(r'"((?:[^"\\]|\\.)*)"', s)
        if not m:
            raise ValueError(f"line {no}: a quotation mark is open")
        names = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda x: chr(int(x[1][1:], 16)) if len(x[1]) == 5 else names.get(x[1], x[1]), m[1]), s[m.end() :]
    if s[:1] == "'":
        m = re.match(r"'((?:[^']|'')*)'", s)
        if not m:
            raise ValueError(f"line {no}: a quotation mark is open")
        return m[1].replace("''", "'"), s[m.end() :]
    if s[:1] in ("*", "&", "!", "%", "@", "`"):
        raise ValueError(f"line {no}: {s[:1]!r} can't begin a value")
    end = re.search(r"\s#" if top else r"\s#|[,\[\]{}]|:(?=\s|$)", s)
    raw = (s[: end.start()] if end else s).strip()
    if top and re.search(r":(?:\s|$)", raw):
        raise ValueError(f"line {no}: a colon within a value")
    return _plain(raw), s[end.start() :] if end else ""


def _plain(raw: str):
    if raw.lower() in ("", "~", "null"):
        return None
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", raw):
        return int(raw)
    if re.fullmatch(r"[-+]?\d*\.\d+", raw):
        return float(raw)
    return raw
