"""Facts from SQL texts: statements, tables with operations, foreign keys, declared columns. A lexer of our own; what it cannot read is reported."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import spread

SCHEMA = "path string, line int, fact string, table_name string, detail string"
_NAME = r'(?:"[^"]+"|[A-Za-z_][\w$]*)(?:\.(?:"[^"]+"|[A-Za-z_][\w$]*))*'
_TOKEN = re.compile(r"--[^\n]*|/\*|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$([A-Za-z_]\w*)?\$|;|\(|\)|[^\s;()'\"$/-]+|\s+|.", re.S)
_READS = re.compile(rf"\b(?:from|join|using)\s+(?:only\s+)?({_NAME})(?!\s*\()", re.I)
_WRITES = re.compile(rf"\b(?:insert\s+into|update(?:\s+only)?|delete\s+from|merge\s+into|truncate(?:\s+table)?|copy)\s+({_NAME})", re.I)
_DECLARES = re.compile(rf"\b(?:create|alter|drop)\s+(?:unlogged\s+|temp(?:orary)?\s+|materialized\s+|foreign\s+|or\s+replace\s+)*(?:table|view)\s+(?:if\s+(?:not\s+)?exists\s+)?(?:only\s+)?({_NAME})", re.I)
_CTE = re.compile(rf"(?:\bwith\s+(?:recursive\s+)?|,\s*)({_NAME})\s*(?:\([^()]*\)\s*)?as\s+(?:not\s+)?(?:materialized\s+)?\(", re.I)
_REFERENCES = re.compile(rf"\breferences\s+({_NAME})", re.I)
_STARTS = re.compile(r"\s*(?:select|insert|update|delete|merge|with|create|alter|drop|truncate|copy|grant|revoke|comment|begin|commit|rollback|set|do|explain|analyze|vacuum|values|table)\b", re.I)


def statements(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement): split at semicolons outside quotes, dollar quotes, comments and parentheses; comments become blanks."""
    at, line, start, depth, out = 0, 1, 1, 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        token, end = m[0], m.end()
        if token == "/*":  # block comments nest
            level = 1
            while level and end < len(text):
                n = re.compile(r"/\*|\*/").search(text, end)
                if not n:
                    end = len(text)
                    break
                level, end = level + (1 if n[0] == "/*" else -1), n.end()
            token = " "
        elif token.startswith("--"):
            token = " "
        elif token.startswith("$") and token.endswith("$") and len(token) > 1:
            close = text.find(token, end)
            end = len(text) if close < 0 else close + len(token)
            token = text[at:end]
        depth = max(0, depth + (token == "(") - (token == ")"))
        if token == ";" and not depth:
            if body := "".join(out).strip():
                yield start, body
            out, start = [], line
        else:
            if not "".join(out).strip():
                out, start = [], line
            out.append(token)
        line += text.count("\n", at, end)
        at = end
    if body := "".join(out).strip():
        yield start, body


def _plain(statement: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", statement)


def fold(name: str) -> str:
    """Quoted identifiers keep their case, others are lower."""
    return ".".join(p[1:-1] if p.startswith('"') else p.lower() for p in re.findall(r'"[^"]+"|[^."]+', name))


def columns_of(body: str) -> list[str]:
    """Columns that the parenthesised part of a CREATE TABLE declares."""
    depth, part, parts = 0, "", []
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    names = [m[0] for p in [*parts, part] if (m := re.match(rf"\s*({_NAME})", p)) and (m := [m[1]])]
    return [fold(n) for n in names if n.lower() not in ("primary", "foreign", "unique", "check", "constraint", "exclude", "like")]


def facts(text: str) -> list[tuple]:
    rows = []
    for line, statement in statements(text):
        plain = _plain(statement)
        if not _STARTS.match(plain):
            rows.append((line, "unsupported-statement", None, plain[:60]))
            continue
        own = {fold(n) for n in _CTE.findall(plain)} if re.match(r"\s*with\b", plain, re.I) or " with " in plain.lower() else set()
        declared = [fold(n) for n in _DECLARES.findall(plain)]
        for kind, names in (("declares", declared), ("writes", map(fold, _WRITES.findall(plain))), ("reads", map(fold, _READS.findall(plain)))):
            rows += [(line, kind, n, "") for n in dict.fromkeys(names) if n not in own]
        if declared and re.match(r"\s*create\s+(?:\w+\s+)*table", plain, re.I) and (m := re.search(r"\((.*)\)", plain, re.S)):
            rows += [(line, "column", declared[0], c) for c in columns_of(m[1])]
        rows += [(line, "foreign-key", declared[0] if declared else None, fold(n)) for n in _REFERENCES.findall(plain)]
    return rows


def sql_facts(files: DataFrame) -> DataFrame:
    """path, line, fact, table_name, detail for SQL files (path, text). Null texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(p, *f) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if t is not None for f in facts(t)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "line", "fact", "table_name", "detail"])

    return spread(files.select("path", "text")).mapInArrow(run, SCHEMA)
