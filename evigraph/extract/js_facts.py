"""Facts from JavaScript and TypeScript by tokens: functions, classes, imports, requests, exports; routes of file-based routers from paths.

This tier reads tokens and not a syntax tree: comments, strings and patterns do not mislead it, scopes are not known to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import spread
from .js_tokens import Token, closing, tokens

SCHEMA = "path string, fact string, name string, line int, detail string"
#: Names on which a call of an HTTP verb is a request, and functions that are requests themselves.
CLIENTS = frozenset({"api", "axios", "client", "http"})
REQUESTS = frozenset({"fetch", "useSWR"})
VERBS = frozenset({"get", "post", "put", "patch", "delete"})
DECLARATIONS = frozenset({"const", "let", "var"})
EXPORTABLE = DECLARATIONS | {"function", "class", "type", "interface", "enum"}
NOTHING = Token("end", "", 0)


class _Reader:
    """Walks the tokens of one source; every method looks at what begins at place ``i``."""

    def __init__(self, found: list[Token]):
        self.found = found

    def at(self, i: int) -> Token:
        return self.found[i] if 0 <= i < len(self.found) else NOTHING

    def is_sign(self, i: int, text: str) -> bool:
        return self.at(i).kind == "sign" and self.at(i).text == text

    def said(self, i: int) -> str | None:
        return self.at(i).text if self.at(i).kind in ("text", "template") else None

    def facts(self) -> Iterator[tuple[str, str, int, str]]:
        for i, token in enumerate(self.found):
            if token.kind != "word" or self.is_sign(i - 1, "."):
                continue
            reader = getattr(self, f"_{token.text}", None) if token.text in ("function", "class", "import", "require", "export") else None
            if reader is not None:
                yield from reader(i)
            elif token.text in DECLARATIONS and self._holds_function(i + 1):
                yield "function", self.at(i + 1).text, token.line, ""
            elif token.text in REQUESTS and self.is_sign(i + 1, "(") and self.said(i + 2) is not None:
                yield "request", token.text, token.line, self.said(i + 2)
            elif token.text in CLIENTS and self.is_sign(i + 1, ".") and self.at(i + 2).text in VERBS:
                opened = self._past_types(i + 3)
                if self.is_sign(opened, "(") and self.said(opened + 1) is not None:
                    yield "request", self.at(i + 2).text, token.line, self.said(opened + 1)

    def _past_types(self, i: int) -> int:
        """The place after type arguments that begin at ``i``, or ``i`` itself."""
        if not self.is_sign(i, "<"):
            return i
        depth = 0
        for k in range(i, len(self.found)):
            depth += self.is_sign(k, "<") - self.is_sign(k, ">")
            if depth == 0:
                return k + 1
        return i

    def _holds_function(self, i: int) -> bool:
        """Whether the variable named at ``i`` is given an arrow function."""
        if self.at(i).kind != "word":
            return False
        k = i + 1
        while self.is_sign(k, ":") or (k > i + 1 and not self.is_sign(k, "=") and not self.is_sign(k, ";") and self.at(k) is not NOTHING and self.at(k).line == self.at(i).line):
            k += 1  # a type stands before the value
        if not self.is_sign(k, "="):
            return False
        k += 1
        k += self.at(k).text == "async" and not self.is_sign(k + 1, "=>")
        k = self._past_types(k)
        if self.is_sign(k, "("):
            k = closing(self.found, k) + 1
            if self.is_sign(k, ":"):  # a type of what is returned, up to the arrow on its line
                line = self.at(k).line
                while self.at(k).line == line and not self.is_sign(k, "=>"):
                    k += 1
            return self.is_sign(k, "=>")
        return self.at(k).kind == "word" and self.is_sign(k + 1, "=>")

    def _function(self, i: int) -> Iterator[tuple]:
        k = i + 1 + self.is_sign(i + 1, "*")
        if self.at(k).kind == "word":
            yield "function", self.at(k).text, self.found[i].line, ""

    def _class(self, i: int) -> Iterator[tuple]:
        if self.at(i + 1).kind == "word" and self.at(i + 1).text not in ("extends", "implements"):
            yield "class", self.at(i + 1).text, self.found[i].line, ""

    def _import(self, i: int) -> Iterator[tuple]:
        k = i + 1 + self.is_sign(i + 1, "(")
        while self.at(k) is not NOTHING and self.said(k) is None and not self.is_sign(k, ";") and not self.is_sign(k, "("):
            k = closing(self.found, k) + 1 if self.is_sign(k, "{") else k + 1
        if self.said(k) is not None:
            yield "import", self.said(k), self.found[i].line, ""

    def _require(self, i: int) -> Iterator[tuple]:
        if self.is_sign(i + 1, "(") and self.said(i + 2) is not None:
            yield "import", self.said(i + 2), self.found[i].line, ""

    def _export(self, i: int) -> Iterator[tuple]:
        line, k = self.found[i].line, i + 1
        if self.is_sign(k, "{") or self.is_sign(k, "*"):
            end = closing(self.found, k) if self.is_sign(k, "{") else k
            names = [t for t in self.found[k + 1 : end] if t.kind == "word" or t.text == ","]
            for n, t in enumerate(names):  # the last word before a comma is the name outside
                if t.kind == "word" and (n + 1 == len(names) or names[n + 1].text == ","):
                    yield "export", t.text, line, ""
            while self.at(k).kind != "text" and k <= end + 3:
                k += 1
            if self.at(k - 1).text == "from" and self.said(k) is not None:
                yield "import", self.said(k), line, ""
            return
        while self.at(k).text in ("default", "async", "declare", "abstract"):
            k += 1
        if self.at(k).text in EXPORTABLE:
            k += 1 + self.is_sign(k + 1, "*")
            if self.at(k).kind == "word":
                yield "export", self.at(k).text, line, ""


def facts(source: str) -> list[tuple[str, str, int, str]]:
    """(fact, name, line, detail) of one source, in its order."""
    return list(_Reader(tokens(source)).facts())


def js_facts(files: DataFrame) -> DataFrame:
    """path, fact, name, line, detail for files (path, text). Lines may be of any length; null texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [(p, f, n, line, d) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if t is not None for f, n, line, d in facts(t)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "fact", "name", "line", "detail"])

    return spread(files.select("path", "text")).mapInArrow(run, SCHEMA)


def file_routes(files: DataFrame) -> DataFrame:
    """path, kind, route, catch_all of pages and handlers of the app and pages routers; groups and slots add no segment, an optional catch-all also serves its parent."""
    path = F.col("path")
    app = F.regexp_extract(path, r"(?:^|/)app/(?:(.*)/)?(page|route)\.[jt]sx?$", 1)
    is_app = path.rlike(r"(?:^|/)app/(?:.*/)?(page|route)\.[jt]sx?$")
    pages = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(.*)\.[jt]sx?$", 1), "(^|/)index$", "")
    is_page = path.rlike(r"(?:^|/)pages/.*\.[jt]sx?$") & ~path.rlike(r"(?:^|/)pages/(?:.*/)?_[^/]*$")
    inner = F.when(is_app, app).when(is_page, pages)
    segments = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    named = F.transform(segments, lambda s: F.when(s.rlike(r"^\[.*\]$"), "{dynamic}").otherwise(s))
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    route = F.concat(F.lit("/"), F.array_join(named, "/"))
    handler = path.rlike(r"/route\.[jt]sx?$") | (is_page & inner.rlike("^api(/|$)"))
    rows = files.where(is_app | is_page).select("path", F.when(handler, "handler").otherwise("page").alias("kind"), route.alias("route"), last.rlike(r"^\[\[?\.\.\.").alias("catch_all"), last.rlike(r"^\[\[\.\.\.").alias("optional"))
    parents = rows.where("optional").select("path", "kind", F.regexp_replace(F.regexp_replace("route", r"/\{dynamic\}$", ""), "^$", "/").alias("route"), F.lit(False).alias("catch_all"))
    return rows.drop("optional").unionByName(parents)
