"""Ignore rules of a tree: patterns of the files named .gitignore, and which paths they leave out.

A pattern is turned into a regular expression once, and most patterns need none: a plain name, a plain path and ``*.suffix`` are met by equality. A path meets the
rules of all folders above it; the deepest folder's last match decides, and nothing below an ignored folder comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns with wildcards are copied this many times, and each path meets one copy, so that those of the top folder do not meet all paths in one task.
COPIES = 32
_TOKENS = r"(\\.|\[[!^]?\]?(?:\\.|\[:[a-z]+:\]|[^\]\\]){0,200}\]|\*+|\?|[^\\\[*?]+|.)"


def _token(t: Column) -> Column:
    """The regular expression of one token of a segment; a bracket or backslash that stands alone matches nothing."""
    inner = F.regexp_replace(F.regexp_replace(F.substring(t, 2, 1 << 20), r"\]$", ""), "^!", "^")
    inner = F.regexp_replace(inner, r"^(\^?)\]", r"$1\\]")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\[(?!:[a-z]+:)", r"\\["), "&", r"\\&")
    for name in ("alnum", "alpha", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper"):
        inner = F.replace(inner, F.lit(f"[:{name}:]"), F.lit(rf"\p{{{name.capitalize()}}}"))
    inner = F.replace(inner, F.lit("[:xdigit:]"), F.lit(r"\p{XDigit}"))
    return (
        F.when(t.rlike(r"^\*"), "[^/]*").when(t == "?", "[^/]").when(t.isin("[", "\\"), "(?!)")
        .when(F.startswith(t, F.lit("\\")), F.concat(F.lit("\\Q"), F.substring(t, 2, 2), F.lit("\\E")))
        .when(F.startswith(t, F.lit("[")), F.concat(F.lit("(?!/)["), inner, F.lit("]"))).otherwise(F.concat(F.lit("\\Q"), t, F.lit("\\E")))
    )


def _regex(body: Column, anchored: Column) -> Column:
    parts = F.split(body, "/")

    def segment(s: Column, i: Column) -> Column:
        last = i == F.size(parts) - 1
        plain = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_TOKENS), 1), _token), "")
        any_depth = (s == "**") & anchored
        return F.when(any_depth & last, ".+").when(any_depth, "(?:.*/)?").otherwise(F.concat(plain, F.when(last, "").otherwise("/")))

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, segment), ""), F.lit("$"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """folder, line, pattern, negated, folders_only, kind, key, regex of the patterns in ignore files (folder, text); the top folder is the empty string.

    Comments, empty lines, NULL texts and patterns that end in a lone backslash are no rules. ``kind`` is ``name``, ``path``, ``suffix`` (met by ``key``) or ``glob``.
    Classes of more than 200 members are not known.
    """
    text = F.regexp_replace("text", "^﻿", "")
    lines = files.select(F.coalesce("folder", F.lit("")).alias("folder"), F.posexplode(F.split(text, "\r?\n")).alias("line", "pattern")).where("pattern NOT LIKE '#%'")
    cut = F.rtrim("pattern")
    escaped = F.length(F.regexp_extract(cut, r"\\*$", 0)) % 2 == 1
    lines = lines.withColumn("body", F.when(~escaped, cut).when(F.length("pattern") > F.length(cut), F.concat(cut, F.lit(" "))))
    lines = lines.withColumns({"line": F.col("line") + 1, "negated": F.startswith("body", F.lit("!"))})
    lines = lines.withColumn("body", F.when(F.col("negated"), F.substring("body", 2, 1 << 20)).otherwise(F.col("body")))
    lines = lines.withColumns({"folders_only": F.endswith("body", F.lit("/")), "body": F.regexp_replace("body", "/$", "")})
    lines = lines.withColumns({"anchored": F.contains("body", F.lit("/")), "body": F.regexp_replace("body", "^/", "")}).where("body != ''")
    plain = ~F.col("body").rlike(r"[*?\[\\]")
    suffix = F.regexp_extract("body", r"^\*(\.[^.*?\[\\]+)$", 1)
    kind = F.when(plain & F.col("anchored"), "path").when(plain, "name").when(~F.col("anchored") & (suffix != ""), "suffix").otherwise("glob")
    key = F.when(kind == "suffix", suffix).when(kind != "glob", F.col("body"))
    return lines.select(
        "folder", "line", "pattern", "negated", "folders_only", kind.alias("kind"), key.alias("key"),
        F.when(kind == "glob", _regex(F.col("body"), F.col("anchored"))).alias("regex"), "anchored",
    )


def _above(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def last_matches(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path, hit (ignored, folder, line, pattern) of the entries (path, is_folder) that a rule matches: the deepest folder's last match."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = entries.select("path", "is_folder", name.alias("name"), F.explode(_above(F.col("path"))).alias("folder"))
    rows = rows.withColumn("rel", F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)")))
    keys = [("name", F.col("name")), ("path", F.col("rel")), ("suffix", F.regexp_extract("name", r"(\.[^.]+)$", 1)), ("glob", F.pmod(F.xxhash64("path"), F.lit(COPIES)).cast("string"))]
    rows = rows.withColumn("k", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys])))
    rows = rows.select("path", "is_folder", "folder", "name", "rel", "k.kind", "k.key")
    copies = F.when(F.col("kind") == "glob", F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda i: i.cast("string"))).otherwise(F.array("key"))
    met = rows.join(rules.withColumn("key", F.explode(copies)), ["folder", "kind", "key"])
    target = F.when(F.col("anchored"), F.col("rel")).otherwise(F.col("name"))
    met = met.where((~F.col("folders_only") | F.col("is_folder")) & (F.col("regex").isNull() | F.rlike(target, F.col("regex"))))
    hit = F.struct((~F.col("negated")).alias("ignored"), "folder", "line", "pattern")
    return met.groupBy("path").agg(F.max_by(hit, F.struct(F.length("folder"), "line")).alias("hit"))


def ignored(paths: DataFrame, rules: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """The rows of ``paths`` (path of files, no leading slash) with ignored, rule_folder, rule_line, rule: what decides, also where it takes a file back.

    Below an ignored folder the topmost one's rule decides. Tracked files (path) are never ignored, though their rule is named. Rows that repeat a path are
    kept; a NULL path is not ignored.
    """
    names = paths.select("path").where("path IS NOT NULL").distinct()
    # folders by length, the top left out: it has no name
    folders = names.select(F.explode(F.slice(_above(F.col("path")), 2, 1 << 20)).alias("path")).distinct()
    closed = last_matches(folders.withColumn("is_folder", F.lit(True)), rules).where("hit.ignored")
    below = folders.select(F.col("path").alias("parent"), F.explode(F.array_append(F.slice(_above(F.col("path")), 2, 1 << 20), F.col("path"))).alias("path"))
    shut = below.join(closed, "path").groupBy("parent").agg(F.min_by("hit", F.length("path")).alias("shut"))
    named = names.withColumn("parent", F.regexp_replace("path", "/?[^/]*$", "")).join(shut, "parent", "left")
    own = last_matches(named.where("shut IS NULL").select("path", F.lit(False).alias("is_folder")), rules)
    verdicts = named.where("shut IS NOT NULL").select("path", F.col("shut").alias("hit")).unionByName(own)
    out = paths.join(verdicts, "path", "left")
    value = F.coalesce("hit.ignored", F.lit(False))
    if tracked is not None:
        out = out.join(tracked.select("path").distinct().withColumn("_tracked", F.lit(True)), "path", "left")
        value = value & F.col("_tracked").isNull()
    out = out.withColumns({"ignored": value, "rule_folder": F.col("hit.folder"), "rule_line": F.col("hit.line"), "rule": F.col("hit.pattern")})
    return out.drop("hit", "_tracked")
