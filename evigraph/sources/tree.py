"""Source trees and artifacts as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import language_of
from ..operators.ignore import ignore_rules, ignored
from ..ship import ship
from .listing import TreeSource

SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "sql", "prisma", "json", "yaml", "yml", "toml", "md", "sh")
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "coverage")


def skipped(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a whole component of the path is a name to skip; a name with slashes is a run of components."""
    padded = F.concat(F.lit("/"), path, F.lit("/"))
    out = F.lit(False)
    for name in names:
        out = out | F.contains(padded, F.lit(f"/{name}/"))
    return out


def listed_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], excluded: tuple[str, ...], max_bytes: int, also: tuple[str, ...] = (), tasks: int = 64) -> DataFrame:
    """path, size, status, content of the files under ``root`` with one of the suffixes or of the names ``also``, listed and read by ``tasks`` tasks."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    lists = {name: json.dumps(value) for name, value in (("suffixes", suffixes), ("excluded", excluded), ("also", also))}
    return spark.read.format("evigraph_tree").options(root=root, max_bytes=max_bytes, tasks=tasks, **lists).load()


def source_tree(
    spark: SparkSession, root: str, max_bytes: int = 2_000_000, suffixes: tuple[str, ...] = SUFFIXES, excluded: tuple[str, ...] = EXCLUDED,
    ignore_file: str | None = None, tracked: DataFrame | None = None,
) -> DataFrame:
    """path, text, status, size, language of the files under ``root``. The text is NULL unless the status is ``read``; else the file was ``too_large``, ``binary``,
    ``invalid_utf8`` or ``unreadable`` (gone or closed to us when it was to be read).

    Folders that ``excluded`` names are never listed and links not followed. With ``ignore_file`` (``.gitignore``) what the patterns of such files leave out is dropped, but for
    ``tracked`` files (path). The patterns are judged on paths, so folders that only they leave out are listed.
    """
    rows = listed_files(spark, root, suffixes, excluded, max_bytes)
    if ignore_file is not None:
        files = listed_files(spark, root, (), excluded, max_bytes, (ignore_file,))
        folder = F.regexp_replace("path", "/?[^/]*$", "")
        rules = ignore_rules(files.select(folder.alias("folder"), F.col("content").cast("string").alias("text")))
        rows = ignored(rows, rules, tracked).where("NOT ignored").select("path", "size", "status", "content")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    is_read = F.col("status") == "read"
    status = F.when(is_read & F.contains("content", F.lit(bytearray(b"\x00"))), "binary").when(is_read & text.isNull(), "invalid_utf8").otherwise(F.col("status"))
    return rows.select("path", F.when(status == "read", text).alias("text"), status.alias("status"), "size", language_of(F.col("path")).alias("language"))


def write_sarif(findings: DataFrame, runs: DataFrame, path: str) -> None:
    """One SARIF run per tool as a JSON line: findings (tool, rule, severity, message, file, line, fp) of runs (tool, skipped, error). A tool that was skipped or
    failed has no ``results``, which differs from an empty list."""
    level = F.create_map(*[F.lit(v) for p in (("critical", "error"), ("high", "error"), ("medium", "warning"), ("low", "note"), ("info", "note")) for v in p])[F.col("severity")]
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), "file", "line", F.col("fp").alias("fingerprint"))
    by_tool = findings.groupBy("tool").agg(F.array_sort(F.collect_list(result)).alias("results"))
    joined = runs.join(by_tool, "tool", "left")
    ran = F.col("skipped").isNull() & F.col("error").isNull()
    kept = F.when(ran, F.coalesce("results", F.array().cast(by_tool.schema["results"].dataType)))
    joined.select(F.struct(F.struct(F.col("tool").alias("name")).alias("driver")).alias("tool"), kept.alias("results")).write.json(path)
