"""Detectors over tables of facts: routes, model fields, migrations. Each gives (rule, severity, confidence, file, line, subject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUTATING = ("POST", "PUT", "PATCH", "DELETE")
#: Width of the column in which a migration's revision is recorded.
REVISION_WIDTH = 32


def _finding(rows: DataFrame, rule: Column | str, severity: Column | str, confidence: Column | str, subject: str) -> DataFrame:
    named = [(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((rule, "rule"), (severity, "severity"), (confidence, "confidence"))]
    return rows.select(*named, "file", "line", F.col(subject).alias("subject"))


def open_routes(routes: DataFrame, public: DataFrame) -> DataFrame:
    """Routes (file, line, method, path, authenticated, optional, object_param) that change state, or show an object, for anyone; paths in ``public`` are meant to be open."""
    bare = routes.where("NOT authenticated").join(public.select("path").distinct(), "path", "left_anti")
    changes = F.col("method").isin(*MUTATING)
    rule = F.when(changes, "security/unauthenticated-mutation-route").otherwise("security/unauthenticated-object-read")
    confidence = F.when(changes & ~F.col("optional"), "medium").otherwise("low")
    return _finding(bare.where(changes | F.col("object_param").isNotNull()), rule, F.when(changes, "high").otherwise("medium"), confidence, "path")


def unchecked_objects(routes: DataFrame) -> DataFrame:
    """Authenticated routes (file, line, method, path, authenticated, object_param, reads_caller, checks_caller) that use an object's id without asking whose it is.

    Routes of the same file that check the caller for the same parameter raise the confidence; they are counted per file and parameter first, so a file
    with many routes costs no pairs.
    """
    checking = routes.where("checks_caller AND object_param IS NOT NULL").groupBy("file", "object_param").agg(F.count("*").alias("siblings"))
    asked = routes.where("authenticated AND object_param IS NOT NULL AND NOT reads_caller AND NOT checks_caller").join(checking, ["file", "object_param"], "left")
    rank = F.col("method").isin(*MUTATING).cast("int") + F.col("siblings").isNotNull().cast("int")
    return _finding(asked, "security/object-route-without-ownership-check", "high", F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), rank + 1), "path")


def privileged_fields(fields: DataFrame, privileged: DataFrame) -> DataFrame:
    """Fields (file, line, model, field, request) of request models whose names callers should not set."""
    return _finding(fields.where("request").join(privileged.select("field").distinct(), "field", "left_semi"), "security/caller-settable-privileged-field", "medium", "medium", "field")


def long_revisions(revisions: DataFrame, width: int = REVISION_WIDTH) -> DataFrame:
    return _finding(revisions.where(F.length("revision") > width), "migrations/revision-id-too-long", "high", "high", "revision")


def columns_without_default(added: DataFrame, created: DataFrame) -> DataFrame:
    """Added columns (file, line, table_name, column_name, nullable, has_default) that existing rows cannot have; tables made in the same file have no rows."""
    strict = added.where("NOT nullable AND NOT has_default").join(created.select("file", "table_name").distinct(), ["file", "table_name"], "left_anti")
    return _finding(strict.withColumn("column", F.concat_ws(".", "table_name", "column_name")), "migrations/not-null-column-without-default", "high", "medium", "column")


def unforced_security(steps: DataFrame) -> DataFrame:
    """Tables whose last state of row security (file, line, seq, table_name, action) is enabled but never forced, told where they are enabled last.

    ``enable`` and ``disable``, ``force`` and ``no force`` cancel each other; the later step counts.
    """
    last = lambda on, off: F.max(F.when(F.col("action").isin(on, off), F.struct("seq", (F.col("action") == on).alias("on"), "file", "line")))
    state = steps.groupBy("table_name").agg(last("enable", "disable").alias("enabled"), last("force", "no force").alias("forced"))
    weak = state.where("enabled.on AND NOT coalesce(forced.on, false)")
    return _finding(weak.select("table_name", "enabled.file", "enabled.line"), "migrations/rls-without-force", "medium", "medium", "table_name")


def owner_views(made: DataFrame, altered: DataFrame) -> DataFrame:
    """Views (file, line, view, invoker) that run with their owner's rights, and that no other statement, before or after, alters (view, invoker)."""
    weak = made.where("NOT invoker").join(altered.where("invoker").select("view").distinct(), "view", "left_anti")
    return _finding(weak, "migrations/view-without-security-invoker", "medium", "medium", "view")


def blocking_indexes(indexes: DataFrame, created: DataFrame) -> DataFrame:
    """Indexes (file, line, table_name, concurrently) that lock a table which the same migration did not make, one for each line and table."""
    slow = indexes.where("NOT concurrently").join(created.select("file", "table_name").distinct(), ["file", "table_name"], "left_anti")
    return _finding(slow.select("file", "line", "table_name").distinct(), "migrations/index-not-concurrent", "low", "low", "table_name")


def unsecured_tables(created: DataFrame, steps: DataFrame, schemas: tuple[str, ...] = ()) -> DataFrame:
    """Tables (file, line, table_name) that no step of row security enables; with ``schemas``, those of these schemas alone."""
    own = created.where(F.element_at(F.split("table_name", r"\."), 1).isin(*schemas) & F.contains("table_name", F.lit("."))) if schemas else created
    return _finding(own.join(steps.where("action = 'enable'").select("table_name").distinct(), "table_name", "left_anti"), "migrations/table-without-rls", "medium", "low", "table_name")
