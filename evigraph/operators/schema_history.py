"""A catalogue of columns made of the changes that declare them, and references judged by what was declared when they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_migration_path
from ..functions.scalars import is_test_path

#: Columns that every table of the database has without declaring them (fixed values).
SYSTEM_COLUMNS = ("ctid", "xmin", "xmax", "cmin", "cmax", "tableoid", "oid")
TABLE = ["package", "table_name"]


def _next(wanted: Column) -> Column:
    """The place of the next change of the table for which ``wanted`` holds."""
    later = W.partitionBy(*TABLE).orderBy("seq").rangeBetween(1, W.unboundedFollowing)
    return F.min(F.when(wanted, F.col("seq"))).over(later)


def column_intervals(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validity intervals of columns, and of tables as a whole.

    ``changes`` has package, table_name, seq (a whole number, no two changes of a table alike), kind, columns, column_name and new_name: ``create`` declares ``columns``
    (NULL: not known, as of a view or a copy) and ends all before; ``add`` and ``drop`` change column_name, ``rename`` turns it into new_name; ``reshape``
    makes the table unknown until it is created again. First (package, table_name, column_name, since, until): a column is there from ``since`` to before
    ``until`` (NULL: to the end). Second (package, table_name, since, until, known).

    The fold needs no state that is passed from row to row: an interval ends at the next change of its column or the next creation of its table,
    whichever comes first. Changes of a table that is never created only ever add to what others declare.
    """
    is_create = F.col("kind") == "create"
    dated = changes.withColumns({"made_again": _next(is_create), "touched": _next(is_create | (F.col("kind") == "reshape"))})
    spans = dated.where("kind IN ('create', 'reshape')").select(*TABLE, F.col("seq").alias("since"), F.col("touched").alias("until"), (is_create & F.col("columns").isNotNull()).alias("known"))
    opened = F.when(is_create, F.col("columns")).when(F.col("kind") == "add", F.array("column_name")).when(F.col("kind") == "rename", F.array("new_name"))
    closed = F.when(F.col("kind").isin("drop", "rename"), F.array("column_name"))
    marked = lambda of, flag: F.transform(F.coalesce(of, F.expr("CAST(array() AS array<string>)")), lambda c: F.struct(c.alias("column_name"), F.lit(flag).alias("open")))
    # a rename of a column to itself leaves it open, so what opens comes last at a place
    each = dated.select(*TABLE, "seq", "made_again", F.explode(F.concat(marked(closed, False), marked(opened, True))).alias("c")).select(*TABLE, "seq", "made_again", "c.*")
    each = each.groupBy(*TABLE, "column_name", "seq").agg(F.max("open").alias("open"), F.max("made_again").alias("made_again"))
    after = F.lead("seq").over(W.partitionBy(*TABLE, "column_name").orderBy("seq"))
    columns = each.withColumn("after", after).where("open").select(*TABLE, "column_name", F.col("seq").alias("since"), F.least("after", "made_again").alias("until"))
    return columns, spans


def _at(intervals: DataFrame, place: str) -> Column:
    return (F.col("since") <= F.col(place)) & (F.col("until").isNull() | (F.col(place) < F.col("until")))


def judge_references(references: DataFrame, changes: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """(ref_id, verdict) of references (ref_id, package, table_name, column_name, seq, path, outer_tables, redirected).

    ``unknown`` means that a known schema at that time has no such column; ``declared`` that it has. Every other verdict is why a reference
    proves nothing: ``system`` column, ``test`` or ``migration`` file, ``own_ddl`` (its file changes the table itself, by ``path`` of the changes), ``redirected``
    (a search path may make the name another table), ``foreign`` (another tool changes the table), ``no_table`` (none declared at the time, in this
    package), ``opaque`` (its columns were not known then), ``outer`` (a table of an enclosing query may have the column, or is not known).
    The first that holds, in this order, is given. Tests declare nothing, so changes in their files count for no catalogue.
    """
    told = changes.where(~is_test_path(F.coalesce("path", F.lit(""))))
    columns, spans = column_intervals(told)
    path = F.coalesce("path", F.lit(""))
    flags = {"system": F.col("column_name").isin(*SYSTEM_COLUMNS), "test": is_test_path(path), "migration": is_migration_path(path)}
    refs = references.withColumns(flags)
    touched = changes.where("path IS NOT NULL").select("path", "table_name").distinct().withColumn("own_ddl", F.lit(True))
    refs = refs.join(touched, ["path", "table_name"], "left")
    if foreign is not None:
        refs = refs.join(foreign.select("table_name").distinct().withColumn("foreign", F.lit(True)), "table_name", "left")
    else:
        refs = refs.withColumn("foreign", F.lit(False))
    # the table and the enclosing ones are looked up alike: a row each, as of the place of the reference
    asked = refs.select("ref_id", "package", "column_name", "seq", F.posexplode(F.concat(F.array("table_name"), F.coalesce("outer_tables", F.expr("CAST(array() AS array<string>)")))).alias("depth", "table_name"))
    span = asked.join(spans, TABLE).where(_at(spans, "seq")).select("ref_id", "depth", "known")
    has = asked.join(columns, [*TABLE, "column_name"]).where(_at(columns, "seq")).select("ref_id", "depth").distinct().withColumn("has", F.lit(True))
    met = asked.select("ref_id", "depth").join(span.groupBy("ref_id", "depth").agg(F.min("known").alias("known")), ["ref_id", "depth"], "left").join(has, ["ref_id", "depth"], "left")
    inner = F.col("depth") == 0
    state = met.groupBy("ref_id").agg(
        F.max(F.when(inner, F.col("known").isNotNull())).alias("there"), F.max(F.when(inner, F.coalesce("known", F.lit(False)))).alias("known"), F.max(F.when(inner, F.coalesce("has", F.lit(False)))).alias("has"),
        F.coalesce(F.max(F.when(~inner, F.coalesce(~F.col("known"), F.lit(True)) | F.coalesce("has", F.lit(False)))), F.lit(False)).alias("outer"),
    )
    first = F.when(F.col("system"), "system").when(F.col("test"), "test").when(F.col("migration"), "migration").when(F.col("own_ddl"), "own_ddl").when(F.coalesce("redirected", F.lit(False)), "redirected").when(F.col("foreign"), "foreign")
    verdict = first.when(~F.col("there"), "no_table").when(~F.col("known"), "opaque").when(F.col("has"), "declared").when(F.col("outer"), "outer").otherwise("unknown")
    return refs.join(state, "ref_id").select("ref_id", verdict.alias("verdict"))
