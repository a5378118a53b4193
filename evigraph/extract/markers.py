"""Feature markers in comments, by SQL functions: blocks of ``Field: value`` lines after a tag line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("layer", "data flow", "related", "toggle", "collections", "tables", "tests")
LAYERS = ("router", "service", "model", "frontend", "worker", "migration", "script", "test", "config", "shared", "api", "hook", "component", "page")


def markers(files: DataFrame, tag: str = "@feature") -> DataFrame:
    """(path, line, feature, field, value) of every marker; values may go on over lines that are indented further."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.withColumn("t", F.regexp_replace("raw", r"^\s*(?:#|//|\*|--)+ ?", "")).where(F.col("raw").rlike(r"^\s*(?:#|//|\*|--)"))
    order = W.partitionBy("path").orderBy("line")
    feature = F.when(F.trim("t").startswith(tag), F.trim(F.regexp_extract("t", rf"{tag}\s+([\w./-]+)", 1)))
    lines = lines.withColumn("gap", (F.col("line") - F.lag("line", 1, -9).over(order) > 1).cast("int")).withColumn("start", feature)
    lines = lines.withColumn("block", F.sum(F.greatest("gap", F.col("start").isNotNull().cast("int"))).over(order))
    in_block = W.partitionBy("path", "block").orderBy("line")
    lines = lines.withColumn("feature", F.first("start", ignorenulls=True).over(in_block)).where("feature IS NOT NULL AND start IS NULL")
    name = F.lower(F.regexp_extract("t", r"^([A-Za-z ]+):", 1))
    lines = lines.withColumn("own", F.when(name.isin(*FIELDS), name)).withColumn("field", F.last("own", ignorenulls=True).over(in_block)).where("field IS NOT NULL")
    value = F.trim(F.when(F.col("own").isNotNull(), F.regexp_replace("t", r"^[A-Za-z ]+:", "")).otherwise(F.col("t")))
    parts = lines.select("path", "block", "feature", "field", "line", value.alias("v"))
    grouped = parts.groupBy("path", "block", "feature", "field").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]), " ").alias("value"))
    return grouped.select("path", (F.col("line") + 1).alias("line"), "feature", "field", "value")


def marker_issues(found: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, line, issue): unknown layers, related files that are not tracked, empty fields."""
    layer = found.where("field = 'layer'").where(~F.lower("value").isin(*LAYERS)).select("path", "line", F.lit("unknown-layer").alias("issue"))
    related = found.where("field = 'related'").select("path", "line", F.explode(F.split("value", r"[,\s]+")).alias("ref")).where("ref != ''")
    dangling = related.join(tracked.select(F.col("path").alias("ref")), "ref", "left_anti").select("path", "line", F.lit("dangling-related").alias("issue"))
    empty = found.where("value = ''").select("path", "line", F.lit("empty-field").alias("issue"))
    return layer.unionByName(dangling).unionByName(empty).distinct()
