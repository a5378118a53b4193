"""A report as one HTML page of bounded length, made and written by tasks."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .links import row_budget

# Rows shown of each rule, rows of a page, characters of a cell.
PER_GROUP, TOTAL, CELL = 500, 5_000, 2_000
#: What stands before and after the rows; nothing in the page can be fetched or run.
HEAD = (
    "<!doctype html><meta charset='utf-8'><meta http-equiv='Content-Security-Policy' content=\"default-src 'none'; style-src 'unsafe-inline'\"><title>{title}</title>"
    "<style>body{{font:14px sans-serif;max-width:75em;margin:auto}}td{{border:1px solid #ccc;padding:4px;overflow-wrap:anywhere}}table{{border-collapse:collapse}}</style><h1>{title}</h1>"
)
OPEN, ROW, CLOSE, OMITTED = 0, 1, 2, 3


def html(value: Column, most: int = CELL) -> Column:
    """A value as text of a page, cut at ``most`` characters before it is escaped; NULL is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    out = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)
    for char in "&<>\"'":
        out = F.replace(out, F.lit(char), F.lit(escape(char)))
    return out


def page_lines(findings: DataFrame, tie: str, total: int = TOTAL, per_group: int = PER_GROUP) -> DataFrame:
    """(priority, worst, rule, part, place, line): lines of the page in the order of these columns, ``worst`` descending; of findings (priority, score, rule, category,
    severity, confidence, exposure, file, line, message). ``tie`` tells findings apart that are equal otherwise.

    Findings are grouped by priority and rule, groups with the highest score first. A group shows ``per_group`` findings at most and the page ``total``, spent by the groups in
    order; a group says how many more it has, groups beyond the budget are counted at the end of the page. Of a group no task holds more than ``per_group`` findings of each
    partition, and the budget is spent by prefix sums over ranges of groups, since there may be as many rules as findings.
    """
    order = [F.desc("score"), "category", "file", "line", tie]
    first = F.min(F.struct((-F.col("score")).alias("s"), "category", "file", "line", tie, "severity", "confidence"))
    groups = findings.groupBy("priority", "rule").agg(F.count("*").alias("all"), first.alias("f")).select("priority", (-F.col("f.s")).alias("worst"), "rule", "all", F.col("f.category").alias("category"), F.col("f.severity").alias("severity"), F.col("f.confidence").alias("confidence"), F.least("all", F.lit(per_group)).alias("n"))
    budgeted = row_budget(groups, total, ["priority", F.desc("worst"), "rule"])
    shown = budgeted.where("shown > 0")
    top = findings.withColumn("place", F.row_number().over(W.partitionBy("priority", "rule").orderBy(*order))).where(F.col("place") <= per_group)
    at = lambda name: F.concat(F.lit("<td>"), html(F.col(name)), F.lit("</td>"))
    where = F.concat(F.lit("<td>"), html(F.concat_ws(":", F.col("file"), F.col("line").cast("string"))), F.lit("</td>"))
    rows = top.join(shown.select("priority", "rule", "worst", "shown"), ["priority", "rule"]).where("place <= shown")
    rows = rows.select("priority", "worst", "rule", F.lit(ROW).alias("part"), F.col("place").cast("long").alias("place"), F.concat(F.lit("<tr>"), where, at("message"), at("exposure"), F.lit("</tr>")).alias("line"))
    heads = F.concat(F.lit("<details><summary>"), F.concat_ws(" · ", html(F.col("priority")), html(F.col("rule")), html(F.col("category")), html(F.concat_ws("/", "severity", "confidence")), F.col("all").cast("string")), F.lit("</summary><table>"))
    more = F.when(F.col("all") > F.col("shown"), F.concat(F.lit("<p>"), F.col("all") - F.col("shown"), F.lit(" more</p>"))).otherwise("")
    ends = F.concat(F.lit("</table>"), more, F.lit("</details>"))
    frame = shown.select("priority", "worst", "rule", F.explode(F.array(F.struct(F.lit(OPEN).alias("part"), heads.alias("line")), F.struct(F.lit(CLOSE).alias("part"), ends.alias("line")))).alias("x"))
    frame = frame.select("priority", "worst", "rule", "x.part", F.lit(0).cast("long").alias("place"), "x.line")
    left = budgeted.where("shown = 0").agg(F.count("*").alias("groups"), F.sum("all").alias("findings")).where("groups > 0")
    # sorts after every priority
    last = left.select(F.lit("~").alias("priority"), F.lit(None).cast(groups.schema["worst"].dataType).alias("worst"), F.lit("").alias("rule"), F.lit(OMITTED).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("<p>"), F.col("groups"), F.lit(" rules not shown, "), F.col("findings"), F.lit(" findings</p>")).alias("line"))
    return frame.unionByName(rows).unionByName(last)


def write_page(lines: DataFrame, path: str, title: str) -> None:
    """The page as text files whose names are in order, so that ``cat path/part-*`` is the page. No task sorts more than its range of lines."""
    head = lines.sparkSession.range(1, numPartitions=1).select(F.lit("").alias("priority"), F.lit(None).cast(lines.schema["worst"].dataType).alias("worst"), F.lit("").alias("rule"), F.lit(OPEN).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(HEAD.format(title=escape(title))).alias("line"))
    order = ["priority", F.desc("worst"), "rule", "part", "place"]
    lines.unionByName(head).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
