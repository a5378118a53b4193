"""Findings: score, identity, baseline, summary, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, magnitudes, score_table

SORT = ("priority", "neg_score", "category", "rule", "file", "line")


def with_score(findings: DataFrame) -> DataFrame:
    """Adds score and priority from a constant table of all 90 combinations; an unknown exposure weighs 1."""
    table = F.create_map(*[x for s, c, e, score, p in score_table() for x in (F.lit(f"{s}|{c}|{e}"), F.struct(F.lit(score).alias("score"), F.lit(p).alias("priority")))])
    known = F.when(F.col("exposure").isin("unauthenticated", "authenticated", "internal", "undeployed", "unreachable"), F.col("exposure")).otherwise("")
    cell = F.element_at(table, F.concat_ws("|", "severity", "confidence", known))
    return findings.withColumn("_cell", cell).select("*", "_cell.score", "_cell.priority").drop("_cell")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fp", fingerprint(F.col("tool"), F.col("rule"), F.col("file"), F.col("message")))


def with_occurrence(findings: DataFrame, tie: str) -> DataFrame:
    """Numbers equal fingerprints from 0 in fix-first order; ``tie`` orders what is equal otherwise."""
    order = W.partitionBy("fp").orderBy("priority", F.desc("score"), "category", "rule", "file", "line", tie)
    return findings.withColumn("occurrence", F.row_number().over(order) - 1)


def baseline(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts per fingerprint, and the numbers in the messages of findings whose counts matter, by occurrence."""
    counts = findings.groupBy("fp").agg(F.count("*").alias("known"))
    return counts, findings.where("counts_matter").select("fp", "occurrence", magnitudes(F.col("message")).alias("was"))


def mark_new(findings: DataFrame, counts: DataFrame | None, numbers: DataFrame | None = None) -> DataFrame:
    """``is_new``: beyond the baseline's count, or a number of a counted message has risen. NULL without a baseline."""
    if counts is None:
        return findings.withColumn("is_new", F.lit(None).cast("boolean"))
    joined = findings.join(counts, "fp", "left").withColumn("is_new", F.col("occurrence") >= F.coalesce("known", F.lit(0)))
    if numbers is None:
        return joined.drop("known")
    joined = joined.join(numbers, ["fp", "occurrence"], "left").withColumn("now", magnitudes(F.col("message")))
    rose = F.exists(F.zip_with("now", "was", lambda n, w: n > w), lambda up: F.coalesce(up, F.lit(False)))
    worse = F.col("counts_matter") & F.col("was").isNotNull() & ((F.size("now") != F.size("was")) | rose)
    return joined.withColumn("is_new", F.col("is_new") | worse).drop("known", "now", "was")


def summary_matrix(findings: DataFrame) -> DataFrame:
    """Findings per category and priority, all four priorities present."""
    return findings.groupBy("category").agg(F.count("*").alias("total"), *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")])


def top_per_rule(findings: DataFrame, limit: int, tie: str) -> DataFrame:
    order = W.partitionBy("rule").orderBy("priority", F.desc("score"), "category", "file", "line", tie)
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def blocking(findings: DataFrame, fail_on: str) -> DataFrame:
    """Findings that stop a merge: new, not of low confidence, at or above a priority."""
    return findings.where("is_new AND confidence != 'low'").where(F.col("priority") <= fail_on)


def unmet_tools(required: DataFrame, runs: DataFrame) -> DataFrame:
    """Required tools that did not run clean to the end; skipped and failed runs are not clean."""
    return required.join(runs.where("skipped IS NULL AND error IS NULL"), "tool", "left_anti")


def ratchet(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of counts per path: path, was, now, change (NEW FILE, INCREASED, improved, same)."""
    both = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), "path", "full")
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    change = F.when(F.col("was").isNull() & (now > 0), "NEW FILE").when(now > was, "INCREASED").when(now < was, "improved").otherwise("same")
    return both.select("path", was.alias("was"), now.alias("now"), change.alias("change"))


def suppress(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    return findings.join(suppressed, "fp", "left_anti")


def relevant_issues(issues: DataFrame, selected: DataFrame) -> DataFrame:
    """Issues with up to two nodes if one is selected, with more if their first is, without nodes never."""
    nodes = issues.where(F.size("node_ids") > 0).withColumn("n", F.explode(F.when(F.size("node_ids") <= 2, F.col("node_ids")).otherwise(F.slice("node_ids", 1, 1))))
    return nodes.join(selected.withColumnRenamed("id", "n"), "n", "left_semi").drop("n").distinct()


def incomplete_reasons(issues: DataFrame, codes: list[str], examples: int = 3) -> DataFrame:
    """Per code that makes an analysis incomplete: number of issues and the first examples. Counts are summed apart, so the window keeps
    only the first rows of a code before they are shuffled."""
    order = W.partitionBy("code").orderBy("evidence")
    own = issues.where(F.col("code").isin(codes)).select("code", "evidence")
    first = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples)
    shown = first.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("evidence")), ", ").alias("examples"))
    return own.groupBy("code").agg(F.count("*").alias("n")).join(shown, "code", "left").select("code", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def blocks(condition: Column) -> Column:
    return F.max(condition.cast("int")) == 1
