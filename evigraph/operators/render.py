"""Reports as text. What is shown is ranked and cut by Spark; only those rows reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import summary_matrix, top_per_rule


def cell(value: Column, most: int = 160) -> Column:
    """A value for a Markdown table: no line break, no pipe, no markup, cut at ``most`` characters."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "), r"([\\`*_{}\[\]<>|#!])", r"\\$1")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def markdown_report(findings: DataFrame, per_rule: int = 15, tie: str = "fp") -> str:
    """Priorities per category, then the first findings of each rule, worst rules first."""
    head = ["| category | total | P0 | P1 | P2 | P3 |", "|---|---|---|---|---|---|"]
    head += ["| " + " | ".join(str(v) for v in r) + " |" for r in summary_matrix(findings).withColumn("category", cell(F.col("category"))).orderBy("category").collect()]
    shown = top_per_rule(findings, per_rule, tie).select("rule", "place", "priority", "score", cell(F.col("file")).alias("file"), "line", cell(F.col("message")).alias("message"))
    worst = findings.groupBy("rule").agg(F.max("score").alias("worst"))
    out = head
    rule = None
    for r in shown.join(worst, "rule").orderBy(F.desc("worst"), "rule", "place").collect():
        if r.rule != rule:
            rule = r.rule
            out += ["", f"## {rule}", ""]
        out.append(f"- {r.priority} {r.file}:{r.line} {r.message}")
    return "\n".join(out) + "\n"


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 200) -> str:
    """A flowchart of nodes (id, label) and the edges (src, dst, kind) between them, at most ``most`` of each; labels cannot break out of their quotes."""
    shown = nodes.orderBy("id").limit(most)
    quoted = F.regexp_replace(F.regexp_replace(F.left("label", F.lit(80)), r"\s+", " "), r"[\"<>#;&`]", "'")
    rows = shown.select("id", quoted.alias("label")).orderBy("id").collect()
    names = {r.id: f"n{i}" for i, r in enumerate(rows)}
    inside = edges.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = inside.select("src", "dst", F.regexp_replace("kind", r"[^A-Za-z_ ]", "").alias("kind")).distinct().orderBy("src", "dst", "kind").limit(most).collect()
    return "\n".join(["flowchart LR", *[f'  {names[r.id]}["{r.label}"]' for r in rows], *[f"  {names[e.src]} -->|{e.kind}| {names[e.dst]}" for e in links]]) + "\n"
