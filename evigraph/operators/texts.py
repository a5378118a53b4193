"""Text search, line scans, function index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import camel_words, redact, topic_words


def seed_search(nodes: DataFrame, terms: list[str], limit: int = 12) -> DataFrame:
    """(id, score): best nodes (id, label, path) for the terms, which are scored in sorted order so that results do not depend on it."""
    named = nodes.withColumns({"l": F.array_join(camel_words(F.col("label")), " "), "p": F.array_join(camel_words(F.coalesce("path", F.lit(""))), " ")})
    score: Column = F.lit(0.0)
    for term in sorted(terms):
        score = F.when(F.col("l") == term, F.greatest(score, F.lit(100.0))).otherwise(score)
        score = F.when(F.col("p") == term, F.greatest(score, F.lit(98.0))).otherwise(score)
        score = score + F.when(F.contains("l", F.lit(term)), 28.0).otherwise(0.0) + F.when(F.contains("p", F.lit(term)), 22.0).otherwise(0.0)
    words = sorted({w for t in terms for w in t.split()})
    own = F.array_distinct(F.split(F.concat_ws(" ", "l", "p"), " "))
    score = score + 4.0 * F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    return named.select("id", score.alias("score"), "label").where("score > 0").orderBy(F.desc("score"), "label", "id").limit(limit).select("id", "score")


def source_hits(files: DataFrame, terms: list[str]) -> DataFrame:
    """(path, score, snippets): lines with a term count 8 each up to 36, shared words 0.2 each up to 12; the first three lines are shown redacted."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(F.lower("line"), F.lit(term.lower()))
    words = sorted({w for t in terms for w in t.split()})
    shared = F.size(F.array_intersect(F.array_distinct(camel_words(F.col("line"))), F.array(*map(F.lit, words))))
    scored = lines.select("path", "n", "line", hit.alias("hit"), shared.alias("shared")).where("hit OR shared > 0")
    grouped = scored.groupBy("path").agg(
        F.count_if("hit").alias("hits"), F.sum("shared").alias("words"), F.min_by("n", "n").alias("_"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("n", F.left(redact(F.trim("line")), F.lit(220)).alias("s"))))).alias("all")
    )
    return grouped.select("path", (F.least(F.lit(36.0), F.col("hits") * 8.0) + F.least(F.lit(12.0), F.col("words") * 0.2)).alias("score"), F.array_join(F.transform(F.slice("all", 1, 3), lambda x: x["s"]), " / ").alias("snippets"))


def inverted_index(files: DataFrame, least: int = 4) -> DataFrame:
    """(token, files): how many files hold an identifier of at least ``least`` characters."""
    tokens = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[A-Za-z_][A-Za-z0-9_]{{{least - 1},}}"), F.lit(0)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("files"))


def pattern_scan(files: DataFrame, patterns: list[tuple[str, str]], cap: int = 20, longest: int = 2000) -> DataFrame:
    """(rule, path, line): lines that match a rule's pattern; beyond ``cap`` per rule one row ``<rule>-capped`` says so. Longer lines are passed over."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.length("t") <= longest)
    hits = lines.select("path", "line", F.explode(F.filter(F.array(*[F.when(F.col("t").rlike(p), F.lit(r)) for r, p in patterns]), lambda r: r.isNotNull())).alias("rule"))
    # one row beyond the cap tells that there are more, so lines are matched once and few rows are shuffled
    ranked = hits.withColumn("place", F.row_number().over(W.partitionBy("rule").orderBy("path", "line"))).where(F.col("place") <= cap + 1)
    shown = F.col("place") <= cap
    return ranked.select(F.when(shown, F.col("rule")).otherwise(F.concat("rule", F.lit("-capped"))).alias("rule"), F.when(shown, F.col("path")).alias("path"), F.when(shown, (F.col("line") + 1).cast("long")).alias("line"))


def duplicates(rows: DataFrame, fingerprint: str, path: str) -> DataFrame:
    """(a, b): neighbours, in path order, among rows of equal fingerprint in at least two paths."""
    order = W.partitionBy(fingerprint).orderBy(path)
    return rows.select(fingerprint, path).distinct().withColumn("b", F.lead(path).over(order)).where("b IS NOT NULL").select(F.col(path).alias("a"), "b")


def callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(key, homonyms, blast_radius): functions (key, name) with how many share the name and how many other callers (caller, name) may mean them.

    Callers are counted per name before functions are joined, so a popular name costs its callers plus its homonyms, not their product; a
    function that calls its own name is taken off its own count."""
    named = functions.groupBy("name").agg(F.count("*").alias("homonyms"))
    called = calls.distinct().groupBy("name").agg(F.count("*").alias("n"))
    own = calls.distinct().select(F.col("caller").alias("key"), "name", F.lit(1).alias("self"))
    joined = functions.join(named, "name").join(called, "name", "left").join(own, ["key", "name"], "left")
    return joined.select("key", "homonyms", (F.coalesce("n", F.lit(0)) - F.coalesce("self", F.lit(0))).cast("long").alias("blast_radius"))


def store_clusters(uses: DataFrame) -> DataFrame:
    """(stores, n): exact sets of two or more stores that more than one function uses; ``uses`` has key and store."""
    sets = uses.groupBy("key").agg(F.array_sort(F.collect_set("store")).alias("s")).where(F.size("s") >= 2)
    return sets.groupBy(F.array_join("s", ",").alias("stores")).agg(F.count("*").alias("n")).where("n > 1")


def similar(records: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """(key, score): records (key, text) that share most topic words with ``text``; at least three."""
    want = F.filter(F.array_distinct(topic_words(F.lit(text))), lambda w: w != "")
    scored = records.select("key", F.size(F.array_intersect(F.array_distinct(topic_words(F.col("text"))), want)).cast("long").alias("score"))
    return scored.where("score >= 3").orderBy(F.desc("score"), "key").limit(limit)
