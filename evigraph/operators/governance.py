"""Owners, gates, contrasts, coverage, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owner_violations(known: DataFrame, found: DataFrame) -> DataFrame:
    """(concept, path, state): violations that are new, resolved or known; both tables have concept and path."""
    both = known.distinct().withColumn("k", F.lit(True)).join(found.distinct().withColumn("f", F.lit(True)), ["concept", "path"], "full")
    return both.select("concept", "path", F.when(F.col("k").isNull(), "new").when(F.col("f").isNull(), "resolved").otherwise("known").alias("state"))


def referenced_scripts(scripts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(script, surfaces): in how many surfaces (surface, text) the name of a script (a run of word characters) stands as a word.

    Surfaces are split into words, which meet the names by equality, so no surface is searched for every name."""
    words = surfaces.select("surface", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_#]+"), F.lit(0)))).alias("script"))
    hits = words.join(scripts, "script").where("script != surface").groupBy("script").agg(F.count("*").alias("surfaces"))
    return scripts.join(hits, "script", "left").select("script", F.coalesce("surfaces", F.lit(0)).cast("long").alias("surfaces"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(item, side): items of one side only, for each direction."""
    return left.exceptAll(right).distinct().join(right, "item", "left_anti").withColumn("side", F.lit("left")).unionByName(right.distinct().join(left, "item", "left_anti").withColumn("side", F.lit("right")))


def coverage(symbols: DataFrame, by: str) -> DataFrame:
    """Symbols, documented ones, and their share in tenths of a percent, 1000 for none, per group."""
    grouped = symbols.groupBy(by).agg(F.count("*").alias("symbols"), F.count_if("documented").alias("documented"))
    return grouped.withColumn("permille", F.expr("CASE WHEN symbols = 0 THEN 1000 ELSE (2000 * documented + symbols) DIV (2 * symbols) END"))


def sibling_contrast(rows: DataFrame, group: str, key: str, checks: str) -> DataFrame:
    """Rows that do not check while a sibling of their group does, with how many siblings do."""
    peers = rows.groupBy(group).agg(F.count_if(checks).alias("checking"))
    return rows.where(~F.col(checks)).join(peers.where("checking > 0"), group).select(key, group, "checking")


def owner_choice(candidates: DataFrame, group: str) -> DataFrame:
    """One owner per group: inside the group first, then by rank of its place, most references, name."""
    order = F.struct((~F.col("inside")).alias("o"), "rank", (-F.col("refs")).alias("r"), "path")
    return candidates.groupBy(group).agg(F.min(order)["path"].alias("owner"), F.max("refs").alias("most"))


def content_digest(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row: the sha256 over the digests of all files in the order of their keys. The list of digests meets in one task: 64 bytes a file."""
    each = files.select(key, F.sha2(F.concat(F.col(key).cast("string"), F.lit("|read|"), F.octet_length(text).cast("string"), F.lit("|"), F.coalesce(text, F.lit(""))), 256).alias("d"))
    # partial digests per run of keys keep the last list short
    runs = each.groupBy(F.floor(F.col(key) / 4096).alias("run")).agg(F.array_sort(F.collect_list(F.struct(key, "d"))).alias("l"), F.count("*").alias("n"))
    runs = runs.select("run", "n", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("d"))
    whole = runs.agg(F.array_sort(F.collect_list(F.struct("run", "d"))).alias("l"), F.sum("n").alias("files"))
    return whole.select("files", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("digest"))


#: A statement begins with one of these.
SQL_START = r"(?is)^\s*(select|insert\s+into|update|delete\s+from|with|create|alter|drop|merge\s+into)\b"
#: And a reading statement names a source.
SQL_BODY = r"(?is)\b(from|into|set|table|values|view|index)\b"


def looks_like_sql(text):
    return text.rlike(SQL_START) & text.rlike(SQL_BODY)
