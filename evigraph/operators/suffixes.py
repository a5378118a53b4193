"""Paths named by their ends: notes that name a file, and paths of another machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, UNIQUE, AMBIGUOUS, NONE = "exact", "unique", "ambiguous", "none"
MAPPED, BLOCKING = "mapped", "blocking"


def ends(path: Column) -> Column:
    """All ends of a path in whole segments, the shortest first: ``c``, ``b/c``, ``a/b/c``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def _ended(paths: DataFrame, depths: list[int]) -> DataFrame:
    """(tail, path, hits): for each end of ``paths`` that has one of the given numbers of segments the paths with it, and the least one.

    Only counts leave the tasks that read the paths: an end that a million paths share is one row of each task, and no list of paths is ever made.
    """
    at = F.array(*[F.lit(d) for d in depths]) if depths else F.expr("CAST(array() AS array<int>)")
    some = F.filter(F.transform(at, lambda n: F.get(F.col("ends"), n - 1)), lambda e: e.isNotNull())
    listed = paths.select("path").where("path != ''").distinct().withColumn("ends", ends(F.col("path")))
    return listed.select("path", F.explode(some).alias("tail")).groupBy("tail").agg(F.min("path").alias("path"), F.count("*").alias("hits"))


def by_end(wanted: DataFrame, paths: DataFrame, key: str = "q") -> DataFrame:
    """(key, path, hits, state) for each row of ``wanted`` (key, token): the path that a token names.

    A path that equals the token is ``exact``; else the one path that ends in it, by whole segments, is ``unique``; several are
    ``ambiguous`` and give no path, like ``none``. Leading ``/`` and ``./`` of a token do not count; a token that is NULL or empty names none. Keys need not be
    distinct. ``hits`` counts the paths that end in the token.

    How deep tokens are is asked first, so only ends of those depths are made of the paths; they meet tokens by equality, after they were counted.
    """
    token = F.regexp_replace(F.coalesce("token", F.lit("")), r"^(\.?/+)+", "")
    asked = wanted.select(key, token.alias("tail"))
    depths = sorted(r[0] for r in asked.where("tail != ''").select(F.size(F.split("tail", "/")).alias("n")).distinct().collect())
    tokens = asked.select("tail").distinct()
    whole = tokens.join(paths.select(F.col("path").alias("tail")).distinct(), "tail", "left_semi").select("tail", F.lit(True).alias("whole"))
    found = tokens.join(_ended(paths, depths), "tail").join(whole, "tail", "left")
    state = F.when(F.col("whole"), EXACT).when(F.col("hits") == 1, UNIQUE).when(F.col("hits") > 1, AMBIGUOUS).otherwise(NONE)
    named = F.when(F.col("whole"), F.col("tail")).when(F.col("hits") == 1, F.col("path"))
    return asked.join(found, "tail", "left").select(key, named.alias("path"), F.coalesce("hits", F.lit(0)).alias("hits"), state.alias("state"))


def home_folder(foreign: DataFrame, folders: DataFrame, key: str = "q", least: int = 2) -> DataFrame:
    """(key, folder): the longest end of a path of another machine, of ``least`` segments or more, that is a folder of this tree.

    ``foreign`` has key and path; of ``folders`` (folder) each is written from the root. One segment would be coincidence. Backslashes separate too; empty
    segments, ``.``, ``..`` and ``~`` do not count. Paths without such an end give no row.
    """
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda p: ~p.isin("", ".", "..", "~"))
    tails = foreign.select(key, F.explode(F.slice(ends(F.array_join(parts, "/")), least, 1 << 20)).alias("folder"))
    met = tails.join(folders.select("folder").distinct(), "folder", "left_semi")
    return met.groupBy(key).agg(F.max_by("folder", F.length("folder")).alias("folder"))


def deployed_files(wanted: DataFrame, files: DataFrame, key: str = "q") -> DataFrame:
    """(key, path, state): what a deployment's path (key, token) runs of ``files`` (path); keys are distinct.

    An absolute path is ``mapped`` if its folder has a home in this tree where a file of that name lies; else a file whose name is unique in the tree is taken. A relative
    path is taken if one file ends in it; one that climbs is looked up by its name. Several files are ``ambiguous``; without any the path is ``blocking``: something runs
    that was not read, so nothing below it may be called dead.
    """
    name = F.substring_index("token", "/", -1)
    asked = wanted.select(key, F.translate("token", "\\", "/").alias("token")).withColumn("name", name)
    absolute = F.startswith("token", F.lit("/")) | F.startswith("token", F.lit("~"))
    climbs = F.array_contains(F.split("token", "/"), "..")
    away = asked.where(absolute)
    homes = home_folder(away.select(key, F.regexp_extract("token", "^(.*)/[^/]*$", 1).alias("path")), folders_of(files), key)
    at_home = away.join(homes, key).select(key, F.concat_ws("/", "folder", "name").alias("path")).join(files.select("path").distinct(), "path", "left_semi").select(key, "path")
    rest = asked.join(at_home.select(key), key, "left_anti")
    shown = by_end(rest.select(key, F.when(absolute | climbs, F.col("name")).otherwise(F.col("token")).alias("token")), files, key)
    state = F.when(F.col("state") == NONE, BLOCKING).otherwise(F.col("state"))
    return at_home.select(key, "path", F.lit(MAPPED).alias("state")).unionByName(shown.select(key, "path", state.alias("state")))


def folders_of(files: DataFrame) -> DataFrame:
    """(folder): all folders above the files, written from the root."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("folder")).distinct()
