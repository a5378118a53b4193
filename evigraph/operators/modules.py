"""What names mean across files: modules that imports name, and definitions behind chains of re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .resolve import ancestors

#: Endings that a JavaScript or TypeScript import may leave out, and those that a Python import does, in the order in which they are tried (fixed values).
SCRIPT_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
PYTHON_ENDINGS = (".py",)
#: Folders below the root of a repository in which Python packages commonly lie (fixed values).
PYTHON_ROOTS = ("", "src", "backend")


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` segments, ``..`` taken back; NULL if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.struct(F.lit(False).alias("out"), F.slice(parts, F.lit(1), F.lit(0)).alias("kept"))

    def step(state: Column, part: Column) -> Column:
        size = F.size(state["kept"])
        up = part == ".."
        kept = F.when(up, F.slice(state["kept"], F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.array_append(state["kept"], part))
        return F.struct((state["out"] | (up & (size == 0))).alias("out"), kept.alias("kept"))

    return F.aggregate(parts, empty, step, lambda s: F.when(~s["out"], F.array_join(s["kept"], "/")))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _joined(folder: Column, rest: Column) -> Column:
    return normal_path(F.concat(folder, F.lit("/"), rest))


def probe(bases: DataFrame, files: DataFrame, key: list[str], endings: tuple[str, ...], index: str) -> DataFrame:
    """``key`` and ``target``: the first file that a base stands for. ``bases`` has ``key``, place and base; bases of a key are tried by place, each as it
    stands, with each ending, then as a folder with a file ``index``. Every try is a row that meets the files by equality."""
    tries = [F.col("base"), *[F.concat("base", F.lit(e)) for e in endings], *[F.concat(F.when(F.col("base") != "", F.concat("base", F.lit("/"))).otherwise(""), F.lit(index + e)) for e in endings]]
    tried = bases.where("base IS NOT NULL").select(*key, "place", F.posexplode(F.array(*tries)).alias("try", "target"))
    met = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return met.groupBy(*key).agg(F.min(F.struct("place", "try", "target")).alias("m")).select(*key, "m.target")


def inherited(configs: DataFrame) -> DataFrame:
    """Configurations (folder, extends, base_url, patterns) with what they inherit: (folder, base, base_url, patterns): where its patterns lead from, and its base if
    one is stated. Paths are relative to the folder of the configuration that states them; a folder has one configuration.

    A configuration's own base and its own patterns each replace those that it extends. Chains are followed by doubling: a round replaces what a
    configuration extends by what that one extends, taking over what is still missing; circles end with what was found on them.
    """
    stated = F.col("patterns").isNotNull()
    own_base = F.when(F.col("base_url").isNotNull(), _joined(F.col("folder"), F.col("base_url")))
    state = cut(configs.groupBy("folder").agg(F.min_by("extends", F.struct("extends")).alias("extends"), F.min("base_url").alias("base_url"), F.first("patterns", True).alias("patterns")).select("folder", "extends", own_base.alias("base"), F.when(stated, F.coalesce(own_base, F.col("folder"))).alias("from"), "patterns"))
    open_, rounds = state.where("extends IS NOT NULL").count(), 0
    while open_ and rounds < 64:
        rounds += 1
        above = state.select(F.col("folder").alias("extends"), F.col("extends").alias("further"), F.col("base").alias("a_base"), F.col("from").alias("a_from"), F.col("patterns").alias("a_patterns"))
        met = state.join(above, "extends", "left")
        found = F.col("patterns").isNotNull()
        further = F.when((F.col("further") != F.col("folder")) & (F.col("further") != F.col("extends")), F.col("further"))
        state = cut(met.select("folder", further.alias("extends"), F.coalesce("base", "a_base").alias("base"), F.when(found, F.col("from")).otherwise(F.col("a_from")).alias("from"), F.coalesce("patterns", "a_patterns").alias("patterns")))
        now = state.where("extends IS NOT NULL").count()
        if now == open_ and rounds > 1 and now <= 2 ** (rounds - 1):  # more rounds than a chain of all that are left could need
            break
        open_ = now
    return state.select("folder", F.coalesce("from", "base", "folder").alias("base"), F.col("base").alias("base_url"), "patterns")


def resolve_script_imports(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """(import_id, target, local): imports (import_id, path, module) of scripts as files (path).

    A module that begins with a dot stands below the importing file's folder. Others are looked up in the configuration (folder, extends, base_url, patterns)
    of the nearest folder above: of the ``patterns`` (an array of pattern and targets) that match, the one with the longest text before its ``*``, then the least, decides alone,
    its targets tried in order; without one the base, if a configuration states one. ``local`` says whether the module ought to be
    a file of this tree, so a gap can be told from a package.

    Patterns meet modules by equality on the text before the star, cut to each length that the configuration's patterns have, so there is neither a
    pair of every module with every pattern nor a nested loop.
    """
    asked = imports.select("import_id", "path", "module").where("module IS NOT NULL").distinct()
    relative = F.startswith("module", F.lit("."))
    near = asked.where(relative).select("import_id", F.lit(0).alias("place"), _joined(_folder(F.col("path")), F.col("module")).alias("base"))
    others = asked.where(~relative)
    settled = cut(inherited(configs))
    tried = others.select("import_id", "module", F.posexplode(ancestors(F.col("path"))).alias("up", "folder")).join(settled.select("folder"), "folder")
    under = cut(tried.groupBy("import_id", "module").agg(F.min_by("folder", "up").alias("folder")))
    rules = settled.select("folder", "base", F.explode("patterns").alias("p")).select("folder", "base", F.col("p.pattern").alias("pattern"), F.col("p.targets").alias("targets")).where(F.length("pattern") - F.length(F.replace("pattern", F.lit("*"), F.lit(""))) <= 1)
    starred = F.contains("pattern", F.lit("*"))
    rules = cut(rules.withColumns({"open": starred, "head": F.substring_index("pattern", "*", 1), "tail": F.when(starred, F.substring_index("pattern", "*", -1)).otherwise("")}))
    sizes = rules.groupBy("folder").agg(F.collect_set(F.length("head")).alias("sizes"))
    heads = under.join(sizes, "folder").select("import_id", "module", "folder", F.explode("sizes").alias("size")).where(F.length("module") >= F.col("size")).withColumn("head", F.expr("left(module, size)"))
    met = heads.join(rules, ["folder", "head"]).where("(NOT open AND module = head) OR (open AND length(module) >= length(head) + length(tail) AND endswith(module, tail))")
    best = met.groupBy("import_id").agg(F.min(F.struct(-F.length("head"), "pattern", "head", "tail", "open", "targets", "base", "module")).alias("b")).select("import_id", "b.*")
    wild = F.expr("CASE WHEN open THEN substring(module, length(head) + 1, length(module) - length(head) - length(tail)) ELSE '' END")
    mapped = best.withColumn("wild", wild).select("import_id", "base", "wild", F.posexplode("targets").alias("place", "to")).select("import_id", "place", _joined(F.col("base"), F.replace(F.col("to"), F.lit("*"), F.col("wild"))).alias("base"))
    based = under.join(settled.where("base_url IS NOT NULL").select("folder", "base_url"), "folder").join(best.select("import_id"), "import_id", "left_anti").select("import_id", F.lit(0).alias("place"), _joined(F.col("base_url"), F.col("module")).alias("base"))
    found = probe(near.unionByName(mapped).unionByName(based), files, ["import_id"], SCRIPT_ENDINGS, "index")
    expected = near.select("import_id").unionByName(best.select("import_id")).distinct().withColumn("must", F.lit(True))
    out = asked.select("import_id").distinct().join(found, "import_id", "left").join(expected, "import_id", "left")
    return out.select("import_id", "target", (F.col("target").isNotNull() | F.coalesce("must", F.lit(False))).alias("local"))


def package_roots(files: DataFrame) -> DataFrame:
    """(folder, root): for every folder with files the folder that holds its outermost package: the nearest folder above, itself included, that has no ``__init__.py``."""
    packages = files.where(F.col("path").rlike("(^|/)__init__[.]py$")).select(_folder(F.col("path")).alias("above")).where("above != ''").distinct().withColumn("package", F.lit(True))
    folders = files.select(_folder(F.col("path")).alias("folder")).distinct()
    lines = folders.select("folder", F.posexplode(F.concat(F.array("folder"), F.when(F.col("folder") != "", ancestors(F.col("folder"))).otherwise(F.expr("CAST(array() AS array<string>)")))).alias("up", "above"))
    first = lines.join(packages, "above", "left").where("package IS NULL").groupBy("folder").agg(F.min_by("above", "up").alias("root"))
    return first


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, target): imports (import_id, path, module, level) of Python files as files (path), NULL where none or several fit.

    A relative import (``level`` > 0) goes up from the importing file's folder. An absolute one stands below the folder of the file's outermost package, else below the
    root, its ``src`` or ``backend``, or the file's own folder, if the files found there are one and the same.
    """
    asked = imports.selectExpr("import_id", "path", "coalesce(module, '') AS module", "coalesce(level, 0) AS level").distinct()
    asked = asked.withColumns({"folder": _folder(F.col("path")), "rest": F.replace("module", F.lit("."), F.lit("/"))})
    ups = F.expr("concat(folder, repeat('/..', level - 1), '/', rest)")
    relative = asked.where("level > 0").select("import_id", F.lit(0).alias("place"), normal_path(ups).alias("base"))
    absolute = asked.where("level <= 0 AND module != ''")
    rooted = absolute.join(package_roots(files), "folder").select("import_id", F.lit(0).alias("place"), _joined(F.col("root"), F.col("rest")).alias("base"))
    first = cut(probe(relative.unionByName(rooted), files, ["import_id"], PYTHON_ENDINGS, "__init__"))
    folders = F.array(*[F.lit(r) for r in PYTHON_ROOTS], F.col("folder"))
    rest = absolute.join(first, "import_id", "left_anti").select("import_id", "rest", F.explode(F.array_distinct(folders)).alias("under"))
    tried = rest.select("import_id", F.col("under").alias("root"), F.lit(0).alias("place"), _joined(F.col("under"), F.col("rest")).alias("base"))
    common = probe(tried, files, ["import_id", "root"], PYTHON_ENDINGS, "__init__").groupBy("import_id").agg(F.min("target").alias("target"), F.max("target").alias("last")).where("target = last").drop("last")
    return asked.select("import_id").distinct().join(first.unionByName(common), "import_id", "left")


def export_origins(wanted: DataFrame, definitions: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name, origin, origin_name, state): where names (file, name) that a file offers are defined.

    ``definitions`` has file and name, ``reexports`` file, place, public, target and imported. A file's own definition shadows its named re-exports, these its
    ``*`` re-exports; of several named ones the first by place decides, of several files behind stars the nearest, then the first. ``default`` does not pass through a ``*``; a re-export of a whole
    module under a name (``imported`` is ``*``) ends there, with the state ``module``. States are ``found``, ``module``, ``missing`` (the
    chain ends at a file without the name) and ``circle``.

    Every (file, name) has one next hop, so chains are followed by doubling: round k replaces a hop by the hop of its end, so a chain of n hops settles in about
    log2(n) rounds; what no round settles any more is a circle.
    """
    own = definitions.select("file", "name").distinct()
    named = reexports.where("public != '*'").groupBy("file", F.col("public").alias("name")).agg(F.min(F.struct("place", "target", "imported")).alias("r")).select("file", "name", F.col("r.target").alias("to_file"), F.col("r.imported").alias("to_name"))
    asked = cut(wanted.select("file", "name").unionByName(named.where("to_name != '*'").select(F.col("to_file").alias("file"), F.col("to_name").alias("name"))).distinct())
    stars = reexports.where("public = '*'").select("file", F.col("target").alias("to"), "place").groupBy("file", "to").agg(F.min("place").alias("place"))
    offered = cut(own.unionByName(named.select("file", "name")).distinct().withColumnsRenamed({"file": "to"}))
    lacking = cut(asked.join(offered.withColumnRenamed("to", "file"), ["file", "name"], "left_anti").where("name != 'default'"))
    wanted_of = cut(offered.join(lacking.select("name").distinct(), "name", "left_semi"))
    reach = star_reach(stars, wanted_of.select("to").distinct())
    through = reach.join(wanted_of, "to").join(lacking, ["file", "name"], "left_semi").groupBy("file", "name").agg(F.min(F.struct("way", "to")).alias("r")).select("file", "name", F.col("r.to").alias("to_file"), F.col("name").alias("to_name"))
    # names that a star offers are asked of a file that has them itself, so no further names come up
    nodes = asked.unionByName(through.select(F.col("to_file").alias("file"), F.col("to_name").alias("name"))).distinct()
    hops = named.unionByName(through).join(own, ["file", "name"], "left_anti")
    ends = nodes.join(own.withColumn("own", F.lit(True)), ["file", "name"], "left").join(hops, ["file", "name"], "left")
    state = F.when(F.col("own"), "found").when(F.col("to_file").isNull(), "missing").when(F.col("to_name") == "*", "module")
    step = cut(ends.select("file", "name", state.alias("state"), F.when(F.col("own") | F.col("to_file").isNull(), F.col("file")).otherwise(F.col("to_file")).alias("to_file"), F.when(F.col("own") | F.col("to_file").isNull(), F.col("name")).otherwise(F.col("to_name")).alias("to_name")))
    left = step.where("state IS NULL").count()
    while left:
        ahead = step.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("state").alias("a_state"), F.col("to_file").alias("a_file"), F.col("to_name").alias("a_name"))
        moved = step.where("state IS NULL").join(ahead, ["to_file", "to_name"]).select("file", "name", F.col("a_state").alias("state"), F.col("a_file").alias("to_file"), F.col("a_name").alias("to_name"))
        step = cut(step.where("state IS NOT NULL").unionByName(moved))
        now = step.where("state IS NULL").count()
        if now == left:
            break
        left = now
    lost = F.col("state").isNull() | (F.col("state") == "missing")
    out = wanted.select("file", "name").distinct().join(step, ["file", "name"])
    return out.select("file", "name", F.when(~lost, F.col("to_file")).alias("origin"), F.when(~lost, F.col("to_name")).alias("origin_name"), F.coalesce("state", F.lit("circle")).alias("state"))


def star_reach(stars: DataFrame, ends: DataFrame) -> DataFrame:
    """(file, to, way): which of ``ends`` (to) files reach by ``*`` re-exports alone, each pair once, by the way with the fewest hops, of these by the one whose places come
    first; the way holds their number, then the places.

    Round k knows all ways of fewer than 2^k hops to an end and all walks of exactly 2^k hops between files; one before the other gives the ways of up to twice as many, so a chain of n
    stars takes about log2(n) rounds and a row of each kind for a file, not one for each pair of files. A round without a new pair is the last, as a longer way would end in one of its length; so circles end.
    """
    links = stars.where("file != to").select("file", "to", F.struct(F.lit(1).alias("hops"), F.array("place").alias("places")).alias("way"))
    walks = cut(links)
    found = new = cut(links.join(ends, "to", "left_semi"))
    longer = F.struct((F.col("way.hops") + F.col("rest.hops")).alias("hops"), F.concat("way.places", "rest.places").alias("places"))

    def before(rest: DataFrame) -> DataFrame:
        ahead = rest.select(F.col("file").alias("mid"), F.col("to").alias("further"), F.col("way").alias("rest"))
        return walks.withColumnRenamed("to", "mid").join(ahead, "mid").select("file", F.col("further").alias("to"), longer.alias("way")).groupBy("file", "to").agg(F.min("way").alias("way"))

    first = True
    while first or not new.isEmpty():
        walks = walks if first else cut(before(walks))
        first = False
        new = cut(before(found).where("file != to").join(found, ["file", "to"], "left_anti"))
        found = cut(found.unionByName(new))
    return found
