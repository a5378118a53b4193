"""Small relational operators of the evidence model: links, gaps, choices, sets, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running_before

#: Concepts of one symbol are dealt to tasks by so many.
DEALT = 1_000
# Fixed mapping of an issue's severity to severity and confidence of its finding.
ISSUE_SEVERITY = {"error": ("high", "medium"), "warning": ("medium", "low"), "info": ("info", "low")}


def ordinals(findings: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``findings`` with ``ordinal``, from 0 among rows of equal keys; tells equal results of a run apart."""
    return findings.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(tie)) - 1)


def without_fix(made: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``made`` that no row of ``fixed`` answers, wherever it stands: views altered later, indexes of tables made in the same step, and the like."""
    return made.join(fixed.select(keys).distinct(), keys, "left_anti")


def enclosing(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """uses (path, line) with ``name`` of the innermost of definitions (path, name, first, last) around the line, or NULL. Definitions' lines are 32-bit integers.

    A range of lines is cut into blocks of 1, 2, 4 and so on lines, each block at a multiple of its size, two of a size at most; a line lies in one block of each size. A block
    keeps only its innermost definition, so work grows with definitions and lines, never with pairs of them, however crowded a file is.
    """
    ranges = definitions.selectExpr("path", "name", "CAST(first AS int) AS first", "CAST(last AS int) AS last").where("first <= last").groupBy("path", "first", "last").agg(F.min("name").alias("name"))
    # the latest beginning is the innermost; of equal ones the earliest end, then the name: the first two as one number, so blocks are combined before the shuffle
    rank = F.expr("shiftleft(CAST(first AS bigint), 32) + (2147483647 - CAST(last AS bigint))").alias("rank")
    size = F.expr("length(bin(CAST(last AS bigint) - first + 1)) - 1")
    spans = ranges.select("path", rank, "first", "last", F.explode(F.sequence(F.lit(0), size)).alias("level"))
    spans = spans.selectExpr("path", "rank", "level", "-shiftright(-CAST(first AS bigint), level) AS low", "shiftright(CAST(last AS bigint) + 1, level) AS high").where("low < high")
    ends = F.explode(F.expr("array(IF(low & 1 = 1, low, NULL), IF(high & 1 = 1, high - 1, NULL))"))
    blocks = spans.select("path", "level", "rank", ends.alias("block")).where("block IS NOT NULL").groupBy("path", "level", "block").agg(F.max("rank").alias("rank"))
    top = ranges.agg(F.max(size)).first()[0] or 0
    asked = uses.select("path", "line").distinct().select("path", "line", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).withColumn("block", F.expr("shiftright(CAST(line AS bigint), level)"))
    best = asked.join(blocks, ["path", "level", "block"]).groupBy("path", "line").agg(F.max("rank").alias("rank"))
    found = best.selectExpr("path", "line", "CAST(shiftright(rank, 32) AS int) AS first", "CAST(2147483647 - (rank & 4294967295) AS int) AS last")
    inner = found.join(ranges, ["path", "first", "last"]).select("path", "line", "name")
    return uses.join(inner, ["path", "line"], "left")


def latest_before(uses: DataFrame, bindings: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``uses`` with ``value`` of the last of ``bindings`` with equal keys at or before ``at``, or NULL: imports that shadow earlier ones, declarations before a line.

    One ordered pass over both; at equal places a binding comes first, and of several the greatest value counts.
    """
    rows = uses.withColumn("own", F.lit(True)).unionByName(bindings.groupBy(*keys, at).agg(F.max(value).alias(value)).withColumn("own", F.lit(False)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(at, "own").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("own").select(*uses.columns, value)


def row_budget(groups: DataFrame, budget: int, order: list[str | Column]) -> DataFrame:
    """groups (name, n) with ``shown``: rows of each, in order, until the budget is spent. There may be as many groups as rows, so no task holds them all."""
    left = F.greatest(F.lit(budget) - F.col("evigraph_before"), F.lit(0))
    return running_before(groups, "n", order, "evigraph_before").select(*groups.columns, F.least("n", left).alias("shown"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each set of equal keys. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f")).select(*keys, "f.*").select(rows.columns)


def ranked(rows: DataFrame, measures: list[str], name: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the greatest sum of measures, then by name."""
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    return rows.orderBy(F.desc(total), name).limit(limit)


def best_tag(tags: DataFrame) -> DataFrame:
    """(path, tag): of tags (path, tag, layer, evidence) the one with most evidence, then the least layer, then the name."""
    return tags.groupBy("path").agg(F.min(F.struct(-F.col("evidence"), "layer", "tag")).alias("b")).select("path", "b.tag")


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that are added or gone."""
    both = before.select(key).distinct().withColumn("old", F.lit(True)).join(after.select(key).distinct().withColumn("new", F.lit(True)), key, "full")
    return both.where("old IS NULL OR new IS NULL").select(key, F.when(F.col("old").isNull(), "added").otherwise("gone").alias("change"))


def shared_stores(uses: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the number of stores that both use and that either does; uses has key and store."""
    sets = uses.groupBy("key").agg(F.collect_set("store").alias("s"))
    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), F.size(F.array_union("sa", "sb")).alias("either"))


def common_items(uses: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """(group, item): items that every member of a group has, counted and not intersected list by list."""
    once = uses.select(group, member, item).distinct()
    members = once.groupBy(group).agg(F.countDistinct(member).alias("members"))
    return once.groupBy(group, item).agg(F.count("*").alias("n")).join(members, group).where("n = members").select(group, item)


def map_state(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, state): wanted and existing (path, hash) as missing, stale or orphan; what is up to date is left out."""
    both = wanted.withColumnRenamed("hash", "w").join(existing.withColumnRenamed("hash", "e"), "path", "full")
    state = F.when(F.col("e").isNull(), "missing").when(F.col("w").isNull(), "orphan").when(F.col("w") != F.col("e"), "stale")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def known_elsewhere(references: DataFrame, stores: DataFrame) -> DataFrame:
    """References (source, store) found by pattern in tests, kept only for stores that other evidence has."""
    return references.join(stores.select("store").distinct(), "store", "left_semi")


def unconfirmed(references: DataFrame, stores: DataFrame, of: str) -> DataFrame:
    """(of, n): how many stores each artifact names that no other evidence has."""
    return references.join(stores.select("store").distinct(), "store", "left_anti").select(of, "store").distinct().groupBy(of).agg(F.count("*").alias("n"))


def owned_symbols(concepts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(concept, target): concepts (concept, owner, symbol) linked to symbols (target, name, path) of that name in the owner's own file.

    There may be as many links as concepts times symbols. Concepts of one symbol are dealt to parts of ``DEALT``, which each meet all targets, and only what several names link
    is made distinct, so links stream out of their tasks and none is held or shuffled for the others.
    """
    c, s = concepts.select("concept", "owner", "symbol").distinct(), symbols.selectExpr("target", "path AS owner", "name AS symbol").distinct()
    parts = c.groupBy("owner", "symbol").agg(F.expr(f"1 + count(*) DIV {DEALT}").alias("parts"))
    c = _several(c, "concept").join(parts, ["owner", "symbol"]).withColumn("part", F.expr("pmod(xxhash64(concept), parts)")).drop("parts")
    s = _several(s, "target").join(parts, ["owner", "symbol"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    width = int(concepts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows in say nothing of links out, so few rows must not become few tasks

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = ["owner", "symbol", "part"]
        return a.repartition(width, *keys).join(b.hint("merge"), keys).select("concept", "target")

    once = met(c, s.where("NOT several")).unionByName(met(c.where("NOT several"), s.where("several")))
    return once.unionByName(met(c.where("several"), s.where("several")).distinct())


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Distinct ``rows`` with ``several``: whether another row has the same key."""
    counts = rows.groupBy(F.col(key).alias("evigraph_key")).agg((F.count("*") > 1).alias("several"))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("evigraph_key"))).drop("evigraph_key")


def with_tests_and_stores(functions: DataFrame, tests: DataFrame, stores: DataFrame, churn: DataFrame | None = None, first: int = 12) -> DataFrame:
    """functions (key, name, path) with the first tests (name, test) by order of name, the stores (key, store), and commits of the path (path, commits), NULL unless asked for."""
    place = F.row_number().over(W.partitionBy("name").orderBy("test"))
    shown = tests.select("name", "test").distinct().withColumn("place", place).where(F.col("place") <= first).groupBy("name").agg(F.array_sort(F.collect_list("test")).alias("tests"))
    used = stores.groupBy("key").agg(F.array_sort(F.collect_set("store")).alias("stores"))
    empty = F.expr("CAST(array() AS array<string>)")
    out = functions.join(shown, "name", "left").join(used, "key", "left")
    out = out.withColumn("commits", F.lit(None).cast("long")) if churn is None else out.join(churn, "path", "left")
    return out.select("key", F.coalesce("tests", empty).alias("tests"), F.coalesce("stores", empty).alias("stores"), "commits")


def related(evidence: list[DataFrame], limit: int) -> DataFrame:
    """(path, other, n): files tied by any of the evidence tables (path, other), with the number of ties; the most tied first, per file."""
    ties = evidence[0]
    for more in evidence[1:]:
        ties = ties.unionByName(more)
    counted = ties.where("path != other").groupBy("path", "other").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "other"))
    return counted.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def issue_locations(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """(issue, file, line): issues (issue, evidence, node_ids) at ``path:line`` of their evidence if the path is that of one of their nodes (id, path, line), else
    at the first node with a path, else what the evidence says."""
    ties = issues.select("issue", F.posexplode("node_ids").alias("place", "id")).join(nodes.where("path IS NOT NULL AND path != ''"), "id")
    located = ties.groupBy("issue").agg(F.collect_set("path").alias("paths"), F.min(F.struct("place", "path", F.coalesce("line", F.lit(0)).alias("line"))).alias("first"))
    said = F.coalesce("evidence", F.lit(""))
    path, line = F.regexp_extract(said, "^(.*?):([0-9]+)", 1), F.try_to_number(F.regexp_extract(said, "^(.*?):([0-9]+)", 2), F.lit("999999999")).cast("int")
    own = said.rlike("^.*?:[0-9]+") & F.coalesce(F.array_contains("paths", path), F.lit(False))
    out = issues.join(located, "issue", "left")
    return out.select("issue", F.when(own, path).otherwise(F.coalesce("first.path", said)).alias("file"), F.when(own, line).otherwise(F.coalesce("first.line", F.lit(0))).alias("line"))


def unexamined(skipped: DataFrame, inputs: DataFrame, most: int = 20) -> DataFrame:
    """(check, n, listed): files (path, status) that were not read among the inputs (check, path) of each check, and the first of them."""
    lost = inputs.join(skipped, "path")
    place = F.row_number().over(W.partitionBy("check").orderBy("path"))
    shown = lost.withColumn("place", place).where(F.col("place") <= most).groupBy("check").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(" ("), "status", F.lit(")")))), ", ").alias("listed"))
    return lost.groupBy("check").agg(F.count("*").alias("n")).join(shown, "check")


def index_counts(functions: DataFrame) -> DataFrame:
    """One row of counts over functions (language, routed, guarded, tests, homonyms, key)."""
    has = lambda condition: F.count_if(F.expr(condition))
    return functions.agg(
        F.count("*").alias("total"), has("language = 'python'").alias("python"), has("language != 'python'").alias("javascript"), has("routed").alias("routed"), has("routed AND guarded").alias("guarded"),
        has("tests = 0").alias("untested"), has("homonyms > 1").alias("ambiguous"), F.countDistinct("key").alias("ids"),
    )


def missing_per_file(symbols: DataFrame, failed: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, missing): undocumented symbols (path, documented) per file; a file that failed keeps the count of the baseline (path, n)."""
    own = symbols.groupBy("path").agg(F.count_if(~F.col("documented")).alias("missing"))
    kept = failed.select("path").distinct().join(baseline, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("missing"))
    return own.join(failed.select("path").distinct(), "path", "left_anti").unionByName(kept).where("missing > 0")


def group_evidence(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, name, score): for links (path, kind, target) and groups (name, kind, target) how many distinct targets of each kind they share, summed."""
    return links.select("path", "kind", "target").distinct().join(groups.select("name", "kind", "target").distinct(), ["kind", "target"]).groupBy("path", "name").agg(F.count("*").alias("score"))


def grouped_references(references: DataFrame, tables: int = 3, names: int = 5) -> DataFrame:
    """(location, message): unknown columns (location, table_name, column_name) as one line for each place, so many tables and names of each shown."""
    once = references.distinct()
    of_table = W.partitionBy("location", "table_name").orderBy("column_name")
    per = once.withColumn("place", F.row_number().over(of_table)).groupBy("location", "table_name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= names, F.col("column_name")))).alias("c"))
    part = F.concat(F.col("table_name"), F.lit(": "), F.array_join("c", ", "), F.when(F.col("n") > names, F.concat(F.lit(" and "), (F.col("n") - names).cast("string"), F.lit(" more"))).otherwise(""))
    of_place = W.partitionBy("location").orderBy("table_name")
    shown = per.withColumn("part", part).withColumn("place", F.row_number().over(of_place)).groupBy("location").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= tables, F.struct("table_name", "part")))).alias("p")
    )
    return shown.select("location", F.concat(F.array_join(F.transform("p", lambda p: p["part"]), "; "), F.when(F.col("n") > tables, F.concat(F.lit("; "), (F.col("n") - tables).cast("string"), F.lit(" more tables"))).otherwise("")).alias("message"))


def affected(changed_files: DataFrame, tags: DataFrame, maps: DataFrame) -> DataFrame:
    """(artefact, n): maps (tag, artefact) of the tags (path, tag) of changed files, with the number of files."""
    return tags.join(changed_files.select("path").distinct(), "path", "left_semi").join(maps, "tag").select("artefact", "path").distinct().groupBy("artefact").agg(F.count("*").alias("n"))


def declared_consumers(owners: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(concept, relation, path): owners (concept, owner, consumers) that a changed file owns or consumes."""
    own = owners.join(changed_files.select("path").distinct(), F.col("owner") == F.col("path")).select("concept", F.lit("owner").alias("relation"), "path")
    uses = owners.select("concept", F.explode("consumers").alias("path")).join(changed_files.select("path").distinct(), "path").select("concept", F.lit("consumer").alias("relation"), "path")
    return own.unionByName(uses).distinct()


def expand_aliases(query: Column, aliases: dict[str, list[str]]) -> Column:
    """The query, normalised, and every word group (a key and its aliases) that equals, contains or lies in it."""
    normal = lambda c: F.array_join(camel(c), " ")
    out = F.array(normal(query))
    for key, others in sorted(aliases.items()):
        group = F.transform(F.array(*map(F.lit, [key, *others])), normal)
        meets = F.exists(group, lambda g: F.contains(g, normal(query)) | F.contains(normal(query), g))
        out = F.array_union(out, F.when(meets, group).otherwise(F.expr("CAST(array() AS array<string>)")))
    return F.array_sort(F.filter(out, lambda t: t != ""))


def camel(value: Column) -> Column:
    from ..functions.scalars import camel_words

    return camel_words(value)


def issues_as_findings(issues: DataFrame) -> DataFrame:
    """tool, rule, severity, confidence, category, file, line, message of issues (code, severity, file, line, message)."""
    pick = lambda i, other: F.coalesce(*[F.when(F.col("severity") == k, F.lit(v[i])) for k, v in ISSUE_SEVERITY.items()], F.lit(other))
    return issues.select(F.lit("impact").alias("tool"), F.concat(F.lit("impact/"), "code").alias("rule"), pick(0, "low").alias("severity"), pick(1, "low").alias("confidence"), F.lit("traceability").alias("category"), "file", "line", "message")
