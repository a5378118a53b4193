"""URL filtering by sorted sweeps over reversed-host keys and over paths.

A rule is (host, path prefix, verdict); it covers its host, all subdomains, and every path that starts with its path.
Written from the right, a host and its subdomains are one interval of keys: ``com.example.`` up to ``com.example/``; below a host, the paths
with a prefix are one interval of keys too. Such intervals nest or are disjoint, so one ordered pass over each kind of key is enough: the last
interval that began at or before a key knows, in its stack, every interval that can contain that key. The first pass finds the rule hosts of a page, one for
each level of its host at most, the second the rules of these hosts that fit its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, shuffle_width, table

#: Sorts before every salt of a page.
FIRST = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _host_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule host: its interval of keys and the stack of hosts that enclose it, its own included."""
    nodes = rules.select("host").distinct().withColumn("labels", _reversed_labels(F.col("host")))
    own = nodes.select(_key(F.col("labels")).alias("at"), "host")
    up = nodes.select(_key(F.col("labels")).alias("key"), F.explode(F.expr("sequence(1, size(labels))")).alias("depth"), "labels")
    up = up.select("key", _key(F.slice("labels", F.lit(1), F.col("depth"))).alias("at"))
    stacks = up.join(own, "at").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "host"))).alias("stack"))
    return stacks.withColumn("end", F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")))


def _path_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def _path_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule: its interval of host and path and the stack of rules of that host that enclose it, its own included, as struct(at, verdict)."""
    once = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block wins over allow
    up = once.select("host", F.col("path").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left("path", n))).alias("path"))
    stacks = up.join(once, ["host", "path"]).groupBy("host", "own").agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("at"), "verdict"))).alias("stack"))
    return stacks.select(_path_key(F.col("host"), F.col("own")).alias("key"), "stack").withColumn("end", F.concat("key", F.lit("\U0010ffff")))


def _bounds(probes: DataFrame, buckets: int) -> list:
    """Lower bounds of at most ``buckets`` key ranges of about equal size; a hot host is split by its salt."""
    ranged = probes.select("key", "salt").repartitionByRange(buckets, "key", "salt").withColumn("part", F.spark_partition_id())
    found = ranged.groupBy("part").agg(F.min(F.struct("key", "salt")).alias("low")).orderBy("low").collect()  # one row a range
    return [row["low"] for row in found]


def _bucket(key: Column, salt: Column, bounds: list) -> Column:
    """Number of bounds at or below (key, salt), by binary search."""
    if len(bounds) < 2:
        return F.lit(0)
    lows = F.array(*[F.struct(F.lit(b["key"]).alias("key"), F.lit(b["salt"]).alias("salt")) for b in bounds])
    steps = [2**i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    probe = F.struct(key.alias("key"), salt.alias("salt"))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda done, step: F.when((done + step <= len(bounds)) & (F.get(lows, done + step - 1) <= probe), done + step).otherwise(done),
    )


def _swept(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``probes`` (key, salt and more) with ``active``, the stack of the last node (key, end, stack) that begins at or before their key.

    Keys are dealt to ranges of about equal size, a hot one by its salt; nodes are sent to the ranges that their interval meets. Only the bounds
    of ranges, one per shuffle partition, reach the driver.
    """
    bounds = _bounds(probes, shuffle_width(probes.sparkSession))
    first = F.lit(FIRST).cast("long")
    starts = nodes.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("key"), first, bounds), _bucket(F.col("end"), first, bounds))))
    events = probes.withColumn("bucket", _bucket(F.col("key"), F.col("salt"), bounds)).withColumn("probe", F.lit(True)).unionByName(
        starts.select("bucket", "key", "stack", first.alias("salt"), F.lit(False).alias("probe")), allowMissingColumns=True
    )
    sweep = W.partitionBy("bucket").orderBy("key", "salt", "probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("probe").select(*probes.columns, "active")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every row of ``pages``: id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. Of the rules that fit, the one with the longest host and path together wins,
    then the longest host; equal rules with both verdicts block. Without a fitting rule, ``rule`` is null and the verdict
    is ``default``. Null urls and urls without ``://`` have an empty host and path and take the default; null ids are ids like others; urls may be of any
    length. Repeated rows stay repeated; further columns of ``pages`` are ignored. Empty ``pages`` or ``rules`` give no row or only defaults.

    Cost: for each of the two sweeps one range shuffle of keys, one shuffle of rows and a sort in each range, and one shuffle that puts together the rule
    hosts of a page. What travels with a page is the stack around one place, whatever the number of rules of a host.
    """
    probes = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    probes = probes.withColumn("key", _key(_reversed_labels(F.col("host")))).withColumn("salt", F.xxhash64("_id", "path"))
    hosts = F.transform(F.filter("active", lambda s: F.col("key").startswith(s["at"])), lambda s: s["host"])
    # numbers of rows are written once, so they stay
    met = materialise(_swept(probes, _host_nodes(rules)).select("_id", "host", "path", "salt", hosts.alias("hosts"), F.monotonically_increasing_id().alias("row")), "rule-hosts")
    covered = F.coalesce(F.size("hosts"), F.lit(0)) > 0
    below = met.where(covered).select("_id", "host", "path", "salt", "row", F.explode("hosts").alias("of"))
    below = _swept(below.withColumn("key", _path_key(F.col("of"), F.col("path"))), _path_nodes(rules).withColumn("of", F.substring_index("key", "\x00", 1)).withColumn("stack", F.struct("of", "stack")).drop("of"))
    # the last node may belong to another host
    own = F.when(F.col("active.of") == F.col("of"), F.try_element_at(F.filter("active.stack", lambda s: F.col("path").startswith(s["at"])), F.lit(-1)))
    fit = F.when(own.isNotNull(), F.struct((F.length("of") + F.length(own["at"])).alias("size"), F.length("of").alias("host_size"), own["verdict"].alias("verdict"), F.concat("of", own["at"]).alias("rule")))
    best = below.withColumn("fit", fit).groupBy("row").agg(F.max("fit").alias("best"))
    out = met.join(best, "row", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query: host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return url_filter(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)"))


OP1_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES {values}),
parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM parts
), fits AS (
  SELECT n, max(struct_pack(a := length(rhost) + length(rpath), b := length(rhost), c := rverdict, d := rhost || rpath)) AS best
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, best.d AS rule, coalesce(best.c, 'allow') AS verdict FROM split LEFT JOIN fits USING (n)
""".format(values=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES))
