"""Evidence graph: merging, costs, degrees, walks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import edge_cost

CONFIDENT_KINDS = ("CALLS", "RENDERS", "DEFINES")
CONFIDENT = ("exact", "high", "declared")
HUB = 60
#: What a walk has seen is a union of its rounds, written as one table every so many rounds.
RENEW = 8
#: Rows of a table that are sent to the driver and to all tasks at most.
BROADCAST = 100_000
#: Kinds of nodes that edges are filtered by at most.
KINDS = 100


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder.

    Without a folder set, one of this machine serves a local master; on a cluster that would lose files, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evigraph-walk-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write an iterate to the shared checkpoint folder and read it back, so that plans stay short and lost executors do no harm."""
    path = shared_folder(df.sparkSession, "evigraph-walk")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """``df``, one side of a join, to be broadcast if it has ``BROADCAST`` rows at most, else to be merged: its size on disk tells little of what the driver would hold."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df.hint("merge")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """First emitted edge per source, target, kind and evidence. Aggregated before the shuffle, so hot keys cost no more."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind", "evidence", "seq")]
    first = edges.groupBy("src", "dst", "kind", "evidence").agg(F.min(F.struct("seq", *rest)).alias("f"))
    return first.select("src", "dst", "kind", "evidence", *[f"f.{c}" for c in rest])


def merge_nodes(nodes: DataFrame, fields: list[str], metadata: list[str]) -> DataFrame:
    """One row per id: of each field the first value that is not empty, of each metadata column the last value."""
    first = [F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("seq", c)))[c].alias(c) for c in fields]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c) for c in metadata]
    return nodes.groupBy("id").agg(*first, *last)


def with_cost(edges: DataFrame) -> DataFrame:
    return edges.withColumn("cost", edge_cost(F.col("kind"), F.col("resolution"), F.col("origin")))


def hubs(edges: DataFrame, most: int = HUB) -> DataFrame:
    return edges.where("kind = 'CONTAINS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children")).where(F.col("children") > most)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def overview(edges: DataFrame, first_kinds: list[str], limit: int) -> DataFrame:
    """The nodes to show first: chosen kinds, then those with most edges."""
    ranked = degrees(edges).withColumn("first", F.split("id", ":")[0].isin(first_kinds))
    return ranked.orderBy(F.desc("first"), F.desc("degree"), "id").limit(limit).select("id", "degree")


def induced(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges both ends of which are selected. Ids begin with their kind and a colon; if few kinds are selected, edges with an end of another kind are left out before they are shuffled."""
    ends, kind = selected.select("id").where("id IS NOT NULL"), lambda c: F.substring_index(c, ":", 1)
    kinds = [r.kind for r in ends.select(kind("id").alias("kind")).distinct().limit(KINDS + 1).collect()]
    some = edges.where(kind("src").isin(kinds) & kind("dst").isin(kinds)) if len(kinds) <= KINDS else edges
    return some.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def _steps(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Both directions of the edges that a walk may take, cheapest first; children of hubs are reached only if the hub is a seed."""
    costed = with_cost(edges)
    closed = hubs(edges, most).select(F.col("id").alias("src")).join(seeds.select(F.col("id").alias("src")), "src", "left_anti").withColumn("hub", F.lit(True))
    # definitions are walked from the inner symbol outwards only
    forward = costed.join(closed, "src", "left").where("kind != 'DEFINES' AND NOT (kind = 'CONTAINS' AND coalesce(hub, false))").select(F.col("src").alias("at"), F.col("dst").alias("to"), "cost")
    backward = costed.select(F.col("dst").alias("at"), F.col("src").alias("to"), "cost")
    return forward.unionByName(backward).groupBy("at", "to").agg(F.min("cost").alias("cost"))


def min_cost_reach(edges: DataFrame, seeds: DataFrame, depth: int, most: int = HUB) -> DataFrame:
    """(id, cost, hops): the least cost over walks of at most ``depth`` edges from any seed, and the fewest edges of any walk.

    Every round joins what changed in the last round with the adjacency, which is written once.
    """
    steps = cut(_steps(edges, seeds, most))
    best = seeds.select("id").distinct().withColumns({"cost": F.lit(0), "hops": F.lit(0)})
    moved = best
    for hop in range(1, depth + 1):
        found = moved.withColumnRenamed("cost", "so_far").join(steps, F.col("id") == F.col("at")).groupBy(F.col("to").alias("id")).agg(F.min(F.col("so_far") + F.col("cost")).alias("cost"))
        merged = best.select("id", F.col("cost").alias("old"), "hops").join(found, "id", "full")
        merged = cut(merged.select("id", F.least("cost", "old").alias("cost"), F.coalesce("hops", F.lit(hop)).alias("hops"), F.expr("old IS NULL OR cost < old").alias("moved")))
        best, moved = merged.select("id", "cost", "hops"), merged.where("moved").select("id", "cost")
    return best


def classify(reached: DataFrame) -> DataFrame:
    """Class of a node from its hops and the edge that reached it (kind, resolution, origin)."""
    case = (
        F.when(F.col("hops") == 0, "query match")
        .when(F.col("origin").isin("policy", "policy+ast"), "required review")
        .when((F.col("resolution") == "exact") & (F.col("hops") == 1), "required review")
        .when(F.col("kind") == "STRUCTURALLY_SIMILAR", "similar candidate")
        .when(F.col("resolution").isin("exact", "declared"), "review recommended")
        .otherwise("similar candidate")
    )
    return reached.withColumn("class", case)


def confident(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(*CONFIDENT_KINDS) & F.col("resolution").isin(*CONFIDENT))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, id, hops) of all nodes that a walk along the edges reaches, the start included. Without ``depth`` until nothing new is found,
    which the finite number of nodes ensures. The steps are written once, what has been seen is written anew every few rounds."""
    steps = cut(edges.select("src", "dst").distinct())
    front = starts.select(F.col("id").alias("start"), "id").distinct().withColumn("hops", F.lit(0))
    seen, hop = front, 0
    while depth is None or hop < depth:
        hop += 1
        new = front.join(steps, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = cut(seen) if hop % RENEW == 0 else seen
    return seen


def closure(edges: DataFrame, starts: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Nodes that can be reached from any start, the starts included. Rounds go on until nothing new is found, however long the chains. ``reached`` are nodes that are known to be
    reached by edges of which these are a part, so they are not walked to again; they are part of what is returned.

    The steps are shuffled and sorted once, by where they begin, and kept so on the executors' disks; a round shuffles only where they lead.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = edges.select("src", "dst").repartition(width, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    steps.count()  # how a kept table is dealt is known to later plans only once it is there
    front = cut((starts if reached is None else reached.unionByName(starts)).select("id").distinct())
    seen, hop = front, 0
    try:
        while True:
            hop += 1
            front = cut(steps.join(front.hint("merge"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.hint("merge"), "id", "left_anti"))
            if front.isEmpty():
                return seen
            seen = seen.unionByName(front)
            seen = cut(seen) if hop % RENEW == 0 else seen
    finally:
        steps.unpersist()


def unreachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame, unknown: bool = False) -> DataFrame:
    """Nodes outside the closure; none if what starts is not known, as absence would prove nothing."""
    if unknown:
        return nodes.limit(0)
    return nodes.join(closure(edges, starts), "id", "left_anti")


def only_ambiguous(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that are tied to the seeds only through ambiguous calls."""
    both = edges.select("src", "dst", "resolution").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "resolution"))
    firm = closure(both.where("resolution != 'ambiguous'"), seeds)
    return closure(both, seeds, firm).join(firm.hint("merge"), "id", "left_anti")


def unverified_stores(edges: DataFrame) -> DataFrame:
    """Stores all of whose evidence comes from patterns in text."""
    return edges.where("kind = 'TOUCHES_STORE'").groupBy(F.col("dst").alias("store")).agg(F.count("*").alias("n"), F.min((F.col("origin") == "regex").cast("int")).alias("r")).where("r = 1").drop("r")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))
