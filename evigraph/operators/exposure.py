"""Which files that serve routes can be reached, and which of those are run by what is deployed; what is not known proves nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure, cut

#: Remarks that are put behind messages of findings in files that nothing reaches or runs; fingerprints leave the second one out, whatever it names (fixed value).
UNREACHABLE_NOTE = " [nothing that starts imports this file]"
UNDEPLOYED_NOTE = " [not run by any deployment manifest found: {}]"


def liveness(files: DataFrame, imports: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, state, reason): every file as ``reached``, ``unknown`` or ``dead``.

    ``files`` has id and ``dynamic``: whether it imports what is chosen at run time. Files that a walk along ``imports`` (src, dst) from ``roots`` meets are
    reached. If one of them is dynamic it may reach any other, so all the rest are unknown; so they are without any root. The ``reason`` of a dead
    file is the least file that imports it (itself dead), or ``nothing imports it``.
    """
    known = imports.join(files.select(F.col("id").alias("src")), "src", "left_semi").join(files.select(F.col("id").alias("dst")), "dst", "left_semi").where("src != dst")
    started = roots.join(files, "id", "left_semi").select("id").distinct()
    reached = cut(closure(known, started))
    blind = started.isEmpty() or not reached.join(files.where("dynamic"), "id", "left_semi").isEmpty()
    rest = files.select("id").distinct().join(reached, "id", "left_anti")
    if blind:
        others = rest.select("id", F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("reason"))
    else:
        by = known.groupBy(F.col("dst").alias("id")).agg(F.min("src").cast("string").alias("by"))
        others = rest.join(by, "id", "left").select("id", F.lit("dead").alias("state"), F.coalesce("by", F.lit("nothing imports it")).alias("reason"))
    return reached.select("id", F.lit("reached").alias("state"), F.lit(None).cast("string").alias("reason")).unionByName(others)


def route_exposure(files: DataFrame, imports: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(id, exposure, reason) of files with routes that are ``unreachable`` or ``undeployed``; those of which either is not known are not listed.

    ``files`` has id, routes, app (makes an application), entry (configured as an entry point) and dynamic. A file with routes is unreachable if it is dead from
    applications and entry points. ``targets`` (manifest, id, auxiliary, server, blocking) are what deployment manifests run; a row with ``blocking`` is one
    that could not be read. A reached file with routes is undeployed if nothing that any manifest runs, and no entry point, reaches it; that
    needs a manifest that is not auxiliary and runs a server or an application, and no blocking row.
    """
    roots = files.where("app OR entry").select("id")
    alive = cut(liveness(files.select("id", "dynamic"), imports, roots))
    served = files.where("routes").select("id").distinct()
    unreachable = served.join(alive.where("state = 'dead'"), "id").select("id", F.lit("unreachable").alias("exposure"), "reason")
    if targets is None or not targets.where("blocking").isEmpty():
        return unreachable
    runs = targets.where("NOT auxiliary").join(roots.distinct().withColumn("root", F.lit(True)), "id", "left").where("server OR root").join(files.select("id"), "id", "left_semi")
    if runs.isEmpty():
        return unreachable
    started = targets.select("id").unionByName(files.where("entry").select("id"))
    live = cut(liveness(files.select("id", "dynamic"), imports, started))
    shown = runs.agg(F.min(F.struct("manifest", "id")).alias("m")).select(F.concat_ws(" runs ", F.col("m.manifest").cast("string"), F.col("m.id").cast("string")).alias("reason"))
    said = shown.head().reason
    undeployed = served.join(alive.where("state = 'reached'"), "id", "left_semi").join(live.where("state = 'dead'"), "id", "left_semi")
    return unreachable.unionByName(undeployed.select("id", F.lit("undeployed").alias("exposure"), F.lit(said).alias("reason")))


def demote(findings: DataFrame, exposed: DataFrame) -> DataFrame:
    """``findings`` (file, exposure, message, ...) with the exposure of files that ``route_exposure`` lists and a remark behind their messages; none is dropped."""
    marks = exposed.groupBy(F.col("id").alias("file")).agg(F.min(F.struct("exposure", "reason")).alias("m")).select("file", F.col("m.exposure").alias("marked"), "m.reason")
    undeployed = F.replace(F.lit(UNDEPLOYED_NOTE), F.lit("{}"), F.coalesce("reason", F.lit("")))
    note = F.when(F.col("marked") == "unreachable", F.lit(UNREACHABLE_NOTE)).when(F.col("marked") == "undeployed", undeployed).otherwise("")
    joined = findings.join(marks, "file", "left")
    return joined.withColumns({"exposure": F.coalesce("marked", "exposure"), "message": F.concat("message", note)}).select(findings.columns)
