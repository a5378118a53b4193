"""Where routers are served: prefixes and dependencies that a router gets through whatever mounts it.

Routers are rows (router, prefix, dependencies), mounts are rows (parent, child, place, prefix, dependencies, inherit). A router that nothing
mounts is served under its own prefix; every other one under each of its parents' prefixes, the mount's and its own, one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, sized

_NONE = "CAST(array() AS array<string>)"


def _peel(links: DataFrame) -> DataFrame:
    """(parent, child) of the links that lie on a circle or between circles: ends without a link in, or out, are taken off until none is left."""
    left = cut(links.select("parent", "child").distinct())
    size = left.count()
    while size:
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        inner = cut(inner)
        now = inner.count()
        if now == size:
            break
        left, size = inner, now
    return left


def _levels(links: DataFrame) -> tuple[DataFrame, int, int]:
    """(child, level) of all routers that something mounts, the last level, and that of the routers on or between circles (0: there are none).

    The parents of a router have lower levels. Routers on circles share a level of their own, between what leads to circles and what hangs below them. Only pairs of names are shuffled here.
    """
    left = cut(links.select("parent", "child").distinct())
    out, level, circle = left.select("child", F.lit(0).alias("level")).where("false"), 0, 0
    while not left.isEmpty():
        level += 1
        waits = left.join(left.select(F.col("child").alias("parent")).distinct().hint("merge"), "parent", "left_semi").select("parent", "child")
        ready = cut(left.select("child").distinct().join(waits.select("child").distinct().hint("merge"), "child", "left_anti"))
        if ready.isEmpty():
            circle = level
            ready = cut(_peel(waits).select(F.explode(F.array("parent", "child")).alias("child")).distinct())
        out = out.unionByName(ready.withColumn("level", F.lit(level)))
        left = cut(left.join(ready.hint("merge"), "child", "left_anti"))
    return out, level, circle


def _steps(own: DataFrame, links: DataFrame) -> tuple[DataFrame, int, int]:
    """The links between known routers with what the child has (own_prefix, own_deps), its level and whether it mounts others itself (leads), written once; last and circles' level."""
    names = own.select("router")
    known = links.join(names.withColumnRenamed("router", "parent").hint("merge"), "parent", "left_semi").join(names.withColumnRenamed("router", "child").hint("merge"), "child", "left_semi").select(links.columns)
    levels, last, circle = _levels(known)
    leads = known.select(F.col("parent").alias("child")).distinct().withColumn("leads", F.lit(True))
    children = own.withColumnRenamed("router", "child").join(levels.hint("merge"), "child").join(leads.hint("merge"), "child", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    return cut(known.distinct().join(children.hint("merge"), "child")), last, circle


def _walk(ways: DataFrame, mounts: DataFrame) -> DataFrame:
    """The ways one mount further, each once, with the least and the greatest depth of the walks that led to it. Ways that know what they ``passed`` do not pass it again."""
    met = ways.drop("leads").join(mounts.hint("merge"), F.col("router") == F.col("parent"))
    apart = "passed" in ways.columns
    met = met.where("NOT array_contains(passed, child)") if apart else met
    moved = met.select(
        F.col("child").alias("router"), F.concat("prefix", "link_prefix", "own_prefix").alias("prefix"),
        F.concat(F.when(F.col("inherit"), F.col("dependencies")).otherwise(F.expr(_NONE)), "link_deps", "own_deps").alias("dependencies"),
        "leads", (F.col("depth") + 1).alias("depth"), *([F.array_sort(F.array_append("passed", F.col("child"))).alias("passed")] if apart else []),
    )
    return moved.groupBy([c for c in moved.columns if c != "depth"]).agg(F.min("depth").alias("depth"), F.max("depth").alias("far"))


def _crowded(ways: DataFrame, most: int) -> DataFrame | None:
    """Routers with more than ``most`` ways, if there are any. Rows are counted first: those that differ only by what they passed are looked at where there are many."""
    many = cut(ways.groupBy("router").agg(F.count("*").alias("n")).where(F.col("n") > most).select("router"))
    if "passed" in ways.columns and not many.isEmpty():
        many = cut(ways.join(sized(many), "router", "left_semi").groupBy("router").agg(F.count_distinct("prefix", "dependencies").alias("n")).where(F.col("n") > most).select("router"))
    return None if many.isEmpty() else many


def _circled(entered: DataFrame, mounts: DataFrame, most: int, deepest: int) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame]]:
    """Ways of routers on circles, round by round; those with too many ways; those that longer walks lead to. ``entered`` are the ways that come from outside.

    A way of round n has passed n routers here, so ways of different rounds differ and are not compared.
    """
    front = entered.withColumn("passed", F.array("router"))
    parts, over, far = [], None, []
    while not front.isEmpty():
        parts.append(front)
        over = _crowded(_union(parts), most)
        going = front if over is None else front.join(sized(over), "router", "left_anti")
        moved = cut(_walk(going, mounts))
        far.append(moved.where(F.col("far") > deepest).select("router"))
        front = moved.where(F.col("depth") <= deepest).drop("far")
    return parts, over, far


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def mount_variants(routers: DataFrame, links: DataFrame, most: int = 100, deepest: int = 30) -> tuple[DataFrame, DataFrame]:
    """All ways in which routers are served, and what is not known of them.

    First (router, prefix, dependencies): the distinct sums of prefixes, and chains of dependencies, over all walks from a router that nothing
    mounts and that meet no router twice; a mount with ``inherit`` false passes on no dependencies of its parent. Second (router, issue):
    ``cycle`` for routers that no such walk reaches, ``too_many`` for those with more than ``most`` ways or walks of more than
    ``deepest`` mounts. Such routers, and what hangs below them alone, have no ways listed: some of many would look like all.

    Routers are taken level by level, each once all its parents are known, so a way is made and shuffled once and nothing that was found is
    read again but the ways of routers that mount others. Ways are kept apart by what they passed only on circles, so diamonds do not multiply
    them. Mounts of unknown routers are left out; repeated rows count once.
    """
    own = cut(routers.groupBy("router").agg(F.min(F.struct("prefix", "dependencies")).alias("o")).select("router", F.col("o.prefix").alias("own_prefix"), F.coalesce("o.dependencies", F.expr(_NONE)).alias("own_deps")))
    links = links.select("parent", "child", F.col("prefix").alias("link_prefix"), F.coalesce("dependencies", F.expr(_NONE)).alias("link_deps"), "inherit")
    steps, last, circle = _steps(own, links)
    roots = own.join(steps.select(F.col("child").alias("router")).hint("merge"), "router", "left_anti")
    found = [cut(roots.selectExpr("router", "own_prefix AS prefix", "own_deps AS dependencies", "true AS leads", "0 AS depth"))]
    blocked = []
    for level in range(1, last + 1):
        moved = cut(_walk(_union(found).where("leads"), steps.where(F.col("level") == level)))
        far = [moved.where(F.col("far") > deepest).select("router")]
        front = moved.where(F.col("depth") <= deepest).drop("far")
        if level == circle:
            parts, over, farther = _circled(front, steps.where(F.col("level") == level), most, deepest)
            far += farther
            front = cut(_union(parts).groupBy("router", "prefix", "dependencies", "leads").agg(F.min("depth").alias("depth"))) if parts else front
        else:
            over = _crowded(front, most)
        blocked += far if over is None else [*far, over]
        # routers with too many ways go no further, so no level can grow beyond their bound times the mounts
        found.append(front if over is None else front.join(sized(over), "router", "left_anti"))
    # what hangs below a router that is not known in full is not known in full either
    edge = cut(_union(blocked).distinct() if blocked else own.select("router").where("false"))
    hidden = [edge]
    pairs = steps.select("parent", "child").distinct()
    while not edge.isEmpty():
        below = pairs.join(edge.hint("merge"), F.col("parent") == F.col("router"), "left_semi").select(F.col("child").alias("router")).distinct()
        edge = cut(below.join(_union(hidden).hint("merge"), "router", "left_anti"))
        hidden.append(edge)
    hidden, ways = cut(_union(hidden)), _union(found).select("router", "prefix", "dependencies")
    ways = ways if hidden.isEmpty() else ways.join(sized(hidden), "router", "left_anti")
    seen = _union(found).select("router").distinct()
    missed = own.select("router").join(seen.hint("merge"), "router", "left_anti").join(hidden.hint("merge"), "router", "left_anti")
    return ways, hidden.withColumn("issue", F.lit("too_many")).unionByName(missed.withColumn("issue", F.lit("cycle")))


def effective_mounts(routers: DataFrame, links: DataFrame) -> DataFrame:
    """(router, prefix, dependencies, cyclic): one mount for each router that holds for all of its routes.

    The prefix is that of the first mount (least ``place``, then parent), the dependencies are those that all mounts share, in the order of the first, each once.
    A router on a circle of mounts takes parents on the circle by their own prefix and dependencies, and is marked ``cyclic``.

    Routers are settled level by level, those on circles as one level; of what is settled, only routers that mount others are read again. Dependencies that all mounts share
    are counted, a row for each, so a router with many mounts gathers no lists.
    """
    own = cut(routers.groupBy("router").agg(F.min(F.struct("prefix", "dependencies")).alias("o")).select("router", F.col("o.prefix").alias("own_prefix"), F.array_distinct(F.coalesce("o.dependencies", F.expr(_NONE))).alias("own_deps")))
    steps, last, circle = _steps(own, links.select("parent", "child", "place", F.col("prefix").alias("link_prefix"), F.coalesce("dependencies", F.expr(_NONE)).alias("link_deps")))
    roots = own.join(steps.select(F.col("child").alias("router")).hint("merge"), "router", "left_anti")
    settled = [cut(roots.selectExpr("router", "own_prefix AS prefix", "own_deps AS deps", "false AS cyclic", "true AS leads"))]
    for level in range(1, last + 1):
        mounts = steps.where(F.col("level") == level)
        above = _union(settled).where("leads").selectExpr("router AS parent", "prefix AS p_prefix", "deps AS p_deps")
        if level == circle:
            above = above.unionByName(mounts.where("leads").selectExpr("child AS parent", "own_prefix AS p_prefix", "own_deps AS p_deps").distinct())
        offers = above.join(mounts.hint("merge"), "parent").select("child", "place", "parent", F.concat("p_prefix", "link_prefix").alias("through"), F.array_distinct(F.concat("p_deps", "link_deps")).alias("given"), "own_prefix", "own_deps", "leads")
        offers = cut(offers)
        first = offers.groupBy("child").agg(F.min(F.struct("place", "parent", "through", "given", "own_prefix", "own_deps", "leads")).alias("first"), F.count("*").alias("mounts"))
        shared = offers.select("child", F.explode("given").alias("dep")).groupBy("child", "dep").agg(F.count("*").alias("times"))
        common = shared.join(first.select("child", "mounts").hint("merge"), "child").where("times = mounts").groupBy("child").agg(F.collect_set("dep").alias("common"))
        met = first.join(common.hint("merge"), "child", "left")
        kept = F.filter(F.col("first.given"), lambda d: F.array_contains(F.coalesce("common", F.expr(_NONE)), d))
        now = met.select(
            F.col("child").alias("router"), F.concat("first.through", "first.own_prefix").alias("prefix"), F.array_distinct(F.concat(kept, "first.own_deps")).alias("deps"),
            F.lit(level == circle).alias("cyclic"), F.col("first.leads").alias("leads"),
        )
        settled.append(cut(now))
    return _union(settled).select("router", "prefix", F.col("deps").alias("dependencies"), "cyclic")


def served_routes(routes: DataFrame, ways: DataFrame) -> DataFrame:
    """Routes (route, router, path, dependencies) under every way of their router: (route, path, dependencies). Routes of routers that nothing is known of
    are left out; ``mount_variants`` lists these routers."""
    met = routes.withColumnsRenamed({"path": "own_path", "dependencies": "own_deps"}).join(ways, "router")
    return met.select("route", F.concat("prefix", "own_path").alias("path"), F.concat("dependencies", F.coalesce("own_deps", F.expr(_NONE))).alias("dependencies"))
