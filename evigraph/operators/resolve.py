"""Resolution passes: which handler serves a call, which definition a name means, which columns are unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DYNAMIC = "{dynamic}"


def _fits(call: Column | str, served: Column | str, loose: bool) -> Column:
    """Whether every segment called is the one served, or served (or, if loose, called) at run time."""

    def same(c: Column, s: Column) -> Column:
        equal = (c == s) | (s == DYNAMIC)
        return equal | (c == DYNAMIC) if loose else equal

    return F.forall(F.zip_with(call, served, same), lambda ok: F.coalesce(ok, F.lit(False)))


def methods_fit(call: Column, handler: Column) -> Column:
    return (handler == "ANY") | (handler == call) | (call == "UNKNOWN") | ((call == "HEAD") & (handler == "GET"))


def match_endpoints(calls: DataFrame, handlers: DataFrame, cap: int = 12) -> DataFrame:
    """(call_id, handler_id, resolution): calls (call_id, method, segments) joined with handlers (handler_id, h_method, h_segments) that serve them.

    ``open_tail`` of a call says that its last segment goes on at run time, ``open_head`` that a path may stand before its first one;
    ``catch_all`` of a handler that its last segment takes one or more. Columns that are missing count as false. A strict match beats one through
    a runtime segment of the call, and both one after leading segments of the handler, which only calls with an open head and a literal
    segment may have. Where a runtime segment or an open tail widens the match, more than ``cap`` matches link nothing (see ``too_open``).
    """
    linked = _served(calls, handlers).where((F.col("n") <= cap) | ~F.col("widened"))
    ambiguous = (F.col("tier") == 2) | (F.col("widened") & (F.col("n") > 1))
    return linked.select("call_id", "handler_id", F.when(ambiguous, "ambiguous").otherwise("probable").alias("resolution"))


def too_open(calls: DataFrame, handlers: DataFrame, cap: int = 12) -> DataFrame:
    """(call_id, n): calls that so many handlers could serve that a link would say nothing."""
    return _served(calls, handlers).where((F.col("n") > cap) & F.col("widened")).select("call_id", "n").distinct()


def _served(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """call_id, handler_id, tier (0 strict, 1 through runtime segments, 2 after leading segments), widened and n, the number of handlers, in the best tier of each call.

    Handlers have a row for each number of segments that they may skip. Both sides meet on the first segment, literal or not, so that a popular shape
    does not meet every handler; sizes are compared there.
    """
    flag = lambda df, name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    c = calls.select("call_id", "method", "segments", flag(calls, "open_tail").alias("open_tail"), flag(calls, "open_head").alias("open_head"))
    c = c.withColumns({"head": F.coalesce(F.get("segments", F.lit(0)), F.lit("")), "open_head": F.col("open_head") & F.exists("segments", lambda x: x != DYNAMIC)})
    h = handlers.select("handler_id", "h_method", "h_segments", flag(handlers, "catch_all").alias("catch_all"))
    h = h.withColumn("skip", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h_segments") - 1, F.lit(0)))))
    h = h.withColumn("h_segments", F.expr("slice(h_segments, skip + 1, size(h_segments))")).withColumn("h_head", F.coalesce(F.get("h_segments", F.lit(0)), F.lit("")))
    # what a handler's first segment meets: the same literal, any call if it is dynamic or a catch-all may take nothing more, and runtime calls
    dynamic = F.col("h_head") == DYNAMIC
    keyed = h.withColumn("key", F.explode(F.when(dynamic, F.array(F.lit(DYNAMIC))).otherwise(F.array("h_head", F.lit("*")))))
    tail_head = F.col("open_tail") & (F.size("segments") == 1)  # the only segment may go on, so literals that begin with it fit
    asked = c.withColumn("key", F.explode(F.when((F.col("head") == DYNAMIC) | tail_head | (F.size("segments") == 0), F.array(F.lit(DYNAMIC), F.lit("*"))).otherwise(F.array("head", F.lit(DYNAMIC)))))
    met = asked.join(keyed, "key").where("skip = 0 OR open_head").where(methods_fit(F.col("method"), F.col("h_method")))
    serves = lambda loose: _serves("segments", "h_segments", F.col("open_tail"), F.col("catch_all"), loose)
    first = F.col("skip") == 0
    tier = F.when(first & serves(False), 0).when(first & F.array_contains("segments", DYNAMIC) & serves(True), 1).when(~first & serves(False), 2)
    met = met.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("call_id", "open_tail", "handler_id").agg(F.min("tier").alias("tier"))
    of_call = W.partitionBy("call_id")
    best = met.withColumn("least", F.min("tier").over(of_call)).where("tier = least").withColumn("n", F.count("*").over(of_call))
    return best.select("call_id", "handler_id", "tier", ((F.col("tier") == 1) | F.col("open_tail")).alias("widened"), "n")


def _serves(call: str, served: str, open_tail: Column, catch_all: Column, loose: bool) -> Column:
    """Whether a route serves the segments of a call, its runtime segments being any literal if loose."""
    c, s = F.col(call), F.col(served)

    def begins(size: Column) -> Column:
        """The first segments of both, as many as ``size``, agree."""
        return _fits(F.slice(c, F.lit(1), size), F.slice(s, F.lit(1), size), loose)

    many = F.size(c)
    before = F.size(s) - 1  # segments of a catch-all before what it takes
    takes = catch_all & (F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")) == DYNAMIC)
    taken = ((many > before) | (open_tail & (many == before))) & begins(F.greatest(before, F.lit(0)))
    last, there = F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit("")), F.coalesce(F.get(s, many - 1), F.lit(""))
    goes_on = F.startswith(there, last) & (F.endswith(last, F.lit(".")) | F.startswith(F.substring(there, F.length(last) + 1, F.length(there)), F.lit(".")))
    same = (last == there) | (there == DYNAMIC) | (F.lit(loose) & (last == DYNAMIC))
    opened = (many > 0) & (F.size(s) >= many) & begins(F.greatest(many - 1, F.lit(0))) & (same | goes_on)
    return F.when(takes, taken).when(open_tail, opened).otherwise((many == F.size(s)) & _fits(c, s, loose))


def endpoint_gaps(endpoints: DataFrame, calls: DataFrame, matches: DataFrame, others: DataFrame) -> DataFrame:
    """(id, code, severity, methods): endpoints (id, method, handled) that are called but served by nothing, or served but never called.

    ``calls`` has id, site and whether the calling code is dead, ``matches`` the ids of endpoints with a handler of the same shape, ``others`` ids with the
    methods that their shape is served for. Calls from dead code alone, and pre-flight requests, are no warnings.
    """
    called = calls.groupBy("id").agg(F.count("*").alias("n"), F.min(F.col("dead").cast("int")).alias("all_dead"))
    known = endpoints.join(called, "id", "left").join(matches.select("id").distinct().withColumn("matched", F.lit(True)), "id", "left").join(others, "id", "left")
    gap = F.col("n").isNotNull() & ~F.col("handled") & F.col("matched").isNull() & (F.col("method") != "OPTIONS")
    code = F.when(gap & F.col("methods").isNotNull(), "API_METHOD_MISMATCH").when(gap, "API_CALL_WITHOUT_HANDLER").when(F.col("handled") & F.col("n").isNull(), "API_HANDLER_WITHOUT_STATIC_CALLER")
    severity = F.when(gap & (F.col("all_dead") == 0), "warning").otherwise("info")
    return known.withColumn("code", code).where("code IS NOT NULL").select("id", "code", severity.alias("severity"), F.when(gap, F.col("methods")).alias("methods"))


def method_mismatch(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """(call_id, methods): calls whose shape is served, but by other methods alone.

    Handlers may be catch-alls (``catch_all``, their last segment takes one or more), which serve all that is below them. Calls with an open tail (``open_tail``) may go on to
    another shape at run time and are never mismatches. Columns that are missing count as false. Plain handlers meet calls of their size, catch-alls those of any.
    """
    flag = lambda df, name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    c = calls.where(~flag(calls, "open_tail")).select("call_id", "method", "segments", F.size("segments").alias("size"))
    c = c.withColumn("key", F.explode(F.array_distinct(F.array(F.coalesce(F.get("segments", F.lit(0)), F.lit("")), F.lit(DYNAMIC)))))
    takes = flag(handlers, "catch_all") & (F.coalesce(F.try_element_at("h_segments", F.lit(-1)), F.lit("")) == DYNAMIC)
    h = handlers.select("h_method", "h_segments", takes.alias("takes"), F.size("h_segments").alias("size"), F.coalesce(F.get("h_segments", F.lit(0)), F.lit("")).alias("key"))
    plain = c.join(h.where("NOT takes"), ["size", "key"]).where(_fits("segments", "h_segments", False)).select("call_id", "method", "h_method")
    wide = c.drop("size").join(h.where("takes").drop("size"), "key").where(_serves("segments", "h_segments", F.lit(False), F.lit(True), False))
    met = plain.unionByName(wide.select("call_id", "method", "h_method"))
    named = F.when(~F.col("h_method").isin("", "UNKNOWN"), F.col("h_method"))
    grouped = met.groupBy("call_id").agg(F.array_sort(F.collect_set(named)).alias("methods"), F.max(methods_fit(F.col("method"), F.col("h_method"))).alias("served"))
    return grouped.where("NOT served AND size(methods) > 0").select("call_id", F.array_join("methods", ",").alias("methods"))


def endpoint_status(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """endpoints (id, served, open) and calls (id, linked, from_test) to (id, status)."""
    own = calls.where("NOT from_test").groupBy("id").agg(F.count("*").alias("n"), F.min(F.col("linked").cast("int")).alias("all_linked"))
    status = F.when(F.col("served"), "served").when(F.col("open"), "open").when(F.col("n").isNull(), "uncalled").when(F.col("all_linked") == 1, "matched").otherwise("unserved")
    return endpoints.join(own, "id", "left").select("id", status.alias("status"))


def resolve_names(calls: DataFrame, definitions: DataFrame, cap: int = 12) -> DataFrame:
    """(source, name, target, resolution): pending calls (source, file, language, name) to definitions (target, d_file, d_language, name).

    Same-file definitions win over those elsewhere; a call never resolves to itself; more than ``cap`` candidates link nothing and more
    than one is ambiguous. Names with too many definitions are dropped by their count before the join, unless one is in the caller's file.
    """
    once = calls.select("source", "file", "language", "name").distinct()
    here = definitions.withColumnsRenamed({"d_file": "file", "d_language": "language"})
    few = here.groupBy("file", "language", "name").agg(F.count("*").alias("homonyms"))
    # a file with more definitions of a name than the cap links nothing for it, so these are known by their number alone
    crowded = once.join(few.where(F.col("homonyms") > cap + 1).drop("homonyms"), ["file", "language", "name"], "left_semi")
    once = once.join(crowded.select("source", "name"), ["source", "name"], "left_anti")
    near = once.join(here.join(few.where(F.col("homonyms") <= cap + 1).drop("homonyms"), ["file", "language", "name"], "left_semi"), ["file", "language", "name"]).where("source != target").select("source", "name", "target", F.lit(0).alias("tier"))
    usable = definitions.groupBy("name", "d_language").agg(F.count("*").alias("homonyms")).where(F.col("homonyms") <= cap + 1).drop("homonyms")
    rest = once.join(near.select("source", "name").distinct(), ["source", "name"], "left_anti")
    far = rest.join(definitions.join(usable, ["name", "d_language"]).withColumnRenamed("d_language", "language"), ["name", "language"]).where("source != target").select("source", "name", "target", F.lit(1).alias("tier"))
    found = near.unionByName(far).withColumn("n", F.count("*").over(W.partitionBy("source", "name"))).where(F.col("n") <= cap)
    return found.select("source", "name", "target", F.when(F.col("n") > 1, "ambiguous").otherwise(F.when(F.col("tier") == 0, "exact").otherwise("high")).alias("resolution"))


def ancestors(path: Column) -> Column:
    """All directories above a path, the longest first, ending with the empty root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_root(files: DataFrame, roots: DataFrame, key: str = "path") -> DataFrame:
    """``files`` with ``root``: the longest ancestor among ``roots``, or NULL."""
    tried = files.select(key, F.posexplode(ancestors(F.col(key))).alias("place", "root")).join(roots.select("root").distinct(), "root")
    return files.join(tried.groupBy(key).agg(F.min_by("root", "place").alias("root")), key, "left")


def unknown_columns(references: DataFrame, catalog: DataFrame, opaque: DataFrame) -> DataFrame:
    """References (table_name, column_name, ...) to columns no schema declares. Tables without a schema, and tables in ``opaque``, whose columns cannot be
    known, are no evidence."""
    known = references.join(catalog.select("table_name").distinct(), "table_name", "left_semi").join(opaque, "table_name", "left_anti")
    return known.join(catalog, ["table_name", "column_name"], "left_anti")


#: Parts of keys are found by their runs of so many characters.
GRAM = 3


def _containing(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, key): records whose key contains a wanted text, case aside. A text of three characters or more meets the keys that have its rarest run of
    three, as far as runs go by number of keys; a shorter one meets the keys that have a run which begins with it."""
    low = records.select("key", F.lower("key").alias("k")).distinct()
    padded = F.concat("k", F.lit(" " * (GRAM - 1)))  # so that every place begins a run
    runs = low.select("key", "k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("k"), F.lit(1))), lambda i: F.substring(padded, i, F.lit(GRAM))))).alias("run"))
    asked = wanted.select("q", F.lower("q").alias("w")).distinct()
    long_ = asked.where(F.length("w") >= GRAM).withColumn("run", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - GRAM + 1), lambda i: F.substring("w", i, F.lit(GRAM)))))
    common = runs.join(long_.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("keys"))
    rarest = long_.join(common, "run", "left").groupBy("q", "w").agg(F.min(F.struct(F.coalesce("keys", F.lit(0)).alias("keys"), "run")).alias("r")).select("q", "w", "r.run")
    found = runs.join(rarest, "run").where(F.contains("k", "w")).select("q", "key")
    short = asked.where(F.length("w") < GRAM).select("q", "w", F.length("w").alias("size"))
    sizes = range(GRAM)
    begins = runs.select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.left("run", F.lit(n)).alias("w")) for n in sizes])).alias("b")).select("key", "b.*").distinct()
    return found.unionByName(short.join(begins, ["size", "w"]).select("q", "key")).distinct()


def lookup_cascade(records: DataFrame, wanted: DataFrame, limit: int = 12) -> DataFrame:
    """(q, key, tier, place): of ``records`` (key, source_id, name) the first tier that has a hit: exact key, source id, exact name, part of a key."""
    names = F.posexplode(F.array("key", "source_id", "name")).alias("tier", "q")
    exact = wanted.join(records.select("key", names), "q").select("q", "key", "tier")
    parts = wanted.join(exact.select("q").distinct(), "q", "left_anti")
    found = exact.unionByName(_containing(records, parts).select("q", "key", F.lit(3).alias("tier")))
    ranked = found.withColumn("best", F.min("tier").over(W.partitionBy("q"))).where("tier = best").distinct()
    place = F.row_number().over(W.partitionBy("q").orderBy(F.length("key"), "key"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("q", "key", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))
