"""Secret scan with positions, and linking of multipart credentials, in SQL functions only.

Base kinds are strong by themselves. Weak kinds (account names, token-like strings, endpoints) prove little alone and are
reported only when the complementary parts of a credential lie in the same scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

#: Kinds in order of listing: name, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as all runs, short ones dropped
)
#: Weak kinds and the part of a credential that each may be.
WEAK = (
    ("account", r"(?i)\b(?:user|username|login|client_?id|account|access_?key_?id)\b[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", "identifier"),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", "secret"),
    ("endpoint", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])", "endpoint"),
)
#: Matches whose places are added up together.
CHUNK = 128
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {name: role for name, _, role in WEAK}
ORDER = [name for name, *_ in BASE] + [name for name, *_ in WEAK]
#: Parts that a weak part of each role needs within its scope.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, ord, end, kind>>, in code points.

    The text between two matches is a piece of ``split``, so starts are running sums of the lengths of pieces and matches.
    """
    found, sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(found, F.length), F.transform(F.slice(gaps, F.lit(1), F.size(found)), F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    placed = _placed(lengths)
    kept = placed if group == 0 and least <= 1 else F.transform(
        F.filter(F.arrays_zip(placed.alias("p"), sized.alias("s")), lambda x: F.length(x["s"]) >= least), lambda x: x["p"]
    )
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(pattern), spans).otherwise(none())


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(lengths: Column) -> Column:
    """array<struct<start, end>> of matches from array<struct<m, g>>, their lengths and those of the gaps before them.

    Appending to an array copies it, so sums run within chunks, then over chunks: a text with very many matches costs them times a chunk's size.
    """
    empty = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    chunks = _let(lengths, lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: F.slice(every, k * CHUNK + 1, F.lit(CHUNK))))
    summed = F.transform(
        chunks,
        lambda chunk: F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), empty("struct<start: int, end: int>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")
            ),
        ),
    )
    before = lambda inner: F.aggregate(inner, F.struct(F.lit(0).alias("at"), empty("int").alias("offs")), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["offs"], F.array(acc["at"])).alias("offs")), lambda acc: acc["offs"])
    return _let(summed, lambda inner: F.flatten(F.zip_with(inner, before(inner), lambda c, off: F.transform(c["out"], lambda p: F.struct((p["start"] + off).alias("start"), (p["end"] + off).alias("end"))))))


def none() -> Column:
    return F.expr("CAST(array() AS array<struct<start: int, ord: int, end: int, kind: string>>)")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cells(spans: DataFrame, scope: int, reach: int = 0) -> DataFrame:
    """``spans`` with a row for each cell of ``scope`` code points that they, and ``reach`` code points around them, touch."""
    return spans.withColumn("cell", F.explode(F.expr(f"sequence(greatest(start - {reach}, 0) DIV {scope}, greatest(end - 1 + {reach}, start) DIV {scope})")))


def without_covered(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """``parts`` without the weak ones that overlap a strong one; spans meet in the cells that both touch, so a text with many spans costs no more
    for each than what a cell holds."""
    strong = _cells(parts.where("NOT weak"), scope).select(*keys, "cell", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    weak = parts.where("weak")
    met = _cells(weak, scope).join(strong, [*keys, "cell"]).where("s_start < end AND s_end > start").select(*keys, "start", "ord").distinct()
    return parts.where("NOT weak").unionByName(weak.join(met, [*keys, "start", "ord"], "left_anti").select(parts.columns))


def linked_weak(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """Weak parts of ``parts`` (keys, start, end, kind, role, weak) whose complementary parts lie at most ``scope`` code points away.

    Interval join: a part's neighbourhood covers one to a few cells of ``scope`` code points; parts meet in a cell by an equality
    join and the distance is checked there. Spans do not overlap within a kind, so a cell holds a bounded number of them; they travel as one
    array for each cell and role, and of a partner only its role is kept. Keys are never null.
    """
    bounds = _cells(parts, scope).groupBy(*keys, "role", "cell").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    weak = _cells(parts.where("weak"), scope, scope + 1)
    near = weak.alias("w").join(bounds.withColumnRenamed("role", "other").alias("b"), [*keys, "cell"])
    near = near.where("role != other").where(f"exists(spans, s -> s.start <= w.end + {scope} AND s.end >= w.start - {scope})")
    needs = F.create_map(*[x for role, wanted in NEEDS.items() for x in (F.lit(role), F.array(*map(F.lit, wanted)))])
    met = near.groupBy(*keys, "start", "ord", "end", "kind", "role").agg(F.collect_set("other").alias("met"))
    return met.where(F.size(F.array_except(needs[F.col("role")], F.col("met"))) == 0).select(*keys, "start", "ord", "end", "kind")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``added`` (arrays of start, ord, end, kind).

    ``base`` has the strong kinds. ``added`` has weak account names with a secret within ``scope`` code points, weak token-like
    strings with an identifier there, and endpoints with both. Weak spans that overlap a strong one are not reported. Null texts
    are empty; rows are told apart by numbers of their own, so rows without an id, and rows that repeat an id, are scanned and linked like others;
    texts of any length are scanned whole, and linking grows with the number of their spans; an empty table gives no row; further columns are ignored.
    Only spans of texts with a weak part and another role take part in the joins; texts are never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("_row", "_id", "_text", F.concat(*[spans_of(F.col("_text"), p, k, g, n) for k, p, g, n in BASE]).alias("base"))
    maybe = F.exists("base", lambda s: s["kind"] == "access") | F.col("_text").rlike(WEAK[0][1])
    weak = F.when(maybe, F.concat(*[spans_of(F.col("_text"), p, k) for k, p, _ in WEAK])).otherwise(none())
    rows = materialise(rows.select("_row", "_id", "base", weak.alias("weak")), "secret-spans")  # texts are scanned once; what follows reads spans only
    role = F.create_map(*[F.lit(x) for kind, r in ROLES.items() for x in (kind, r)])
    several = F.size(F.array_distinct(F.transform(F.concat("base", "weak"), lambda s: role[s["kind"]]))) > 1
    parts = rows.where((F.size("weak") > 0) & several).select("_row", F.explode(F.concat("base", "weak")).alias("s")).select("_row", "s.*")
    parts = parts.withColumns({"role": role[F.col("kind")], "weak": F.col("ord") >= len(BASE)})
    found = linked_weak(without_covered(parts, ["_row"], scope), ["_row"], scope).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("added"))
    return rows.select("_row", "_id", "base").join(found, "_row", "left").select(F.col("_id").alias(id_col), "base", F.coalesce("added", none()).alias("added"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan(table(spark, sf_dir, "documents"))
    number = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS bigint) AS n_{kind}") for kind, *_ in BASE]
    return rows.select("doc_id", *number, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
