"""SARIF 2.1.0 documents as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = "map<string, struct<text: string, markdown: string>>"
SCHEMA = (
    f"version string, runs array<struct<tool: struct<driver: struct<name: string, messageStrings: {_STRINGS}, globalMessageStrings: {_STRINGS},"
    f" rules: array<struct<id: string, messageStrings: {_STRINGS}, defaultConfiguration: struct<level: string>, properties: struct<`security-severity`: string>>>>>,"
    " originalUriBaseIds: map<string, struct<uri: string, uriBaseId: string>>, artifacts: array<struct<location: struct<uri: string, uriBaseId: string>>>, invocations: array<struct<executionSuccessful: boolean>>,"
    " results: array<struct<ruleId: string, ruleIndex: int, rule: struct<id: string, index: int>, level: string, message: struct<text: string, markdown: string, id: string, arguments: array<string>>, properties: struct<`security-severity`: string>,"
    " locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string, uriBaseId: string, index: int>, region: struct<startLine: int>>>>>>>>"
)
# Severity of a level, and the least score of a severity.
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
SCORES = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.0, "low"))
OUTSIDE, UNRESOLVED, CIRCLE, INDEX, RULES = "location outside the tree", "base of the location is unknown", "bases of the location are a circle", "artifact index is out of range", "rule id and index differ"
NO_MESSAGE, NOT_JSON, VERSION, NO_RUNS = "result has no message", "document is no JSON", "document of another version", "document has no runs"


def _joined(base: Column, uri: Column) -> Column:
    """A reference read against its base: absolute ones stay, others replace what follows the base's last slash."""
    whole = uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.startswith(uri, F.lit("/"))
    return F.when(whole | F.coalesce(base == "", F.lit(True)), uri).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), uri))


def _resolved(location: Column, bases: Column) -> Column:
    """struct(uri, base) after all known bases: ``base`` is what is left, an unknown base's name or that of a circle."""
    at = F.struct(F.coalesce(location["uri"], F.lit("")).alias("uri"), location["uriBaseId"].alias("base"))

    def step(acc: Column, _: Column) -> Column:
        entry = F.try_element_at(bases, acc["base"])
        known = acc["base"].isNotNull() & entry.isNotNull()
        return F.struct(F.when(known, _joined(F.coalesce(entry["uri"], F.lit("")), acc["uri"])).otherwise(acc["uri"]).alias("uri"), F.when(known, entry["uriBaseId"]).otherwise(acc["base"]).alias("base"))

    # each base is used once at most unless they are a circle
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(bases), F.lit(1))), at, step)


def _path(uri: Column, root: str) -> Column:
    """The path below the root that a resolved URI names, or NULL: other hosts, queries, drives, climbing and absolute paths elsewhere name none."""
    rest = F.regexp_replace(uri, r"(?i)^file:(?://(?:localhost)?(?=/))?", "")
    remote = rest.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | F.startswith(rest, F.lit("//")) | rest.rlike(r"[?#]")
    plain = F.translate(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), "\\", "/")
    base = root.rstrip("/") + "/"
    below = F.when(F.startswith(plain, F.lit("/")), F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 20))).otherwise(plain)
    bad = remote | plain.isNull() | (plain == "") | F.array_contains(F.split(plain, "/"), "..") | plain.rlike(r"[\x00-\x1f]") | F.contains(below, F.lit(":"))
    return F.when(~bad, F.regexp_replace(below, r"^\./", ""))


def _message(message: Column, rule: Column, driver: Column) -> Column:
    """The text, else the markdown, else that of the string which the id names in the rule or the driver; numbers in braces stand for arguments."""
    owners = [rule["messageStrings"], driver["messageStrings"], driver["globalMessageStrings"]]
    strings = [F.try_element_at(owner, message["id"]) for owner in owners]
    template = F.coalesce(*[F.when(v != "", v) for item in (message, *strings) for v in (item["text"], item["markdown"])])

    def filled(token: Column) -> Column:
        number = F.regexp_extract(token, r"^\{([0-9]+)\}$", 1).try_cast("int")
        return F.coalesce(F.get(message["arguments"], number), token)

    # in one pass, so that braces within arguments stay
    whole = F.array_join(F.transform(F.regexp_extract_all(template, F.lit(r"(\{[0-9]+\}|[^{]+|\{)"), 1), filled), "")
    return F.when(F.size(message["arguments"]) > 0, whole).otherwise(template)


def read_sarif(documents: DataFrame, column: str = "value", root: str = "") -> DataFrame:
    """tool, rule, severity, message, file, line, error of the results in SARIF documents, one row each.

    The rule is given by id, by index or by both, which must agree. The severity follows a score of the result or its rule, else the level. Locations
    go through artifact indices and nested bases; absolute ones are mapped under ``root``. A location that cannot be trusted leaves ``file`` as it was
    written and is named in ``error``, the finding stays, as does one without a message. Messages may be given by id, with arguments. Documents of another version,
    without runs, or that are no JSON are a row each with ``error`` alone; runs without results and NULL documents give none.
    """
    d = documents.where(F.col(column).isNotNull()).select(F.from_json(column, SCHEMA).alias("d"), F.try_parse_json(column).isNull().alias("broken"))
    bad = F.when(F.col("broken"), NOT_JSON).when(F.col("d.version") != "2.1.0", VERSION).when(F.col("d.runs").isNull(), NO_RUNS)
    run = d.schema["d"].dataType["runs"].dataType
    one = lambda kind: F.array(F.lit(None).cast(kind))
    runs = d.select(bad.alias("bad"), F.explode(F.when(bad.isNull(), F.col("d.runs")).otherwise(one(run.elementType))).alias("r"))
    rows = F.when(F.col("bad").isNull(), F.col("r.results")).otherwise(one(run.elementType["results"].dataType.elementType))
    results = runs.select(
        "bad", F.col("r.tool.driver").alias("driver"), F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.col("r.originalUriBaseIds").alias("bases"), F.col("r.artifacts").alias("artifacts"), F.explode(rows).alias("x"),
    )
    id_, index = F.coalesce("x.ruleId", "x.rule.id"), F.coalesce("x.ruleIndex", "x.rule.index", F.lit(-1))
    results = results.withColumns({"id": id_, "by_index": F.when(index >= 0, F.get("rules", index))})
    # a rule below another is named by both, with a slash
    by_id = F.get(F.filter("rules", lambda r: (r["id"] == F.col("id")) | F.startswith(F.col("id"), F.concat(r["id"], F.lit("/")))), F.lit(0))
    results = results.withColumn("known", F.coalesce(F.when(F.col("id").isNotNull(), by_id), F.col("by_index")))
    differ = F.col("id").isNotNull() & F.col("by_index.id").isNotNull() & (F.col("id") != F.col("by_index.id")) & ~F.startswith("id", F.concat("by_index.id", F.lit("/")))
    level = F.coalesce("x.level", "known.defaultConfiguration.level", F.lit("warning"))
    score = F.coalesce(*[F.col(f"{c}.properties.`security-severity`").try_cast("double") for c in ("x", "known")])
    by_score = F.coalesce(*[F.when(score >= least, F.lit(name)) for least, name in SCORES])
    by_level = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVELS.items()], F.lit("medium"))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    results = results.withColumn("place", place).withColumn("artifact", F.col("place.artifactLocation"))
    pointed = F.col("artifact.uri").isNull() & F.col("artifact.index").isNotNull()
    entry = F.when(pointed & (F.col("artifact.index") >= 0), F.get("artifacts", F.col("artifact.index")))
    named = F.when(pointed, entry["location"]).otherwise(F.when(F.col("artifact").isNotNull(), F.struct(F.col("artifact.uri").alias("uri"), F.col("artifact.uriBaseId").alias("uriBaseId"))))
    results = results.withColumn("named", named).withColumn("at", _resolved(F.col("named"), F.coalesce("bases", F.expr("CAST(map() AS map<string, struct<uri: string, uriBaseId: string>>)"))))
    results = results.withColumn("path", _path(F.col("at.uri"), root))
    circle = F.col("at.base").isNotNull() & F.try_element_at("bases", F.col("at.base")).isNotNull()
    results = results.withColumn("message", _message(F.col("x.message"), F.col("known"), F.col("driver")))
    error = F.when(differ, RULES).when(pointed & entry.isNull(), INDEX).when(circle, CIRCLE).when(F.col("at.base").isNotNull(), UNRESOLVED).when(F.col("named").isNotNull() & F.col("path").isNull(), OUTSIDE).when(F.col("message").isNull(), NO_MESSAGE)
    # a location that is refused is shown as it was written
    file = F.when(F.col("named").isNull(), "").when(F.col("at.base").isNull() & F.col("path").isNotNull(), F.col("path")).otherwise(F.col("named.uri"))
    return results.select(
        "tool", F.coalesce("id", "by_index.id").alias("rule"), F.when(F.col("bad").isNull(), F.coalesce(by_score, by_level)).alias("severity"), "message",
        F.when(F.col("bad").isNull(), file).alias("file"), F.col("place.region.startLine").alias("line"), F.coalesce("bad", error).alias("error"),
    )
