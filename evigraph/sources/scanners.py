"""JSON reports of external scanners as findings, whatever their format, in one pass over the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities of rule prefixes, the first that fits counts; words for severities; what remedies and messages say.
RUFF_SEVERITIES = (("S608", "high"), ("S105", "high"), ("S106", "high"), ("S107", "high"), ("S301", "high"), ("S307", "high"), ("S5", "medium"), ("S3", "medium"), ("S6", "low"), ("S1", "low"), ("S", "medium"), ("ASYNC", "medium"), ("PERF", "low"), ("B", "low"))
SEMGREP_SEVERITIES = (("ERROR", "high"), ("WARNING", "medium"), ("INFO", "low"))
GRADES = ("high", "medium", "low")
PERFORMANCE_RULES = ("ASYNC", "PERF")
UNSCANNED, UNREADABLE = "could-not-scan", "unreadable-report"
SHOWN = 300

_ITEM = "array<struct<kind: string, item: variant, about: variant, source: string>>"


def _list(value: Column, path: str = "$") -> Column:
    """The elements of an array inside a VARIANT; none where there is no array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("CAST(array() AS array<variant>)"))


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _items(values: Column, kind: str | Column, about: Column | None = None, source: Column | None = None) -> Column:
    """Entries for the elements of an array: what they are, the element, what it is about and where it was found."""
    kinds = F.lit(kind) if isinstance(kind, str) else kind
    nothing = F.lit(None).cast("variant") if about is None else about
    return F.transform(values, lambda x: F.struct(kinds.alias("kind"), x.alias("item"), nothing.alias("about"), (F.lit(None).cast("string") if source is None else source).alias("source")))


def _ruff(v: Column) -> Column:
    return F.transform(_list(v), lambda x: F.struct(F.when(F.coalesce(_text(x, "$.code"), F.lit("")) == "", UNSCANNED).otherwise("result").alias("kind"), x.alias("item"), F.lit(None).cast("variant").alias("about"), F.lit(None).cast("string").alias("source")))


def _bandit(v: Column) -> Column:
    return F.concat(_items(_list(v, "$.errors"), UNSCANNED), _items(_list(v, "$.results"), "result"))


def _osv(v: Column) -> Column:
    def packages(result: Column) -> Column:
        source = F.coalesce(_text(result, "$.source.path"), F.lit(""))
        return F.flatten(F.transform(_list(result, "$.packages"), lambda p: _items(_list(p, "$.vulnerabilities"), "result", F.try_variant_get(p, "$.package", "variant"), source)))

    return F.flatten(F.transform(_list(v, "$.results"), packages))


def _pip_audit(v: Column) -> Column:
    return F.flatten(F.transform(_list(v, "$.dependencies"), lambda d: _items(_list(d, "$.vulns"), "result", d)))


#: What a report holds by tool, and the type that its top must have.
READERS = {"ruff": (_ruff, "ARRAY"), "bandit": (_bandit, "OBJECT"), "semgrep": (_bandit, "OBJECT"), "osv-scanner": (_osv, "OBJECT"), "pip-audit": (_pip_audit, "OBJECT")}


def _by_prefix(code: Column, table: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    return F.coalesce(*[F.when(F.startswith(code, F.lit(p)), F.lit(s)) for p, s in table], F.lit(otherwise))


def _grade(value: Column, otherwise: str, more: tuple[str, ...] = ()) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*GRADES, *more), low).otherwise(otherwise)


def read_reports(reports: DataFrame) -> DataFrame:
    """(report_id, tool, rule, severity, confidence, category, file, line, message, remedy, error) of the results in reports (report_id, tool, file, text).

    ``tool`` is one of ``READERS``; ``file`` is what pip-audit was asked about, which its report does not say. A file that a tool could not read is a finding
    of its rule ``could-not-scan``, so its silence is no all-clear. A report that is no JSON, whose top is of another type, whose tool is not known, or whose tool
    failed as a whole (an error of semgrep without a path) gives one row with ``error`` and nothing else of it. An unknown level takes the default of its tool.

    Each report is parsed once, to a VARIANT, and its results are exploded once, whichever tools wrote them.
    """
    parsed = reports.select("report_id", "tool", "file", F.try_parse_json("text").alias("v"))
    top = F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("")), "^[A-Z]+", 0)
    fits = F.coalesce(*[F.when(F.col("tool") == t, top == kind) for t, (_, kind) in READERS.items()])
    broken = F.when(F.col("tool") == "semgrep", F.get(F.filter(_list(F.col("v"), "$.errors"), lambda e: F.coalesce(_text(e, "$.path"), F.lit("")) == ""), F.lit(0)))
    failed = F.coalesce(_text(broken, "$.message"), _text(broken, "$.type"), F.when(broken.isNotNull(), "unnamed error"))
    error = F.when(fits.isNull(), "unknown tool").when(F.col("v").isNull(), "no JSON").when(~fits, "another type of document").otherwise(F.left(failed, F.lit(SHOWN)))
    judged = parsed.withColumn("error", error)
    items = F.coalesce(*[F.when(F.col("error").isNull() & (F.col("tool") == t), read(F.col("v"))) for t, (read, _) in READERS.items()])
    refused = F.expr(f"CAST(array(named_struct('kind', '{UNREADABLE}', 'item', NULL, 'about', NULL, 'source', NULL)) AS {_ITEM})")
    one = judged.select("report_id", "tool", "file", "error", F.explode(F.coalesce(items, F.when(F.col("error").isNotNull(), refused))).alias("e")).select("report_id", "tool", "file", "error", "e.*")

    item, about = F.col("item"), F.col("about")
    get = lambda path: F.coalesce(_text(item, path), F.lit(""))
    is_ = lambda name: F.col("tool") == name
    deps = F.col("tool").isin("osv-scanner", "pip-audit")
    code = _text(item, "$.code")
    rule = F.when(is_("ruff"), code).when(is_("bandit"), F.concat_ws("-", _text(item, "$.test_id"), _text(item, "$.test_name"))).when(is_("semgrep"), _text(item, "$.check_id")).otherwise(_text(item, "$.id"))
    # advisories say MODERATE
    level = F.lower(F.coalesce(_text(item, "$.database_specific.severity"), F.lit("high")))
    severity = (
        F.when(is_("ruff"), _by_prefix(code, RUFF_SEVERITIES, "low")).when(is_("bandit"), _grade(_text(item, "$.issue_severity"), "low"))
        .when(is_("semgrep"), F.coalesce(*[F.when(_text(item, "$.extra.severity") == k, F.lit(s)) for k, s in SEMGREP_SEVERITIES], F.lit("medium")))
        .when(is_("osv-scanner"), F.when(level == "moderate", "medium").otherwise(_grade(level, "high", ("critical",)))).otherwise("high")
    )
    confidence = (
        F.when(is_("ruff"), F.when(F.startswith(code, F.lit("ASYNC")), "high").otherwise("medium")).when(is_("bandit"), _grade(_text(item, "$.issue_confidence"), "low"))
        .when(is_("semgrep"), _grade(_text(item, "$.extra.metadata.confidence"), "medium")).otherwise("high")
    )
    slow = F.coalesce(*[F.when(F.startswith(code, F.lit(p)), F.lit("performance")) for p in PERFORMANCE_RULES])
    category = F.when(is_("ruff"), F.when(F.startswith(code, F.lit("S")), "security").otherwise(F.coalesce(slow, F.lit("correctness")))).when(deps, "dependencies").otherwise("security")
    file = F.when(F.col("tool").isin("ruff", "bandit"), get("$.filename")).when(is_("semgrep"), get("$.path")).when(is_("osv-scanner"), F.col("source")).otherwise(F.col("file"))
    line = F.when(is_("ruff"), F.try_variant_get(item, "$.location.row", "long")).when(is_("bandit"), F.try_variant_get(item, "$.line_number", "long")).when(is_("semgrep"), F.try_variant_get(item, "$.start.line", "long"))
    package = F.concat_ws(" ", _text(about, "$.name"), _text(about, "$.version"))
    told = F.when(is_("osv-scanner"), F.coalesce(_text(item, "$.summary"), _text(item, "$.id"))).otherwise(_text(item, "$.id"))
    message = F.when(deps, F.concat(package, F.lit(": "), F.coalesce(told, F.lit("")))).when(is_("ruff"), get("$.message")).when(is_("bandit"), get("$.issue_text")).otherwise(get("$.extra.message"))
    fixes = F.array_join(F.try_variant_get(item, "$.fix_versions", "array<string>"), ", ")
    remedy = (
        F.when(is_("ruff"), get("$.url")).when(is_("bandit"), get("$.more_info")).when(is_("osv-scanner"), "Upgrade to a fixed version.")
        .when(is_("pip-audit"), F.concat(F.lit("Upgrade to: "), F.coalesce(F.nullif(fixes, F.lit("")), F.lit("none published")))).otherwise("")
    )
    reason = F.left(F.coalesce(_text(item, "$.message"), _text(item, "$.reason"), _text(item, "$.type"), F.lit("")), F.lit(SHOWN))

    unscanned, unread = F.col("kind") == UNSCANNED, F.col("kind") == UNREADABLE

    def pick(result: Column, of_file: Column, of_report: Column) -> Column:
        return F.when(unread, of_report).when(unscanned, of_file).otherwise(result)

    home = F.when(deps, "deps").otherwise(F.col("tool"))
    return one.select(
        "report_id", "tool",
        pick(F.concat(home, F.lit("/"), rule), F.concat("tool", F.lit(f"/{UNSCANNED}")), F.concat(F.coalesce("tool", F.lit("")), F.lit(f"/{UNREADABLE}"))).alias("rule"),
        pick(severity, F.lit("medium"), F.lit("medium")).alias("severity"), pick(confidence, F.lit("high"), F.lit("high")).alias("confidence"),
        pick(category, F.lit("security"), F.lit("security")).alias("category"), pick(file, file, F.coalesce("file", F.lit(""))).alias("file"),
        F.when(unread | unscanned, F.lit(0).cast("long")).otherwise(F.coalesce(line, F.lit(0).cast("long"))).alias("line"),
        pick(message, F.concat("tool", F.lit(" could not scan this file: "), reason), F.concat(F.coalesce("tool", F.lit("")), F.lit(" left no report that can be read: "), F.col("error"))).alias("message"),
        pick(remedy, F.lit("Fix what stops it parsing; until then no rule of this tool sees the file."), F.lit("")).alias("remedy"), "error",
    )
