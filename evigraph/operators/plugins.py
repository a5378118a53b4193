"""Extractors that others bring: run over files, judged file by file, and taken into the graph whole or not at all."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from importlib.metadata import entry_points
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, sized

GROUP, API = "evigraph.extractors", 1
# Records of one file at most, words for how sure an edge is and how grave an issue.
MOST = 20_000
RESOLUTIONS = ("exact", "high", "probable", "ambiguous", "declared")
SEVERITIES = ("info", "warning", "error")
NODE, EDGE, ISSUE, FAILED = "node", "edge", "issue", "failed"
FIELDS = ("id", "kind", "label", "path", "metadata", "src", "dst", "resolution", "evidence", "severity", "message", "recommendation")
RECORDS = "file string, record string, " + ", ".join(f"{f} string" for f in FIELDS) + ", node_ids array<string>"
_ARROW = pa.schema([("file", pa.string()), ("record", pa.string()), *[(f, pa.string()) for f in FIELDS], ("node_ids", pa.list_(pa.string()))])


class Extractor(Protocol):
    """What a plugin provides. ``analyze`` yields records: dicts of ``record`` (node, edge or issue) and of ``FIELDS``; ``metadata`` is JSON."""

    api: int
    name: str
    version: str
    endings: tuple[str, ...]

    def analyze(self, path: str, text: str) -> Iterable[dict]: ...


def installed() -> dict[str, list[str]]:
    """Where the plugins of each name are installed; none of them is imported."""
    found: dict[str, list[str]] = {}
    for point in entry_points(group=GROUP):
        found.setdefault(point.name, []).append(point.value)
    return found


def checked(plugin: Extractor, name: str) -> Extractor:
    """``plugin``, if it is one that this engine can run under that name."""
    wrong = [
        text
        for bad, text in (
            (getattr(plugin, "api", None) != API, f"is not of interface {API}"),
            (getattr(plugin, "name", None) != name, "has another name"),
            (not (isinstance(getattr(plugin, "version", None), str) and plugin.version), "has no version"),
            (not callable(getattr(plugin, "analyze", None)), "has no analyze"),
            (not getattr(plugin, "endings", ()) or any(not e.startswith(".") or e != e.lower() or "/" in e for e in plugin.endings), "names no endings, or endings that are not lower-case ones"),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"extractor {name!r} {' and '.join(wrong)}")
    return plugin


def load(names: Iterable[str]) -> list[Extractor]:
    """The plugins that the caller names, by name; each must be installed once."""
    out = []
    for name in sorted(set(names)):
        points = [p for p in entry_points(group=GROUP) if p.name == name]
        if len(points) != 1:
            raise ValueError(f"extractor {name!r} is installed {len(points)} times")
        out.append(checked(points[0].load()(), name))
    return out


def extract(files: DataFrame, plugin: Extractor, rows: int = 2_000) -> DataFrame:
    """Records (``RECORDS``) that ``plugin`` finds in the files (path, text) with one of its endings. A file on which it fails gives one record ``failed``,
    whatever it had found there. Batches of records leave as they fill, so a file may have any number of them.

    Files without text are passed over.
    """
    asked = files.where(F.col("text").isNotNull() & F.lower("path").rlike("|".join(rf"\Q{e}\E$" for e in plugin.endings))).select("path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for found in plugin.analyze(path, text):
                        held.append({**found, "file": path})
                        if len(held) >= rows:
                            yield pa.RecordBatch.from_pylist(held, _ARROW)
                            held = []
                except Exception as wrong:  # a plugin is not ours: what it raises is a fact about the file
                    held.append({"file": path, "record": FAILED, "message": f"{type(wrong).__name__}: {wrong}"})
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    return asked.mapInArrow(run, RECORDS)


def inside(path: Column) -> Column:
    """Whether a path stays below the root and is written plainly."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~(F.contains(path, F.lit("..")) & F.array_contains(F.split(path, "/"), "..")) & ~path.rlike(r"[\\:\x00-\x1f]")


#: What a file is withdrawn for, in order of texts, so that the least of a file's numbers stands for its least reason; the text of FAILURE goes on.
REASONS = (
    "edge without an end, kind or evidence", FAILURE := "failed: ", "issue without a text", "metadata is no JSON", UNKNOWN := "names an unknown node", DIFFERENT := "node is described differently",
    "node without id, kind or label", "path outside the tree", TOO_MANY := "too many records", "unknown record", "unknown resolution", "unknown severity",
)


def _reason(text: str) -> Column:
    return F.lit(REASONS.index(text))


def _own_faults() -> Column:
    """The number of what is wrong with a record by itself, or NULL."""
    missing = lambda *names: F.coalesce(*[F.when(F.col(n).isNull(), True) for n in names], F.lit(False))
    node = F.when(missing("id", "kind", "label") | (F.col("id") == ""), _reason("node without id, kind or label")).when(~inside(F.col("path")), _reason("path outside the tree"))
    node = node.when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), _reason("metadata is no JSON"))
    edge = F.when(missing("src", "dst", "kind", "evidence"), _reason("edge without an end, kind or evidence")).when(~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False)), _reason("unknown resolution"))
    issue = F.when(missing("message", "evidence", "recommendation"), _reason("issue without a text")).when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), _reason("unknown severity"))
    what = F.col("record")
    return F.when(what == NODE, node).when(what == EDGE, edge).when(what == ISSUE, issue).when(what == FAILED, _reason(FAILURE)).otherwise(_reason("unknown record"))


def _described() -> Column:
    return F.struct(F.col("kind"), F.col("label"), F.col("path"))


#: 128 bits that stand for a description; as hashes pass over NULL, they have the number of the texts that are NULL too.
_MARKS = ("mark1", "mark2")


def _marks() -> list[Column]:
    texts = [F.col("kind"), F.col("label"), F.col("path")]
    missing = reduce(lambda x, y: x + y, [F.when(t.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(texts)])
    return [F.xxhash64(F.lit(seed), missing, *texts).alias(name) for seed, name in enumerate(_MARKS)]


def _bounds(low: Callable[[str], str | Column], high: Callable[[str], str | Column]) -> list[Column]:
    return [x for m in _MARKS for x in (F.min(low(m)).alias(f"{m}_low"), F.max(high(m)).alias(f"{m}_high"))]


def _named(records: DataFrame) -> DataFrame:
    """(file, id, n, fault, nodes, ends) and bounds of the marks of descriptions, for each id that records of a file name: records counted at their first id, their
    least fault, nodes of the id, and how often edges or issues name it.

    One pass over the records. All that is combined has a fixed width, so it is combined by hash, in each task before the shuffle.
    """
    what = F.col("record")
    named = F.when(what == NODE, F.array("id")).when(what == EDGE, F.array("src", "dst")).when(what == ISSUE, F.col("node_ids"))
    each = records.select("file", (what == NODE).alias("node"), _own_faults().alias("fault"), *_marks(), F.posexplode_outer(named).alias("at", "id"))
    first, node = F.coalesce(F.col("at"), F.lit(0)) == 0, F.coalesce("node", F.lit(False)) & F.col("id").isNotNull()
    mark = lambda m: F.when(node, F.col(m))
    sums = [F.count_if(first).alias("n"), F.min("fault").alias("fault"), F.count_if(node).alias("nodes"), F.count_if(~F.coalesce("node", F.lit(False)) & F.col("at").isNotNull()).alias("ends")]
    return each.groupBy("file", "id").agg(*sums, *_bounds(mark, mark))


def withdrawn(records: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """(file, reason): files whose records break a rule, with the least reason. ``known`` has the nodes (id, kind, label, path) of the graph.

    A file is judged by its own records and the graph as it was before any plugin: the outcome does not depend on an order of files. Rules: at most ``most``
    records; nodes, edges and issues are whole; ends of edges and nodes of issues are known or nodes of the same file; a node is described as the graph or the same file describes it.
    Of files that pass and describe a node differently the one that comes first by name keeps it, the others go.

    Counts and reasons are combined in each task, so a file with millions of records is one row for each id of each task before the shuffle. Descriptions are
    read and compared for the ids alone that are described in several ways, by records or the graph, as 128 bits of hashes tell.
    """
    named = cut(_named(records))
    nodes = cut(known.select("id", _described().alias("known")).dropDuplicates(["id"]))
    graph = sized(nodes)
    # the graph has each id once, so its parts are even: they are hashed, and the many ends need no order
    loose = named.where("nodes = 0 AND ends > 0").select("file", "id").join(nodes.select("id").hint("shuffle_hash"), "id", "left_anti")
    ranges = [f"{m}_{end}" for m in _MARKS for end in ("low", "high")]
    described = named.where("nodes > 0").select("id", *ranges).unionByName(nodes.select("id", "known.*").select("id", *[m.alias(f"{name}_{end}") for name, m in zip(_MARKS, _marks(), strict=True) for end in ("low", "high")]))
    differ = " OR ".join(f"{m}_low != {m}_high" for m in _MARKS)
    several = cut(described.groupBy("id").agg(*_bounds(lambda m: f"{m}_low", lambda m: f"{m}_high")).where(differ).select("id"))
    # one row for each way in which a file describes such a node; whatever follows reads these
    here = cut(records.where((F.col("record") == NODE) & F.col("id").isNotNull()).join(sized(several), "id", "left_semi").select("file", "id", "kind", "label", "path").distinct())
    twice = here.groupBy("file", "id").agg(F.count("*").alias("n")).where("n > 1").select("file")
    other = here.select("file", "id", _described().alias("d")).join(graph, "id").where("NOT (d <=> known)").select("file")
    met = loose.select("file", _reason(UNKNOWN).alias("met")).unionByName(twice.unionByName(other).select("file", _reason(DIFFERENT).alias("met")))
    files = named.select("file", "n", "fault").unionByName(met, allowMissingColumns=True)
    files = files.groupBy("file").agg(F.sum("n").alias("n"), F.min("fault").alias("fault"), F.min("met").alias("met"))
    files = cut(files.select("file", F.least(F.when(F.col("n") > most, _reason(TOO_MANY)).otherwise(F.col("fault")), "met").alias("why")).where("why IS NOT NULL"))
    # only what failed has a text of its own
    failed = F.col("why") == _reason(FAILURE)
    texts = records.where(F.col("record") == FAILED).join(sized(files.where(failed).select("file")), "file", "left_semi").groupBy("file").agg(F.min(F.concat(F.lit(FAILURE), F.coalesce("message", F.lit("")))).alias("reason"))
    first = cut(files.where(~failed).select("file", F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("why")).alias("reason")).unionByName(texts))
    # what is left may still disagree among files
    rest = here.join(first.select("file").hint("merge"), "file", "left_anti").select("file", "id", _described().alias("d"))
    torn = rest.groupBy("id").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min_by("d", "file").alias("kept")).where("NOT (low <=> high)").select("id", "kept")
    later = rest.join(sized(cut(torn)), "id").where("NOT (d <=> kept)").select("file", F.lit("another file describes the node first").alias("reason"))
    return first.unionByName(later.distinct())


def commit(records: DataFrame, known: DataFrame, name: str, version: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(records that enter the graph, withdrawn files). All records of a file enter or none; nodes that the graph has already keep what it knows of them, so
    they do not enter again. ``origin`` of a record is always the plugin's name and version, whatever the plugin says."""
    out = cut(withdrawn(records, known, most))
    kept = records.join(out.select("file").hint("merge"), "file", "left_anti")
    new = kept.where(F.col("record") == NODE).dropDuplicates(["id"]).join(sized(cut(known.select("id").distinct())), "id", "left_anti").select(records.columns)
    entered = new.unionByName(kept.where(F.col("record") != NODE))
    return entered.withColumn("origin", F.lit(f"plugin:{name}@{version}")), out
