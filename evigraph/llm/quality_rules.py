"""Quality rules whose thresholds follow the corpus: one quantile sketch per language and source.

The sketch of a measure is a histogram on a grid that keeps eight significant bits. Sketches merge by adding counts,
in any order and with the same outcome, and a quantile is off by less than one part in 128.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, table
from .textstats import base_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: measure -> (SQL for an integer value, least distance of its upper fence from the upper quartile, whether low values are outliers too)
MEASURES = {
    "symbols": ("1000 * n_symbols DIV greatest(word_chars, 1)", 50, False),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", 400, False),
    "repeats": ("1000 * n_repeat_words DIV greatest(n_words, 1)", 400, False),
    "word_length": ("100 * word_chars DIV greatest(n_words, 1)", 250, True),
}
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


@dataclass(frozen=True)
class Settings:
    """``fence``: quartile distances beyond a quartile; groups under ``min_docs`` documents use their language's sketch, then that of all;
    threshold tables over ``max_broadcast_rows`` rows are joined by a shuffle in ``salts`` parts."""

    fence: int = 3
    min_docs: int = 100
    max_broadcast_rows: int = 20_000
    salts: int = 64


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and the counts of each row's whole text."""
    picked = docs.select(*keep, F.col(text_col).alias("counted"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + [f"{c} long" for c in COUNTS])

    def count(batches):
        for batch in batches:
            found = [base_counts(t.as_py()) for t in batch.column("counted")]
            columns = list(zip(*found, strict=True)) if found else [()] * len(COUNTS)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *COUNTS])

    return picked.mapInArrow(count, schema)


def with_base(counts: DataFrame) -> DataFrame:
    return counts.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"))


def thresholds(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fences per (lang, source) from the rows that pass the base rules: lang, source and, per measure, ``<m>_lo`` and ``<m>_hi``."""
    stacked = ", ".join(f"'{m}', {value}" for m, (value, _, _) in MEASURES.items())
    values = rows.where("NOT base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {stacked}) AS (measure, v)")
    cell = F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 8, 0)), greatest(length(bin(v)) - 8, 0))")
    sketch = values.groupBy("lang", "source", "measure", cell.alias("cell")).agg(F.count("*").alias("n"))
    # merged sketches of each language and of all rows; level 0 is the group itself
    merged = sketch.select(
        "measure", "cell", "n", F.explode(F.expr("array(struct(0 AS level, lang AS l, source AS s), struct(1 AS level, lang AS l, '' AS s), struct(2 AS level, '' AS l, '' AS s))")).alias("g")
    )
    merged = merged.groupBy("measure", "cell", "g").agg(F.sum("n").alias("n"))
    ordered = W.partitionBy("measure", "g").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merged.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(W.partitionBy("measure", "g")))
    quartiles = merged.groupBy("g", "measure").agg(
        F.min(F.expr("CASE WHEN 4 * upto >= all THEN cell END")).alias("q1"), F.min(F.expr("CASE WHEN 4 * upto >= 3 * all THEN cell END")).alias("q3"), F.max("all").alias("docs")
    )
    slack = F.create_map(*[F.lit(x) for m, (_, s, _) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    two_sided = F.col("measure").isin(*[m for m, (_, _, two) in MEASURES.items() if two])
    reach = F.greatest(settings.fence * (F.col("q3") - F.col("q1")), slack.cast("long"))
    fences = quartiles.select("g", "measure", "docs", F.when(two_sided, F.col("q1") - reach).otherwise(F.lit(-1).cast("long")).alias("lo"), (F.col("q3") + reach).alias("hi"))
    wide = fences.groupBy("g").agg(F.max("docs").alias("docs"), *[F.max(F.expr(f"CASE WHEN measure = '{m}' THEN {e} END")).alias(f"{m}_{e}") for m in MEASURES for e in ("lo", "hi")])
    names = [f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")]
    own = wide.where("g.level = 0").select(F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "docs", F.struct(*names).alias("own"))
    language = wide.where(f"g.level = 1 AND docs >= {settings.min_docs}").select(F.col("g.l").alias("lang"), F.struct(*names).alias("language"))
    overall = wide.where("g.level = 2").select(F.struct(*names).alias("overall"), F.lit(1).alias("one"))
    joined = own.join(language, "lang", "left").withColumn("one", F.lit(1)).join(overall, "one", "left")
    chosen = joined.withColumn("t", F.when(F.col("docs") >= settings.min_docs, F.col("own")).otherwise(F.coalesce("language", "overall")))
    return chosen.select("lang", "source", *[f"t.{n}" for n in names])


def judge(rows: DataFrame, fences: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` with ``kept``. Small fence tables are broadcast after counting; larger ones are replicated over salts and joined by a shuffle."""
    inside = " AND ".join(f"({value}) BETWEEN {m}_lo AND {m}_hi" for m, (value, _, _) in MEASURES.items())
    if fences.limit(settings.max_broadcast_rows + 1).count() <= settings.max_broadcast_rows:
        joined = rows.join(F.broadcast(fences), ["lang", "source"], "left")
    else:
        salted = fences.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
        counts = [F.col(c) for c in COUNTS]
        joined = rows.withColumn("salt", F.pmod(F.xxhash64(*counts), F.lit(settings.salts)).cast("int")).join(salted, ["lang", "source", "salt"], "left")
    names = [f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")]
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND coalesce({inside}, false)")).drop(*names, "salt")


def _prepared(docs: DataFrame, keep: Column, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    named = docs.select(keep.alias("own"), F.col(text_col).alias("text"), F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"))
    return with_base(text_counts(named, "text", ("own", "lang", "source")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, ``base_failed`` and ``kept``.

    A row is kept if it passes the base rules and each measure lies within the fences of its language and source
    (quartile plus ``fence`` quartile distances, at least the slack of the measure). Null texts have no words and fail
    the base rules; null languages or sources count as the empty string; null ids are ids like others; texts of any length are read whole;
    repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
    """
    rows = materialise(_prepared(docs, F.col(id_col), lang_col, source_col, text_col), "quality-counts")
    fences = materialise(thresholds(rows, settings), "quality-fences")
    return judge(rows, fences, settings).select(F.col("own").alias(id_col), *COUNTS, "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("n_lines")


def keep_good(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, whatever these are called.

    Null texts go, as they fail the base rules; null ids, languages and sources and repeated rows are judged like others; an empty table stays
    empty. Whole rows are written once next to their counts, so texts are counted once, and are not shuffled unless the fence table is large.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = materialise(_prepared(docs, F.struct(*columns), "lang", "source", "text"), "quality-counts")
    fences = materialise(thresholds(rows, settings), "quality-fences")
    return judge(rows, fences, settings).where("kept").select("own.*")


def _sql() -> str:
    s = Settings()
    sql = {m: value.replace(" DIV ", " // ") for m, (value, _, _) in MEASURES.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM base WHERE NOT base_failed" for m, v in sql.items())
    fences = " UNION ALL ".join(
        f"SELECT level, l, s, docs, measure, {'q1 - greatest(%d * (q3 - q1), %d)' % (s.fence, slack) if two else '-1'} AS lo, q3 + greatest({s.fence} * (q3 - q1), {slack}) AS hi FROM quartiles WHERE measure = '{m}'"
        for m, (_, slack, two) in MEASURES.items()
    )
    inside = " AND ".join(f"EXISTS (SELECT 1 FROM chosen c WHERE c.lang = base.lang AND c.source = base.source AND c.measure = '{m}' AND {v} BETWEEN c.lo AND c.hi)" for m, v in sql.items())
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
starts AS (SELECT n, i, (w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT n, i FROM starts QUALIFY count(*) OVER (PARTITION BY n, k) > 1),
repeats AS (SELECT n, count(DISTINCT i + o) AS c FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY n),
base AS (
  SELECT n, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{blank}+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(w) < {MIN_WORDS} OR 100 * coalesce(c, 0) > {MAX_REPEATED_PERCENT} * len(w) AS base_failed
  FROM split LEFT JOIN repeats USING (n)
),
vals AS ({values}),
cells AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS cell FROM vals),
levels AS (SELECT 0 AS level, lang AS l, source AS s, measure, cell FROM cells UNION ALL SELECT 1, lang, '', measure, cell FROM cells UNION ALL SELECT 2, '', '', measure, cell FROM cells),
quartiles AS (
  SELECT level, l, s, measure, count(*) AS docs, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM levels GROUP BY ALL
),
fences AS ({fences}),
chosen AS (
  SELECT o.l AS lang, o.s AS source, o.measure, CASE WHEN o.docs >= {s.min_docs} THEN o.lo WHEN g.docs >= {s.min_docs} THEN g.lo ELSE a.lo END AS lo,
         CASE WHEN o.docs >= {s.min_docs} THEN o.hi WHEN g.docs >= {s.min_docs} THEN g.hi ELSE a.hi END AS hi
  FROM fences o LEFT JOIN fences g ON g.level = 1 AND g.l = o.l AND g.measure = o.measure LEFT JOIN fences a ON a.level = 2 AND a.measure = o.measure
  WHERE o.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept FROM base
"""


OP2_SQL = _sql()
