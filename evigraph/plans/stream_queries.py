"""Queries that run a stream over a driver table, and the ignore rules of a tree made of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..operators.ignore import ignore_rules, ignored
from ..sources.corpus import CUTOFF, PAGE_ROUTES_SQL, table
from ..streaming.incremental import incremental, run_incremental
from .path_queries import _files

_FP = "concat(event_type, ' ', user_id)"


def incremental_findings(spark, sf):
    """Occurrences by fingerprint of the events since the cutoff, as a stream; those before it are the baseline. Five days without an event, and a fingerprint is gone."""
    e = table(spark, sf, "events")
    baseline = e.where(F.col("ts") < CUTOFF).groupBy(F.expr(_FP).alias("fp")).agg(F.count("*").alias("known"), F.max("ts").alias("since"))
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events*.parquet").where(F.col("ts") >= CUTOFF).select(F.expr(_FP).alias("fp"), F.col("ts").cast("timestamp").alias("ts"))
    out = shared_folder(spark, "evigraph-stream")
    run_incremental(incremental(stream, baseline, ttl_days=5), f"{out}/rows", f"{out}/state")
    rows = spark.read.schema("fp string, ts timestamp, kind string, occurrence long, is_new boolean").parquet(f"{out}/rows")
    return rows.select("fp", "kind", "occurrence", "is_new")


def ignored_files(spark, sf):
    """Which files of a tree made of pages its ignore files leave out: one at the top, one for each host by the length of its name, one in each Spanish folder."""
    f = _files(spark, sf)
    by_host = "CASE length(host) % 4 WHEN 0 THEN '/en/*\\n!/en/*[13579].ts' WHEN 1 THEN 'fr/' WHEN 2 THEN '!index.tsx' ELSE '/**/1*' END"
    hosts = f.select(F.concat(F.lit("web/"), "host").alias("folder"), F.expr(by_host).alias("text")).distinct()
    spanish = f.where("lang = 'es'").select(F.concat_ws("/", F.lit("web"), "host", "lang").alias("folder"), F.lit("*\n!*5*").alias("text")).distinct()
    top = spark.createDataFrame([("", "# generated files\n*.tsx\n/web/www.*/de/\n!web\n")], "folder string, text string")
    rules = ignore_rules(top.unionByName(hosts).unionByName(spanish))
    return ignored(f.select("page_id", "path"), rules).select("page_id", "path", "ignored", "rule_folder", "rule_line", "rule")


QUERIES = {f.__name__: f for f in (incremental_findings, ignored_files)}

ORACLES = {
    "incremental_findings": f"""WITH e AS (SELECT event_type || ' ' || user_id AS fp, ts, event_id FROM events),
known AS (SELECT fp, count(*) AS known, max(ts) AS since FROM e WHERE ts < '{CUTOFF}' GROUP BY fp),
later AS (SELECT fp, ts, row_number() OVER (PARTITION BY fp ORDER BY ts, event_id) - 1 AS occurrence FROM e WHERE ts >= '{CUTOFF}'),
last AS (SELECT fp, max(ts) AS last FROM e GROUP BY fp)
SELECT fp, 'found' AS kind, occurrence, occurrence >= coalesce(known, 0) AS is_new FROM later LEFT JOIN known USING (fp)
UNION ALL SELECT fp, 'gone', (SELECT count(*) FROM later l WHERE l.fp = last.fp), NULL FROM last
WHERE last + INTERVAL 5 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""",
    "ignored_files": f"""WITH {PAGE_ROUTES_SQL},
f AS (SELECT page_id, host, regexp_extract(path, '^/([^/]*)', 1) AS lang, regexp_extract(path, '([0-9]+)', 1) AS num, page_id % 4 = 1 AS tsx, length(host) % 4 AS rest FROM routes),
p AS (SELECT *, concat_ws('/', 'web', host, lang, CASE WHEN tsx THEN num || '/index.tsx' ELSE num || '.ts' END) AS path FROM f),
hit AS (SELECT page_id, path, host, lang, CASE
  WHEN rest = 1 AND lang = 'fr' THEN 'host1'
  WHEN host LIKE 'www.%' AND lang = 'de' THEN 'top3'
  WHEN lang = 'es' THEN CASE WHEN NOT tsx AND contains(num, '5') THEN 'es2' ELSE 'es1' END
  WHEN rest = 0 AND lang = 'en' THEN CASE WHEN NOT tsx AND num[-1:] IN ('1', '3', '5', '7', '9') THEN 'host2' ELSE 'host1' END
  WHEN rest = 3 AND num[1:1] = '1' THEN 'host1'
  WHEN rest = 2 AND tsx THEN 'open1'
  WHEN tsx THEN 'top2' END AS h, rest FROM p)
SELECT page_id, path, coalesce(h NOT IN ('es2', 'host2', 'open1'), false) AS ignored,
  CASE WHEN h LIKE 'top%' THEN '' WHEN h LIKE 'es%' THEN 'web/' || host || '/es' WHEN h IS NOT NULL THEN 'web/' || host END AS rule_folder, h[-1:]::INT AS rule_line,
  CASE h WHEN 'top2' THEN '*.tsx' WHEN 'top3' THEN '/web/www.*/de/' WHEN 'es1' THEN '*' WHEN 'es2' THEN '!*5*' WHEN 'host2' THEN '!/en/*[13579].ts' WHEN 'open1' THEN '!index.tsx'
    WHEN 'host1' THEN CASE rest WHEN 0 THEN '/en/*' WHEN 1 THEN 'fr/' ELSE '/**/1*' END END AS rule FROM hit""",
}
