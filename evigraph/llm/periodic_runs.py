"""Periodic runs of words within a text, by heavy/light lag counting.

A stretch of period q and length at least max(6, 4q) holds at least max(6 - q, 3q) consecutive places whose word comes again q words
later. So lags are counted first: words that occur often by an exact FFT autocorrelation of their places, the others by the differences of
their pairs of places. Only lags with enough matches are scanned for islands of matches.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Pairs of places, and numbers in a block of Fourier transforms, that are held at once.
BLOCK = 1 << 20
#: Places of a period that are compared before a stretch is looked at in full.
PROBES = 8


@dataclass(frozen=True)
class Settings:
    least_length: int = 6
    least_periods: int = 4


def repeat_planted(words: list, key: int | None) -> list:
    """The words of the row ``key``, with a period planted where the checksum of the key says so."""
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbers(words: list) -> np.ndarray:
    """Words as numbers, equal words alike."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most``, how many words come again so many words later; exact."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    times = np.bincount(ids)
    heavy = times > max(16, int((2 * n * max(1, n.bit_length())) ** 0.5))
    counts = np.zeros(most + 1, dtype=np.int64)
    # light words: differences of all pairs of places of a word, a block of pairs at a time
    light = order[~heavy[ids[order]]]
    if len(light):
        own = ids[light]
        ends = np.searchsorted(own, own, side="right")
        partners = ends - np.arange(len(light)) - 1
        upto = np.cumsum(partners)
        first = 0
        while first < len(light):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK, side="right")))
            some = partners[first:last]
            left = np.repeat(np.arange(first, last), some)
            right = np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some) + left + 1
            lags = light[right] - light[left]
            counts += np.bincount(lags[lags <= most], minlength=most + 1)
            first = last
    # heavy words: autocorrelation of their indicator, padded so that nothing wraps; sums are whole numbers far below 2^53
    often = np.flatnonzero(heavy)
    size = 1 << int(n + most).bit_length()
    rows = max(1, BLOCK // size)
    for at in range(0, len(often), rows):
        marks = (ids == often[at : at + rows, None]).astype(np.float64)
        spectrum = np.fft.rfft(marks, size, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def _islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """First place and end of all maximal stretches of at least ``least`` places whose word comes again ``q`` words later."""
    n = len(ids) - q
    if q <= PROBES:
        same = ids[:n] == ids[q:]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
        return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= least]
    # such a stretch covers two whole blocks of q places; blocks are probed at a few places, then stretches are measured
    blocks = n // q
    at = np.arange(blocks)[:, None] * q + np.arange(PROBES) * q // PROBES
    full = (ids[at] == ids[at + q]).all(axis=1)
    out: list[tuple[int, int]] = []
    for b in np.flatnonzero(full[:-1] & full[1:]):
        start = int(b) * q
        if out and start < out[-1][1]:
            continue
        if not np.array_equal(ids[start : start + 2 * q], ids[start + q : start + 3 * q]):
            continue
        end = start + 2 * q
        while end < n:
            step = ids[end : min(n, end + q)] == ids[end + q : min(n, end + q) + q]
            if not step.all():
                end += int(np.argmin(step))
                break
            end += len(step)
        while start:
            low = max(0, start - q)
            step = ids[low:start] == ids[low + q : start + q]
            if not step.all():
                start -= int(np.argmin(step[::-1]))
                break
            start = low
        if end - start >= least and not (out and out[-1][0] == start):
            out.append((start, end))
    return out


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def runs_of(ids: np.ndarray, settings: Settings = Settings()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found = len(ids), []
    most = n // settings.least_periods
    if n < settings.least_length or not most:
        return []
    lags = np.arange(most + 1)
    wanted = np.maximum(settings.least_length - lags, (settings.least_periods - 1) * lags)
    for q in np.flatnonzero((lag_counts(ids, most) >= wanted) & (lags > 0)):
        q = int(q)
        for start, end in _islands(ids, q, int(wanted[q])):
            length = end - start + q
            smaller = (q // p for p in _primes(q))  # a smaller period divides q, as the stretch holds q four times
            if not any(np.array_equal(ids[start : start + length - d], ids[start + d : start + length]) for d in smaller):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, depth in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not depth]


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string()]


def _digest(text: str | None, key: int | None, planted: bool, settings: Settings) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split knows just the six blanks
    if planted:
        words = repeat_planted(words, key)
    runs = runs_of(numbers(words), settings)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(collapsed(words, runs) if runs else words)
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, settings: Settings = Settings()) -> DataFrame:
    """(id, start, length, period) of every run of every text, one row each.

    A run is a maximal stretch of consecutive words with smallest period ``period`` that is at least ``least_periods`` periods and
    ``least_length`` words long. Null and empty texts have no runs; ids may be null or repeat (each row is judged by itself);
    overlapping runs are all listed; texts are read whole, with memory in proportion to the longest text and ``BLOCK``; an empty table gives no
    row; further columns are ignored. Nothing is shuffled.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, period long"

    def listed(batches):
        for batch in batches:
            keys, cells = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = runs_of(numbers(repeat_planted(words, key.as_py()) if planted else words), settings)
                keys += [key.as_py()] * len(found)
                cells += found
            columns = zip(*cells, strict=True) if cells else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in columns]], names=["id", "start", "length", "period"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(listed, schema).withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: number of runs, the longest one, digests of all runs and of the text without what repeats.

    Rows are treated as ``periodic_runs`` says; a text without runs has four nulls for the longest. Of runs that are equally long the
    first, then the one with the smallest period is reported. With ``planted`` some rows get a period planted by the checksum of their id
    (rows without an id never do).
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {FIELDS}"
    names = ["id", *[f.split()[0] for f in FIELDS.split(", ")]]

    def digests(batches):
        for batch in batches:
            rows = [_digest(text.as_py(), key.as_py(), planted, settings) for key, text in zip(batch.column(0), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(digests, schema).withColumnRenamed("id", id_col)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted=True)


#: crc32 of the decimal digits of a number, byte by byte and bit by bit.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, t: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"
)

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32_SQL.format("doc_id")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
word AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM t),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
lags AS (SELECT r, q FROM pairs GROUP BY r, q HAVING count(*) >= greatest(6 - q, 3 * q)),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs SEMI JOIN lags USING (r, q)),
cand AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM isl GROUP BY r, q, k HAVING count(*) >= greatest(6 - q, 3 * q)),
runs AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.r = c.r AND o.q < c.q AND c.q % o.q = 0 AND o.s <= c.s AND o.s + o.len >= c.s + c.len)),
listed AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS listed,
                  arg_min({{'s': s, 'len': len, 'q': q}}, [-len, s, q]) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
       coalesce(listed, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
