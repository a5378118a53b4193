"""Findings as they arrive: occurrences and news by fingerprint, kept as state across batches and restarts, and dropped by timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADDED = "kind string, occurrence long, is_new boolean"
#: Fingerprints are kept in so many buckets, each with one state and one timer: a call for each fingerprint costs more than what it does.
BUCKETS = 4096


class Occurrences(StatefulProcessor):
    """State of a bucket of fingerprints: of each how often it was found, how many the baseline knew, when it was last seen. Its timer is that of the one seen longest ago."""

    def __init__(self, columns: list[str], kind: str, ttl_ms: int):
        self.columns, self.kind, self.ttl_ms = columns, kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", f"fp array<{self.kind}>, n array<long>, known array<long>, last array<long>")

    def _held(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        fps, *numbers = self.state.get() if self.state.exists() else ([], [], [], [])
        return list(fps), *[np.array(x, dtype="int64") for x in numbers]

    def _keep(self, fps: list, n: np.ndarray, known: np.ndarray, last: np.ndarray, before: int | None) -> None:
        after = int(last.min()) if len(last) else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            if after is not None:
                self.handle.registerTimer(after + self.ttl_ms)
        if fps:
            self.state.update((fps, n.tolist(), known.tolist(), last.tolist()))
        else:
            self.state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        initialState.columns = ["fp", "known", "since", "bucket"]
        fps, n, known, last = self._held()
        before = int(last.min()) if fps else None
        slots, fps = _slots(fps, initialState["fp"])
        n, known, last = _wider(len(fps), n, known, last)
        np.add.at(known, slots, initialState["known"].to_numpy("int64"))
        np.maximum.at(last, slots, initialState["since"].to_numpy("int64"))
        self._keep(fps, n, known, last, before)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fps, n, known, last = self._held()
        before = int(last.min()) if fps else None
        for some in rows:
            # Spark may lose the names of computed columns on the way here, never their order
            some.columns = [*self.columns, "_ms", "_bucket"]
            slots, fps = _slots(fps, some["fp"])
            n, known, last = _wider(len(fps), n, known, last)
            number = n[slots] + some.groupby(slots).cumcount().to_numpy()
            np.add.at(n, slots, 1)
            np.maximum.at(last, slots, some["_ms"].to_numpy("int64"))
            yield some[self.columns].assign(kind="found", occurrence=number, is_new=number >= known[slots], _last=None)
        self._keep(fps, n, known, last, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fps, n, known, last = self._held()
        gone = last + self.ttl_ms <= timerValues.getCurrentWatermarkInMs()
        names = [fp for fp, out in zip(fps, gone, strict=True) if out]
        rows = {name: [None] * len(names) for name in self.columns} | {"fp": names}
        # the timer that brought us here is spent
        self._keep([fp for fp, out in zip(fps, gone, strict=True) if not out], n[~gone], known[~gone], last[~gone], None)
        yield pd.DataFrame(rows).assign(kind="gone", occurrence=n[gone], is_new=None, _last=last[gone])

    def close(self) -> None:
        pass


def _slots(fps: list, found: pd.Series) -> tuple[np.ndarray, list]:
    """Places of the fingerprints found in the list of those known, and the list with new ones added."""
    place = {fp: i for i, fp in enumerate(fps)}
    slots = [place.setdefault(fp, len(place)) for fp in found.astype(object).where(found.notna(), None)]
    return np.array(slots, dtype="int64"), list(place)


def _wider(size: int, n: np.ndarray, known: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    more = size - len(n)
    return [np.append(x, np.full(more, start, dtype="int64")) for x, start in ((n, 0), (known, 0), (last, np.iinfo("int64").min))]


def incremental(findings: DataFrame, baseline: DataFrame, ts: str = "ts", late: str = "1 hour", ttl_days: float = 30.0) -> DataFrame:
    """The findings of a stream (fp, ts and more) with kind, occurrence and is_new, and a row ``gone`` for each fingerprint not seen for ``ttl_days``.

    Occurrences of a fingerprint are numbered from 0 as they arrive, over all batches; those beyond the count of the baseline (fp, known, since) are new. Among equal
    fingerprints of one batch the order is that of arrival, so which row bears which number may differ between runs, never the numbers or how many are new.
    A row ``gone`` holds the fingerprint, the time it was last seen and how often it was found; other columns are NULL. Its state is dropped, the baseline's count as well, so
    it is new if it comes back. Findings later than ``late`` behind the newest are left out, and NULL fingerprints share one state. The state holds three numbers for a
    fingerprint, by ``BUCKETS`` buckets whose fingerprints are read and written together; rows are streamed through a task, never held. A checkpoint keeps its number of buckets. The session must use ``ROCKSDB`` as its state store.
    """
    columns = findings.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema] + [ADDED, "_last long"])
    # times travel as numbers, as pandas shows timestamps in the session's time zone
    since = F.unix_millis(F.col("since").cast("timestamp"))
    bucket = F.pmod(F.xxhash64("fp"), F.lit(BUCKETS)).alias("_bucket")
    known = baseline.select("fp", F.col("known").cast("long").alias("known"), since.alias("_since"), bucket)
    timed = findings.withWatermark(ts, late).withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("_bucket", bucket)
    state = Occurrences(columns, findings.schema["fp"].dataType.simpleString(), int(ttl_days * 86_400_000))
    out = timed.groupBy("_bucket").transformWithStateInPandas(state, schema, "Append", "EventTime", initialState=known.groupBy("_bucket"))
    return out.withColumn(ts, F.coalesce(ts, F.timestamp_millis("_last"))).drop("_last")


def run_incremental(marked: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and append it to ``path``; exactly once across restarts."""
    spark = marked.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        query = marked.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.start(path).awaitTermination()
    finally:
        spark.conf.set(key, before)
