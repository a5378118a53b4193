"""Sparse rule ensemble for quality scores.

Boosted shallow trees over statistics of the texts propose rules: the path to a node is a conjunction of threshold tests. A logistic
regression with an absolute-value penalty over the rules keeps a few of them, which are compiled to one Spark expression.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table
from .textstats import BLANKS, SYMBOLS, repeated_words

#: Statistics of a text; none of them depends on its language tag, source or id.
STATISTICS = (
    "log_words", "word_length", "symbols", "punctuation", "digits", "upper", "capital_words", "unique_words", "repeats", "top_word",
    "dup_lines", "words_per_line", "short_lines", "symbol_words", "exclaims", "longest_word", "non_ascii",
)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows to fit on at most, those whose hashed ids come first; the rest of the labels is not used."""

    sample: int = 20_000
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    penalty: float = 2e-3
    steps: int = 1_500
    leaf: int = 20
    cut: float = 0.7


def statistics(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text) - sum(map(text.count, BLANKS)), 1)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    counts = Counter(words)
    raw = text.encode("utf-8", "surrogatepass")
    digits = sum(raw.count(b) for b in b"0123456789")
    upper = sum(map(str.isupper, text))
    return (
        float(np.log1p(len(words))), chars / n, sum(map(text.count, SYMBOLS)) / chars, sum(map(text.count, ".,;:!?'\"()")) / chars, digits / chars, upper / chars,
        sum(w[0].isupper() for w in words) / n, len(counts) / n, repeated_words(words) / n, max(counts.values(), default=0) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), n / max(len(lines), 1), sum(len(line) < 40 for line in lines) / max(len(lines), 1), sum(w[-1] in SYMBOLS for w in words) / n,
        text.count("!") / n, float(max(map(len, counts), default=0)), (len(raw) - len(text)) / chars,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the statistics of each row's whole text."""

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], names=[id_col, *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{s} double" for s in STATISTICS)]))


def _tree(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, s: Settings) -> tuple[list, np.ndarray]:
    """Paths of all nodes of one tree, and its step for each row. A test is (statistic, threshold, whether above)."""
    step, paths, queue = np.zeros(len(slope)), [], [((), np.arange(len(slope)))]
    while queue:
        path, rows = queue.pop()
        best = None
        if len(path) < s.depth and len(rows) >= 2 * s.leaf:
            g, h = slope[rows], curve[rows]
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                n, gs, hs = (np.cumsum(np.bincount(b, w, minlength=s.bins))[:-1] for w in (None, g, h))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1)
                gain = np.where((n >= s.leaf) & (len(rows) - n >= s.leaf), gain, -1)[: len(edges[f])]
                if len(gain) and gain.max() > (best[0] if best else g.sum() ** 2 / (h.sum() + 1) + 1e-6):
                    best = (gain.max(), f, int(gain.argmax()))
        if path:
            paths.append(path)
        if best is None:
            step[rows] = -slope[rows].sum() / (curve[rows].sum() + 1)
            continue
        _, f, at = best
        above = bins[rows, f] > at
        queue += [((*path, (f, float(edges[f][at]), False)), rows[~above]), ((*path, (f, float(edges[f][at]), True)), rows[above])]
    return paths, step


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, t, above in rule])


def _simplified(path: tuple) -> tuple:
    """One test per statistic and side, in a fixed order."""
    tight: dict = {}
    for f, t, above in path:
        known = tight.get((f, above))
        tight[f, above] = t if known is None else max(known, t) if above else min(known, t)
    return tuple(sorted((f, t, above) for (f, above), t in tight.items()))


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple  # of (weight, rule)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * holds(r, x) for w, r in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            test = F.lit(True)
            for f, t, above in rule:
                test = test & ((F.col(STATISTICS[f]) > t) if above else (F.col(STATISTICS[f]) <= t))
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on statistics ``x`` and labels ``y``; without labels of both kinds the score is the share of ones, 0.5 without labels."""
    if len(y) < 2 * s.leaf or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, rules = np.zeros(len(y)), {}
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        paths, step = _tree(bins, edges, p - y, p * (1 - p), s)
        z += s.rate * step
        rules.update((_simplified(p), None) for p in paths)
    # of rules that hold for the same rows only the first counts
    held = {}
    for rule in rules:
        on = holds(rule, x)
        if 0 < on.sum() < len(y):
            held.setdefault(on.tobytes(), (rule, on))
    chosen = [rule for rule, _ in held.values()]
    r = np.stack([on for _, on in held.values()], axis=1).astype(np.float32)
    # accelerated proximal gradient; the penalty sets the weights of most rules to zero
    weight = past = np.zeros(r.shape[1])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    rate, turn = 4 / (np.linalg.norm(r, 2) ** 2 / len(y)), 1.0
    point = weight
    for _ in range(s.steps):
        gap = 1 / (1 + np.exp(-(bias + r @ point))) - y
        bias -= float(gap.mean())
        weight = point - rate * (r.T @ gap) / len(y)
        weight = np.sign(weight) * np.maximum(np.abs(weight) - rate * s.penalty, 0)
        later = (1 + np.sqrt(1 + 4 * turn**2)) / 2
        point, past, turn = weight + (turn - 1) / later * (weight - past), weight, later
    return Model(bias, tuple((float(w), rule) for w, rule in zip(weight, chosen, strict=True) if w))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    The model is fitted on labelled rows whose id is not held out (crc32 of the id as text, modulo 4, is 2), at most ``sample`` of them.
    Null ids, null labels and labels without a document are not used; several labels of an id count by their greatest, rows that repeat
    an id by their greatest statistics; repeated rows get equal scores; null and empty texts are scored from zero statistics; texts of any length are
    read whole; an empty table gives no row; further columns are ignored. The statistics are written once; the sample is drawn from the labels alone,
    by a hash of the id, and only its statistics reach the driver.
    """
    rows = materialise(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg(F.max(label_col).alias("label")).where(~held_out(F.col("known")))
    draw = F.crc32(F.concat(F.lit("draw"), F.col("known").cast("string")))
    # a share of the hash's range that holds about ``sample`` ids; so a limit on it takes few rows of each task
    share = settings.sample / max(known.count(), 1)
    drawn = known.where(draw <= int(min(share, 1) * 2**32)).orderBy(draw, "known").limit(settings.sample)
    stats = rows.join(F.broadcast(drawn), rows[id_col] == F.col("known")).groupBy("known").agg(F.max(F.struct(*STATISTICS)).alias("x"), F.max("label").alias("label"))
    data = np.array(stats.orderBy("known").select("x.*", "label").collect(), dtype=float).reshape(-1, len(STATISTICS) + 1)
    model = fit(data[:, :-1], (data[:, -1] > 0).astype(float), settings)
    score = rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), model.column().alias("score"))
    return score.withColumn("predicted", F.when(F.col("score") >= settings.cut, 1).otherwise(0))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
