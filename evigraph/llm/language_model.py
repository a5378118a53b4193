"""Hashed maximum-entropy language model with a class-factored softmax.

The most frequent words stand in classes of equal size, all other words in one open class. The class of the next word, and the word within
its class, are predicted by two softmax layers whose scores are sums of hashed feature rows: the word before, the two words before, and the one before a skip.
Rows start at zero over the exact unigram frequencies, so an untrained model is the class-factored unigram. Within the open class a word has
its add-one frequency there, so probabilities of all known words and one unknown word add up to one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialise, table

#: The end of a text as a word; no word is empty.
END = b""
LN10 = float(np.log(10.0))


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; none grows with the corpus.

    ``width`` classes (class 0 is open) of ``width`` words each are the head; ``rows`` feature rows in each layer, 2^16 at most; counts of the ``listed`` most
    frequent words, of at most ``longest`` bytes, are sent to all tasks, those of other words are joined. Training goes over the corpus once, in
    ``rounds`` parts; after each the tasks' models are averaged. ``rate`` is the step of the row-wise adaptive gradient.
    """

    width: int = 64
    rows: int = 1 << 14
    listed: int = 1 << 17
    longest: int = 64
    rounds: int = 2
    rate: float = 0.25
    batch: int = 8192
    held_out_mod: int = 7
    held_out_is: int = 2
    #: A training task goes over so many tokens at least.
    task_tokens: int = 1 << 21
    #: Rows that are averaged together.
    block: int = 64


FEATURES = 3
#: Feature rows stay within this, biases above its negative.
LIMIT = 18.0
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; both bytes methods know ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Lexicon:
    """The listed words with their counts, the head's ids among them, and sums over all training tokens."""

    def __init__(self, listed: list[tuple[bytes, int]], total: int, distinct: int, head: int):
        self.number = {w: i for i, (w, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], dtype=np.float64)
        self.total, self.distinct, self.head = total, distinct, min(head, len(listed))
        inside = self.counts[: self.head].sum()
        self.open_total, self.open_distinct = total - int(inside), distinct - self.head


class Model:
    """Feature rows of both layers and their fixed unigram biases. Head word i (from 1) is word (i - 1) % width of class 1 + (i - 1) // width."""

    def __init__(self, settings: Settings, lexicon: Lexicon, rows: np.ndarray | None = None):
        s = self.s = settings
        head = np.zeros((s.width - 1) * s.width)
        head[: lexicon.head] = lexicon.counts[: lexicon.head]
        head = head.reshape(s.width - 1, s.width)
        sums = np.concatenate(([lexicon.open_total + 1], head.sum(axis=1)))  # the one is the unknown word's
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(sums / sums.sum()).astype(np.float32)
            inner = np.log(head / np.maximum(head.sum(axis=1, keepdims=True), 1))
        self.class_bias = np.maximum(self.class_bias, np.float32(-LIMIT))
        self.word_bias = np.vstack([np.zeros((1, s.width)), np.maximum(inner, -LIMIT)]).astype(np.float32)
        # places of no word never get mass
        self.word_bias[1:][head == 0] = -np.inf
        self.class_bias[1:][head.sum(axis=1) == 0] = -np.inf
        self.rows = np.zeros((2, s.rows, s.width), dtype=np.float32) if rows is None else rows
        self.seen = np.ones((2, s.rows), dtype=np.float32)
        self.ones = np.ones(s.width, dtype=np.float32)
        self.buffers = [np.empty((s.batch, s.width), dtype=np.float32) for _ in range(4)]

    def contexts(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Hashes of the features before each token: one word, two words, and a skip of one. ``begins`` numbers tokens within their text."""
        before = []
        for k in (1, 2):
            past = np.full(len(ids), 1 << 17, dtype=np.uint64)  # before a text
            past[k:] = np.where(begins[k:] >= k, ids[:-k], past[k:])
            before.append(past)
        one, two = before
        out = np.stack([one * _PRIMES[0] + _PRIMES[4], (one + two * _PRIMES[1]) * _PRIMES[2] + np.uint64(1), two * _PRIMES[3] + np.uint64(2)])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def _layer(self, layer: int, keys: np.ndarray, bias: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the features, and the exponentials of the scores with their sums; limits on rows and biases keep these within single precision.

        Arrays of a batch are taken from buffers, as new ones would cost more than what is done with them.
        """
        at = (keys % np.uint64(self.s.rows)).astype(np.uint16)
        scores, part = self.buffers[0][: keys.shape[1]], self.buffers[1][: keys.shape[1]]
        self.rows[layer].take(at[0], axis=0, out=scores, mode="clip")
        for f in range(1, FEATURES):
            scores += self.rows[layer].take(at[f], axis=0, out=part, mode="clip")
        scores += bias if own is None else bias.take(own, axis=0, out=part, mode="clip")
        np.exp(scores, out=scores)
        return at, scores, scores @ self.ones

    def _summed(self, grad: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Sums of the groups of rows that begin at ``firsts``: the first few rows of all groups together, the rest of large groups one by one."""
        sizes = np.diff(np.append(firsts, len(grad)))
        total = grad.take(firsts, axis=0, out=self.buffers[2][: len(firsts)], mode="clip")
        more, j = np.flatnonzero(sizes > 1), 1
        while len(more) and j < 8:
            total[more] += grad.take(firsts[more] + j, axis=0, out=self.buffers[3][: len(more)], mode="clip")
            j += 1
            more = more[sizes[more] > j]
        for i in more.tolist():
            total[i] += grad[firsts[i] + j : firsts[i] + sizes[i]].sum(axis=0)
        return total

    def _learn(self, layer: int, at: np.ndarray, mass: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> None:
        """One step of the row-wise adaptive gradient for a batch."""
        mass /= sums[:, None]
        mass[np.arange(len(wanted)), wanted] -= 1
        rows_, seen = self.rows[layer], self.seen[layer]
        for f in range(FEATURES):
            order = np.argsort(at[f], kind="stable")  # a radix sort for 16 bits
            sorted_ = at[f][order]
            firsts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            rows = sorted_[firsts]
            total = self._summed(mass.take(order, axis=0, out=self.buffers[1][: len(order)], mode="clip"), firsts)
            seen[rows] += np.einsum("ij,ij->i", total, total)
            total *= (self.s.rate / np.sqrt(seen[rows]))[:, None]
            left = rows_.take(rows, axis=0, out=self.buffers[3][: len(rows)], mode="clip")
            left -= total
            rows_[rows] = left

    def go_over(self, ids: np.ndarray, begins: np.ndarray, learn: bool = False) -> np.ndarray:
        """Natural log-probability of each token given those before it in its text (of the open class as a whole for id 0)."""
        s, out = self.s, np.zeros(len(ids))
        if learn:
            np.clip(self.rows, -LIMIT / 2, LIMIT / 2, out=self.rows)
        for a in range(0, len(ids), s.batch):
            b, back = min(len(ids), a + s.batch), min(a, 2)
            k = self.contexts(ids[a - back : b].astype(np.uint64), begins[a - back : b])[:, back:]
            own = np.where(ids[a:b] > 0, 1 + (ids[a:b] - 1) // s.width, 0)
            at, mass, sums = self._layer(0, k, self.class_bias)
            out[a:b] = np.log(mass[np.arange(len(own)), own] / sums)
            if learn:
                self._learn(0, at, mass, sums, own)
            inside = np.flatnonzero(own)
            if len(inside):
                own, word = own[inside], (ids[a:b][inside] - 1) % s.width
                k = k[:, inside] + own.astype(np.uint64) * _PRIMES[2]
                k ^= k >> np.uint64(31)
                at, mass, sums = self._layer(1, k, self.word_bias, own)
                out[a + inside] += np.log(mass[np.arange(len(own)), word] / sums)
                if learn:
                    self._learn(1, at, mass, sums, word)
        return out


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts of a batch, each id's number within its text, and where texts begin."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    ids = raw.view("<u2").astype(np.int64)
    starts = (offsets - offsets[0]) // 2
    return ids, np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts)), starts


def word_counts(texts: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(word, n) over the column ``text``, ends of texts included; tasks count ahead, ``most`` words at a time."""

    def counted(batches):
        held: dict[bytes, int] = {}
        get = held.get

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                for word in words_of(text.as_py()):
                    held[word] = get(word, 0) + 1
                held[END] = get(END, 0) + 1
                if len(held) > most:
                    yield given()
        if held:
            yield given()

    return texts.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame, settings: Settings) -> Lexicon:
    """Of a table of counts what every task needs; its size is bounded by ``listed`` words of ``longest`` bytes."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
    first = F.when(F.col("word") == F.lit(END), 0).otherwise(1)
    top = counts.where(F.octet_length("word") <= settings.longest).orderBy(first, F.desc("n"), "word").limit(settings.listed)
    listed = [(bytes(r.word), r.n) for r in top.collect()]
    if not listed or listed[0][0] != END:  # nothing to learn from
        listed = []
    return Lexicon(listed, sums.n or 0, sums.v, (settings.width - 1) * settings.width)


def encode(docs: DataFrame, lexicon: Lexicon, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Texts as ids, written once: row, id, held_out, part, n_tokens, n_listed, n_open, log_listed, log_open, ids, rare.

    ``ids`` are 16-bit head ids, 0 for the open class; ``log_listed`` sums log10 of count + 1 over listed tokens, ``log_open`` over those outside
    the head; ``rare`` has the words that are not listed, with their number in the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = f"id {kind}, held_out boolean, part int, n_tokens long, n_listed long, n_open long, log_listed double, log_open double, ids binary, rare array<struct<word: binary, n: long>>"
    struct = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    types = [pa.bool_(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.binary(), struct]
    names = [f.split()[0] for f in schema.split(", ")[:9]] + ["rare"]
    mod, chosen, rounds = settings.held_out_mod, settings.held_out_is, settings.rounds

    def encoded(batches):
        lex = shared.value
        number, logs, missing = lex.number.get, np.log10(lex.counts + 1), len(lex.counts)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                words.append(END)
                at = np.fromiter((number(w, missing) for w in words), dtype=np.int64, count=len(words))
                rare: dict[bytes, int] = {}
                for i in np.flatnonzero(at == missing).tolist():
                    rare[words[i]] = rare.get(words[i], 0) + 1
                listed = at[at < missing]
                outside = listed[listed >= lex.head]
                ids = np.where(at < lex.head, at + 1, 0).astype("<u2")
                crc = zlib.crc32(str(key).encode()) if key is not None else 0
                rows.append((key is not None and crc % mod == chosen, crc // mod % rounds, len(words), len(listed), int((ids == 0).sum()), float(logs[listed].sum()), float(logs[outside].sum()), ids.tobytes(), [{"word": w, "n": n} for w, n in rare.items()]))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encoded, schema)
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "lm-encoded")


def _average(parts: DataFrame, settings: Settings, tasks: int) -> np.ndarray:
    """Mean of the tasks' rows, by their numbers of tokens; summed block by block in two steps, so that no task holds more than about the root of the
    number of tasks. Only the mean, whose size is fixed, comes to the driver."""
    across = max(1, int(tasks**0.5))

    def added(rows: pa.Table) -> pa.Table:
        weights = rows.column("weight").to_numpy()
        total = sum(w * np.frombuffer(b.as_py(), dtype=np.float32).astype(np.float64) for w, b in zip(weights, rows.column("rows"), strict=True))
        mean = (total / weights.sum()).astype(np.float32)
        return pa.table({"block": rows.column("block")[:1], "task": rows.column("task")[:1], "weight": pa.array([float(weights.sum())]), "rows": pa.array([mean.tobytes()], pa.binary())})

    schema = "block int, task int, weight double, rows binary"
    some = parts.withColumn("task", F.col("task") % across).groupBy("block", "task").applyInArrow(added, schema)
    found = some.groupBy("block").applyInArrow(added, schema).select("block", "rows").collect()
    out = np.zeros((2 * settings.rows // settings.block, settings.block, settings.width), dtype=np.float32)
    for r in found:
        out[r.block] = np.frombuffer(r.rows, dtype=np.float32).reshape(out.shape[1:])
    return out.reshape(2, settings.rows, -1)


def train(encoded: DataFrame, lexicon: Lexicon, settings: Settings) -> Model:
    """The model after one pass over all rows that are not held out, in ``rounds`` parts.

    In each part every task goes over its own rows by batches, from the model that all share; then the models are averaged.
    """
    sc = encoded.sparkSession.sparkContext
    words, model = sc.broadcast(lexicon), Model(settings, lexicon)
    for part in range(settings.rounds):
        shared = sc.broadcast(model.rows)

        def learned(batches, shared=shared):
            own, seen, task = None, 0, 0
            for batch in batches:
                own = own or Model(settings, words.value, shared.value.copy())
                ids, begins, _ = _laid(batch.column(0))
                own.go_over(ids, begins, learn=True)
                seen += len(ids)
                task = batch.column(1)[0].as_py() if len(ids) else task
            if seen:
                blocks = own.rows.reshape(-1, settings.block, own.rows.shape[2])
                n = len(blocks)
                for a in range(0, n, 64):
                    some = [b.tobytes() for b in blocks[a : a + 64]]
                    yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(some)), pa.int32()), pa.array([task] * len(some), pa.int32()), pa.array([float(seen)] * len(some)), pa.array(some, pa.binary())], names=["block", "task", "weight", "rows"])

        # a task sends all of its model, so it gets enough to learn from
        tasks = -(-lexicon.total // (settings.rounds * settings.task_tokens))
        chosen = encoded.where(f"NOT held_out AND part = {part}").coalesce(max(1, tasks)).select("ids", F.spark_partition_id().alias("task"))
        parts = materialise(chosen.mapInArrow(learned, "block int, task int, weight double, rows binary"), "lm-gradients")
        tasks = parts.where("block = 0").count()
        if tasks:
            model = Model(settings, lexicon, _average(parts, settings, tasks))
        discard(parts)
        shared.unpersist()
    return model


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model).

    Both scores are log10 probabilities of the whole text and its end. Null and empty texts are the end alone; rows without an id are never held
    out and are learned from; repeated rows count and are scored each; texts may be of any length; an empty table gives no row; without training
    rows every token is unknown; further columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    inside = F.coalesce(F.crc32(F.col("id").cast("string")) % settings.held_out_mod != settings.held_out_is, F.lit(True))
    counts = materialise(word_counts(named.where(inside)), "lm-counts")
    lexicon = lexicon_of(counts, settings)
    rows = encode(docs, lexicon, settings, id_col, text_col)
    model = train(rows, lexicon, settings)

    # words that are not listed: their counts come by a join, then one sum for each row
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("log_rare"))

    sc = docs.sparkSession.sparkContext
    words, shared = sc.broadcast(lexicon), sc.broadcast(model.rows)

    def scored(batches):
        own = None
        for batch in batches:
            own = own or Model(settings, words.value, shared.value)
            ids, begins, starts = _laid(batch.column(batch.schema.get_field_index("ids")))
            upto = np.concatenate(([0.0], np.cumsum(own.go_over(ids, begins))))
            head = (upto[starts[1:]] - upto[starts[:-1]]) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(head)], names=[*batch.schema.names[:-1], "log_head"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["row", "id", "held_out", "n_tokens", "n_listed", "n_open", "log_listed", "log_open"]
    heads = rows.select(*fields, "ids").mapInArrow(scored, f"row long, id {kind}, held_out boolean, n_tokens long, n_listed long, n_open long, log_listed double, log_open double, log_head double")
    all_ = heads.join(met, "row", "left")
    extra = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_listed") + extra - F.col("n_tokens") * float(np.log10(lexicon.total + lexicon.distinct + 1))
    score = F.col("log_head") + F.col("log_open") + extra - F.col("n_open") * float(np.log10(lexicon.open_total + lexicon.open_distinct + 1))
    return all_.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_listed") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"),
    )


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
