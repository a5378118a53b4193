"""Near-duplicate documents by BagMinHash signatures of word shingles, banding, and exact verification.

A shingle of weight w is the set of all points of Poisson processes on the weights up to w. Weights are cut at 0, 1, 2, 4, 8, ...;
the process of a cell depends on the shingle and the cell alone, and a point beyond w is passed over, so heavy shingles cost
the logarithm of their weight. Each component of the signature keeps the earliest point that fell to it; two documents agree
in it with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import few_rows, materialise, spare_names, table
from .shingles import GOLDEN, blocks, mix, window_hashes, word_hashes, words_of


#: Up to so many rows' ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` components: a pair of similarity 0.8 meets in a band with probability 0.9995, one of 0.3 with 0.007."""

    width: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 7
    block: int = 1_000
    block_chars: int = 8_000_000


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    return window_hashes(word_hashes(words), min(width, len(words)) or 1, 5)


def signatures(shingles: np.ndarray, docs: np.ndarray, count: int, size: int) -> np.ndarray:
    """BagMinHash signatures (count x size) of documents 0..count-1, given one entry for each occurrence of a shingle."""
    if size > 1024:
        raise ValueError("a component is drawn by eleven bits, so there may be 1024 at most")
    _, first, weight = np.unique(mix(shingles + mix(docs.astype(np.uint64) * GOLDEN)), return_index=True, return_counts=True)
    shingle, doc = shingles[first], docs[first]
    total = np.bincount(docs, minlength=count).astype(float)
    out = np.full(count * size, np.inf)
    reach = np.where(total > 0, (np.log(size) + 3) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        out.reshape(count, size)[todo] = np.inf
        for cell in range(64):
            low = 0 if cell == 0 else 1 << (cell - 1)
            span = 1 if cell == 0 else low
            pick = todo[doc] & (weight > low)
            if not pick.any():
                if cell:
                    break
                continue
            state, owner, top = mix(shingle[pick] + np.uint64(cell * int(GOLDEN) % 2**64)), doc[pick], weight[pick]
            last, at = reach[owner], np.zeros(len(owner))
            while len(state):
                state = state + GOLDEN
                z = mix(state)
                at = at - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * span)
                on = at <= last
                state, owner, top, last, at, z = state[on], owner[on], top[on], last[on], at[on], z[on]
                part = ((z & np.uint64(0x7FF)) * np.uint64(size)) >> np.uint64(11)
                place = owner * size + part.astype(np.int64)
                if cell > 1:
                    level = low + ((mix(z) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * span)
                    inside = level < top
                    np.minimum.at(out, place[inside], at[inside])
                else:
                    np.minimum.at(out, place, at)
        todo = np.isinf(out.reshape(count, size)).any(axis=1) & (total > 0)
        reach = reach * 2
    return out.reshape(count, size)


def band_hashes(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sigs[:, : bands * rows].copy().view(np.uint64).reshape(len(sigs), bands, rows)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (len(sigs), 1))
    for r in range(rows):
        out = mix(out ^ bits[:, :, r]) + GOLDEN
    return out.view(np.int64)


def sketches(sigs: np.ndarray) -> np.ndarray:
    """One bit of each component, packed into 64-bit words. Bits of equal components are equal, others by chance."""
    bits = (mix(sigs.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def most_differing(settings: Settings) -> int:
    """Bits in which the sketches of a pair at the threshold may differ: five standard deviations above the mean."""
    size, miss = settings.bands * settings.rows, (1 - settings.threshold) / 2
    return int(size * miss + 5 * math.sqrt(size * miss * (1 - miss)))


def _sign(docs: DataFrame, settings: Settings) -> DataFrame:
    """(id, t, k1, k2, n_words, bands, sketch): a 128-bit key of the word sequence; band hashes and sketch are empty without words."""

    def run(batches):
        size = settings.bands * settings.rows
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            for start, texts_words in blocks(texts):
                seen: dict = {}
                place = [seen.setdefault(hashlib.blake2b(b" ".join(w), digest_size=16).digest(), len(seen)) for w in texts_words]
                which = {p: i for i, p in reversed(list(enumerate(place)))}
                parts = [shingle_hashes(texts_words[which[p]], settings.width) for p in range(len(seen))]
                owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                sigs = signatures(np.concatenate(parts), owner, len(parts), size)
                found, sketch = band_hashes(sigs, settings.bands, settings.rows), sketches(sigs)
                lists = [found[p] if len(parts[p]) else [] for p in range(len(parts))]
                keys = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)[place]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(place)),
                        batch.column("t").slice(start, len(place)),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array([len(w) for w in texts_words], pa.int64()),
                        pa.array([lists[p] for p in place], pa.list_(pa.int64())),
                        pa.array([sketch[p] for p in place], pa.list_(pa.int64())),
                    ],
                    names=["id", "t", "k1", "k2", "n_words", "bands", "sketch"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, t long, k1 long, k2 long, n_words long, bands array<long>, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles overlap by the threshold."""
    with_texts = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        held: OrderedDict = OrderedDict()

        def bag(key, text):
            if key not in held:
                words = words_of(text)
                width = min(settings.width, len(words))
                held[key] = Counter(zip(*(words[i:] for i in range(width)), strict=False))
                if len(held) > 32:
                    held.popitem(last=False)
            return held[key]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                x, y = bag(a.as_py(), text_a.as_py()), bag(b.as_py(), text_b.as_py())
                small, large = (x, y) if len(x) < len(y) else (y, x)
                both = sum(min(n, large[s]) for s, n in small.items() if s in large)
                keep.append(both >= settings.threshold * (x.total() + y.total() - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, class_id) for every row: classes are the components of all pairs that share a band and overlap by the threshold.

    Equal word sequences are one class at once. Of the different texts in a band bucket all are compared with the one that has the
    most copies; sizes, and sketches that differ by five standard deviations more than those of a pair at the threshold (less than one
    such pair in 10^6), rule pairs out before texts are read. Most buckets are one component then. What is left is joined exactly, block
    by block, so no link is lost and pairs are never written out.

    Rows are told apart by numbers of their own, so rows that repeat an id, or have none, are texts like others. The class id is the least id
    of the class, null if no row of it has an id. Rows without a word (null or empty texts) are classes of their own; texts may be of any
    length; an empty table gives no row; further columns are ignored.
    """
    return _classes(docs, id_col, text_col, settings).select(F.col("id").alias(id_col), "class_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """id, t (hash of the text), node (number of the row), label (one for each class) and class_id of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    signed = materialise(_sign(rows, settings).withColumn("node", F.monotonically_increasing_id()), "signatures")  # once written, numbers stay
    full = signed.where("n_words > 0")
    firsts = materialise(full.groupBy("k1", "k2").agg(F.min("node").alias("node"), F.min("id").alias("low"), F.count("*").alias("copies")), "first-copies")
    distinct = signed.join(firsts.select("node", "copies"), "node")
    words = -(-settings.bands * settings.rows // 64)
    size = F.greatest(F.col("n_words") - (settings.width - 1), F.lit(1))  # shingles
    what = {"rarity": -F.col("copies"), "size": size, **{f"s{i}": F.get("sketch", F.lit(i)) for i in range(words)}}
    buckets = distinct.select(F.col("node").alias("id"), F.named_struct(*[x for n, c in what.items() for x in (F.lit(n), c)]).alias("what"), F.explode("bands").alias("bucket"))
    met = buckets.join(_shared(buckets), "bucket")
    # texts whose sizes are too far apart cannot overlap enough: a bucket falls into classes of size, each text in two of them
    step = F.floor(F.log(F.col("what.size").cast("double")) / F.lit(-math.log(settings.threshold)) + 1e-9)
    met = met.select("id", "what", F.explode(F.array(step, step + 1)).alias("class"), "bucket").select("id", "what", F.xxhash64("bucket", "class").alias("bucket"))
    members = materialise(met.join(_shared(met), "bucket"), "bucket-members")
    linked = None if members.isEmpty() else _link(members, _texts(members, signed, rows), settings)
    named = firsts.withColumn("label", F.col("node"))
    if linked is not None:
        named = firsts.join(linked.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("low").alias("class_id"))
    classes = full.select("id", "t", "node", "k1", "k2").join(named.select("k1", "k2", "label").join(least, "label"), ["k1", "k2"])
    alone = signed.where("n_words = 0").select("id", "t", "node", F.col("node").alias("label"), F.col("id").alias("class_id"))
    return classes.select(alone.columns).unionByName(alone)


def _texts(members: DataFrame, signed: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, text) of the members; ids are the numbers of their rows."""
    wanted = signed.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", F.col("id").alias("own"), F.col("t").alias("hash"))
    wanted = few_rows(materialise(wanted, "bucket-ids"), BROADCAST_IDS)
    found = rows.join(wanted, F.expr("id <=> own AND t = hash")).select(F.col("node").alias("id"), "text")
    return materialise(found.dropDuplicates(["id"]), "bucket-texts")


def _shared(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")


def _link(members: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame | None:
    """(id, label) of the members that are linked to another; None if none is."""
    words = sum(n[0] == "s" and n != "size" for n in members.schema["what"].dataType.names)
    # all members of a bucket against the one with the most copies
    pivot = members.groupBy("bucket").agg(F.min(F.struct("what.rarity", "id", "what")).alias("p")).select("bucket", F.col("p.id").alias("pivot"), F.col("p.what").alias("p_what"))
    room = F.least("what.size", "p_what.size") >= settings.threshold * F.greatest("what.size", "p_what.size") - 1e-6
    unlike = sum((F.bit_count(F.col(f"what.s{i}").bitwiseXOR(F.col(f"p_what.s{i}"))) for i in range(words)), F.lit(0))
    near = members.join(pivot, "bucket").where("id != pivot").where(room).where(unlike <= most_differing(settings))
    pairs = materialise(near.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
    edges = materialise(_verified(pairs, texts, settings), "similar-pairs")
    labels = None if edges.isEmpty() else materialise(components(edges), "labels")
    # a bucket of two is settled; others stay open while they hold several components
    named = members.select("bucket", "id")
    named = named.withColumn("label", F.col("id")) if labels is None else named.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    left = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.min("id").alias("hub")).where("lo < hi AND n > 2").select("bucket", "hub")
    open_ = materialise(members.select("bucket", "id").join(left, "bucket").select("id", "hub").distinct(), "open-members")
    if open_.isEmpty():
        return labels
    more = materialise(_all_pairs(open_, texts, settings), "similar-pairs")
    edges = edges.unionByName(more)
    return None if edges.isEmpty() else materialise(components(edges), "labels")


def _all_pairs(open_: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that connect all pairs of the threshold among members of open buckets (id, hub).

    Buckets that share members form a group. A group falls into blocks of about ``block`` texts and ``block_chars`` characters; each pair of blocks is one unit of work
    with bounded memory, which joins its texts exactly by an inverted index of shingles and returns a spanning forest of the links.
    """
    groups = components(open_.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    chars = groups.join(texts.select("id", F.length("text").alias("chars")), "id")
    sizes = chars.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / settings.block, F.sum("chars") / settings.block_chars)).alias("parts"))
    placed = groups.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = spread.select("id", "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    work = spread.join(texts, "id").select("id", "text", "label", "i", "j")

    def run(key, data):
        ids = data.column("id").to_pylist()
        units = []
        for text in data.column("text").to_pylist():
            words = words_of(text)
            hashes = np.sort(shingle_hashes(words, settings.width))
            # the n-th occurrence of a shingle is an element of its own, so overlaps of multisets are those of sets
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, dtype=bool)
            starts = np.flatnonzero(first)
            nth = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
            units.append(mix(hashes + nth.astype(np.uint64) * GOLDEN))
        count = np.array([len(u) for u in units], dtype=np.int64)
        flat, owner = np.concatenate(units), np.repeat(np.arange(len(units)), count)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        for n, u in enumerate(units):
            lo, hi = np.searchsorted(flat, u, "left"), np.searchsorted(flat, u, "right")
            spans = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(owner[at], minlength=len(ids))
            alike = np.flatnonzero(both >= settings.threshold * (count + count[n] - both) - 1e-9)
            for m in alike[alike > n].tolist():
                x, y = root(n), root(m)
                if x != y:
                    parent[y] = x
                    out_a.append(ids[n])
                    out_b.append(ids[m])
        kind = data.schema.field("id").type
        return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})

    kind = texts.schema["id"].dataType.simpleString()
    return work.groupBy("label", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, that with the least id, with all columns, whatever these are called.

    Rows that repeat an id and a text count as one document, of which one row stays; rows that repeat an id with other texts, and rows without
    an id, are documents like others. Null and empty texts are no copies of each other. An empty table stays empty.
    """
    classes = materialise(_classes(docs, id_col, text_col, settings), "classes")
    kept = classes.where("id <=> class_id").groupBy("label").agg(F.min("node").alias("node"))
    kept = classes.join(kept.select("node"), "node", "left_semi").select(F.col("id").alias("own"), F.col("t").alias("hash"))
    rows = classes.groupBy("id", "t").agg(F.count("*").alias("n"))
    gone = few_rows(materialise(rows.join(kept, F.expr("id <=> own AND t = hash"), "left_anti").select("id", "t"), "dropped"), BROADCAST_IDS)
    row_id, row_hash = spare_names(docs, 2)
    gone = gone.toDF(row_id, row_hash)
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    left = docs.join(gone, docs[id_col].eqNullSafe(gone[row_id]) & (text_hash == gone[row_hash]), "left_anti")
    if rows.where("n > 1").isEmpty():
        return left
    return left.withColumn(row_hash, text_hash).dropDuplicates([id_col, row_hash]).drop(row_hash)
