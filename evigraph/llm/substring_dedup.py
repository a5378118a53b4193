"""Removal of passages that already stand in an earlier document, located by Aho-Corasick automata.

Three passes over blocks of documents, joined by two small shuffles:

1. anchors: in every window of ``width`` words the short gram with the least hash. Equal windows have equal anchors, so only
   windows with an anchor that two documents share can recur; there is about one anchor in five words.
2. windows: 96-bit hashes of the windows with a shared anchor, grouped over the corpus, confirm which windows recur and the first
   document of each.
3. automata: each block compiles the confirmed windows that stand in it into automata over word numbers and streams all its
   documents through them; the places that they find, word by word, are what goes.

What is shuffled by anchor or window is first combined within a block, so a passage that a third of the documents share counts
once for each block.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shuffle_width, table
from .shingles import window_hashes, word_hashes, words_of


#: Stands for a missing id; half the range of 64 bits, so differences do not overflow.
NO_ID = -(1 << 62)


@dataclass(frozen=True)
class Settings:
    """``gram``: words of an anchor; ``block``: characters, and ``documents``: documents that are streamed through the same automata, on average;
    ``shard``: windows in an automaton at most."""

    width: int = 13
    gram: int = 5
    block: int = 800_000
    documents: int = 256
    shard: int = 100_000


class Block:
    """Words and hashes of some documents, end to end."""

    def __init__(self, docs: pa.Table, settings: Settings):
        self.words = [words_of(t.as_py()) for t in docs.column("text")]
        self.ids = docs.column("own").to_numpy().astype(np.int64, copy=False)
        sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        hashes = word_hashes([w for words in self.words for w in words])
        self.hashes, self.settings = hashes, settings
        width = settings.width
        n = max(len(hashes) - width + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # windows that do not reach into the next document
        self.valid = owner[:n] == owner[width - 1 :] if n else np.zeros(0, dtype=bool)
        self.owner = owner[:n]

    def anchors(self) -> np.ndarray:
        """The least gram of each window; the pass of automata does without."""
        n, gram = len(self.owner), self.settings.gram
        grams = window_hashes(self.hashes, gram, 7)
        anchors = grams[:n].copy()
        for i in range(1, self.settings.width - gram + 1 if n else 1):
            np.minimum(anchors, grams[i : i + n], out=anchors)
        return anchors

    def window_keys(self) -> tuple[np.ndarray, np.ndarray]:
        width = self.settings.width
        return window_hashes(self.hashes, width, 11).view(np.int64), (window_hashes(self.hashes, width, 13) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _anchors(settings: Settings):
    def run(key, data):
        block = Block(data, settings)
        found, doc = block.anchors()[block.valid], block.owner[block.valid]
        change = np.ones(len(found), dtype=bool)
        change[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        found, ids = found[change], block.ids[doc[change]]
        order = np.argsort(found)
        found, ids = found[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, dtype=bool)
        # the sign tells whether two documents of the block share the anchor
        place = np.where(several, -1 - key[0].as_py(), key[0].as_py())
        return pa.table({"anchor": pa.array(found[first].view(np.int64)), "place": pa.array(place, pa.int64())})

    return run


def _windows(settings: Settings):
    def run(key, docs, shared):
        empty = pa.table({n: pa.array([], t) for n, t in (("h1", pa.int64()), ("h2", pa.int32()), ("lo", pa.int64()), ("more", pa.bool_()), ("block", pa.int32()))})
        if not shared.num_rows or not docs.num_rows:
            return empty
        block = Block(docs, settings)
        anchors = np.sort(shared.column("anchor").to_numpy().view(np.uint64))
        own = block.anchors()
        # neighbours mostly have the same anchor, which is looked up once
        first = np.flatnonzero(np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]]))
        near = np.minimum(np.searchsorted(anchors, own[first]), len(anchors) - 1)
        pick = np.flatnonzero(block.valid & np.repeat(anchors[near] == own[first], np.diff(first, append=len(own))))
        if not len(pick):
            return empty
        h1, h2 = (h[pick] for h in block.window_keys())
        ids = block.ids[block.owner[pick]]
        order = np.argsort(h1)
        if np.any((h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] != h2[order[:-1]])):  # rare: the second hash tells windows apart
            order = np.lexsort((h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        low = np.minimum.reduceat(ids, first)
        more = np.maximum.reduceat(ids, first) > low
        return pa.table({"h1": h1[first], "h2": h2[first], "lo": low, "more": more, "block": np.full(len(first), key[0].as_py(), dtype=np.int32)})

    return run


def _patterns(block: Block, confirmed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block where its confirmed windows stand, one for each, and the first document of each. Hashes serve to pick them only."""
    order = np.argsort(confirmed)
    confirmed, first = confirmed[order], first[order]
    own = window_hashes(block.hashes, block.settings.width, 11).view(np.int64)
    near = np.minimum(np.searchsorted(confirmed, own), len(confirmed) - 1)
    at = np.flatnonzero(block.valid & (confirmed[near] == own))
    near = near[at]
    # a window goes in documents after its first one, so one that stands in no such document of the block is no pattern
    last = np.full(len(confirmed), np.iinfo(np.int64).min)
    np.maximum.at(last, near, block.ids[block.owner[at]])
    which, one = np.unique(near, return_index=True)
    used = last[which] > first[which]
    return at[one][used], first[which][used]


#: The first character of a word.
FIRST = 32


def _letters(block: Block, place: np.ndarray | None = None) -> list[str]:
    """The documents with two characters for each word, the first and the second from alphabets of their own.

    Words of the windows at ``place`` (all words if none are given) have characters of their own, by the words themselves; all others, which no
    window holds, share theirs. An automaton keeps the branches of a node in a list, so an alphabet of all words would make the root a long one; and as the alphabets differ,
    what it finds begins and ends with a word.
    """
    words = chain.from_iterable(block.words)
    if place is not None:
        held = np.zeros(len(block.hashes), dtype=bool)
        for i in range(block.settings.width):
            held[place + i] = True
        words = compress(words, held.tolist())
    named = dict.fromkeys(words)
    base = math.isqrt(len(named)) + 1
    coded = {word: chr(FIRST + i // base) + chr(FIRST + base + i % base) for i, word in enumerate(named, 1)}
    other = repeat(chr(FIRST) + chr(FIRST + base))
    return ["".join(map(coded.get, words, other)) for words in block.words]


def locate(block: Block, confirmed: np.ndarray, first: np.ndarray) -> list[np.ndarray | None]:
    """For each document the words that lie in a confirmed window which starts in an earlier document; None if there are none.

    The confirmed windows of the block are compiled into automata of ``shard`` windows at most, and all documents of the block are streamed
    through each. What an automaton finds decides which words go: its windows are the words themselves.
    """
    width, shard = block.settings.width, block.settings.shard
    drop: list[np.ndarray | None] = [None] * len(block.words)
    if not len(confirmed) or not len(block.valid):
        return drop
    place, earliest = _patterns(block, confirmed, first)
    if not len(place):
        return drop
    coded = _letters(block, place)
    home = np.searchsorted(block.starts, place, side="right") - 1
    offset = place - block.starts[home]
    for low in range(0, len(place), shard):
        automaton = ahocorasick.Automaton()
        for d, i, f in zip(home[low : low + shard].tolist(), offset[low : low + shard].tolist(), earliest[low : low + shard].tolist(), strict=True):
            automaton.add_word(coded[d][2 * i : 2 * (i + width)], f)
        automaton.make_automaton()
        for d, text in enumerate(coded):
            own = int(block.ids[d])
            ends = np.array([end // 2 for end, f in automaton.iter(text) if f < own], dtype=np.int64)
            if len(ends):
                edge = np.zeros(len(text) // 2 + 1, dtype=np.int64)
                edge[ends - width + 1] += 1
                edge[ends + 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                drop[d] = gone if drop[d] is None else drop[d] | gone
    return drop


def _kept(settings: Settings, digest_only: bool):
    def run(key, docs, windows):
        block = Block(docs, settings)
        drop = locate(block, windows.column("h1").to_numpy(), windows.column("first").to_numpy())
        kept = [b" ".join(words if gone is None else compress(words, (~gone).tolist())) for words, gone in zip(block.words, drop, strict=True)]
        return pa.table(
            {
                "id": docs.column("id"),
                "n_words": pa.array([len(w) for w in block.words], pa.int64()),
                "n_removed": pa.array([0 if d is None else int(d.sum()) for d in drop], pa.int64()),
                **({} if digest_only else {"kept": pa.array(kept, pa.binary()).cast(pa.string())}),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    return run


def dealt(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (own, text) with their ``block``; by the text too, so rows without an id, or with one that repeats, are dealt like others."""
    return rows.withColumn("block", F.pmod(F.xxhash64("own", "text"), F.lit(count)).cast("int"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), digest_only: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) per row of ``docs``; ``digest_only`` leaves out the kept text.

    A word goes if a window of ``width`` words that covers it, within its document, also starts in a document with a smaller
    id. Windows are judged on the input. Null and empty texts have no words; texts shorter than a window lose nothing;
    rows that repeat an id keep their words unless a smaller id has them; rows without an id come before all others; rows are dealt
    to blocks by id and text, so only rows equal in both meet in one block for sure; an empty table gives no row; further columns are ignored. Texts may be of any length. Ids must be integers, of less than 2^62 in amount.
    """
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.coalesce(id_, F.lit(NO_ID)).alias("own"), F.col(text_col).alias("text"))
    documents, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    count = max(1, -(-documents // settings.documents), -(-chars // settings.block))

    rows = dealt(rows, count).repartition(shuffle_width(spark), "block")
    anchors = rows.groupBy("block").applyInArrow(_anchors(settings), "anchor long, place long").repartition(shuffle_width(spark), "anchor")
    same = W.partitionBy("anchor")
    shared = anchors.select("anchor", "place", F.count("*").over(same).alias("n"), F.min("place").over(same).alias("p")).where("n > 1 OR p < 0")
    shared = shared.select("anchor", F.expr("CAST(IF(place < 0, -1 - place, place) AS int) AS block"))
    by_block = rows.groupBy("block")
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_windows(settings), "h1 long, h2 int, lo long, more boolean, block int").repartition(shuffle_width(spark), "h1", "h2")
    same = W.partitionBy("h1", "h2")
    confirmed = windows.select("h1", "lo", "more", "block", F.min("lo").over(same).alias("first")).where("lo > first OR more").select("h1", "first", "block")
    out = rows.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(
        _kept(settings, digest_only), "id long, n_words long, n_removed long, " + ("" if digest_only else "kept string, ") + "kept_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest_only=True)


OP8_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM places WHERE i + 12 <= len(w)),
firsts AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM windows JOIN firsts USING (k), range(13) r(o) WHERE f < doc_id),
kept AS (
  SELECT p.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS gone, string_agg(w[p.i], ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""
