"""Packing of tokenised documents into fixed-length sequences by bounded-space online best fit."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

_ENCODERS: dict = {}


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    The same merges run several times faster in ``tiktoken``; it is used where a probe gives equal ids, except for texts
    that hold a special token's string, which ``tokenizers`` maps to that token.
    """

    PROBE = "It's 12 o'clock;  naïve\n\n\t x1 ÅÖ 東京 🙂 they'll   end   \x1f\x85 don't"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._twin(spec)

    def _twin(self, spec: dict):
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        twin = tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return twin if twin.encode_ordinary(self.PROBE) == self.slow.encode(self.PROBE, add_special_tokens=False).ids else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class BestFit:
    """Online best fit with at most ``open_bins`` open bins.

    A bitset has the bit f set while an open bin has f tokens free, so the tightest fit for a piece is the lowest set bit
    at or above its length. If a new bin is needed and all are open, the fullest closes. ``closed`` lists the bins that are full or closed.
    """

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.limit, self.next = capacity, open_bins, first
        self.bits, self.free, self.open = 0, [[] for _ in range(capacity + 1)], 0
        self.closed: list[int] = []

    def _pop(self, free: int) -> int:
        found = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.open >= self.limit:
                self.closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(bin_)
        return bin_, self.capacity - free


class _Packed:
    """Rows (length at ``at``) with their places, given out as their sequences close."""

    def __init__(self, bins: BestFit, at: int):
        self.bins, self.at, self.held = bins, at, {}

    def add(self, row: tuple) -> list[tuple]:
        sequence, offset = self.bins.place(row[self.at])
        self.held.setdefault(sequence, []).append((*row, sequence, offset))
        done = [r for closed in self.bins.closed for r in self.held.pop(closed)]
        self.bins.closed.clear()
        return done

    def rest(self) -> list[tuple]:
        return [r for rows in self.held.values() for r in rows]


#: Sequences that the first pass leaves open are packed anew, about so many of their pieces to a task.
TAIL_PIECES = 50_000


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, open_bins: int = 256, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids with ``with_ids``.

    Each document is its ids and then ``end_id``; longer ones are cut so that only the first piece is short. Null and
    empty texts are the end id alone; null ids are ids like others; repeated rows are packed each; texts may be of any length; an empty table gives
    no piece; further columns are ignored. Every task packs its own rows with bounded memory and no shuffle. What the tasks leave in open
    sequences is packed anew, longest pieces first, in tasks of ``TAIL_PIECES`` pieces, so sequences that are not full stay as few however many tasks there are.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema = f"id {id_type}, {fields}, sequence_id long, offset long"
    types = [pa.int32(), *[pa.int64()] * 3, *([pa.list_(pa.int64())] if with_ids else []), *[pa.int64()] * 2]
    names = ["id", *[f.split()[0] for f in fields.split(", ")], "sequence_id", "offset"]

    def batch_of(rows, kinds, columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    def first(batches):
        packed = _Packed(BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40), 3)
        enc, kinds, columns = encoder(tokenizer_path), None, [*names, "tail"]
        for batch in batches:
            kinds = [batch.schema.field(0).type, *types, pa.bool_()]
            out = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                key, start, piece = key.as_py(), 0, 0
                while start < len(ids):
                    length = len(ids) % capacity or capacity if not piece else capacity
                    part = ids[start : start + length]
                    out += packed.add((key, piece, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if with_ids else [])))
                    start, piece = start + length, piece + 1
            if out:
                yield batch_of([(*r, False) for r in out], kinds, columns)
        if rest := packed.rest():
            yield batch_of([(*r, True) for r in rest], kinds, columns)

    def second(batches):
        packed, kinds = _Packed(BestFit(capacity, open_bins, 1 << 62 | TaskContext.get().partitionId() << 40), 3), None
        for batch in batches:
            kinds = [batch.schema.field(0).type, *types]
            if out := [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in packed.add(row)]:
                yield batch_of(out, kinds, names)
        if rest := packed.rest():
            yield batch_of(rest, kinds, names)

    placed = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(first, f"{schema}, tail boolean"), "packed-pieces")
    tails = placed.where("tail").drop("tail", "sequence_id", "offset")
    tasks = -(-tails.count() // TAIL_PIECES)
    done = placed.where("NOT tail").drop("tail")
    if tasks:
        ordered = tails.repartition(tasks).sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32")
        done = done.unionByName(ordered.mapInArrow(second, schema))
    last = ["ids"] if with_ids else []
    return done.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *last)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
