"""Prefix trie of conversations by partition refinement.

All conversations start in one class. In round d every class that still holds several different conversations is split by turn d; a class
with one conversation left is retired, and the rest of that conversation becomes a chain of nodes with one child each. When no class is
left, counts are folded back from the deepest round to the root. Equal conversations are one with a weight, so copies are retired too, and the
number of rounds is the depth at which the last two different conversations part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .periodic_runs import CRC32_SQL
from .shared import materialise, shuffle_width, table

#: Turns that a conversation may take over from another one are fewer than this.
HEADS = 9
#: Decimal ids that are joined to one piece before pieces are hashed.
PIECE = 4096
#: Turns of a tail that are summed up together.
SPAN = 1024
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the length of the role keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, ord from 1, digest, bytes), written once.

    Rows are sorted over the whole table, numbered within the tasks, and the numbers of conversations that go on from one task to the next
    are raised by what stands before, so a conversation of any length is dealt over many tasks.
    """
    rows = turns.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    key = ["conv_id", "turn", "digest", "spread"]
    ordered = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(shuffle_width(turns.sparkSession), *key).sortWithinPartitions(*key)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def places(batches):
        last, count = None, 0
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            values = ids.to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            sizes = np.diff(np.append(firsts, len(values)))
            place = np.arange(len(values)) - np.repeat(firsts, sizes) + 1
            if values[0] == last:
                place[: sizes[0]] += count
            last, count = values[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int64()), batch.column(1), batch.column(2), batch.column(3)], names=["conv_id", "place", "digest", "bytes", "task"])

    numbered = ordered.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("task")).mapInArrow(places, f"conv_id {kind}, place long, digest string, bytes long, task int")
    written = materialise(numbered, "turns-numbered")
    parts = written.groupBy("conv_id", "task").agg(F.max("place").alias("n"))
    split = written.groupBy("conv_id").agg(F.min("task").alias("a"), F.max("task").alias("b")).where("a < b").select("conv_id")
    # two conversations at most go on over each border between tasks, so this table has fewer rows than twice the number of tasks
    before = W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    raised = parts.join(split, "conv_id", "left_semi").withColumn("raised", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = written.join(F.broadcast(raised), ["conv_id", "task"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("raised", F.lit(0))).alias("ord"), "digest", "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns (conv_id, pos, digest, bytes) after each has taken over the head of another one."""
    sizes = turns.groupBy("conv_id").agg(F.max("ord").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = sizes.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base"))
    convs = convs.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialise(convs.withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where(F.col("ord") < HEADS).withColumnsRenamed({"conv_id": "base", "ord": "pos"})
    first = heads.join(convs.select("base", "conv_id", "taken"), "base").where("pos <= taken")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("ord > h").withColumn("pos", F.col("taken") + F.col("ord") - F.col("h"))
    columns = ["conv_id", "pos", "digest", "bytes"]
    return convs.select("conv_id", "len"), materialise(first.select(columns).unionByName(own.select(columns)), "turns-rebuilt")


def ends_digests(members: DataFrame) -> DataFrame:
    """(item, ends_sha256): SHA-256 of the members' decimal ids, ascending and joined by commas.

    Ids are sorted over the whole table and joined to pieces, so that the task which hashes the pieces of a large group in their order reads few
    rows, one at a time.
    """
    width = shuffle_width(members.sparkSession)
    ordered = members.select("item", "conv_id").repartitionByRange(width, "item", "conv_id").sortWithinPartitions("item", "conv_id")
    kind = members.schema["conv_id"].dataType.simpleString()

    def pieces(batches):
        item, held = None, []
        out: list[tuple] = []

        def flush():
            if held:
                out.append((item, held[0], ",".join(map(str, held))))
                held.clear()

        def given():
            columns = zip(*out, strict=True) if out else ((), (), ())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "first", "ids"])
            out.clear()
            return batch

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string()]
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != item or len(held) >= PIECE:
                    flush()
                    item = own
                held.append(conv)
            yield given()
        flush()
        if out:
            yield given()

    def digests(batches):
        item, state, any_row = None, None, False
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any_row and own == item:
                    state.update(b"," + text.encode())
                else:
                    if any_row:
                        out.append((item, state.hexdigest()))
                    item, state, any_row = own, hashlib.sha256(text.encode()), True
            columns = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, pa.string()], strict=True)], names=["item", "ends_sha256"])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([item], batch.schema.field(0).type), pa.array([state.hexdigest()])], names=["item", "ends_sha256"])

    joined = materialise(ordered.mapInArrow(pieces, f"item {kind}, first {kind}, ids string"), "conversation-ends")
    return joined.repartition(width, "item").sortWithinPartitions("item", "first").select("item", "ids").mapInArrow(digests, f"item {kind}, ends_sha256 string")


def _tails(chain: DataFrame) -> DataFrame:
    """``chain`` (item, pos, bytes, ...) with ``below``: bytes of the turns of the item from ``pos`` to its end. Sums are taken in spans first."""
    spans = chain.groupBy("item", F.expr(f"pos DIV {SPAN}").alias("span")).agg(F.sum("bytes").alias("all"))
    after = W.partitionBy("item").orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("item", "span", F.coalesce(F.sum("all").over(after), F.lit(0)).alias("after"))
    within = W.partitionBy("item", "span").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = chain.withColumn("span", F.expr(f"pos DIV {SPAN}")).join(spans, ["item", "span"])
    return rows.withColumn("below", F.sum("bytes").over(within) + F.col("after")).drop("span", "after")


def refine(items: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Split classes round by round; each round's items are written once.

    ``items`` has item, weight and len, ``turns`` item, pos, digest and bytes. Gives the classes of each round (depth, node, parent, n_convs,
    items, bytes, len), the node being the smallest item; the retired items (item, weight, len, depth of the class that they are alone in);
    and for every item the node at which it ends (item, node).
    """
    kind = items.schema["item"].dataType
    root = items.agg(F.min("item").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("items")).head()
    constants = {"cls": F.lit(None).cast(kind), "node": F.lit(root.node).cast(kind), "n_convs": F.lit(root.n_convs).cast("long"), "items": F.lit(root["items"]), "bytes": F.lit(0).cast("long")}
    moved, depth, levels = items.withColumns(constants), 0, []
    retired = ended = None
    while True:
        at = F.lit(depth).cast("long")
        levels.append(moved.groupBy("node").agg(at.alias("depth"), F.max("cls").alias("parent"), *[F.max(c).alias(c) for c in ("n_convs", "items", "bytes", "len")]))
        alone, active = moved.where("items = 1"), moved.where("items > 1")
        gone = alone.select("item", "weight", "len", at.alias("depth"))
        stops = moved.where((F.col("items") == 1) | (F.col("len") == depth)).select("item", "node")
        retired, ended = (gone, stops) if retired is None else (retired.unionByName(gone), ended.unionByName(stops))
        active = active.where(F.col("len") > depth).select("item", "weight", "len", F.col("node").alias("cls"))
        if active.isEmpty():
            return levels, retired, ended
        depth += 1
        step = active.join(turns.where(F.col("pos") == depth).select("item", "digest", "bytes"), "item")
        classes = step.groupBy("cls", "digest").agg(F.min("item").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("items"))
        moved = materialise(step.join(classes, ["cls", "digest"]).drop("digest"), "trie-round")


def conversation_trie(turns: DataFrame, spread_heads: bool = False) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, turn, role, text), from the root without a text.

    Each node has conv_id (its smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (nodes without children in its
    subtree), saved_tokens (bytes of last texts that a trie stores once instead of once a member, over its subtree) and ends_sha256 (of the ids that end at it).
    Turns are ordered by ``turn``, null first, ties by the SHA-256 of role and text, equal rows in any order; null roles and texts are empty; rows
    without a conversation's id belong to none and are left out; texts may be of any length (they are digested where they are read); an empty
    table has no node, not even a root; further columns are ignored. With ``spread_heads`` a conversation takes over the head of another first.
    """
    named = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    numbered = numbered_turns(named)
    if spread_heads:
        convs, rows = rebuild(numbered)
    else:
        rows = materialise(numbered.withColumnRenamed("ord", "pos"), "turns-plain")
        convs = rows.groupBy("conv_id").agg(F.max("pos").alias("len"))
    # equal conversations become one item, the smallest id, with their number as weight
    marks = [F.bit_xor(F.xxhash64("digest", "pos", F.lit(seed))).alias(f"k{seed}") for seed in (1, 2)]
    keyed = convs.join(rows.groupBy("conv_id").agg(*marks), "conv_id", "left").select("conv_id", "len", F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"))
    keyed = materialise(keyed, "conversation-keys")
    same = ["len", "k1", "k2"]
    items = materialise(keyed.groupBy(*same).agg(F.min("conv_id").alias("item"), F.count("*").alias("weight")), "trie-items")
    ends = ends_digests(keyed.join(items.select("item", *same), same).select("item", "conv_id"))
    tails = rows.withColumnRenamed("conv_id", "item").join(items.select("item"), "item", "left_semi")
    tails = materialise(tails.repartitionByRange(shuffle_width(turns.sparkSession), "pos", "item").sortWithinPartitions("pos"), "trie-turns")
    levels, retired, ended = refine(items.select("item", "weight", "len"), tails)

    # chains of retired items; what a class with one item saves below itself comes from there as well
    chain = tails.join(retired, "item").where("pos > depth")
    columns = ["item", "weight", "len", "depth", "pos", "below"]
    one = chain.where("weight = 1").withColumn("below", F.lit(0).cast("long"))
    chain = materialise(one.select(columns).unionByName(_tails(chain.where("weight > 1")).select(columns)), "trie-chains")
    saved = (F.col("weight") - 1) * F.col("below")
    goes_on = F.when(F.col("len") > F.col("depth"), 1).otherwise(0).cast("long")
    begun = chain.where("pos = depth + 1 AND weight > 1").select(F.col("item").alias("node"), saved.alias("rest"))
    lone = chain.select(F.col("item").alias("conv_id"), F.col("item").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.col("pos").alias("depth"), "len", saved.alias("saved_tokens"))
    lone = lone.withColumns({"n_children": goes_on, "n_leaves": F.lit(1).cast("long")})

    # fold back: each round's classes get what their children of the next round have
    last = ["n_children", "n_leaves", "saved_tokens"]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", *last]
    done, below = lone.select(names), lone.select(names).where("false")
    for level in reversed(levels):
        summed = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        rows = level.join(begun, "node", "left").join(summed, "node", "left")
        alone = F.col("items") == 1
        folded = rows.select(
            F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "depth", "n_convs", F.when(alone, goes_on).otherwise(F.col("n_children")).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.when(alone, F.coalesce("rest", F.lit(0))).otherwise(F.col("saved_tokens"))).alias("saved_tokens"),
        )
        below = materialise(folded, "trie-folded")
        done = done.unionByName(below)
    at = ends.join(items.select("item", F.col("len").alias("depth")), "item").join(ended, "item").select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    return done.join(at, ["conv_id", "depth"], "left").select(*names, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), spread_heads=True)


OP13_SQL = f"""
WITH named AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS o FROM named),
c AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY o) AS own, {CRC32_SQL.format("conv_id")} % 9 AS h FROM t GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, turns[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(max(strlen(turns[d].x)), 0) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
linked AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids USING (k) LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1:n.d - 1]),
up AS (SELECT k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM linked) GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM linked JOIN up USING (k)
"""
