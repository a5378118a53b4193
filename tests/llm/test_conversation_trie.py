"""The conversation trie against a plain trie in a dictionary."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from evigraph.llm.conversation_trie import HEADS, conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows, spread):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    if not spread:
        return turns
    height = {c: zlib.crc32(str(c).encode()) % HEADS for c in turns}
    return {c: turns.get(c - c % 5, [])[: height[c]] + t[height[c] :] for c, t in turns.items()}


def plain_trie(rows, spread=False):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in rebuilt(rows, spread).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        less = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids.get(node)
            saved[node[:d]] += less
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids.get(node, 0), leaves[node], saved[node], digest(node)) for node, own in members.items()
    )


def nodes(spark, rows, spread=False, schema=SCHEMA):
    found = conversation_trie(spark.createDataFrame(rows, schema), spread)
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


def test_trie_of_mixed_conversations(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(60):
        n = draw.choice([1, 2, 3, 4])
        rows += [(conv, t, draw.choice(["user", "bot", None]), draw.choice(["hi", "", None, "é", f"x{draw.randrange(40)}"])) for t in range(n)]
    rows += [(100 + i, t, "user", f"copy {t}") for i in range(9) for t in range(4)]  # copies end at one node
    rows += [(200, 1, "user", "copy 0"), (200, None, "user", "first"), (200, 1, "user", "copy 0"), (200, 1, "bot", "tie")]
    rows += [(None, 1, "user", "nobody's"), (7, 99, "user", "last")]
    draw.shuffle(rows)
    assert nodes(spark, rows, True) == plain_trie(rows, True)


def test_long_copies_are_retired_at_once(spark):
    rows = [(c, t, "user", f"t{t}") for c in (5, 6, 8) for t in range(300)] + [(9, 0, "user", "t0"), (9, 1, "bot", "else")]
    assert nodes(spark, rows) == plain_trie(rows)


def test_one_empty_and_wide_tables(spark):
    wide = [(3, 1, "user", "a", 4, "x")]
    assert nodes(spark, wide, schema=SCHEMA + ", item int, Depth string") == plain_trie([r[:4] for r in wide])
    assert nodes(spark, [], schema=SCHEMA) == []
    assert nodes(spark, [(None, 1, "user", "a")]) == []
