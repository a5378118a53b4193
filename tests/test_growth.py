"""Steps whose work must grow with their input, on small input that shows how they go about it."""

from __future__ import annotations

import random
import re

from evigraph.extract.js_facts import js_facts
from evigraph.extract.python_facts import python_facts
from evigraph.extract.sql_facts import sql_facts
from evigraph.operators import graph as G
from evigraph.operators import links as L
from evigraph.operators import modules as M
from evigraph.operators import mounts as R
from evigraph.operators import plugins as P


def _final(df) -> str:
    """The plan that ran last, without the one that it began as."""
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_enclosing_compares_no_lines_with_ranges(spark):
    rng = random.Random(1)
    ranges = [("a", f"d{i}", (f := rng.randint(-40, 300)), f + rng.choice([-1, 0, 1, 7, 64, 200])) for i in range(400)] + [("a", "whole", -2147483648, 2147483647), ("b", "one", 5, 5), ("b", None, 5, None), (None, "lost", 0, 9)]
    lines = [("a", i) for i in range(-50, 520)] * 2 + [("b", 4), ("b", 5), ("b", 6), (None, 3), ("c", 1), ("a", 2147483647)]
    found = L.enclosing(spark.createDataFrame(lines, "path string, line long"), spark.createDataFrame(ranges, "path string, name string, first int, last int"))
    rows = sorted((str(p), n, str(d)) for p, n, d in found.select("path", "line", "name").collect())
    around = lambda p, n: min(((-f, l, d) for q, d, f, l in ranges if q is not None and q == p and l is not None and f <= n <= l), default=(0, 0, None))[2]
    assert rows == sorted((str(p), n, str(around(p, n))) for p, n in lines)
    assert not re.search(r"line#\d+L? [<>]=", _final(found))


def test_owned_symbols_hold_no_links(spark, monkeypatch):
    monkeypatch.setattr(L, "DEALT", 3)
    concepts = [(c, o, "s") for c in range(40) for o in ("x", "y")] + [(None, "x", "s"), (7, "x", "s"), (3, None, "s"), (4, "z", "t")]
    symbols = [(t, "s", o) for t in range(9) for o in (("x", "y") if t < 2 else ("x",))] + [(None, "s", "x"), (5, "s", None), (1, "t", "z")]
    met = {(c, t) for c, o, s in concepts for t, n, p in symbols if o == p and s == n and o is not None}
    linked = lambda c, s: L.owned_symbols(spark.createDataFrame(c, "concept long, owner string, symbol string"), spark.createDataFrame(s, "target long, name string, path string"))
    assert sorted(map(str, linked(concepts, symbols).collect())) == sorted(f"Row(concept={c}, target={t})" for c, t in met)
    plain = linked(concepts, [s for s in symbols if s[2] == "x"])
    assert len(plain.collect()) == 41 * 10
    assert not re.search(r"Aggregate\(keys=\[concept#\d+L, target", _final(plain))


def test_plugins_send_no_large_graph_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST", 10)
    columns = ["file", "record", *P.FIELDS, "node_ids"]
    node = lambda file, id_, label: {"file": file, "record": P.NODE, "id": id_, "kind": "k", "label": label, "path": "p"}
    edge = lambda file, a, b: {"file": file, "record": P.EDGE, "src": a, "dst": b, "kind": "k", "resolution": "exact", "evidence": "e"}
    rows = [node("a", "n", "1"), edge("a", "n", "g5"), node("b", "n", "2"), node("c", "c", "1"), node("c", "c", "2"), node("d", "g1", "x"), node("e", "g2", "g2"), edge("e", "g2", "no"), node("f", "f", "1"), edge("f", "f", "g3"), edge("f", "f", "g4")]
    records = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], P.RECORDS)
    known = spark.createDataFrame([(f"g{i}", "k", f"g{i}", "p") for i in range(50)], "id string, kind string, label string, path string")
    entered, out = P.commit(records, known, "x", "1", most=2)
    found = {r.file: r.reason for r in out.collect()}
    assert found == {"b": "another file describes the node first", "c": "node is described differently", "d": "node is described differently", "e": "names an unknown node", "f": "too many records"}
    assert sorted((r.file, r.record) for r in entered.collect()) == [("a", "edge"), ("a", "node")]
    assert "Broadcast" not in _final(entered)


def test_plugins_compare_only_what_is_described_in_several_ways(spark, monkeypatch):
    written, plain = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: (written.append(plain(df)), written[-1])[1])
    columns = ["file", "record", *P.FIELDS, "node_ids"]
    node = lambda file, id_, label, path="p": {"file": file, "record": P.NODE, "id": id_, "kind": "k", "label": label, "path": path}
    edge = lambda file, a, b, how="exact": {"file": file, "record": P.EDGE, "src": a, "dst": b, "kind": "k", "resolution": how, "evidence": "e"}
    issue = lambda file, ids: {"file": file, "record": P.ISSUE, "severity": "info", "message": "m", "evidence": "e", "recommendation": "r", "node_ids": ids}
    failed = lambda file, text: {"file": file, "record": P.FAILED, "message": text}
    rows = [r for i in range(40) for r in (node(f"ok{i % 5}", f"n{i}", "1"), node(f"ok{i % 5}", f"n{i}", "1"), edge(f"ok{i % 5}", f"n{i}", "g1"), issue(f"ok{i % 5}", [f"n{i}", "g2"]))]
    rows += [node("ok0", "g1", "g1"), issue("ok0", []), issue("ok0", None), issue("ok1", ["g3", None]), node("ok2", "t", "1"), node("ok3", "t", "1", None), node("swap", "g4", "p", "g4")]
    rows += [failed("a", "y"), failed("a", None), failed("a", "x"), edge("a", "g1", "no"), failed("b", "x"), edge("b", None, "g1"), node("c", None, "l"), edge("c", "g1", "g2", "odd"), {"file": "d", "record": None}, node("e", "e", "1"), node("e", "e", None), edge("e", "e", "no"), *[failed("l", str(i)) for i in range(50)]]
    records = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], P.RECORDS)
    known = spark.createDataFrame([(f"g{i}", "k", f"g{i}", "p") for i in range(50)], "id string, kind string, label string, path string")
    found = {r.file: r.reason for r in P.withdrawn(records, known, most=40).collect()}
    later = {"ok3": "another file describes the node first", "ok1": "names an unknown node"}
    assert found == {**later, "swap": "node is described differently", "a": "failed: ", "b": "edge without an end, kind or evidence", "c": "node without id, kind or label", "d": "unknown record", "e": "names an unknown node", "l": "too many records"}
    described = [df for df in written if {"file", "label"} <= set(df.columns)]
    assert len(described) == 1 and {r.id for r in described[0].collect()} == {"t", "e", "g4"}


def test_star_ways_are_kept_to_offering_files_alone(spark):
    stars = [(i, i + 1, 1) for i in range(64)] + [(64, 0, 2), (3, 60, 2), (3, 60, 1), (10, 10, 1), (20, 70, 0), (70, 22, 0)]
    ends = [(40,), (60,), (3,), (99,)]
    edges = {}
    for a, b, p in stars:
        if a != b:
            edges[a, b] = min(p, edges.get((a, b), p))
    expected = {}
    for (end,) in ends:
        level, ways = {end: ()}, {}
        while level:
            after = {}
            for (a, b), p in edges.items():
                if b in level and a != end and a not in ways:
                    after[a] = min(after.get(a, (p, *level[b])), (p, *level[b]))
            ways.update(after)
            level = after
        expected.update({(a, end): w for a, w in ways.items()})
    frame = spark.createDataFrame([(a, b, p) for (a, b), p in edges.items()], "file long, to long, place int")
    found = M.star_reach(frame, spark.createDataFrame(ends, "to long")).collect()
    assert len(found) == len(expected) and {(r.file, r.to): tuple(r.way.places) for r in found} == expected
    assert all(r.way.hops == len(r.way.places) for r in found)


def test_few_bytes_of_sources_are_many_tasks(spark):
    one = spark.createDataFrame([(f"f{i}", "import os") for i in range(40)], "path string, text string").coalesce(1)
    for facts in (python_facts, sql_facts, js_facts):
        assert facts(one).rdd.getNumPartitions() == 4


def test_closure_shuffles_its_steps_once(spark, monkeypatch):
    plans, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice(["exact", "ambiguous", "ambiguous"])) for _ in range(70)]

    def walk(pairs, start):
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for b in {y for p in pairs for x, y in (p, p[::-1]) if x == at} - seen:
                seen.add(b)
                todo.append(b)
        return seen

    found = G.only_ambiguous(spark.createDataFrame(edges, "src long, dst long, resolution string"), spark.range(1))
    assert {r.id for r in found.collect()} == walk([e[:2] for e in edges], 0) - walk([e[:2] for e in edges if e[2] == "exact"], 0)
    rounds = [p for p in plans if "LeftSemi" in p]
    assert len(rounds) > 2 and all("InMemoryTableScan" in p and "BroadcastHashJoin" not in p for p in rounds)
    assert not any("Exchange hashpartitioning(src" in p.partition("InMemoryRelation")[0] for p in rounds)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_ways_of_routers_are_written_once(spark, monkeypatch):
    written, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: (written.append(plain(df)), written[-1])[1])
    rng = random.Random(3)
    names = ["r0", "s0"] + [f"r{i}" for i in range(1, 11)]
    # a chain with diamonds, below it routers on circles, and more below these
    links = {(f"r{i}", f"r{i + 1}", rng.choice(["", "/x"]), rng.random() < 0.7) for i in range(10)} | {("s0", "r2", "", True), ("r1", "r3", "", True), ("r1", "r3", "/y", False), ("r6", "r4", "/c", True), ("r6", "r5", "", True), ("r3", "r6", "", True), ("r7", "r7", "", True), ("r8", "r10", "", True)}
    own = {n: ("/" + n if n[0] == "s" else "", ("d" + n,)) for n in names}
    walks = {(n, *own[n], (n,)) for n in ("r0", "s0")}
    todo = list(walks)
    while todo:
        at, prefix, deps, passed = todo.pop()
        for a, b, p, inherit in links:
            if a == at and b not in passed:
                way = (b, prefix + p + own[b][0], (deps if inherit else ()) + own[b][1], (*passed, b))
                if way not in walks:
                    walks.add(way)
                    todo.append(way)
    ways = {w[:3] for w in walks}
    routers = spark.createDataFrame([(n, p, list(d)) for n, (p, d) in own.items()], "router string, prefix string, dependencies array<string>")
    mounts = spark.createDataFrame([(a, b, 0, p, None, i) for a, b, p, i in links], "parent string, child string, place int, prefix string, dependencies array<string>, inherit boolean")
    found, issues = R.mount_variants(routers, mounts)
    rows = [(r.router, r.prefix, tuple(r.dependencies)) for r in found.collect()]
    assert len(rows) == len(ways) and set(rows) == ways and issues.isEmpty()
    assert sum(df.count() for df in written if {"router", "prefix"} <= set(df.columns)) <= 2 * len(walks)
    written.clear()
    settled = R.effective_mounts(routers, mounts).collect()
    assert sorted(r.router for r in settled) == sorted(names) and {r.router for r in settled if r.cyclic} == {f"r{i}" for i in range(4, 8)}
    assert sum(df.count() for df in written if "cyclic" in df.columns) == len(names)


def test_edges_of_kinds_that_are_not_selected_are_not_shuffled(spark, monkeypatch):
    edges = spark.createDataFrame([("a:1", "b:1"), ("a:1", "b:2"), ("a:1", "c:1"), ("c:1", "a:1"), ("b:1", "a:1"), ("b:1", "b:1"), (None, "b:1"), ("a", "a:1"), ("x", "a"), ("a:3", None)], "src string, dst string")
    chosen = spark.createDataFrame([("a:1",), ("b:1",), ("b:1",), (None,), ("a",)], "id string")
    expected = [("a", "a:1"), ("a:1", "b:1"), ("b:1", "a:1"), ("b:1", "b:1")]
    found = G.induced(edges, chosen)
    assert sorted(map(tuple, found.collect())) == expected
    assert "substring_index(src" in _final(found)
    assert G.induced(edges, chosen.limit(0)).isEmpty()
    monkeypatch.setattr(G, "KINDS", 1)
    assert sorted(map(tuple, G.induced(edges, chosen).collect())) == expected
