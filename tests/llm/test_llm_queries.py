"""Registered queries against their SQL, or a plain restatement where there is none."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from evigraph.llm.minhash import GOLDEN, mix, signatures
from evigraph.llm.packing import BestFit, encoder, tokenizer_path
from evigraph.llm.registry import ORACLES, QUERIES
from evigraph.llm.shared import table
from evigraph.llm.textstats import base_counts
from evigraph.llm.warc import chunked, parse, records_of, unchunked

SF = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted([plain(v) for v in r] for r in df.select(*columns).collect())
    assert rows == sorted([plain(r[i]) for i in at] for r in found.fetchall())


def test_secret_scan(spark, texts):
    kinds = (
        ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    )
    for row in QUERIES["op3_secret_scan"](spark, SF).collect():
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(kinds) for m in p.finditer(texts[row.doc_id]) if len(m[g]) >= n)
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[3] == k for s in spans) for k, *_ in kinds)


def test_rule_ensemble_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op4_rule_ensemble"](spark, sf).collect()]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def bag(text):
    words = text.encode().split()
    return Counter(zip(*(words[i:] for i in range(min(5, len(words)))), strict=False))


def classes(texts, threshold=0.8):
    bags = {i: bag(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = bags[a], bags[b]
            if x and y and 5 * min(x.total(), y.total()) >= 4 * max(x.total(), y.total()):
                both = (x & y).total()
                if both >= threshold * (x.total() + y.total() - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, texts):
    assert {r.doc_id: r.class_id for r in QUERIES["op6_minhash"](spark, SF).collect()} == classes(texts)


def test_near_duplicate_groups_without_a_centre(spark):
    """Many variants of one text, most pairs below the threshold: classes are those of all pairs."""
    import random

    from evigraph.llm.minhash import Settings, near_duplicates

    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs, settings=Settings(block=16)).collect()}
    assert got == classes(texts)
    assert len(set(got.values())) > 1


def test_weighted_signatures_are_unbiased():
    import numpy as np

    draw = np.random.default_rng(3)
    a = {i: int(draw.integers(1, 9)) for i in range(200)}
    b = {i: int(draw.integers(1, 9)) if i < 70 else n for i, n in a.items()}
    occurrences = [(mix(np.array([k + 1], dtype=np.uint64) * GOLDEN)[0], d) for d, c in enumerate((a, b)) for k, n in c.items() for _ in range(n)]
    sigs = signatures(np.array([h for h, _ in occurrences]), np.array([d for _, d in occurrences]), 2, 1000)
    expected = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
    assert abs((sigs[0] == sigs[1]).mean() - expected) < 0.06


def test_decontamination(spark, texts):
    items = {r.item_id: " ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()}
    flat = {i: " ".join(t.split()) for i, t in texts.items()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    assert got == {(i, k) for i, t in flat.items() for k, v in items.items() if v in t}


def test_decontamination_of_changed_questions(spark):
    from evigraph.llm.decontaminate import leaks

    items = spark.createDataFrame([(1, "Alice bought Bob 12 apples for 30 km at the Market. How many apples did Bob get from the seller in total?")], "item_id long, text string")
    docs = [
        (1, "so. Then Carol bought Dave 15 apples for 40 miles at the Market. How many apples did Dave get from the seller in total?"),  # one value each
        (2, "so. Then Carol bought Dave 15 apples for 40 km at the Market. How many apples did Eve get from the seller in total?"),  # Bob is Dave and Eve
        (3, "Nothing of the kind stands here, although Carol bought 12 apples for Dave."),
    ]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.changed) for r in got] == [(1, 1, True)]


def test_decontamination_of_items_with_few_literals(spark):
    from evigraph.llm.decontaminate import leaks

    items = ["What is 12 + 30 - 5?", "Anna Bea Carl Dora Emil Fritz Gerd Hans Ida", "km to go", "∑ ≠ ∞", "12 30 45", "Yes"]
    docs = ["It says: what is 12 + 30 - 5? Think.", "there Anna Bea Carl Dora Emil Fritz Gerd Hans Ida went", "still 5 km to go now", "see ∑ ≠ ∞ here", "from 12 30 45 on", "yes", "What is 13 + 30 - 5? 12 31 45, Anna Bea"]
    got = leaks(spark.createDataFrame(enumerate(docs), "doc_id long, text string"), spark.createDataFrame(enumerate(items), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.changed) for r in got) == [(i, i, False) for i in range(6)]


def test_decontamination_of_names_that_begin_sentences(spark):
    from evigraph.llm.decontaminate import leaks

    items = [(1, "Tom has 12 apples. Sue has 3 pears. Tom eats 2 of them. How many does Tom have left?")]
    docs = [(1, "Bob has 15 apples. Ann has 4 pears. Bob eats 3 of them. How many does Bob have left?"), (2, "He said Tom has 12 apples. Sue was there. Then Bob eats 3 of them.")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_windows, r.changed) for r in got] == [(1, 1, 12, True)]


def test_decontamination_of_values_that_fall_together(spark):
    from evigraph.llm.decontaminate import leaks

    items = [(1, "the baker sells 12 loaves and 30 rolls to the school in 5 days so how many does the baker sell"), (2, "he gave 4 coins to her and then 4 stamps to them over 3 km of road before the night came")]
    docs = [(1, "the baker sells 20 loaves and 20 rolls to the school in 5 days so how many does the baker sell"), (2, "he gave 5 coins to her and then 6 stamps to them over 3 miles of road before the night came")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.changed) for r in got) == [(1, 1, True), (2, 2, True)]


def unpacked(rows, texts):
    enc = encoder(tokenizer_path())
    ids = {i: [*enc.slow.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert len(own) == max(1, -(-len(ids[i]) // 1024)) and all(r.length == 1024 for r in own[1:])
        for r in own:
            part = ids[i][r.start : r.start + r.length]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sum(map(len, ids.values())), len(sequences)


def test_packing_round_trip(spark, texts):
    tokens, sequences = unpacked(QUERIES["op10_best_fit_packing"](spark, SF).collect(), texts)
    assert sequences <= 1.05 * tokens / 1024 + 2


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 9)]
    bins = BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 8, 7, 2)] == [(0, 0), (1, 0), (2, 0), (2, 7)]  # bin 1 closed, though 2 would fit there


def test_warc_round_trip_in_any_order():
    from evigraph.llm.warc import Settings

    body = bytes(range(256)) * 40
    assert unchunked(chunked(body, 100)) == body and unchunked(chunked(b"", 5)) == b""
    parts = list(records_of("1", "u", body, hashlib.sha1(body).hexdigest(), None, Settings(segment=1000, chunk=77)))
    found = list(parse(b"".join(p + b"\r\n\r\n" for p in reversed(parts))))
    ordered = sorted(found, key=lambda f: int(f[0]["warc-segment-number"]))
    whole = b"".join(b for _, b in ordered)
    assert len(whole) == int(ordered[-1][0]["warc-segment-total-length"]) and unchunked(whole.partition(b"\r\n\r\n")[2]) == body
    with pytest.raises(ValueError):
        list(parse(parts[0][:-5]))


def similar_lines(texts):
    """The texts without lines alike to an earlier line, by all pairs."""
    lines = sorted((i, n, line) for i, t in texts.items() for n, line in enumerate(t.split("\n")) if line.encode().split())
    sets = [frozenset(line.encode().split()) for _, _, line in lines]
    gone = set()
    inverted = {}
    for k, s in enumerate(sets):
        near = Counter(j for w in s for j in inverted.get(w, ()))
        if any(9 * o >= 4 * (len(s) + len(sets[j])) for j, o in near.items()):
            gone.add(lines[k][:2])
        for w in s:
            inverted.setdefault(w, []).append(k)
    out = {}
    for i, t in texts.items():
        split = t.split("\n")
        left = [line for n, line in enumerate(split) if (i, n) not in gone]
        if any(line.encode().split() for line in left) or not any(line.encode().split() for line in split):
            out[i] = "\n".join(left)
    return out


def test_pipeline(spark, texts):
    kept = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, SF).collect() if r.kept}
    assert all(base_counts(texts[i])[0] >= 50 for i in kept)
    left = similar_lines({i: texts[i] for i in kept})
    left = {i: left[i] for i, c in classes(left).items() if i == c}
    items = [" ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not any(v in " ".join(t.split()) for v in items)}
    tokens, sequences = unpacked(corpus_pipeline.run(spark, SF).collect(), left)
    assert sequences <= 1.05 * tokens / 1024 + 2


def test_stages_keep_the_columns(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_substring_dedup_is_decided_by_the_automata(monkeypatch):
    """Without what the automata find nothing goes; with a pattern of other words, those words go."""
    import numpy as np
    import pyarrow as pa

    from evigraph.llm import substring_dedup as S

    texts = [" ".join(f"w{i}" for i in range(30)), "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y", "z " * 20]
    settings = S.Settings()
    block = S.Block(pa.table({"text": texts, "own": [1, 2, 3]}), settings)
    keys = block.window_keys()[0][:18]
    first = np.ones(len(keys), dtype=np.int64)
    drop = S.locate(block, keys, first)
    assert drop[0] is None and drop[2] is None and drop[1].tolist() == [False, *[True] * 20, False]
    assert [d is None or d.tolist() for d in S.locate(S.Block(pa.table({"text": texts, "own": [1, 2, 3]}), S.Settings(shard=3)), keys, first)] == [True, drop[1].tolist(), True]

    class Broken:
        def __init__(self, *args):
            pass

        def add_word(self, *args):
            pass

        def make_automaton(self):
            pass

        def iter(self, text):
            return iter([(25, 0)] if len(text) > 25 else [])  # 13 words, two characters each

    monkeypatch.setattr(S.ahocorasick, "Automaton", Broken)
    assert [int(d.sum()) for d in S.locate(block, keys, first)] == [13, 13, 13]


def test_best_fit_against_a_list_of_bins():
    import random

    draw = random.Random(2)
    for limit in (1, 3, 50):
        fast, slow, made = BestFit(64, limit, 0), [], 0  # slow: (free, turn of its last change, bin), all open bins
        for turn in range(3_000):
            length = draw.choice((draw.randint(1, 64), draw.randint(1, 9)))
            fitting = [b for b in slow if b[0] >= length]
            if fitting:
                chosen = min(fitting, key=lambda b: (b[0], -b[1]))
                slow.remove(chosen)
            else:
                if len(slow) >= limit:
                    slow.remove(min(slow, key=lambda b: (b[0], -b[1])))
                chosen, made = (64, turn, made), made + 1
            if chosen[0] > length:
                slow.append((chosen[0] - length, turn, chosen[2]))
            assert fast.place(length) == (chosen[2], 64 - chosen[0])


def test_packing_with_many_tasks(spark):
    from evigraph.llm.packing import pack

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    few, many = (pack(docs.repartition(n), tokenizer_path()) for n in (2, 48))
    tokens = few.selectExpr("sum(length)").first()[0]
    counts = [df.select("sequence_id").distinct().count() for df in (few, many)]
    assert max(counts) <= 1.03 * tokens / 1024
    placed = many.selectExpr("sequence_id", "length", "offset + length AS end").groupBy("sequence_id").agg({"length": "sum", "end": "max"})
    assert placed.where("`sum(length)` > 1024 OR `max(end)` != `sum(length)`").isEmpty()
    with_ids = pack(docs.limit(20).repartition(3), tokenizer_path(), with_ids=True)
    assert all(len(r.ids) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 for r in with_ids.collect())


def test_rules_as_a_column(spark):
    import numpy as np

    from evigraph.llm.rule_ensemble import STATISTICS, Settings, fit

    draw = np.random.default_rng(4)
    x = draw.random((400, len(STATISTICS))).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7) | (x[:, 5] > 0.9)).astype(float)
    model = fit(x, y, Settings(leaf=5, steps=300))
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *STATISTICS])
    got = [r[0] for r in frame.orderBy("i").select(model.column()).collect()]
    assert len(model.rules) > 2 and np.allclose(got, model.score(x), atol=1e-12)


def test_linked_weak_parts(spark):
    import random

    from evigraph.llm.secrets import NEEDS, ORDER, ROLES, linked_weak

    draw, rows, scope = random.Random(6), [], 50
    for doc in range(30):
        for _ in range(draw.randint(0, 14)):
            kind = draw.choice(ORDER)
            start = draw.randrange(0, 700)
            rows.append((doc, start, ORDER.index(kind), start + draw.randint(1, 160), kind, ROLES[kind], ORDER.index(kind) >= 3))
    rows = sorted(set(rows))
    parts = spark.createDataFrame(rows, "doc int, start int, ord int, end int, kind string, role string, weak boolean")
    got = {tuple(r) for r in linked_weak(parts, ["doc"], scope).collect()}
    want = set()
    for doc, start, place, end, kind, role, weak in rows:
        near = {r[5] for r in rows if r[0] == doc and r[5] != role and r[1] <= end + scope and r[3] >= start - scope}
        if weak and set(NEEDS[role]) <= near:
            want.add((doc, start, place, end, kind))
    assert got == want and want


def held_items(text, items):
    """(item, n_windows) of the items that a text holds, by the definition: all windows of all forms, all alignments."""
    import regex

    from evigraph.llm import decontaminate as D

    word = regex.compile(D.TOKEN)

    def template(t):
        tokens, out = word.findall(t), []
        number = lambda x: "0" <= x < ":"
        for i, x in enumerate(tokens):
            before = tokens[i - 1] if i else None
            if number(x):
                c = "<number>"
            elif before and number(before) and x.lower() in D.UNITS:
                c = "<unit>"
            elif x in ".?!%$€£°":
                continue
            elif before is not None and x[0] != x[0].lower() and before not in ".?!":
                c = "<name>"
            else:
                c = x.lower()
            d = "<name>" if c[0] != "<" and x[0] != x[0].lower() else c
            out.append((c, d, x.lower()))
        return out

    def places(t, width):
        return range(len(t) - width + 1)

    doc, found = template(text), {}
    for item, source in items.items():
        t = template(source)
        width = min(len(t), D.WIDTH)
        if not width:
            continue
        enough = lambda n: n >= D.LITERALS or (width < D.WIDTH and n >= D.LITERALS - 1)
        literals = lambda p, f: sum(x[f][0] != "<" for x in t[p : p + width])
        windows = []
        for p in places(t, width):
            strong, sure = enough(literals(p, 0)), enough(min(literals(p, 0), literals(p, 1)))
            if strong:
                windows.append((p, 0, strong))
            if enough(literals(p, 1)) and any(x[0] != x[1] for x in t[p : p + width]):
                windows.append((p, 1, strong))
            if not sure or (p == 0 and t[0][2] in D.UNITS):
                windows.append((p, 2, strong))
        half = lambda n: min(D.LEAST_WINDOWS, -(-n // 2))
        need, need_all = half(len({p for p, _, strong in windows if strong})), half(len({p for p, _, _ in windows}))
        lines = {}
        for p, form, strong in windows:
            for q in places(doc, width):
                for own in (2,) if form == 2 else (0, 1):
                    if all(a[form] == b[own] for a, b in zip(t[p : p + width], doc[q : q + width], strict=True)):
                        names = {(a[2], b[2]) for a, b in zip(t[p : p + width], doc[q : q + width], strict=True) if form < 2 and a[form] == "<name>"}
                        named = form == 1 or (own == 1 and any(x[0] != x[1] for x in doc[q : q + width]))
                        for use in ("named",) if named else ("literal", "named"):
                            lines.setdefault((q - p, use), []).append((p, strong, names))
        held = set()
        for line in lines.values():
            pairs = set().union(*(n for _, _, n in line))
            mixed = {a for a, b in pairs if any(a == x and b != y for x, y in pairs)}
            held |= {(p, strong) for p, strong, names in line if not any(a in mixed for a, _ in names)}
        if (need and sum(s for _, s in held) >= need) or (need_all and len(held) >= need_all):
            found[item] = len(held)
    return found


def test_decontamination_by_brute_force(spark):
    import random

    from evigraph.llm.decontaminate import leaks

    draw = random.Random(8)
    names, units = ["Tom", "Sue", "Bob", "Ann", "Ida"], ["km", "kg", "miles", "%", "days"]
    plain = "the a of bakery sells loaf rolls well-known don't to school and then gave some apples over road before night came so how many does have left".split()

    def token():
        return draw.choice([*plain, *plain, draw.choice(names), str(draw.randint(1, 99)), f"{draw.randint(1, 9)} {draw.choice(units)}", draw.choice(["apples.", "left?", "so,", '"of']), "3.5"])

    def changed(text):
        swap = dict(zip(names, draw.sample(names, len(names)), strict=True))
        words = [swap.get(w, str(draw.randint(1, 99)) if w.isdecimal() else draw.choice(units) if w in units and draw.random() < 0.5 else w) for w in text.split()]
        if draw.random() < 0.3:
            words[draw.randrange(len(words))] = draw.choice(plain)
        return " ".join(words)

    items = {i: " ".join(token() for _ in range(draw.choice((1, 2, 4, 7, 8, 12, 20, 26)))) for i in range(50)}
    items |= {50: "12 30 45", 51: "∑ ≠", 52: "Yes", 53: "What is 12 plus 5?", 54: "Solve 3 x 4 = 12 now", 55: "Anna Bea Carl", 56: "km to go", 57: "12 and 5 or 7", 58: "ΟΔΟΣ is 5 km", 59: "3.5"}
    docs = {}
    for i in range(160):
        held = draw.choice(list(items.values()))
        docs[i] = " ".join([*(token() for _ in range(draw.randint(0, 30))), draw.choice((held, changed(held), "")), *(token() for _ in range(draw.randint(0, 30)))])
    docs |= {200: "and Solve 3 x 4 = 12 now and more", 201: "Question: What is 12 plus 5? Answer: 17", 202: "see οδος is 7 miles", 203: "", 204: None}
    got = {}
    for r in leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.n_windows
    want = {i: h for i, t in docs.items() if (h := held_items(t or "", items))}
    assert {i: {k: n for k, n in h.items() if k != 51} for i, h in got.items()} == want
    assert 54 in got[200] and 53 in got[201]


def test_url_filter_by_brute_force(spark):
    import random

    from evigraph.llm.url_filter import url_filter

    draw = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "ab.com", "net", "x.net", "y.x.net", "z"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r", "/q", "/é", "/p/qq"]
    rules = [(draw.choice(hosts), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(40)]
    urls = [(draw.randrange(90), f"x://{draw.choice(['', 'w.', 'v.w.'])}{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', 'z', '/q', '?a', '#b'])}") for _ in range(400)]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter(spark.createDataFrame(urls, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = []
    for i, url in urls:
        rest = url[4:].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        path = slash + path
        fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((i, host, path, best[3] if best else "", best[2] if best else "allow"))
    assert got == sorted(want)
