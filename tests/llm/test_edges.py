"""Every operator on nulls, empty and long texts, repeated rows, ties, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm.decontaminate import drop_leaking, leaks
from evigraph.llm.line_dedup import line_marks, remove_lines
from evigraph.llm.minhash import keep_one, near_duplicates
from evigraph.llm.packing import pack, tokenizer_path
from evigraph.llm.quality_rules import keep_good, quality_rules
from evigraph.llm.rule_ensemble import quality_scores
from evigraph.llm.secrets import secret_scan
from evigraph.llm.substring_dedup import NO_ID, Settings, dealt, substring_dedup
from evigraph.llm.url_filter import url_filter
from evigraph.llm.warc import read_warc, write_warc

CLASH = ("id", "block", "n", "key", "bucket", "label", "host", "path", "words", "bands", "kept", "line", "line_no", "hash", "c", "t", "_text", "_id", "base", "weak", "salt", "labels", "size", "removed", "digest", "payload", "own", "node", "code", "text_hash", "counted", "_lang", "_source", "_removed", "_all", "salt", "evigraph_0")
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, PASSAGE), (4, PASSAGE), (5, PASSAGE), (6, PASSAGE + " tail"), (7, "a"), (8, "\n".join(["same line of eight words is right here"] * 3)),
    (9, " ".join(f"long{i % 977}" for i in range(60_000))), (10, "é" * 30 + "\x85b\xa0c\u2028d 🙂 \x1f e"), (None, "no id"),
]


def frame(spark, rows, ids=True):
    df = spark.createDataFrame([r for r in rows if ids or r[0] is not None], "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_quality_rules(spark, docs):
    got = by_id(quality_rules(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].n_words == got[2][0].n_words == got[3][0].n_words == 0 and not got[1][0].kept
    assert got[4][0] == got[4][1] and got[4][0].n_words == 60
    assert got[10][0].n_words == 4 and got[8][0].n_dup_lines == 2 and got[8][0].n_repeat_words == 24
    assert quality_rules(frame(spark, [])).collect() == []
    assert keep_good(docs).columns == docs.columns


def test_secret_scan(spark, docs):
    tricky = [(1, "user=bob AKIA" + "A" * 16 + " x9" + "Zq8" * 8 + " http://h/p far"), (2, "password: token: abcdefgh"), (3, "🙂 TOKEN='abcdef'")]
    got = by_id(secret_scan(frame(spark, tricky)))
    assert [s.kind for s in got[1][0].base] == ["access"] and {s.kind for s in got[1][0].added} == {"account", "opaque", "endpoint"}
    assert got[2][0].base == [] and [(s.start, s.end) for s in got[3][0].base] == [(2, 15)]
    assert sum(map(len, by_id(secret_scan(docs)).values())) == len(TEXTS)
    assert secret_scan(frame(spark, [])).collect() == []
    many = secret_scan(frame(spark, [(1, "é password=abcdef1 " * 1_000)])).first().base
    assert [(s.start, s.end) for s in many if s.kind == "assign"] == [(2 + 19 * i, 18 + 19 * i) for i in range(1_000)]


def test_rule_ensemble(spark, docs):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (99, 0), (4, 0)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(frame(spark, []), labels).collect() == []


def test_line_dedup(spark, docs):
    got = by_id(line_marks(docs, "doc_id"))
    assert got[1][0].n_lines == got[2][0].n_lines == got[3][0].n_lines == 0
    assert got[8][0].removed == [1, 2] and got[4][0].removed == [] and got[5][0].removed == [0] and len(got[4]) == 1 and got[None][0].n_lines == 1
    assert (got[5][0].n_links, got[6][0].n_links, got[8][0].n_links) == (0, 1, 0)
    left = remove_lines(docs, line_marks(docs))
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[8] == "same line of eight words is right here" and 5 not in texts and 6 not in texts and texts[1] is None and texts[2] == "" and texts[None] == "no id"
    assert left.count() == len(TEXTS) - 2
    assert line_marks(frame(spark, [])).collect() == [] and remove_lines(frame(spark, []), line_marks(frame(spark, []))).collect() == []


#: Rows without an id, rows that repeat an id with other texts, and rows that repeat id and text.
ODD = [(None, "first of all\nshared line"), (None, "second of all"), (None, None), (1, "shared line\nown line of one"), (1, "other text\nshared line"), (1, "other text\nshared line"), (2, "own line of one\nlast")]


def test_rows_without_an_id_or_with_repeated_ones(spark):
    rows = frame(spark, ODD)
    left = [(str(r.doc_id), r.text) for r in remove_lines(rows, line_marks(rows)).collect()]
    kept = [("1", "other text"), ("1", "other text"), ("1", "own line of one"), ("2", "last"), ("None", None), ("None", "first of all\nshared line"), ("None", "second of all")]
    assert sorted(map(str, left)) == sorted(map(str, kept))
    classes = near_duplicates(rows).collect()
    assert len(classes) == len(ODD) and sum(r.doc_id is None and r.class_id is None for r in classes) == 3
    texts = [(str(r.doc_id), r.text) for r in keep_one(rows).collect()]
    assert sorted(map(str, texts)) == sorted(str((str(i), t)) for i, t in set(ODD))
    removed = {(r.doc_id, r.kept) for r in substring_dedup(rows).collect()}
    assert (None, "second of all") in removed and len(removed) == len(set(ODD))
    bench = spark.createDataFrame([(1, "second of all")], "item_id long, text string")
    assert drop_leaking(rows, bench).count() == len(ODD) - 1
    passage = frame(spark, [(None, PASSAGE), (None, PASSAGE), (-5, PASSAGE + " x"), (3, PASSAGE)])
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup(passage).collect()) == [("-5", 60), ("3", 60), ("None", 0), ("None", 0)]
    assert sorted(str(r.class_id) for r in near_duplicates(passage).collect()) == ["-5"] * 4


def test_pipeline_stages(spark):
    import corpus_pipeline
    from evigraph.llm.shared import materialise

    bench = spark.createDataFrame([(1, "a text that stands nowhere else here")], "item_id long, text string")
    long_ = "\n".join(" ".join(f"{chr(97 + k % 26)}{k}x{i}" for i in range(30)) for k in range(6))
    for rows in ([], [*TEXTS, *ODD, (11, long_), (None, long_.upper()), (12, long_ + "\nmore of it")]):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = drop_leaking(docs, bench) if name == "decontamination" else stage(spark, docs, None)
            assert docs.columns == before.columns, name
            docs = materialise(docs, "tested")
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        assert kept == ({(4, PASSAGE), (11, long_), (None, long_.upper()), (12, "more of it")} if rows else set()) or kept >= {(11, long_)}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, None)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicates(spark, docs):
    got = by_id(near_duplicates(docs))
    assert {i: r[0].class_id for i, r in got.items()} == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9, 10: 10}
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == sorted(map(str, [None, 1, 2, 3, 4, 7, 8, 9, 10])) and keep_one(docs).columns == docs.columns
    assert near_duplicates(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 40_000
    rows = [(1, None, None), (2, "http://a/\r\nX: y", ""), (3, "u", big), (4, "u", big), (4, "u", big), (5, "u", "x" * 999), (6, "u", "x" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit(2), "record": F.lit(3)})
    write_warc(pages, f"file://{tmp_path}/w")
    got = sorted((r.source_id, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in read_warc(spark, f"file://{tmp_path}/w").collect())
    size = len(big.encode())
    assert got == [("1", "response", None, 0, None), ("2", "response", None, 0, None), ("3", "revisit", "4", size, None), *[("4", "response", None, size, None)] * 2, ("5", "response", None, 999, None), ("6", "response", None, 999, None)]
    write_warc(pages.limit(0), f"file://{tmp_path}/e")
    (tmp_path / "e" / "none.warc").write_bytes(b"")
    assert read_warc(spark, f"file://{tmp_path}/e").collect() == []
    write_warc(spark.createDataFrame([(None, None, "x"), (None, "u", big)], pages.schema.simpleString().replace("struct<", "").replace(">", "").split(",id")[0].replace(":", " ")), f"file://{tmp_path}/n")
    assert sorted(r.payload_bytes for r in read_warc(spark, f"file://{tmp_path}/n").collect()) == [1, size]


def test_warc_that_is_damaged(spark, tmp_path):
    import gzip

    from evigraph.llm.warc import Settings, records_of

    def record(name, payload=b"hello"):
        return b"".join(p + b"\r\n\r\n" for p in records_of(name, "u", payload, hashlib.sha1(payload).hexdigest(), None, Settings()))

    good, nocolon = record("1"), record("2").replace(b"X-Payload-Length:", b"X-Payload-Length;")
    files = {
        "garbage.warc": b"no archive at all", "cut.warc": good + record("3")[:-9], "middle.warc": record("4") + record("5").replace(b"WARC-Type: ", b"WARC-Type ") + record("6"),
        "http.warc": nocolon, "length.warc": record("7").replace(b"Content-Length: ", b"Content-Length: x"), "chunk.warc": record("8").replace(b"5\r\nhello", b"z\r\nhello"),
        "part.warc.gz": gzip.compress(record("9")) + gzip.compress(record("10"))[:-12], "flip.warc.gz": gzip.compress(record("11")) + b"\x1f\x8bxxxxxxxxxxx", "empty.warc": b"", "digest.warc": record("12").replace(b"5\r\nhello", b"5\r\nhallo"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r.source_id for r in rows if r.error is None) == sorted(["1", "4", "6", "9", "11"])
    assert all(r.payload == b"hello" for r in rows if r.error is None)
    said = sorted(r.error.split(",")[0].split(":")[0] for r in rows if r.error)
    assert said == sorted(["no WARC record", "record is cut short", "header line without a colon", "HTTP header line without a colon", "record without a length", "invalid literal for int() with base 16", "gzip member is cut short", "gzip member is damaged", "wrong digest"])


def test_substring_dedup(spark):
    got = by_id(substring_dedup(frame(spark, TEXTS)))
    assert got[None][0].kept == "no id"
    assert got[1][0].n_words == 0 and got[1][0].kept == "" and got[4][0].n_removed == 0
    assert got[5][0].n_removed == 60 and got[6][0].kept == "tail" and got[9][0].n_removed == 0 and got[10][0].n_words == 4
    assert substring_dedup(frame(spark, [])).collect() == []


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "the a"), (1, PASSAGE)], "item_id long, text string").withColumns({c: F.lit(0) for c in ("id", "item", "width", "hash", "at", "need")})
    assert sorted({r.doc_id for r in leaks(docs, bench).collect()}) == [4, 5, 6]
    assert leaks(docs, bench.limit(0)).collect() == [] and leaks(frame(spark, []), bench).collect() == []
    assert drop_leaking(docs, bench).count() == len(TEXTS) - 4


def test_packing(spark, docs):
    got = pack(docs, tokenizer_path()).collect()
    assert {r.doc_id for r in got} == {t[0] for t in TEXTS}
    assert sum(r.doc_id == 4 for r in got) == 2 and [r.length for r in got if r.doc_id == 1] == [1]
    assert pack(frame(spark, []), tokenizer_path()).collect() == []


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "nohost"), (4, "http://A.Com?x"), (5, "x://sub.a.com/p/q#f"), (5, "x://sub.a.com/p/q#f"), (6, "x://ba.com/p"), (7, "x://a.com." + "/p" * 9000)], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "", "block"), ("sub.a.com", "/p", "allow"), ("a.com", "/p/q/long", "allow"), ("a.com", "", "allow")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filter(pages.withColumns({"host": F.lit(1), "key": F.lit(2), "bucket": F.lit(3)}), rules).collect())
    got = [g if g[2] is not None else (*g[:2], "", g[3]) for g in got]
    assert got == [(1, "", "", "allow"), (2, "", "", "allow"), (3, "", "", "allow"), (4, "a.com", "a.com", "block"), *[(5, "sub.a.com", "sub.a.com/p", "allow")] * 2, (6, "ba.com", "", "allow"), (7, "a.com.", "", "allow")]
    assert url_filter(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_many_rows_without_an_id_are_dealt_to_blocks(spark):
    """10,000 rows without an id and 2,000 that repeat one: no block holds them all, and what they share is decided as within one block."""
    passage = " ".join(f"p{i}" for i in range(15))
    rows = spark.range(13_000).selectExpr("CASE WHEN id < 10000 THEN NULL WHEN id < 12000 THEN 7 ELSE id END AS doc_id", f"concat('own', id, ' ', CASE WHEN id % 3 = 0 THEN '{passage}' ELSE concat_ws(' ', transform(sequence(1, 15), i -> concat('w', id, 'x', i))) END) AS text")
    blocks = dealt(rows.selectExpr(f"coalesce(doc_id, {NO_ID}) AS own", "text"), 50).groupBy("block").count().collect()
    assert len(blocks) == 50 and max(b["count"] for b in blocks) < 2 * 13_000 / 50
    got = substring_dedup(rows, settings=Settings(documents=300), digest_only=True)
    shown = got.selectExpr("coalesce(doc_id, -1) AS id", "n_removed").groupBy("id", "n_removed").count().collect()
    first = {(r.id, r.n_removed): r["count"] for r in shown if r.id < 8}
    # a passage goes where a smaller id has it; rows without an id come first and keep theirs
    repeated = sum(i % 3 == 0 for i in range(10_000, 12_000))
    assert first == {(-1, 0): 10_000, (7, 15): repeated, (7, 0): 2_000 - repeated}
    assert {r.n_removed for r in shown if r.id % 3 == 0 and r.id > 7} == {15}


def test_words_that_begin_sentences_are_judged_one_by_one(spark):
    from evigraph.llm import decontaminate as D

    texts = ["The cat sat. The dog ran and Tom saw it. Then nothing moved at all", "no capitals in these ten words that follow each other", "", "Short One."]
    docs = D.with_template(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text").withColumn("text_hash", F.col("id"))
    hashed = D._hashed(D.materialise(docs.select("id", "text_hash", "t"), "test-templates"), [4], [])
    words = {r.id: [(x.c, x.d) for x in r.t] for r in docs.collect()}
    around = {(i, at + 1) for i, w in words.items() for at in range(len(w) - 3) if any(c != d for c, d in w[at : at + 4])}
    found = [(r.id, r["at"]) for r in hashed.where(F.col("form") == D.NAMED).collect()]
    assert len(found) == len(set(found)) and set(found) == around and len(around) > 5
    # no field of the template is taken out of a text again for each of its words
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert ".d AS d" in plan and not re.search(r"\bt#\d+\.\w+\[", plan)


def test_anchors_are_left_out_where_automata_need_none(monkeypatch):
    from evigraph.llm import substring_dedup as S

    taken = []
    monkeypatch.setattr(S, "window_hashes", lambda hashes, width, seed, plain=S.window_hashes: (taken.append(width), plain(hashes, width, seed))[1])
    words = [f"w{i}" for i in range(300)]
    docs = pa.table({"id": [1, 2], "own": pa.array([1, 2], pa.int64()), "text": [" ".join(words[:200]), " ".join(words[150:])]})
    windows = S.Block(docs, S.Settings()).window_keys()[0][150:188]
    taken.clear()
    out = S._kept(S.Settings(), False)(None, docs, pa.table({"h1": windows, "first": np.full(len(windows), 1)}))
    assert out.column("kept").to_pylist() == [" ".join(words[:200]), " ".join(words[200:])] and out.column("n_removed").to_pylist() == [0, 50]
    assert set(taken) == {S.Settings().width}
    coded = S._letters(S.Block(docs, S.Settings()))
    assert len({c[i : i + 2] for c in coded for i in range(0, len(c), 2)}) == 300 and coded[0][300:] == coded[1][:100]


def test_words_that_no_window_holds_share_their_characters():
    """Words are told apart by themselves where a window stands, and need no characters of their own elsewhere."""
    from evigraph.llm import substring_dedup as S

    words = [f"w{i}" for i in range(300)]
    docs = pa.table({"id": [1, 2], "own": pa.array([1, 2], pa.int64()), "text": [" ".join(words), " ".join(f"x{i}" for i in range(90)) + " " + " ".join(words[100:114])]})
    block = S.Block(docs, S.Settings())
    coded = [[c[i : i + 2] for i in range(0, len(c), 2)] for c in S._letters(block, np.array([100, 101]))]
    assert [len(c) for c in coded] == [300, 104] and len(set(coded[0])) == 15 and len(set(coded[1][:90])) == 1
    assert coded[0][100:114] == coded[1][90:] and coded[1][0] == coded[0][0] not in coded[1][90:]
    keys = block.window_keys()[0][100:102]
    assert [d is None or np.flatnonzero(d).tolist() for d in S.locate(block, keys, np.array([1, 1]))] == [True, list(range(90, 104))]
