"""Secret scan from texts to spans, against regular expressions and a comparison of all pairs of spans."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from evigraph.llm.secrets import BASE, NEEDS, ORDER, ROLES, WEAK, listed, secret_scan

SCOPE = 60


def plain_spans(text):
    """All spans that are reported for a text, listed."""
    text = text or ""
    spans = [(m.start(), ORDER.index(k), m.end(), k) for k, p, g, n in BASE for m in re.finditer(p, text) if len(m[g]) >= n]
    strong = list(spans)
    found = [(m.start(), ORDER.index(k), m.end(), k) for k, p, _ in WEAK for m in re.finditer(p, text)]
    if any(s[3] == "access" for s in strong) or re.search(WEAK[0][1], text):
        weak = [w for w in found if not any(s[0] < w[2] and s[2] > w[0] for s in strong)]
        for w in weak:
            near = {ROLES[o[3]] for o in strong + weak if o[0] <= w[2] + SCOPE and o[2] >= w[0] - SCOPE}
            if set(NEEDS[ROLES[w[3]]]) <= near - {ROLES[w[3]]}:
                spans.append(w)
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def made(draw):
    pieces = ["password=abcdef1", "user=bob9", "http://h.example/a", "AKIA" + "A1" * 10, "deadbeef" * 3, "tok3nAbcdefghijklmnop12345", "plain words é 🙂 here", "login: secret_token=Zz9.Zz9", "10.0.0.1:80", "\n" * 20, "x" * 50]
    return " ".join(draw.choice(pieces) for _ in range(draw.randrange(14)))


def test_spans_are_those_of_all_pairs_whatever_the_ids(spark):
    draw = random.Random(6)
    texts = [made(draw) for _ in range(120)] + [None, ""]
    ids = [draw.choice([None, 1, 2, i]) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, n, "c") for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, cell long, Base string").repartition(3)
    got = sorted((str(r.doc_id), r.spans) for r in secret_scan(docs, scope=SCOPE).select("doc_id", listed(F.concat("base", "added")).alias("spans")).collect())
    assert got == sorted((str(i), plain_spans(t)) for i, t in zip(ids, texts, strict=True))
    assert any("endpoint" in s for i, s in got if i == "None")


def test_a_text_with_fifty_thousand_spans(spark):
    n = 16_000
    text = "".join(f"password=abc{i}def user=bob{i} http://h{i}.example/a\n" for i in range(n))
    r = secret_scan(spark.createDataFrame([(None, text)], "doc_id long, text string")).select(F.size("base").alias("base"), F.size("added").alias("added")).first()
    assert (r.base, r.added) == (n, 2 * n)
