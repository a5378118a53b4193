"""The language model: unigram sums restated, probabilities that add up to one, held-out gain, edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from evigraph.llm.language_model import END, Lexicon, Model, Settings, language_model_scores, op12_language_model
from evigraph.llm.shared import table

SMALL = Settings(width=4, rows=64, listed=20, batch=32, block=16)


def restated(rows, mod=7):
    """(held_out, n_tokens, n_known, N, base score) of each row (id, text), without Spark."""
    words = [(text or "").encode().lower().split() + [b""] for _, text in rows]
    held = [key is not None and zlib.crc32(str(key).encode()) % mod == 2 for key, _ in rows]
    counts = Counter(w for own, out in zip(words, held, strict=True) if not out for w in own)
    total, distinct = sum(counts.values()), len(counts)
    score = lambda own: math.fsum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
    return [(out, len(own), sum(w in counts for w in own), total, score(own)) for own, out in zip(words, held, strict=True)]


def test_base_columns_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op12_language_model(spark, sf).collect()}
    assert len(got) == len(docs)
    for (key, _), (held, n, known, total, base) in zip(docs, restated(docs), strict=True):
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.98 * sum(r.base_score for r in out)
    assert sum(r.score > r.base_score for r in out) > 0.9 * len(out)


def test_unlisted_words_are_joined_and_edges_hold(spark):
    rows = [(i, f"the w{i} cat w{i % 3} sat W{i % 5} \x1f é" * (i % 4)) for i in range(60)]
    rows += [(None, "the lost cat"), (5, "twice THE"), (5, "twice THE"), (6, None), (7, ""), (8, "long " + "y" * 200)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, Word string").repartition(5)
    got = sorted(([str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] for r in language_model_scores(docs, settings=SMALL).collect()), key=str)
    assert got == sorted(([str(key), held, n, known, total, round(base, 6)] for (key, _), (held, n, known, total, base) in zip(rows, restated(rows), strict=True)), key=str)
    assert language_model_scores(docs.limit(0), settings=SMALL).collect() == []
    alone = language_model_scores(docs.where("doc_id IN (%s)" % ",".join(str(i) for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)), settings=SMALL).collect()
    assert alone and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 == r.score for r in alone)


def test_probabilities_add_up_to_one_after_training():
    words = [(END, 30)] + [(f"w{i}".encode(), 40 - i) for i in range(15)]
    lexicon = Lexicon(words, 900, 40, 12)
    model = Model(SMALL, lexicon)
    draw = np.random.default_rng(4)
    ids = np.where(draw.random(4000) < 0.5, np.arange(4000) % 5, draw.integers(0, 13, 4000))
    before = model.go_over(ids, np.arange(4000)).mean()
    for _ in range(3):
        model.go_over(ids, np.arange(4000), learn=True)
    assert model.go_over(ids, np.arange(4000)).mean() > before
    for history in ([], [3], [1, 2, 3], [0, 0, 12]):
        total = 0.0
        for word in range(13):
            text = np.array([*history, word])
            total += math.exp(model.go_over(text, np.arange(len(text)))[-1])
        assert total == pytest.approx(1, abs=1e-4)
    # within the open class: its known words and one unknown word
    inside = sum((c + 1) / (lexicon.open_total + lexicon.open_distinct + 1) for c in [lexicon.open_total - lexicon.open_distinct + 1] + [1] * (lexicon.open_distinct - 1)) + 1 / (lexicon.open_total + lexicon.open_distinct + 1)
    assert inside == pytest.approx(1)


def test_contexts_stop_at_the_beginning_of_a_text():
    model = Model(SMALL, Lexicon([(END, 3), (b"a", 2)], 5, 2, 12))
    one, two = np.array([1, 2, 2]), np.array([2, 1, 2])
    both = model.go_over(np.concatenate([one, two]), np.array([0, 1, 2, 0, 1, 2]))
    assert np.allclose(both[3:], model.go_over(two, np.arange(3)))
    a = model.contexts(np.array([1, 2, 2, 2, 1, 2], dtype=np.uint64), np.array([0, 1, 2, 0, 1, 2]))
    assert (a[:, 3:] == model.contexts(two.astype(np.uint64), np.arange(3))).all()
