"""Periodic runs against a plain scan of all lags."""

from __future__ import annotations

import random

import numpy as np

from evigraph.llm.periodic_runs import lag_counts, numbers, periodic_runs, run_digests, runs_of


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(draw):
    letters, words = draw.choice([1, 2, 3, 5, 40]), []
    while len(words) < draw.choice([0, 5, 30, 150]):
        block = [draw.randrange(letters) for _ in range(draw.choice([1, 2, 3, 7, 12, 20]))]
        words += block * draw.choice([1, 1, 3, 4, 5, 6]) + block[: draw.randrange(len(block) + 1)]
    return words


def test_runs_are_those_of_a_scan_of_all_lags():
    draw = random.Random(1)
    for _ in range(800):
        words = made(draw)
        assert runs_of(numbers(words)) == plain_runs(words), words


def test_lag_counts_are_exact_for_frequent_and_rare_words():
    draw = random.Random(2)
    words = [draw.choice(["the", "of", f"w{draw.randrange(300)}"]) for _ in range(3000)]
    ids = numbers(words)
    assert lag_counts(ids, 750)[1:].tolist() == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 751)]


def test_a_very_long_text_of_two_words_is_done_in_seconds():
    ids = np.random.default_rng(0).integers(0, 2, 60_000)
    ids[20_000:50_000] = np.tile(ids[20_000:22_500], 12)
    assert (20_000, 30_000, 2_500) in [(s, length, q) for s, length, q in runs_of(ids) if q == 2_500] or any(q == 2_500 and s <= 20_000 and s + length >= 50_000 for s, length, q in runs_of(ids))


def test_edges(spark):
    rows = [(1, None, "x"), (None, "a b " * 8, "y"), (2, "", "z"), (2, "a " * 9, "z"), (2, "a " * 9, "z"), (3, " x  x  x  x  x  x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = sorted(([r.doc_id, r.start, r.length, r.period] for r in periodic_runs(docs).collect()), key=str)
    assert got == sorted([[None, 0, 16, 2], [2, 0, 9, 1], [2, 0, 9, 1], [3, 0, 6, 1]], key=str)
    digests = run_digests(docs).collect()
    assert len(digests) == 6 and sum(r.n_runs == 0 and r.start is None and r.exponent_milli is None for r in digests) == 2
    assert run_digests(docs.limit(0)).collect() == [] == periodic_runs(docs.where("false")).collect()
