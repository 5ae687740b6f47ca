"""Periodic runs against plain comparisons of all periods, extensions against word by word, and the worked-in periods."""

import hashlib
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqdrift.llm import runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 23, 24, 25, 60, 400):
        for letters in (1, 2, 3, 50):
            yield rng.integers(0, letters, n)
    for n, p in ((24, 8), (24, 1), (25, 8), (90, 30), (89, 30), (300, 13), (333, 26), (200, 7)):
        core = np.resize(rng.integers(0, 4, p), n)
        yield core
        yield np.concatenate([rng.integers(0, 4, 31), core, rng.integers(0, 4, 17)])
        yield np.concatenate([core, [9], core, np.resize(core, 70)])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    yield np.array(fib[-1])


def test_equal_plain_runs():
    hits = 0
    for ids in texts():
        got = [tuple(r) for r in runs.runs_of(np.asarray(ids, np.int64)).tolist()]
        assert got == plain_runs(list(ids))
        hits += len(got)
    assert hits > 50


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_equal_plain_runs_of_composed_texts(head, parts):
    ids = np.array(head + [x for p, k in parts for x in p * k], np.int64)
    assert [tuple(r) for r in runs.runs_of(ids).tolist()] == plain_runs(ids.tolist())


def test_extensions_word_by_word():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 2, 500), np.resize(rng.integers(0, 3, 40), 700), np.zeros(300, np.int64)):
        e = runs.Extensions(ids)
        i, j = rng.integers(0, len(ids) + 1, (2, 4000))
        i, j = i[i != j], j[i != j]
        got = e.of(i, j)
        for a, b, length in zip(i, j, got):
            k = 0
            while max(a, b) + k < len(ids) and ids[a + k] == ids[b + k]:
                k += 1
            assert k == length


def test_grid_in_steps(monkeypatch):
    ids = np.resize(np.arange(50), 1000)
    want = runs.runs_of(ids).tolist()
    monkeypatch.setattr(runs, "GRID", 64)
    assert runs.runs_of(ids).tolist() == want == [[0, 1000, 50]]


def test_long_texts_take_little_longer():
    start = time.perf_counter()
    assert len(runs.runs_of(np.zeros(100_000, np.int64))) == 1
    fresh = runs.runs_of(np.random.default_rng(1).integers(0, 5000, 300_000))
    assert len(fresh) == 0 and time.perf_counter() - start < 20


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_documents_equal_plain_rows(spark, table, odd_rows):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 300)))) for i in range(150)]
    rows += [(1000 + i, "é ü\n日本\v" * (5 + i)) for i in range(20)]
    short = [r for r in odd_rows if r[1] is None or len(r[1]) < 100_000]
    df = table(rows + short)
    for extra in ("runs", "n_words", "strongest", "collapsed", "start", "n_runs"):
        df = df.withColumn(extra, F.lit("clash"))
    out = runs.digests(runs.find_runs(runs.implanted(df)))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((plain_row(*r) for r in rows + short), key=repr)
    assert sum(r[1] for r in got) > 20


def test_very_long_and_empty(spark, table, odd_rows):
    long = [r for r in odd_rows if r[1] is not None and len(r[1]) > 100_000]
    assert len(runs.find_runs(table(long)).collect()) == 2
    assert runs.digests(runs.find_runs(runs.implanted(table([])))).collect() == []
