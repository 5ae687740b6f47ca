import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqdrift.llm import decontaminate, suffixes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def plain_contamination(docs, items, k=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - k + 1, 1) if w else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    sizes, out = {len(x) for x in windows}, {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_of
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_contamination_equals_the_plain_version(spark, table, block_chars):
    draw = random.Random(1)
    vocabulary = [f"v{i}" for i in range(60)] + ["é", "日本", "A1"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 4, 12, 30])))) for i in range(12)]
    docs = []
    for i in range(120):
        own = draw.choices(vocabulary, k=draw.randint(0, 60))
        if draw.random() < 0.4:
            source = draw.choice(items)[1].split()
            a = draw.randrange(len(source) + 1)
            own[draw.randrange(len(own) + 1) :] = [*source[a:], *draw.choices(vocabulary, k=3)]
        docs.append((i, draw.choice([" ", "-", ", "]).join(own).upper()))
    docs.append((999, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(table(docs, 3), bench, block_chars=block_chars).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == plain_contamination(docs, items)
    texts = dict(docs)
    for r in rows:
        for s in r.spans:
            assert words(texts[r.doc_id][s.start : s.end]) == words(texts[r.doc_id])[s.first : s.last]
    kept = {r.doc_id for r in decontaminate.clean(table(docs, 3), bench, block_chars=block_chars).collect()}
    assert kept == {i for i, g in got.items() if not g[4]}


def test_index_against_plain_search():
    draw = np.random.default_rng(1)
    symbols = np.append(draw.integers(1, 5, 700), 0)
    index = decontaminate.Index(symbols, 5)
    for n in (1, 2, 5, 9):
        patterns = draw.integers(2, 5, (40, n))
        which, low, high = index.search(patterns)
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
        want = {i: [j for j in range(len(symbols) - n + 1) if (symbols[j : j + n] == p).all()] for i, p in enumerate(patterns)}
        assert got == {i: w for i, w in want.items() if w}


def test_suffix_array_of_repeats():
    symbols = np.array([2, 3] * 50 + [1] + [2, 3] * 50 + [0])
    assert suffixes is not None and decontaminate.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def plain_passages(docs, length):
    split = {i: (t or "").encode().lower().split() for i, t in docs}
    where = defaultdict(set)
    for i, w in split.items():
        for a in range(len(w) - length + 1):
            where[tuple(w[a : a + length])].add((i, a))
    covered = defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                covered[i] |= set(range(a, a + length))
    out = set()
    for i, own in covered.items():
        for p in sorted(own):
            if p - 1 not in own:
                start = p
            if p + 1 not in own:
                out.add((i, start, p + 1, p + 1 - start))
    return out


@pytest.mark.parametrize("alphabet", [5000, 6])
def test_passages_equal_the_plain_version(table, alphabet):
    draw = random.Random(4)
    passages = [[f"p{draw.randrange(alphabet)}" for _ in range(draw.choice([20, 30, 45, 90]))] for _ in range(6)]
    docs = []
    for i in range(60):
        own = [f"q{draw.randrange(alphabet)}" for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            a, b = sorted(draw.choices(range(len(p) + 1), k=2))
            own += [*p[a:b], *[f"q{draw.randrange(alphabet)}" for _ in range(draw.randrange(12))]]
        docs.append((i, " ".join(own)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None)]
    got = {tuple(r) for r in suffixes.repeated_passages(table(docs, 3), length=20).collect()}
    assert got == plain_passages(docs, 20) and got


def test_many_equal_items_cost_as_one_and_spans_are_linear():
    """Ten thousand items "yes" on a text of 200 KB, and 80,000 spans in one text."""
    text = "yes no maybe " * 16_000
    windows = decontaminate.windows_of([(str(i), "yes") for i in range(10_000)] + [("x", "maybe yes")], 10)
    assert [len(g[0]) for g in windows.groups] == [1, 1] and len(windows.items[0]) == 10_000
    start = time.perf_counter()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_key": [1], "text": [text]})
    (out,) = decontaminate._scan(windows)(iter([batch]))
    row = out.to_pylist()[0]
    assert len(row["item_ids"]) == 10_001 and row["spans"][0] == {"first": 0, "last": 1, "start": 0, "end": 3}
    many = "é yes " * 80_000
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_key": [1], "text": [many]})
    (out,) = decontaminate._scan(decontaminate.windows_of([("a", "yes")], 10))(iter([batch]))
    spans = out.to_pylist()[0]["spans"]
    assert len(spans) == 80_000 and spans[-1] == {"first": 159_999, "last": 160_000, "start": 6 * 79_999 + 2, "end": 6 * 79_999 + 5}
    assert time.perf_counter() - start < 20
