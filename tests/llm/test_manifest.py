"""The Merkle manifest against a plain tree, over groups of one row up to several blocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from seqdrift.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_tree(nodes):
    """All levels of the tree over some digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = at // 3 * 3
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return path


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = plain_tree([x[2] for x in sources[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sources[s]):
            path = plain_path(trees[s], at) + plain_path(top, k)
            fold, text = leaf, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                fold = plain_leaf(r, None if text is None else text.replace("\n", ""))
            for left, right in path:
                fold = sha(left, fold, right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf, trees[s][-1][0], root, sha(*[x + y for x, y in path]), fold, fold == root))
    return sorted(out, key=repr)


def rows_of(df):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r[c] for c in cols) for r in manifest.verified(manifest.manifest(df)).collect()], key=repr)


def test_equals_a_plain_tree(spark, table):
    rows = [(i * 7 % 5003, f"text {i}\nline\n" if i % 3 else None if i % 2 else "", "en" if i % 4 else None, "hot") for i in range(2300)]
    rows += [(i, "ü\n日本" * (i % 5), None, s) for i in range(40) for s in ("", None, "Z", "a", "é", "￿", "😀") if i < 29 or s == "a"]
    rows += [(1, "alone", "de", "single"), (None, "no\nid", None, "single"), (None, None, None, None), (5, "twice", "en", "hot"), (5, "twice", "en", "hot")]
    df = table(rows, 5)
    want = plain([r.asDict() for r in df.collect()])
    got = rows_of(df)
    assert got == want
    assert 0 < sum(r[-1] for r in got) < len(got)
    assert rows_of(df.repartition(3)) == want


@pytest.mark.parametrize("n", [1, 4, manifest.BLOCK, manifest.BLOCK + 1])
def test_one_source_of_any_size(spark, table, n):
    df = table([(i, f"{i}\n", None, "s") for i in range(n)])
    assert rows_of(df) == plain([r.asDict() for r in df.collect()])


def test_three_passes(spark, table, monkeypatch):
    monkeypatch.setattr(manifest, "DEPTH", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    df = table([(i, f"{i}\n", None, "s" if i % 10 else "t") for i in range(800)] + [(i, "x", None, f"s{i}") for i in range(30)])
    assert rows_of(df) == plain([r.asDict() for r in df.collect()])


def test_odd_and_empty_tables(spark, table, odd_rows):
    df = table(odd_rows)
    for extra in ("g", "n", "pos", "path", "digest", "levels", "items", "_tie", "leaf"):
        df = df.withColumn(extra, F.lit("clash"))
    assert rows_of(df) == plain([{c: r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")} for r in df.collect()])
    assert rows_of(table([])) == []
