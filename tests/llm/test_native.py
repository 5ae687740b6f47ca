"""Shards and quality rules: invariants, and plans without Python."""

import zlib
from collections import Counter

from seqdrift.llm import quality, sharding


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shards_are_even_gapless_and_alike_in_mixture(table):
    rows = [(i, None if i % 50 == 0 else f"text é {i % 7}", "en", "hot" if i % 3 else f"s{i % 11}") for i in range(5003)]
    out = sharding.interleave(table(rows, 5), shards=16)
    assert not any(x in plan(out) for x in ("Python", "Arrow", "Pandas"))
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    texts = {i: t for i, t, *_ in rows}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    total = Counter(r.source for r in got)
    for s in range(16):
        own = Counter(r.source for r in got if r.shard == s)
        assert all(abs(own[k] - n / 16) <= 2 for k, n in total.items())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(table(rows, 2), shards=16).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_repeated_words_and_lines(table):
    docs = table([(1, "a b c d a b c"), (2, "a a a a"), (3, "x y\nz\n \nz\nx y\nz"), (4, "a b c")])
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) for r in quality.measures(docs).collect()}
    assert got == {1: (7, 6, 0, 7), 2: (4, 4, 0, 4), 3: (7, 6, 3, 7), 4: (3, 0, 0, 3)}
    assert not any(x in plan(quality.measures(docs)) for x in ("Python", "Arrow", "Pandas"))


def test_ablation_equals_evaluating_again(spark, table):
    draw = [("word%d " % (i % (k + 2))) * (i % 90) + "#" * (i % 40) for i in range(120) for k in (0, 60)]
    ledger = quality.ledger(table(list(enumerate(draw))))
    bits = [r.fail_bits for r in ledger.collect()]
    for version, mask in quality.POLICIES.items():
        rows = {r.rule: r for r in quality.ablation(ledger, version).collect()}
        for i, (name, _) in enumerate(quality.RULES):
            if mask >> i & 1:
                bit = 1 << i
                assert rows[name].n_fail == sum(b & bit != 0 for b in bits)
                assert rows[name].n_only == sum(b & mask == bit for b in bits)
                assert rows[name].n_kept == sum(b & mask == 0 for b in bits)
                assert rows[name].n_kept_without == sum(b & (mask & ~bit) == 0 for b in bits)
