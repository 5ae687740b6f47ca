import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from seqdrift.llm import packing
from seqdrift.llm.queries import tokenizer_path
from seqdrift.llm.words import slices

PARTS = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\u0085", ",", "'s", "don't", "9", "12,5", "é", "…", "<|endoftext|>", "日本", "\r\n", "!?", "word", " The", "#*"]


def strange(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(n)]


def test_ids_equal_those_of_the_tokenizer():
    texts = strange(4000)
    plain = Tokenizer.from_file(tokenizer_path())
    encoder, got = packing.Encoder(tokenizer_path()), []
    for part in slices(pa.array(texts), 1 << 12):
        ids, counts = encoder.encode(part)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_whole_gapless_and_exact(spark, table):
    draw = random.Random(2)
    texts = {i: " ".join(draw.choices(["alpha", "beta", "gamma.", "delta"], k=draw.choice([3, 40, 700, 5000]))) for i in range(150)}
    texts[150] = None
    rows = packing.pack(table(list(texts.items()), 5), tokenizer_path(), with_ids=True).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in texts.items():
        own = sorted(docs[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
    lost = 0
    for own in sequences.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= 1024
        lost += packing.padding(total, 1024)
    assert lost < 0.03 * sum(r.length for r in rows)


def best(lengths, capacity):
    """Least padding of a window that holds the longest length, over all subsets."""
    longest, *rest = sorted(lengths, reverse=True)
    sums = {longest}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= capacity}
    return min(packing.padding(s, capacity) for s in sums)


def test_each_window_has_the_least_padding():
    draw = random.Random(3)
    for _ in range(200):
        lengths = [draw.randint(1, 99) for _ in range(draw.randint(1, 12))]
        remaining = {x: lengths.count(x) for x in set(lengths)}
        chosen = packing.choose(remaining, 100)
        assert all(n <= remaining[k] for k, n in chosen.items()) and sum(k * n for k, n in chosen.items()) <= 100
        assert packing.padding(sum(k * n for k, n in chosen.items()), 100) == best(lengths, 100)


def test_a_plan_is_short_whatever_the_counts():
    rows = list(packing.plan({k: 10**9 + k for k in range(1, 1024)}, 1024))
    assert len(rows) < 20_000
    placed = defaultdict(int)
    for length, low, high, *_ in rows:
        assert low == placed[length]
        placed[length] = high
    assert placed == {k: 10**9 + k for k in range(1, 1024)}
